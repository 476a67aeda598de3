"""Near duplicates by bottom-k sketches of one hash function.

1. A document's set is its distinct word shingles, hashed once. Its sketch is the k smallest hashes.
   Documents with equal sets form a class; only classes go on, so copies cost nothing further.
2. Inverted lists of retained values: a class enters the lists of the first of its retained values,
   in an order that puts values of crowded hash buckets last (a table of fixed size counts them).
   Two sets just as similar as wanted share none of those with a probability of 2e-10 at most.
3. Lists with the same members are one. A list of over `BLOCK` members is dealt out as pairs of blocks.
4. In each list, pairs that the lengths or the sketch of the union rule out (wrongly with a
   probability of 1e-9 at most) are dropped; the rest is verified on full sets. Only links that join two groups of the
   list are passed on, at most one for each member.
5. Connected components of the links, with the smallest doc_id of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pliego.llm import words as W
from pliego.llm.common import components, cut, written
from pliego.llm.tables import fixed_table, narrowed

SKETCH, BLOCK, TABLE_BITS = 64, 1024, 16
#: At most this share of the pairs just at the wanted similarity fails the sketch test; and shares no list.
UNLIKE, MISSED = 1e-9, 2e-10


@cache
def shared(percent: int) -> float:
    """Share of the sketch that sets with this similarity have in common (fewer with a probability of UNLIKE at most)."""
    below, t = 0.0, percent / 100
    for n in range(SKETCH + 1):
        below += math.comb(SKETCH, n) * t**n * (1 - t) ** (SKETCH - n)
        if below > UNLIKE:
            return n / SKETCH
    return 1.0


@cache
def listed_values(percent: int, hot: int) -> int:
    """How many values of a sketch are listed if `hot` of them are crowded: enough that similar sets meet but for MISSED.

    At worst all crowded values, which come last, are shared. Then the first n others are all unshared with a probability
    of (1 - t)^n * C(SKETCH, n) / C(SKETCH - hot, n) at most. So many that two sets must meet are enough in any case.
    """
    most = SKETCH - math.ceil(shared(percent) * SKETCH) + 1
    for n in range(1, min(most, SKETCH - hot) + 1):
        if (1 - percent / 100) ** n * math.comb(SKETCH, n) <= MISSED * math.comb(SKETCH - hot, n):
            return n
    return most


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes, sorted within rows, and the rows' n + 1 places among them.

    A-Z count as a-z. A text with fewer words than `width` has one shingle of all its words; a text without words has none.
    """
    data, offsets = W.raw(column)
    data = W.LOWER[data]
    starts, ends, firsts = W.spans(data, offsets)
    hashed = W.hashes(data, starts, ends)
    at, row = W.window_rows(firsts, width)
    found = W.windows(hashed, width)[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(firsts)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = [W.windows(hashed[firsts[i] : firsts[i + 1]], int(counts[i])) for i in short]
        found, row = np.concatenate([found, *whole]), np.concatenate([row, short])
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    found, row = found[new], row[new]
    return found, np.searchsorted(row, np.arange(len(column) + 1))


def class_keys(found: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of each set (0 for an empty one)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(found), dtype=np.uint64)])
    counts = np.diff(places)
    keys = W.mix(sums[places[1:]] - sums[places[:-1]] + counts.astype(np.uint64))
    return np.where(counts > 0, keys, np.uint64(0))


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, key (null without shingles) and sketch (sorted 64-bit values) of each row."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            found, places = shingle_sets(batch.column("text"), width)
            counts = np.diff(places)
            keys = class_keys(found, places)
            kept = np.minimum(counts, SKETCH)
            ends = np.concatenate([[0], np.cumsum(kept)])
            flat = found[np.arange(ends[-1]) - np.repeat(ends[:-1], kept) + np.repeat(places[:-1], kept)]
            sketches = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(counts, pa.int64()), pa.array(W.signed(keys), pa.int64(), mask=counts == 0), sketches], names=["doc_id", "mark", "n_shingles", "key", "sketch"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(work, "doc_id long, mark long, n_shingles long, key long, sketch binary")


def _buckets(values: np.ndarray) -> np.ndarray:
    return (W.mix(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def crowding(classes: DataFrame) -> np.ndarray:
    """How many retained values fall into each of 2^16 buckets: half a megabyte, whatever the input."""

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        table += np.bincount(_buckets(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64)), minlength=len(table))

    return fixed_table(classes.select("sketch"), fill, 2**TABLE_BITS, "<i8", lambda parts: np.sum(parts, axis=0))


def listed(values: np.ndarray, total: int, level: np.ndarray, percent: int) -> np.ndarray:
    """The retained values of one class under which it is listed."""
    crowd = level[_buckets(values)]
    order = np.argsort(crowd, kind="stable")  # values are sorted already
    size = len(values)
    count = listed_values(percent, int((crowd > 0).sum()))
    if total == size:
        count = min(count, max(listed_values(percent, 0), size - -(-percent * size // 100) + 1))
    return values[order[:count]]


def lists(classes: DataFrame, percent: int) -> DataFrame:
    """(list, key, size): members of each distinct inverted list with two members or more."""
    counts = crowding(classes)
    load = max(1.0, counts.mean())
    # values in buckets with under 8 times the mean load, or under 64 values, count as rare
    level = np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / max(8 * load, 64.0)) + 1)).astype(np.int8)
    levels = classes.sparkSession.sparkContext.broadcast(level)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = [], []
            for key, n, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "sketch")), strict=True):
                some = listed(np.frombuffer(packed, np.uint64), n, levels.value, percent)
                values.append(some)
                keys.append(np.full(len(some), key, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(np.concatenate(values))), pa.array(np.concatenate(keys))], names=["value", "key"])

    rows = cut(classes.select("key", "n", "sketch").mapInArrow(work, "value long, key long"))
    found = rows.groupBy("value").agg(F.count("*").alias("size"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("members")).where("size > 1")
    once = found.groupBy("size", "members").agg(F.min("value").alias("value"))
    return rows.join(once, "value").select(F.col("value").alias("list"), "key", "size")


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections, by products of zero-one matrices over 4096 values at a time."""
    both = sets + (others or [])
    sizes = np.array([len(s) for s in both])
    values, inverse, counts = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    common = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    row, column = row[keep], common[inverse[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cutoff = len(sets)
    out = np.zeros((cutoff, len(others) if others is not None else cutoff), np.float32)
    for start in range(0, int(common[-1]) + 1, 4096):
        i, j = np.searchsorted(column, [start, start + 4096])
        part = np.zeros((len(both), 4096), np.float32)
        part[row[i:j], column[i:j] - start] = 1
        out += part[:cutoff] @ (part[cutoff:] if others is not None else part).T
    return out


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def links(sets: list[np.ndarray], others: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join the groups of one block (or of two blocks, across): a forest of verified pairs.

    Places in `others` are counted on from those in `sets`.
    """
    both = sets + (others or [])
    n = np.array([len(s) for s in both])
    shift = len(sets) if others is not None else 0
    rough = _overlaps([s[:SKETCH] for s in sets], None if others is None else [s[:SKETCH] for s in others])
    left, right = n[: len(sets), None], n[None, shift:]
    least = np.minimum(np.minimum(left, right), SKETCH)
    mask = (rough >= np.ceil(shared(percent) * least)) & (100 * np.minimum(left, right) >= percent * np.maximum(left, right))
    if others is None:
        mask = np.triu(mask, 1)
    i, j = np.nonzero(mask)
    if not len(i):
        return []
    sure = np.zeros(0, bool)
    if len(i) > 20 * len(both):
        inter = _overlaps(sets, others)[i, j].astype(np.int64)
        sure = 100 * inter >= percent * (n[i] + n[j + shift] - inter)
        i, j = i[sure], j[sure]
    else:
        order = np.argsort(-rough[i, j], kind="stable")
        i, j = i[order], j[order]
    parent, out = list(range(len(both))), []
    for a, b in zip(i.tolist(), (j + shift).tolist(), strict=True):
        x, y = _root(parent, a), _root(parent, b)
        if x == y:
            continue
        if not len(sure) and not similar(both[a], both[b], percent):
            continue
        parent[max(x, y)] = min(x, y)
        out.append((a, b))
    return out


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """The union's sketch first, then the full sets."""
    union = np.union1d(one[:SKETCH], two[:SKETCH])[:SKETCH]
    common = np.isin(union, one[:SKETCH], assume_unique=True) & np.isin(union, two[:SKETCH], assume_unique=True)
    if common.sum() < math.ceil(shared(percent) * len(union)):
        return False
    inter = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * inter >= percent * (len(one) + len(two) - inter)


def link(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) between the keys of classes."""
    members = cut(lists(classes, percent))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    dealt = members.withColumn("own", own).select("list", "key", "own", F.explode(pairs).alias("pair"))
    needed = cut(members.select("key").distinct().join(classes.select("key", "doc_id"), "key").select("doc_id").where("doc_id is not null").distinct())

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            found, places = shingle_sets(batch.column("text"), width)
            sets = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer((places * 8).astype(np.int32)), pa.py_buffer(found.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(class_keys(found, places))), sets], names=["key", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    texts = narrowed(rows, needed).join(needed, "doc_id", "left_semi")
    sets = texts.mapInArrow(make, "key long, shingles binary")
    rows = dealt.join(sets, "key").repartition("list", "pair").sortWithinPartitions("list", "pair", "key").select("list", "pair.i", "pair.j", "own", "key", "shingles")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[int, tuple[int, np.ndarray]] = {}
        now, out = None, []

        def close() -> None:
            if len(group) > 1:
                first = [k for k, (own, _) in group.items() if own == now[1]]
                second = [k for k, (own, _) in group.items() if own != now[1]]
                if now[1] == now[2]:
                    found = links([group[k][1] for k in first], None, percent)
                elif first and second:
                    found = links([group[k][1] for k in first], [group[k][1] for k in second], percent)
                else:
                    found = []
                names = first + second
                out.extend((names[a], names[b]) for a, b in found)
            group.clear()

        def flush() -> pa.RecordBatch:
            a, b = zip(*out, strict=True) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in W.slices(batches, "shingles", 8_000_000):
            columns = [batch.column(c).to_pylist() for c in ("list", "i", "j", "own", "key", "shingles")]
            for name, i, j, own, key, packed in zip(*columns, strict=True):
                if (name, i, j) != now:
                    close()
                    now = (name, i, j)
                group[key] = own, np.frombuffer(packed, np.uint64)
            if out:
                yield flush()
        close()
        yield flush()

    return rows.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs`.

    Two texts are linked if their sets of shingles of `width` words (A-Z as a-z) have
    100 * intersection >= percent * union. component_id is the smallest doc_id reachable by links;
    kept says whether it is the row's own. Null, empty and wordless texts are linked with nothing.
    Rows that share a doc_id are compared like others, so copies with one doc_id are all kept or none is.
    """
    return _marked(docs, width, percent).drop("mark")


def _marked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """near_duplicates with each text's mark."""
    sketched = written(sketch(docs, width))
    rows = sketched.drop("sketch")
    classes = cut(sketched.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    groups = components(link(docs, classes, width, percent))
    named = classes.select("key", "doc_id").join(groups.withColumnRenamed("node", "key"), "key")
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    alone = F.coalesce("least", "first")
    ids = classes.select("key", F.col("doc_id").alias("first")).join(named.join(least, "component").select("key", "least"), "key", "left").select("key", alone.alias("component_id"))
    joined = rows.join(ids, "key", "left").select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the one with the smallest doc_id, once.

    Of rows that share a doc_id only texts that are kept themselves count; of these one stays, the one with the smallest
    hash of its text. Rows without a doc_id are kept as they are.
    """
    kept = _marked(docs, width, percent).where("kept").groupBy(F.col("doc_id").alias("kept_id")).agg(F.min("mark").alias("mark"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    same = (F.col("row.doc_id").cast("long") == F.col("kept_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("mark"))
    joined = docs.select(row).join(kept, same, "left_semi")
    one = joined.withColumn("id", F.col("row.doc_id")).dropDuplicates(["id"]).select("row.*")
    return one.unionByName(docs.where("doc_id is null"))


def inherit(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, inherits_from and position_ of each row with a doc_id: siblings are near copies of the whole text.

    inherits_from is the smallest doc_id of the row's component; position_ counts its rows by doc_id from 0.
    Rows are counted in pieces of a table sorted by component, so no component is gathered in one task.
    """
    rows = near_duplicates(docs, width, percent).where("doc_id is not null").select("doc_id", F.col("component_id").alias("inherits_from"))
    ordered = rows.repartitionByRange("inherits_from", "doc_id").sortWithinPartitions("inherits_from", "doc_id")
    placed = cut(ordered.withColumn("piece", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    pieces = placed.groupBy("inherits_from", "piece").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("inherits_from").orderBy("piece")) - F.col("n")
    joined = placed.join(pieces.withColumn("before", before), ["inherits_from", "piece"])
    return joined.select("doc_id", "inherits_from", (F.col("at") - F.col("first") + F.col("before")).alias("position_"))
