"""Line dedup by an exact set-similarity join.

A line's set is its distinct words (A-Z as a-z). Words are put in order of rarity, by a table of fixed
size that counts all words by hash bucket. Two sets with similarity t share a word among the first
n - ceil(t * n) + 1 of each, so lines meet in the lists of those words only. In a list, pairs must pass
the length filter, the positional filter (words left after the shared one must suffice) and a bound by
parities of the sets (bits that words flip, so they differ in fewer places than the sets); then Jaccard is verified on full sets. Lines with equal sets form a class,
of which only one enters a list. Sets so small that one word more or less is too much (up to three words
at 80 per cent) match equal sets only, so they enter none.

A line needs just one earlier match to go. So a list gives each line its `NEAREST` candidates by parity;
only lines for which none of them is verified, and which had more, get the next ones, `GROWTH` times as
many, and so on until no line is left: however large a family of lines, no round gives out all its pairs.

A list with over LIST entries is dealt out: by steps of size, of which only neighbours can match, and
each such part as pairs of blocks, so no task holds a whole list. Entries travel as matrices, one for
the lists of a bucket in a stretch of lines.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm import words as W
from pliego.llm.common import cut, removed, written
from pliego.llm.tables import fixed_table, narrowed, passed_by

BUCKET_BITS, NEAREST, GROWTH, LIST = 16, 4, 1024, 50_000
#: Lines with over LONG words have parities of 256 bits, with over MIDDLE of 128, others of 64: random sets must be further apart than similar ones may be.
MIDDLE, LONG = 64, 128
#: Buckets of a table that counts listed words: where none has over LIST, no word has.
WORD_BITS = 17
#: Pairs of a list that are held at a time.
PAIRS = 200_000
#: Entries that are packed at a time, and entries of a bucket of lists: a bucket is compared at once.
PACKED, BUCKET = 250_000, 100_000


def rarity(docs: DataFrame) -> np.ndarray:
    """For each hash bucket the logarithm of the number of words in it, over all documents."""

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        for piece in W.slices([batch]):
            data, offsets = W.raw(piece.column("text"))
            data = W.LOWER[data]
            starts, ends, _ = W.spans(data, offsets)
            table += np.bincount((W.hashes(data, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(table))

    counts = fixed_table(docs.select("text"), fill, 2**BUCKET_BITS, "<i8", lambda parts: np.sum(parts, axis=0))
    return np.minimum(4 * np.log2(counts + 1), 255).astype(np.uint8)


class Lines:
    """The lines of one piece of a batch that have at least `least` distinct words. Parities are made where `level` is given."""

    def __init__(self, column: pa.Array, least: int, level: np.ndarray | None):
        data, offsets = W.raw(column)
        self.data, self.offsets = data, offsets
        low = W.LOWER[data]
        starts, ends, firsts = W.spans(low, offsets)
        breaks = np.flatnonzero(data == 10)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
        line = np.searchsorted(breaks, starts)
        group = line + row  # grows with each line and each row
        hashed = W.hashes(low, starts, ends)
        first = group[0] if len(group) else 0
        bits = max(1, int(group[-1] - first).bit_length()) if len(group) else 1
        rank = level[(hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.uint64) if level is not None else np.zeros(len(hashed), np.uint64)
        key = ((group - first).astype(np.uint64) << np.uint64(64 - bits)) | (((rank << np.uint64(56)) | (hashed >> np.uint64(8))) >> np.uint64(bits))
        order = np.argsort(key)
        group, hashed = group[order], hashed[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (group[1:] != group[:-1])
        order, group, hashed = order[new], group[new], hashed[new]
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(group)))
        some = size >= least
        head, size = head[some], size[some]
        self.row = row[order[head]]
        self.line = line[order[head]] - np.searchsorted(breaks, offsets[self.row])
        self.size, self.head, self.hashed = size, head, hashed
        if len(head):
            pairs = np.stack([head, head + size], 1).ravel()
            padded = np.append(hashed, np.uint64(0))
            self.key = W.mix(np.add.reduceat(W.mix(padded), pairs)[::2] + size.astype(np.uint64))
        if len(head) and level is not None:
            bit = W.mix(padded)
            one, part = np.uint64(1) << (bit >> np.uint64(58)), (bit >> np.uint64(56)) & np.uint64(3)
            quarters = [np.bitwise_xor.reduceat(np.where(part == i, one, np.uint64(0)), pairs)[::2] for i in range(4)]
            middle, long = (np.where(size > most, ~np.uint64(0), np.uint64(0)) for most in (MIDDLE, LONG))
            # all folded to 64 bits, what is in the upper half of 128, and what is in the upper two quarters of 256
            upper = quarters[1] ^ quarters[3]
            self.parity = [quarters[0] ^ quarters[2] ^ upper, upper & middle, quarters[2] & long, quarters[3] & long]
        else:
            self.key = self.key if len(head) else np.zeros(0, np.uint64)
            self.parity = [np.zeros(len(head), np.uint64)] * 4

    def words(self, chosen: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first `counts` words of chosen lines: the places in `chosen`, the places in the line, the words."""
        own = np.repeat(np.arange(len(chosen)), counts)
        at = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        return own, at, self.hashed[self.head[chosen][own] + at]


PARITIES = ("parity", "parity2", "parity3", "parity4")
LINE = "doc_id long, line int, class long, n int, parity long, parity2 long, parity3 long, parity4 long, words array<int>"


def compared(docs: DataFrame, level: np.ndarray, least: int, percent: int) -> DataFrame:
    """Every line that is compared, with the words that it is listed under, rarest first.

    Of the lines with one set in a piece of a batch only the earliest has words; sets that only equal sets match have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, most=2_000_000):
            x = Lines(batch.column("text"), least, shared.value)
            doc = batch.column("doc_id").to_numpy()[x.row]
            order = np.lexsort((x.line, doc, x.key))
            first = np.zeros(len(order), bool)
            first[order] = np.concatenate([[True], x.key[order][1:] != x.key[order][:-1]]) if len(order) else False
            # the most alike of other sets has one word more
            others = 100 * x.size >= percent * (x.size + 1)
            counts = np.where(first & others, x.size - -(-percent * x.size // 100) + 1, 0)
            _, _, word = x.words(np.arange(len(x.key)), counts)
            word = (word & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(word))
            columns = [pa.array(doc), pa.array(x.line, pa.int32()), pa.array(W.signed(x.key)), pa.array(x.size, pa.int32()), *(pa.array(W.signed(p)) for p in x.parity), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "class", "n", *PARITIES, "words"])

    return docs.mapInArrow(work, LINE)


ENTRY = ("list", "class", PARITIES[0], "doc_id", "spot", "place", *PARITIES[1:])


def listed(batch: pa.RecordBatch, chosen: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """ENTRY's columns: the lines of a batch under those of their words that are chosen. The list is the word.

    `spot`: the line and, in the lowest bit, whether it gets candidates; `place`: its size and the word's place, of 32 bits each.
    """
    lists = batch.column("words")
    counts = np.diff(lists.offsets.to_numpy())
    own = np.repeat(np.arange(batch.num_rows), counts)
    at = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    word = lists.flatten().to_numpy().view(np.uint32).astype(np.int64)
    some = chosen(word)
    own, at, word = own[some], at[some], word[some]
    of = {c: batch.column(c).to_numpy() for c in ("class", "doc_id", "line", "n", *PARITIES)}
    spot, place = of["line"].astype(np.int64) << 1 | 1, of["n"].astype(np.int64) << 32
    return [word, of["class"][own], of[PARITIES[0]][own], of["doc_id"][own], spot[own], place[own] | at, *(of[p][own] for p in PARITIES[1:])]


def entries(lines: DataFrame, chosen: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`listed` as rows."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in listed(batch, chosen)], names=list(ENTRY))

    return lines.mapInArrow(work, ", ".join(f"{c} long" for c in ENTRY))


def packed(columns: np.ndarray) -> bytes:
    """A matrix of longs, byte by byte of the longs: the bytes that are zero in a whole column are left out."""
    planes = np.ascontiguousarray(columns).view(np.uint8).reshape(*columns.shape, 8).transpose(0, 2, 1).reshape(-1, columns.shape[1])
    some = planes.any(1)
    some[0] = True  # it tells the length
    return np.packbits(some).tobytes() + planes[some].tobytes()


def unpacked(block: bytes, count: int) -> np.ndarray:
    """The matrix of `count` columns that `packed` made."""
    head = count  # eight bits for each column
    some = np.unpackbits(np.frombuffer(block, np.uint8, head)).astype(bool)
    found = np.frombuffer(block, np.uint8, offset=head).reshape(int(some.sum()), -1)
    planes = np.zeros((8 * count, found.shape[1]), np.uint8)
    planes[some] = found
    return np.ascontiguousarray(planes.reshape(count, 8, -1).transpose(0, 2, 1)).view(np.int64).reshape(count, -1)


def blocks(frame: DataFrame, read: Callable[[pa.RecordBatch], list[np.ndarray]], buckets: int) -> DataFrame:
    """(bucket, block): the entries that `read` finds in a batch, those of one bucket of lists together."""

    def made(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = np.stack([np.concatenate(x) for x in zip(*held, strict=True)])
        bucket = (W.mix(columns[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        columns, bucket = columns[:, order], bucket[order]
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        starts = np.concatenate([[0], ends[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array([packed(columns[:, a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())], names=["bucket", "block"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(read(batch))
            count += len(held[-1][0])
            if count >= PACKED:
                yield made(held)
                held, count = [], 0
        if count:
            yield made(held)

    return frame.mapInArrow(work, "bucket int, block binary")


def rows_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy() for c in ENTRY]


def word_bucket(word: np.ndarray) -> np.ndarray:
    return (W.mix(word.astype(np.int64).view(np.uint64)) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def dealt(lines: DataFrame, percent: int) -> tuple[Callable[[np.ndarray], np.ndarray], DataFrame | None, int]:
    """Which words have a list of their own, `entries` of all others in the lists in which they are compared, and the number of buckets.

    Of a word with over LIST entries any two whose sizes are within `percent` of each other meet in one of its parts.
    """

    def fill(batch: pa.RecordBatch, table: np.ndarray) -> None:
        table += np.bincount(word_bucket(batch.column("words").flatten().to_numpy().view(np.uint32)), minlength=len(table))

    counts = fixed_table(lines.select("words"), fill, 2**WORD_BITS, "<i8", lambda parts: np.sum(parts, axis=0))
    buckets = max(int(counts.sum()) // BUCKET, 4 * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = counts > LIST
    if not full.any():
        return lambda word: np.ones(len(word), bool), None, buckets
    shared = lines.sparkSession.sparkContext.broadcast(full)
    others = entries(lines, lambda word: shared.value[word_bucket(word)])
    hot = cut(others.groupBy("list").agg(F.count("*").alias("m")).where(F.col("m") > LIST).select("list"))
    step = F.floor(F.ln(F.shiftright("place", 32)) / math.log(100.1 / percent)).cast("int")
    stepped = others.join(hot, "list", "left_semi").withColumn("step", F.explode(F.array(step, step - 1)))
    sizes = stepped.groupBy("list", "step").agg(F.ceil(F.count("*") / LIST).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), "blocks").cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    parts = stepped.join(sizes, ["list", "step"]).withColumn("pair", F.explode(pairs)).withColumn("list", F.xxhash64("list", "step", "pair"))
    return lambda word: ~shared.value[word_bucket(word)], others.join(hot, "list", "left_anti").unionByName(parts.select(*ENTRY)).select(*ENTRY), buckets


CANDIDATE = "later long, earlier long, more boolean, later_doc long, earlier_doc long"


def candidates(packs: DataFrame, percent: int, skip: int, upto: int) -> DataFrame:
    """Pairs of classes that pass the filters: for each line of a list its nearest earlier ones, from number `skip` up to `upto`.

    `packs`: from `blocks`. `more`: the list has others beyond. Each class has the doc_id of its first line, since that is in all of its lists.
    """
    ordered = packs.repartition("bucket").sortWithinPartitions("bucket")

    def passing(i: np.ndarray, j: np.ndarray, n: np.ndarray, left: np.ndarray, parity: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs left by the positional and parity filters, cheapest first, and how far parities are apart."""
        both = n[i] + n[j]
        need = -(-percent * both // (100 + percent))
        enough = np.minimum(left[i], left[j]) >= need
        i, j, spare = i[enough], j[enough], (both - 2 * need)[enough]
        one = parity[0][i] ^ parity[0][j]
        apart = np.bitwise_count(one).astype(np.int32)
        close = apart <= spare
        i, j, spare, apart, one = i[close], j[close], spare[close], apart[close], one[close]
        for most in (MIDDLE, LONG):
            both = np.flatnonzero((n[i] > most) & (n[j] > most))
            two, three, four = (p[i[both]] ^ p[j[both]] for p in parity[1:])
            halves = one[both] ^ two, two
            parts = halves if most == MIDDLE else (halves[0] ^ three, halves[1] ^ four, three, four)
            apart[both] = sum(np.bitwise_count(x).astype(np.int32) for x in parts)
            close = apart <= spare
            i, j, spare, apart, one = i[close], j[close], spare[close], apart[close], one[close]
        return i, j, apart

    def one_piece(word, doc, line, cls, n, at, wanted, *parity) -> Iterator[tuple[np.ndarray, ...]]:
        """Candidates in whole lists, as CANDIDATE has them."""
        order = np.lexsort((cls, line, doc, word))
        word, doc, cls, n, at, wanted, *parity = (x[order] for x in (word, doc, cls, n, at, wanted, *parity))
        # of equal sets in a list the earliest stays
        order = np.lexsort((cls, word))
        again = order[1:][(word[order][1:] == word[order][:-1]) & (cls[order][1:] == cls[order][:-1])]
        keep = np.ones(len(word), bool)
        keep[again] = False
        rank = np.flatnonzero(keep)
        order = rank[np.lexsort((n[rank], word[rank]))]  # by size within a list, then by place
        rank = order
        word, doc, cls, n, at, wanted, *parity = (x[order] for x in (word, doc, cls, n, at, wanted, *parity))
        left = n - at
        # Length filter: an entry meets those before it down to percent of its size. The shorter set of a
        # pair must have its shared word so early that even a set of its own size would reach the overlap.
        able = np.flatnonzero(left >= -(-2 * percent * n // (100 + percent)))
        lists = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])).astype(np.int64) << 32  # one number for each list
        low = np.searchsorted((lists + n)[able], lists - (-percent * n.astype(np.int64) // 100))
        counts = np.maximum(np.searchsorted(able, np.arange(len(word))) - low, 0)
        total = np.cumsum(counts)
        held: list[tuple[np.ndarray, ...]] = []
        more = np.zeros(len(word), bool)

        def nearest_of(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            """Of all candidates so far each line's first `upto`, with their numbers."""
            later, earlier, apart = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.lexsort((rank[earlier], apart, later))
            later, earlier, apart = later[by], earlier[by], apart[by]
            number = np.arange(len(later)) - np.searchsorted(later, later)
            chosen = number < upto
            more[later[~chosen]] = True
            return later[chosen], earlier[chosen], apart[chosen], number[chosen]

        start = 0
        while start < len(word):
            done = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, done + PAIRS, "right")))
            some = counts[start:stop]
            j = np.repeat(np.arange(start, stop), some)
            i = able[np.arange(len(j)) + np.repeat(low[start:stop] - (total[start:stop] - done - some), some)]
            start = stop
            i, j, apart = passing(i, j, n, left, parity)
            if not len(j):
                continue
            first = rank[i] < rank[j]
            later, earlier = np.where(first, j, i), np.where(first, i, j)
            some = wanted[later]
            held.append((later[some], earlier[some], apart[some]))
            if sum(len(x[0]) for x in held[1:]) > 5 * PAIRS:
                held = [nearest_of(held)[:3]]
        if held:
            later, earlier, _, number = nearest_of(held)
            later, earlier = later[number >= skip], earlier[number >= skip]
            yield cls[later], cls[earlier], more[later], doc[later], doc[earlier]

    def made(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        word, cls, first, doc, spot, place, *rest = np.concatenate(held, axis=1)
        parity = [x.view(np.uint64) for x in (first, *rest)]
        for found in one_piece(word, doc, spot >> 1, cls, (place >> 32).astype(np.int32), (place & 0xFFFFFFFF).astype(np.int32), (spot & 1).astype(bool), *parity):
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=[c.split()[0] for c in CANDIDATE.split(", ")])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = -1
        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block"), strict=True):
                if bucket != last and held:
                    yield from made(held)
                    held = []
                last = bucket
                held.append(unpacked(block.as_buffer(), len(ENTRY)))
        if held:
            yield from made(held)

    # one pair may come from several lists
    return ordered.mapInArrow(work, CANDIDATE).groupBy("later", "earlier").agg(F.max("more").alias("more"), F.min("later_doc").alias("later_doc"), F.min("earlier_doc").alias("earlier_doc"))


def verified(docs: DataFrame, pairs: DataFrame, least: int, percent: int) -> DataFrame:
    """Classes whose first line has an earlier match: (class)."""
    side = lambda name: F.struct(F.col(f"{name}_doc").alias("doc_id"), F.col(name).alias("class"))
    needed = pairs.select(F.explode(F.array(side("later"), side("earlier"))).alias("side")).select("side.*")
    per_doc = cut(needed.groupBy("doc_id").agg(F.collect_set("class").alias("classes")))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            x = Lines(batch.column("text"), least, None)
            wanted = batch.column("classes")
            keys = W.signed(x.key)
            chosen = np.flatnonzero(np.isin(keys, wanted.flatten().to_numpy()))
            own, _, found = x.words(chosen, x.size[chosen])
            ends = np.concatenate([[0], np.cumsum(x.size[chosen])])
            sets = pa.Array.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(found.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(keys[chosen]), sets], names=["class", "words"])

    sets = narrowed(docs, per_doc).join(per_doc, "doc_id").select("text", "classes").mapInArrow(work, "class long, words binary").dropDuplicates(["class"])
    joined = pairs.join(sets.select(F.col("class").alias("later"), F.col("words").alias("a")), "later").join(sets.select(F.col("class").alias("earlier"), F.col("words").alias("b")), "earlier")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "a", 4_000_000):
            hits = []
            for later, a, b in zip(*(batch.column(c).to_pylist() for c in ("later", "a", "b")), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * inter >= percent * (len(x) + len(y) - inter):
                    hits.append(later)
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64())], names=["class"])

    return cut(joined.select("later", "a", "b").mapInArrow(compare, "class long").distinct())


def lists_of(seen: DataFrame, single: Callable[[np.ndarray], np.ndarray], others: DataFrame | None, left: DataFrame) -> DataFrame:
    """`entries` of all lists that hold a class of `left`, of which only those classes get candidates."""
    # tests of fixed size go before any shuffle: what they let through beside these lists finds nothing
    some = entries(narrowed(seen, left, "class"), single).select("list")
    if others is not None:
        some = some.unionByName(narrowed(others, left, "class").select("list"))
    some = cut(some.distinct())
    passes = passed_by(some, "list")
    rest = entries(seen, lambda word: single(word) & passes(word))
    if others is not None:
        rest = rest.unionByName(narrowed(others, some, "list"))
    marked = rest.join(left.withColumn("open", F.lit(1).cast("long")), "class", "left")
    return marked.withColumn("spot", F.col("spot") - 1 + F.coalesce("open", F.lit(0).cast("long"))).select(*ENTRY)


def repeated_lines(docs: DataFrame, percent: int = 80, least: int = 5) -> DataFrame:
    """(doc_id, line, class) of the lines to remove: those with an earlier match, by doc_id and line number.

    `docs`: (doc_id, text) without nulls in doc_id. Lines begin at 0. Where rows share a doc_id, lines of
    one number are at the same place: of different sets the one with the smaller hash counts as earlier.
    """
    seen = written(compared(docs, rarity(docs), least, percent))
    firsts = written(seen.groupBy("class").agg(F.min(F.struct("doc_id", "line")).alias("m")).select("class", "m.*"))
    single, others, buckets = dealt(seen, percent)
    skip, upto, gone = 0, NEAREST, None
    packs = blocks(seen, lambda batch: listed(batch, single), buckets)
    if others is not None:
        packs = packs.unionByName(blocks(others, rows_of, buckets))
    pairs = written(candidates(packs, percent, skip, upto))
    while True:
        found = verified(docs, pairs, least, percent)
        gone = found if gone is None else gone.unionByName(found)
        left = cut(pairs.where("more").select(F.col("later").alias("class")).distinct().join(gone, "class", "left_anti"))
        if not left.limit(1).count():
            break
        skip, upto = upto, GROWTH * upto
        removed(pairs)
        pairs = written(candidates(blocks(lists_of(seen, single, others, left), rows_of, buckets), percent, skip, upto))
    removed(pairs)
    marks = firsts.join(gone.withColumn("gone", F.lit(True)), "class", "left").select("class", F.col("doc_id").alias("d"), F.col("line").alias("l"), F.coalesce("gone", F.lit(False)).alias("gone"))
    joined = seen.select("doc_id", "line", "class").join(marks, "class")
    return joined.where(F.col("gone") | (F.col("doc_id") != F.col("d")) | (F.col("line") != F.col("l"))).select("doc_id", "line", "class")


def remove_lines(docs: DataFrame, percent: int = 80, least: int = 5) -> DataFrame:
    """All columns of `docs`, with text rewritten, and n_lines and n_removed (of lines with a word).

    A line (between \\n) goes if an earlier line, in its own document or one with a smaller doc_id, has a
    set of words with 100 * intersection >= percent * union; lines are judged on the input. Lines with
    fewer than `least` distinct words stay and match nothing. The others keep their order and bytes. Null
    texts stay null; rows without a doc_id stay as they are. Columns named n_lines and n_removed are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # the text goes beside the other columns, not among them too
    others = F.struct(*[F.col(f"`{c}`") for c in rest if c != "text"])
    rows = docs.select(others.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = repeated_lines(rows.select("doc_id", "text").where("doc_id is not null"), percent, least)
    per_doc = gone.groupBy("doc_id").agg(F.collect_set(F.struct("line", "class")).alias("gone"))
    joined = rows.join(per_doc, "doc_id", "left").select("row", "text", "gone")
    schema = joined.select("row", F.lit("").alias("kept"), F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed")).schema
    for field in schema.fields:
        field.nullable = True

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            column, marks = batch.column("text"), batch.column("gone")
            texts, removed = column.to_pylist(), [0] * batch.num_rows
            touched = np.flatnonzero(np.asarray(marks.is_valid()))
            if len(touched):
                x = Lines(column.take(pa.array(touched)), least, None)
                keys = W.signed(x.key)
                places = np.searchsorted(x.row, np.arange(len(touched) + 1))
                for k, i in enumerate(touched.tolist()):
                    known = dict(zip(x.line[places[k] : places[k + 1]].tolist(), keys[places[k] : places[k + 1]].tolist(), strict=True))
                    drop = {m["line"] for m in marks[i].as_py() if known.get(m["line"]) == m["class"]}
                    texts[i] = "\n".join(t for n, t in enumerate(texts[i].split("\n")) if n not in drop)
                    removed[i] = len(drop)
            data, offsets = W.raw(column)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(_worded(data, offsets), pa.int64()), pa.array(removed, pa.int64())], names=["row", "kept", "n_lines", "n_removed"])

    made = joined.mapInArrow(work, schema)
    return made.select(*[F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in rest], "n_lines", "n_removed")


def _worded(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word, of each row."""
    starts, _, firsts = W.spans(data, offsets)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=len(offsets) - 1)
