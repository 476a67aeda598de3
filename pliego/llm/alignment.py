"""Cross-tokenizer alignment by byte-owner arrays.

Two tokenizers cut the same bytes in two ways. For each of them an array tells which token owns each
byte (the tokens' indices, each repeated over its bytes). Consecutive distinct pairs of owners are the
pairs of tokens that overlap; where both owners change at once, a token of either kind ends, and the
text falls into groups of tokens that stand for the same bytes. All of it runs over Arrow batches of
whole documents as numpy arrays.

How common an aligned pair of ids is in the whole corpus is counted by a sum that every task begins
by itself. The counts are then looked up slice by slice of the first vocabulary: a slice holds
`SLICE` pairs at most whatever the size of the corpus, and only such a slice is ever broadcast.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm.common import cut, shared_folder
from pliego.llm.words import slices

#: Aligned pairs of ids in one broadcast table: twelve bytes each.
SLICE = 2**22
#: Pairs that a task holds before it sums them up.
HELD = 2**21
#: Bytes of owner arrays made at a time, so that one huge text needs no more.
SPAN = 2**22


class Tokenizer(NamedTuple):
    """`encode` gives the ids of texts; `texts` has the bytes of every id."""

    encode: Callable[[list[str]], list[list[int]]]
    texts: list[bytes]


def byte_level(data: bytes, pattern: str) -> Tokenizer:
    """A byte-level BPE from its JSON file (vocabulary and merges). Special tokens are never made from a text.

    The merges give the ranks, which tiktoken applies: it does the same merges several times faster
    than the library that the file is for.
    """
    import tiktoken

    model = json.loads(data)["model"]
    # bytes that don't print stand as code points from 256 on, all others as themselves
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    own = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    as_bytes = lambda token: bytes(map(own.__getitem__, token))
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    made = [model["vocab"][m] for m in merges]
    if sorted(set(made)) != made:
        raise ValueError("ids must follow the order of the merges")
    ranks = {as_bytes(t): model["vocab"][t] for t in [*own, *merges]}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [b""] * (1 + max(model["vocab"].values()))
    for token, i in model["vocab"].items():
        texts[i] = as_bytes(token) if all(c in own for c in token) else token.encode()
    return Tokenizer(lambda rows: [encoding.encode_ordinary(t) for t in rows], texts)


def pieces(data: bytes) -> Tokenizer:
    """A sentencepiece model, which puts a space before a text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    texts = [bytes([int(name[3:5], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]
    return Tokenizer(lambda rows: model.encode(rows, num_threads=1), texts)


class Table:
    """The bytes of all ids of a tokenizer, one after another."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        return self.data[np.repeat(self.first[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each row has."""
    counts = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum())), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over rows of so many values each."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def same_bytes(table: Table, ids: np.ndarray, counts: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """Of each row, whether its ids stand for exactly the wanted bytes."""
    sizes = np.fromiter(map(len, wanted), np.int64, len(wanted))
    good = _sums(table.sizes[ids], counts) == sizes
    found = table.joined(ids[np.repeat(good, counts)])
    expected = np.frombuffer(b"".join(w for w, g in zip(wanted, good, strict=True) if g), np.uint8)
    good[good] = _sums(found != expected, sizes[good]) == 0
    return good


def owners(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Overlapping pairs of tokens (a, b) in order of place, and whether a cut stands before each, some bytes at a time.

    Both size arrays have the same sum, and no size is zero.
    """
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    total = int(ends_a[-1]) if len(ends_a) else 0
    last = (-1, -1)
    for low in range(0, total, SPAN):
        high = min(low + SPAN, total)
        own = []
        for ends, sizes in ((ends_a, sizes_a), (ends_b, sizes_b)):
            i, j = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left") + 1
            part = np.minimum(ends[i:j], high) - np.maximum(ends[i:j] - sizes[i:j], low)
            own.append(np.repeat(np.arange(i, j), part))
        new = [np.concatenate([[o[0] != before], o[1:] != o[:-1]]) for o, before in zip(own, last, strict=True)]
        at = np.flatnonzero(new[0] | new[1])
        yield own[0][at], own[1][at], (new[0] & new[1])[at]
        last = own[0][-1], own[1][-1]


def overlaps(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of `owners` at once."""
    found = list(owners(sizes_a, sizes_b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    a, b, cuts = zip(*found, strict=True)
    return np.concatenate(a), np.concatenate(b), np.concatenate(cuts)


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to most, and how many each has, with room for one character behind."""
    width = len(str(most))
    names = np.arange(most + 1).astype(f"S{width + 1}")
    return names.view(np.uint8).reshape(most + 1, width + 1), np.char.str_len(names)


def rendered(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, decimals: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All groups as text (`a1,a2|b1;...`), and where the text of each token of a and of b ends (its separator included)."""
    place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
    place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
    ids, marks = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    for place, group, mark in ((place_a, group_a, "|"), (place_b, group_b, ";")):
        marks[place[np.concatenate([group[1:] != group[:-1], [True]])]] = ord(mark)
    digits, lengths = decimals
    rows, sizes = digits[ids], lengths[ids]
    rows[np.arange(len(ids)), sizes] = marks
    text = rows[np.arange(rows.shape[1]) <= sizes[:, None]]
    ends = np.cumsum(sizes + 1)
    return text, ends[place_a], ends[place_b]


_LOADED: dict[str, tuple] = {}


def _loaded(key: str, make: Callable[[], tuple]) -> tuple:
    """What a worker makes of broadcast files, once."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]


def align(frame: DataFrame, first: Callable[[bytes], Tokenizer], first_file: bytes, second: Callable[[bytes], Tokenizer], second_file: bytes, text: str = "text") -> DataFrame:
    """Add a_ids, b_ids (binary: little-endian ids of 16 bits), n_groups, n_links and groups (`a1,a2|b1;...`) of each whole text.

    `first` encodes a space and the text, `second` the text itself. A text that is null, empty, or whose
    tokens' bytes differ from a space and the text has no tokens: empty binaries, zeros and an empty
    string. Repeated rows stay; other columns stay as they are, those named like a new one are replaced.
    Both files are vocabularies, of one size whatever the input; ids must be below 65,536.
    """
    shared = frame.sparkSession.sparkContext.broadcast((first_file, second_file))
    call = uuid.uuid4().hex
    made = ["a_ids", "b_ids", "n_groups", "n_links", "groups"]
    rest = [c for c in frame.columns if c not in made and c != text]
    packed = frame.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = packed.selectExpr("row", "text", "cast('' as binary) a_ids", "cast('' as binary) b_ids", "0L n_groups", "0L n_links", "'' groups").schema

    def make() -> tuple:
        a, b = first(shared.value[0]), second(shared.value[1])
        if max(len(a.texts), len(b.texts)) > 65_536:
            raise ValueError("ids must be below 65,536")
        return a, Table(a.texts), b, Table(b.texts), _decimals(max(len(a.texts), len(b.texts)))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, table_a, b, table_b, decimals = _loaded(call, make)
        for batch in slices(batches):
            rows = [t or "" for t in batch.column("text").to_pylist()]
            spaced = [" " + t if t else "" for t in rows]
            wanted = [t.encode() for t in spaced]
            ids_a, count_a = _flat(a.encode(spaced))
            ids_b, count_b = _flat([f if t else [] for f, t in zip(b.encode(rows), rows, strict=True)])
            good = same_bytes(table_a, ids_a, count_a, wanted) & same_bytes(table_b, ids_b, count_b, wanted)
            ids_a, ids_b = ids_a[np.repeat(good, count_a)], ids_b[np.repeat(good, count_b)]
            count_a, count_b = count_a * good, count_b * good
            own_a, own_b, cuts = overlaps(table_a.sizes[ids_a], table_b.sizes[ids_b])
            group = np.cumsum(cuts)
            group_a, group_b = (group[np.searchsorted(own, np.arange(n))] for own, n in ((own_a, len(ids_a)), (own_b, len(ids_b))))
            out, _, ends_out = rendered(ids_a, ids_b, group_a, group_b, decimals) if len(ids_a) else (np.zeros(0, np.uint8), None, np.zeros(0, np.int64))
            ends_a, ends_b = np.cumsum(count_a), np.cumsum(count_b)
            of_row = np.repeat(np.arange(len(rows)), count_a)[own_a] if len(own_a) else own_a
            last = np.concatenate([[0], ends_out])[ends_b]
            before = np.concatenate([[0], last[:-1]])
            data_a, data_b = ids_a.astype("<u2"), ids_b.astype("<u2")
            columns = [
                pa.array([data_a[e - n : e].tobytes() for e, n in zip(ends_a, count_a, strict=True)], pa.binary()),
                pa.array([data_b[e - n : e].tobytes() for e, n in zip(ends_b, count_b, strict=True)], pa.binary()),
                pa.array(np.bincount(of_row, cuts, len(rows)).astype(np.int64)),
                pa.array(np.bincount(of_row, minlength=len(rows)).astype(np.int64)),
                pa.array([str(out[i : max(j - 1, i)], "ascii") for i, j in zip(before, last, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), *columns], names=["row", "text", *made])

    done = packed.mapInArrow(work, schema)
    return done.select(*[(F.col("text") if c == text else F.col("row")[c]).alias(c) for c in frame.columns if c not in made], *made)


def stored(frame: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder, well compressed."""
    path = f"{shared_folder(frame.sparkSession)}/aligned-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.parquet(path)


def _links(batch: pa.RecordBatch, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and pair (the first id times 65,536, plus the second) of every link of a batch of ids."""
    ids, rows = [], None
    for name in ("a_ids", "b_ids"):
        values = [np.frombuffer(v.as_buffer(), "<u2") for v in batch.column(name)]
        ids.append(np.concatenate(values).astype(np.int64))
        rows = np.repeat(np.arange(len(values)), [len(v) for v in values]) if rows is None else rows
    own_a, own_b, _ = overlaps(sizes_a[ids[0]], sizes_b[ids[1]])
    return rows[own_a], ids[0][own_a] << 16 | ids[1][own_b]


def _firsts(values: np.ndarray) -> np.ndarray:
    """Of sorted values, whether each differs from the one before it."""
    return np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    firsts = np.flatnonzero(_firsts(keys))
    return keys[firsts], np.add.reduceat(counts, firsts)


def pair_counts(aligned: DataFrame, sizes_a: np.ndarray, sizes_b: np.ndarray) -> DataFrame:
    """a, b, n: in how many rows of `align` the two ids overlap at least once. Each task sums up its own rows first."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, least = [], [], 0, HELD
        for batch in slices(batches, "a_ids"):
            rows, pairs = _links(batch, sizes_a, sizes_b)
            if not len(pairs):
                continue
            in_row = np.sort(rows << 32 | pairs)
            found = np.sort(in_row[_firsts(in_row)] & 0xFFFFFFFF)
            at = np.flatnonzero(_firsts(found))
            keys.append(found[at])
            counts.append(np.diff([*at, len(found)]))
            held += len(at)
            if held > least:
                merged = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [merged[0]], [merged[1]], len(merged[0])
                least = max(HELD, 2 * held)
                if held > 4 * HELD:
                    yield from _emit(*merged)
                    keys, counts, held, least = [], [], 0, HELD
        if keys:
            yield from _emit(*_summed(np.concatenate(keys), np.concatenate(counts)))

    partial = aligned.select("a_ids", "b_ids").mapInArrow(work, "pair long, n long")
    summed = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    return summed.select(F.shiftright("pair", 16).cast("int").alias("a"), F.expr("cast(pair & 65535 as int)").alias("b"), "n")


def _emit(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(counts[i : i + 100_000].astype(np.int64))], names=["pair", "n"])


def with_counts(aligned: DataFrame, sizes_a: np.ndarray, sizes_b: np.ndarray, most: int = SLICE) -> DataFrame:
    """Add n_best and count_sum to rows of `align`: links whose pair is the commonest of its first id, and the sum of all links' counts.

    `aligned` is read once for the counts and once for each slice of them; it should be a written table.
    Ties for the commonest all count. Counts are over all rows given, repeated ones included.
    """
    counts = cut(pair_counts(aligned, sizes_a, sizes_b))
    # at most one row for each id of the first vocabulary
    per_id = sorted((r.a, r.n) for r in counts.groupBy("a").agg(F.count("*").alias("n")).collect())
    bounds, held = [0], 0
    for a, n in per_id:
        if held and held + n > most:
            bounds.append(a)
            held = 0
        held += n
    out = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k, (low, high) in enumerate(zip(bounds, [*bounds[1:], 2**31 - 1], strict=True)):
        out = _looked_up(out if not k else stored(out), counts.where(F.col("a").between(low, high - 1)), sizes_a, sizes_b)
    return out


def _looked_up(aligned: DataFrame, counts: DataFrame, sizes_a: np.ndarray, sizes_b: np.ndarray) -> DataFrame:
    """Add what the links found in one slice of the counts contribute to n_best and count_sum."""
    found = counts.toArrow()
    keys = found.column("a").to_numpy().astype(np.int64) << 16 | found.column("b").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], found.column("n").to_numpy()[order]
    del found
    shared = aligned.sparkSession.sparkContext.broadcast((keys, n))
    own = ["a_ids", "b_ids", "n_best", "count_sum"]
    rest = [c for c in aligned.columns if c not in own]
    packed = aligned.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("row"), *own)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = shared.value
        firsts = np.flatnonzero(_firsts(keys >> 16))
        best = n == np.repeat(np.maximum.reduceat(n, firsts), np.diff([*firsts, len(keys)])) if len(keys) else np.zeros(0, bool)
        for batch in slices(batches, "a_ids"):
            rows, pairs = _links(batch, sizes_a, sizes_b)
            n_best, total = (batch.column(c).to_numpy().copy() for c in ("n_best", "count_sum"))
            if len(keys) and len(pairs):
                # sorted needles keep the search within a few lines of memory
                both = np.sort(pairs.astype(np.uint64) << np.uint64(32) | rows.astype(np.uint64))
                rows, pairs = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.int64)
                new = _firsts(pairs)
                distinct = pairs[new]
                at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                hit = keys[at] == distinct
                times = np.diff([*np.flatnonzero(new), len(pairs)])
                each, top = np.repeat(np.where(hit, n[at], 0), times), np.repeat(hit & best[at], times)
                n_best += np.bincount(rows, top, len(total)).astype(np.int64)
                # two halves, so that the sums of doubles are exact
                total += np.bincount(rows, each & 0xFFFFFF, len(total)).astype(np.int64) + (np.bincount(rows, each >> 24, len(total)).astype(np.int64) << 24)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("a_ids"), batch.column("b_ids"), pa.array(n_best), pa.array(total)], names=["row", *own])

    done = packed.mapInArrow(work, packed.schema)
    return done.select(*[(F.col(c) if c in own else F.col("row")[c]).alias(c) for c in aligned.columns])
