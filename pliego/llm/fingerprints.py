"""Homomorphic fingerprints of documents: sums of wide vectors hashed from paragraphs, modulo powers of two.

A text is taken as the multiset of its paragraphs (the parts between line feeds, empty ones too).
Each paragraph has a vector; a fingerprint is the sum of the vectors of its paragraphs. So the order
of paragraphs doesn't matter, and a paragraph is put in or taken out by adding or subtracting its own
fingerprint (`added`, `taken`), without the rest of the text.

A vector has two parts. `EXACT` lanes modulo 2^64 come from 128 bits of hash of the whole paragraph:
equal sums mean equal multisets. `LANES` lanes modulo 2^32 are a signed sketch of the paragraph's
stretches of 16 bytes (one ending at each byte, zeros before the first): the squared length of a
difference of two sketches estimates by how much the stretches of two texts differ, with a standard
error of about sqrt(2 / LANES) of it, which gives `likeness`.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm import words as W

EXACT, LANES = 8, 128
#: Bytes whose stretches are hashed at a time, so that one huge text needs no more.
SPAN = 2**20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each paragraph of texts that lie one after another, in order. Every text has one at least."""
    feeds = np.flatnonzero(data == 10)
    rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, "right") - 1])
    starts = np.concatenate([offsets[:-1], feeds + 1])
    order = np.lexsort([starts, rows])
    rows, starts = rows[order], starts[order]
    ends = offsets[rows + 1].copy()
    inner = np.flatnonzero(rows[1:] == rows[:-1])
    ends[inner] = starts[inner + 1] - 1
    return rows, starts, ends


def _exact(data: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the exact lanes, one line for each text."""
    both = W.hashes(data, starts, ends), W.hashes(255 - data, starts, ends)
    firsts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    steps = np.arange(1, EXACT + 1, dtype=np.uint64) * _STEP
    lanes = [np.add.reduceat(W.mix(both[j % 2] + steps[j]), firsts) for j in range(EXACT)]
    return np.stack(lanes, axis=1)


def _sketch(data: np.ndarray, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int) -> np.ndarray:
    """Sums of the sketch's lanes, one line for each text."""
    total = np.zeros(count * LANES, np.int64)
    sizes = ends - starts
    padded = np.concatenate([np.zeros(16, np.uint8), data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 17,), np.dtype("<u8"), padded, strides=(1,))
    upto = np.cumsum(sizes)
    for low in range(0, int(upto[-1]) if len(upto) else 0, SPAN):
        high = min(low + SPAN, int(upto[-1]))
        i, j = np.searchsorted(upto, low, "right"), np.searchsorted(upto, high, "left") + 1
        part = np.minimum(upto[i:j], high) - np.maximum(upto[i:j] - sizes[i:j], low)
        of = np.repeat(np.arange(i, j), part)
        own = np.arange(low, high) - (upto[of] - sizes[of])  # place within the paragraph
        at = starts[of] + own
        near = _kept(eight[at + 9], own + 1)
        far = _kept(eight[at + 1], own - 7)
        mixed = W.mix((W.mix(near * _STEP + np.uint64(1)) ^ far) * _STEP)
        # twice the place, plus the sign
        where = ((rows[of] * LANES + (mixed >> np.uint64(57)).astype(np.int64)) << 1) | (mixed & np.uint64(1)).astype(np.int64)
        first = int(rows[i]) * LANES
        counts = np.bincount(where - 2 * first)
        counts = np.concatenate([counts, np.zeros(len(counts) % 2, np.int64)])
        total[first : first + len(counts) // 2] += counts[0::2] - counts[1::2]
    return total.reshape(count, LANES).astype(np.uint64).astype(np.uint32)


def _kept(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The last `valid` (0 to 8) of eight little-endian bytes each."""
    gone = (8 * (8 - np.clip(valid, 1, 8))).astype(np.uint64)
    return np.where(valid > 0, values >> gone, np.uint64(0))


def fingerprints(texts: list[bytes]) -> list[bytes]:
    """A fingerprint of each text, 576 bytes: the exact lanes, then the sketch, little-endian."""
    if not texts:
        return []
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = paragraphs(data, offsets)
    exact, sketch = _exact(data, *found), _sketch(data, *found, len(texts))
    return [e.astype("<u8").tobytes() + s.astype("<u4").tobytes() for e, s in zip(exact, sketch, strict=True)]


def _parts(fingerprint: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(fingerprint, "<u8", EXACT), np.frombuffer(fingerprint, "<u4", LANES, 8 * EXACT)


def added(one: bytes, other: bytes) -> bytes:
    """The fingerprint of the paragraphs of both."""
    return b"".join((a + b).tobytes() for a, b in zip(_parts(one), _parts(other), strict=True))


def taken(one: bytes, other: bytes) -> bytes:
    """The fingerprint of the paragraphs of one without those of the other, which it must hold."""
    return b"".join((a - b).tobytes() for a, b in zip(_parts(one), _parts(other), strict=True))


def likeness(one: bytes, other: bytes) -> float:
    """0 to 1: twice the shared weight of stretches over the weight of both, estimated. 1 for equal fingerprints only."""
    if one == other:
        return 1.0
    a, b = (_parts(f)[1].view("<i4").astype(np.float64) for f in (one, other))
    both = (a * a).sum() + (b * b).sum()
    apart = ((a - b) ** 2).sum()
    return float(min(max(1.0 - apart / both, 0.0), np.nextafter(1.0, 0.0))) if both else 0.0


def _order(doc_id: int | None, mark: int) -> tuple:
    return doc_id is not None, doc_id or 0, mark


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add fingerprint (binary) to each row; a column of that name is replaced. A null counts as an empty text."""
    packed = docs.select(F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "fingerprint"]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            made = fingerprints([t.encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.binary())], names=["row", "fingerprint"])

    done = packed.mapInArrow(work, packed.selectExpr("row", "cast('' as binary) fingerprint").schema)
    return done.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "fingerprint"], "fingerprint")


def neighbours(docs: DataFrame, stretches: int | None = None) -> DataFrame:
    """(stretch, ahead, doc_id, text) in stretches of ascending doc_id: each task has whole stretches, in order.

    The last rows of a stretch (ahead = 1) are copies of the first of the next one (of the first stretch
    after the last), so every document stands right before the one that follows it. Rows of one doc_id
    follow each other by a hash of their text, then by text; null ids come first. Only ids and
    hashes are sorted to find where stretches begin, and only these beginnings reach the driver, one for
    each stretch; texts are shuffled once.
    """
    spark = docs.sparkSession
    count = stretches or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    dealt = rows.select("doc_id", "mark").repartitionByRange(count, F.col("doc_id").asc_nulls_first(), "mark")
    firsts = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "mark")).alias("first")).collect()
    bounds = sorted(_order(r.first.doc_id, r.first.mark) for r in firsts)

    @F.pandas_udf("array<struct<stretch:int,ahead:int>>")
    def stretch(ids: pd.Series, given: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for key in map(_order, [int(i) if g else None for i, g in zip(ids, given, strict=True)], marks.tolist()):
            k = max(bisect_right(bounds, key) - 1, 0)
            own = [{"stretch": k, "ahead": 0}]
            out.append(own if key != bounds[k] else [*own, {"stretch": (k or len(bounds)) - 1, "ahead": 1}])
        return pd.Series(out, dtype=object)

    placed = rows.withColumn("at", F.explode(stretch(F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNotNull(), "mark")))
    flat = placed.select("at.stretch", "at.ahead", "doc_id", "mark", "text")
    return flat.repartition("stretch").sortWithinPartitions("stretch", "ahead", F.col("doc_id").asc_nulls_first(), "mark", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_edited(docs: DataFrame, stretches: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many, or
    all, of the document with the next doc_id; the first one follows the last. Texts shorter than four
    code points stay as they are. Null texts are empty, empty ones equal each other, repeated rows stay
    rows of their own, other columns aren't kept. Fingerprints are in base 64.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, which waits for the next one
        for batch in W.slices(batches):
            texts, ahead, ids = batch.column("text").to_pylist(), batch.column("ahead").to_pylist(), batch.column("doc_id").to_pylist()
            prints = fingerprints([t.encode() for t in texts])
            if held:
                ids, texts, ahead, prints = ([h, *now] for h, now in zip(held, (ids, texts, ahead, prints), strict=True))
            held = ids[-1], texts[-1], ahead[-1], prints[-1]
            own = [i for i in range(len(texts) - 1) if not ahead[i]]
            edited = [_edited(texts[i], texts[i + 1]) for i in own]
            made = fingerprints(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in own], pa.int64()),
                    pa.array([len(texts[i]) for i in own], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                    pa.array([base64.b64encode(prints[i]).decode() for i in own], pa.string()),
                    pa.array([base64.b64encode(m).decode() for m in made], pa.string()),
                    pa.array([likeness(prints[i], m) for i, m in zip(own, made, strict=True)], pa.float64()),
                    pa.array([likeness(prints[i], prints[i + 1]) for i in own], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return neighbours(docs, stretches).mapInArrow(work, RESULT)


def _edited(text: str, following: str) -> bytes:
    size = len(text) // 4
    return (text[: len(text) - size] + following[:size]).encode()
