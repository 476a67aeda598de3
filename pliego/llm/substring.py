"""Exact removal of passages that an earlier document has, by a compressed FM-index per shard.

1. Each window of `width` words has an anchor: the smallest hash of its runs of ten words. Equal
   windows have equal anchors, and neighbouring windows mostly share theirs, so a document falls into
   short stretches with one anchor each (about one per 21 words).
2. Anchors in one document only are dropped with a shuffle of hashes alone; equal stretches count once.
3. The other distinct stretches go to shards by anchor. A shard indexes its stretches (Burrows-Wheeler
   transform in a wavelet matrix) and streams them through it by backward search; windows whose matching
   statistic reaches `width` give the smallest document that has them.
4. An anchor with over SHARD words is indexed in several blocks; its stretches stream through all.
5. Windows that a smaller doc_id has become spans of words, and documents are rewritten.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pliego.llm import words as W
from pliego.llm.common import cut, removed, written
from pliego.llm.fmindex import FMIndex
from pliego.llm.tables import narrowed

RUN, SHARD = 10, 250_000
#: Windows in a stretch at most (texts that repeat one word have a single anchor).
LONGEST = 200


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - span : width - span + len(values) - width + 1])


def run_hashes(hashed: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... neighbours, up to `longest` of them."""
    out, span = [hashed], 1
    while 2 * span <= min(longest, len(hashed)):
        half = out[-1]
        both = half[:-span] * np.uint64(0xD6E8FEB86659FD93) + half[span:]
        both ^= both >> np.uint64(29)
        both *= np.uint64(0x9E3779B97F4A7C15)
        both ^= both >> np.uint64(32)
        out.append(both)
        span *= 2
    return out


def joined_hashes(runs: list[np.ndarray], start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each stretch of words: of the two longest runs of a power of two that together cover it."""
    level = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    out = np.zeros(len(start), np.uint64)
    for i in np.unique(level):
        own = level == i
        first = start[own]
        out[own] = runs[i][first] * np.uint64(0xD6E8FEB86659FD93) + runs[i][first + sizes[own] - 2**i]
    return W.mix(out + sizes.astype(np.uint64))


def stretches(hashed: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, first window's place among all words, windows, anchor, hash) of each stretch."""
    run = min(RUN, width)
    none = np.zeros(0, np.int64)
    at, row = W.window_rows(firsts, width)
    if not len(at):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    runs = run_hashes(hashed, LONGEST + width)
    level = run.bit_length() - 1
    of_run = W.mix(runs[level][: len(hashed) - run + 1] * np.uint64(0xD6E8FEB86659FD93) + runs[level][run - 2**level :])
    anchor = minima(of_run, width - run + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    # long stretches are cut where the number of windows so far is a multiple
    parts = -(-count // LONGEST)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    head = np.repeat(head, parts) + step * LONGEST
    count = np.minimum(np.repeat(count, parts) - step * LONGEST, LONGEST)
    start = at[head]
    return row[head], start, count, anchor[head], joined_hashes(runs, start, count + width - 1)


STRETCH = "doc_id long, text_key long, anchor long, stretch long, start int, windows int"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_key) of all rows: those that share a doc_id are told apart by a hash of their text."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.withColumn("text_key", F.xxhash64("text"))


def split(docs: DataFrame, width: int) -> DataFrame:
    """The stretches of all documents, without their words."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            data, offsets = W.raw(batch.column("text"))
            starts, ends, firsts = W.spans(data, offsets)
            row, start, count, anchor, stretch = stretches(W.hashes(data, starts, ends), firsts, width)
            own = pa.array(row)
            columns = [batch.column("doc_id").take(own), batch.column("text_key").take(own), pa.array(W.signed(anchor)), pa.array(W.signed(stretch)), pa.array((start - firsts[row]).astype(np.int32)), pa.array(count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STRETCH.split(", ")])

    return docs.mapInArrow(work, STRETCH)


def with_words(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(anchor, stretch, doc_id, blocks, words) of chosen stretches, with the bytes of their words: one row per document becomes a row per stretch."""
    per_doc = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "anchor", "stretch", "start", "size", "blocks")).alias("parts"))
    schema = "anchor long, stretch long, doc_id long, blocks int, words binary"

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            data, offsets = W.raw(batch.column("text"))
            starts, ends, firsts = W.spans(data, offsets)
            keys = batch.column("text_key").to_numpy()
            parts = batch.column("parts")
            flat = parts.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))
            own = flat.field(0).to_numpy() == keys[row]
            row, flat = row[own], flat.filter(pa.array(own))
            first = flat.field(3).to_numpy().astype(np.int64) + firsts[row]
            last = first + flat.field(4).to_numpy() - 1
            blob = data.tobytes()
            words = [blob[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([flat.field(1), flat.field(2), batch.column("doc_id").take(pa.array(row)), flat.field(5), pa.array(words, pa.binary())], names=["anchor", "stretch", "doc_id", "blocks", "words"])

    wanted = narrowed(docs, per_doc.select("doc_id"))
    return wanted.join(per_doc, "doc_id").select("doc_id", "text", "text_key", "parts").mapInArrow(work, schema)


RESULT = "anchor long, stretch long, first long, flags binary"


def search(stretched: DataFrame, words: int, width: int) -> DataFrame:
    """For each stretch with a window that a smaller doc_id has: a byte for each window, 1 where that is so.

    Shards hold about SHARD words; a task works on several, one after another.
    """
    shards = max(1, -(-words // SHARD))
    tasks = max(min(shards, int(stretched.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-shards // 64))
    own = F.pmod(F.xxhash64("stretch"), F.col("blocks")).cast("int")
    rows = stretched.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    home = F.when(F.col("blocks") > 1, F.xxhash64("anchor", "block")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    rows = rows.select("anchor", "stretch", "doc_id", "words", (F.col("own") == F.col("block")).alias("indexed"), home.alias("home"))
    ordered = rows.repartition(tasks, "home").sortWithinPartitions("home", "anchor", F.desc("indexed"), "stretch")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexed, queue, index = [], [], None
        now, held, last = None, 0, None

        def results(rows: list[tuple]) -> pa.RecordBatch:
            found = index.stream([r[3] for r in rows])
            earlier = [(x >= 0) & (x < r[2]) for r, x in zip(rows, found, strict=True)]
            hits = [(*r[:3], e.tobytes()) for r, e in zip(rows, earlier, strict=True) if e.any()]
            columns = zip(*hits, strict=True) if hits else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "stretch", "first", "flags"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal index
            if index is None and indexed:
                index = FMIndex([r[3] for r in indexed], np.array([r[2] for r in indexed], np.int64), width)
                for at in range(0, len(indexed), 20_000):
                    yield results(indexed[at : at + 20_000])
            if index is not None and queue:
                yield results(queue)
            indexed.clear()
            queue.clear()

        for batch in W.slices(batches, "words"):
            data, offsets = W.raw(batch.column("words"))
            starts, ends, firsts = W.spans(data, offsets)
            hashed, edges = W.hashes(data, starts, ends), firsts.tolist()
            for i, (anchor, stretch, doc, inside, home) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("anchor", "stretch", "doc_id", "indexed", "home")), strict=True)):
                if home != now or (held > SHARD and anchor != last):
                    yield from flush()
                    now, held, index = home, 0, None
                last = anchor
                part = hashed[edges[i] : edges[i + 1]]
                if inside:
                    held += len(part)
                    indexed.append((anchor, stretch, doc, part))
                else:  # the block's index is complete: what isn't in it only streams through
                    queue.append((anchor, stretch, doc, part))
                    if len(queue) == 20_000:
                        yield from flush()
        yield from flush()

    return ordered.mapInArrow(work, RESULT)


def repeated_spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, text_key, start, windows, flags): windows of each document that a smaller doc_id has.

    start counts words; flags has a byte for each of the windows, or is null where all are meant.
    """
    rows = keyed(docs).where("doc_id is not null")
    light = written(split(rows, width))
    shared = light.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    found = written(light.join(shared, "anchor"))
    removed(light)
    distinct = written(found.groupBy("anchor", "stretch").agg(F.min(F.struct("doc_id", "text_key", "start", (F.col("windows") + width - 1).alias("size"))).alias("m")).select("anchor", "stretch", "m.*"))
    per_anchor = distinct.groupBy("anchor").agg(F.sum("size").alias("words")).where(F.col("words") > SHARD)
    blocks = per_anchor.select("anchor", F.ceil(F.col("words") / SHARD).cast("int").alias("blocks"))
    chosen = distinct.join(blocks, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    total = distinct.agg(F.sum("size")).first()[0] or 0
    hits = cut(search(with_words(rows, chosen), total, width))
    # a document that isn't the first with a stretch loses all its windows
    firsts = distinct.select("anchor", "stretch", F.col("doc_id").alias("first"))
    later = found.join(firsts, ["anchor", "stretch"]).where(F.col("doc_id") > F.col("first")).select("doc_id", "text_key", "start", "windows", F.lit(None).cast("binary").alias("flags"))
    own = found.join(hits, ["anchor", "stretch"]).where(F.col("doc_id") == F.col("first")).select("doc_id", "text_key", "start", "windows", "flags")
    return later.unionByName(own)


REWRITTEN = "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of each row of `docs`.

    A word goes if it lies in a window of `width` consecutive words that also starts in a document with
    a smaller doc_id. Windows are judged on the input. Kept words are joined by one space; words are
    runs of bytes other than space and 09 to 0D, compared unchanged. A null text has no words. Rows that
    share a doc_id don't count as earlier than each other; rows without a doc_id lose nothing.
    """
    spans = repeated_spans(docs, width)
    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "start", "windows", "flags")).alias("parts"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            data, offsets = W.raw(batch.column("text"))
            starts, ends, firsts = W.spans(data, offsets)
            keys = batch.column("text_key").to_numpy()
            cover = np.zeros(len(starts) + 1, np.int64)
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                for part in parts or ():
                    if part["text_key"] != keys[i]:
                        continue
                    begin = firsts[i] + part["start"]
                    if part["flags"] is None:
                        cover[begin] += 1
                        cover[begin + part["windows"] + width - 1] -= 1
                    else:
                        hit = begin + np.flatnonzero(np.frombuffer(part["flags"], np.uint8))
                        cover[hit] += 1
                        cover[hit + width] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            texts = joined(data, starts, ends, firsts, ~gone)
            lost = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(firsts), pa.int64()), pa.array(lost[firsts[1:]] - lost[firsts[:-1]], pa.int64()), texts], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return keyed(docs).join(per_doc, "doc_id", "left").select("doc_id", "text", "text_key", "parts").mapInArrow(work, REWRITTEN)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[keep]
    starts, ends = starts[keep], ends[keep]
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    out = data.copy()
    stops = np.where(last, ends, ends + 1)
    out[ends[~last]] = 0x20
    sizes = stops - starts
    places = np.concatenate([[0], np.cumsum(sizes)])
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    kept = out[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    bounds = places[np.searchsorted(row, np.arange(len(firsts)))]
    return pa.Array.from_buffers(pa.string(), len(firsts) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(kept.tobytes())])
