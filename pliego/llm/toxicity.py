"""Toxicity by subword bags: averaged embeddings under a linear softmax, trained jointly in numpy.

A word's features are its character n-grams (of three to five bytes of UTF-8, A-Z as a-z, with marks
for the word's ends), each hashed to a row of one embedding table, so a misspelling that was never
seen shares most of its rows with the word that was. A passage of a few words is the average of its
rows, and a softmax over two classes gives its toxicity. A text is as toxic as its worst passage:
training follows the same rule, so a long clean text doesn't hide a few toxic words, and a label of a
whole text teaches the passage that earned it. As the softmax is linear, scoring needs only one
number per row of the table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pliego.llm import words as W
from pliego.llm.common import removed, written

TABLE_BITS, WIDTH, PASSAGE = 17, 8, 8
#: Labelled rows that a classifier is fitted on at most, chosen by a hash of doc_id, and bytes of their texts.
SAMPLE, BYTES = 4000, 48_000_000
THRESHOLD = 0.3
#: The weight in training of an empty bag, as a share of all texts.
EMPTY = 0.03


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table rows of all n-grams in word order, each word's number of them, and the rows' first words."""
    data, offsets = W.raw(column)
    data = W.LOWER[data]
    starts, ends, firsts = W.spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), firsts
    # words with a mark at either end, packed one after another
    sizes = ends - starts + 2
    begin = np.cumsum(sizes) - sizes
    packed = np.full(int(sizes.sum()) + 8, 0x20, np.uint8)
    inner = np.ones(int(sizes.sum()), bool)
    inner[begin] = inner[begin + sizes - 1] = False
    packed[:-8][inner] = data[~W.SPACES[data]]
    eight = np.ndarray((len(packed) - 7,), np.dtype("<u8"), packed, strides=(1,))[: len(inner)]
    left = np.repeat(begin + sizes, sizes) - np.arange(len(inner))
    grams = []
    for n in (3, 4, 5):
        hashed = (eight & np.uint64(2 ** (8 * n) - 1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
        grams.append(((hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - TABLE_BITS))
    valid = np.stack([left >= n for n in (3, 4, 5)], 1)
    rows = np.stack(grams, 1)[valid].astype(np.int64)
    per = np.add.reduceat(valid.sum(1), begin)
    return rows, per, firsts


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, the words' starts and ends, the texts' first words and a hash of each running word."""
    data, offsets = W.raw(column)
    data = W.LOWER[data]
    starts, ends, firsts = W.spans(data, offsets)
    return data, starts, ends, firsts, W.hashes(data, starts, ends)


def passages(sums: np.ndarray, counts: np.ndarray, firsts: np.ndarray, width: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means over each run of `width` words of a text (of the whole text if it is shorter), with the runs' ends.

    Returned: the means, and the first and last word of each run; runs are in order of texts.
    """
    total, number = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    last = np.repeat(firsts[1:], np.diff(firsts))
    begin = np.arange(len(sums))
    whole = np.repeat(firsts[:-1], np.diff(firsts))
    # the runs at a text's end begin earlier, so that each has all its words
    begin = np.minimum(begin, np.maximum(last - width, whole))
    end = np.minimum(begin + width, last)
    return (total[end] - total[begin]) / np.maximum(number[end] - number[begin], 1), begin, end


@dataclass
class Model:
    gain: np.ndarray  # of each table row: what it adds to the logit
    bias: float
    blank: float  # the score of texts without a word

    def score(self, column: pa.Array) -> np.ndarray:
        """Probabilities; a text without a word, or null, has the score `blank`."""
        rows, per, firsts = features(column)
        out = np.full(len(column), self.blank)
        if len(per):
            ends = np.cumsum(per)
            sums = np.concatenate([[0.0], np.cumsum(self.gain[rows], dtype=np.float64)])
            means, _, _ = passages(sums[ends] - sums[ends - per], per, firsts)
            some = np.flatnonzero(np.diff(firsts))
            out[some] = 1 / (1 + np.exp(-(np.maximum.reduceat(means, firsts[:-1][some]) + self.bias)))
        return out


@dataclass
class Sample:
    """Labelled texts as numbers: what training needs of them, without the texts."""

    word: np.ndarray  # of each running word its place in the vocabulary
    firsts: np.ndarray  # the texts' first words, and their number
    toxic: np.ndarray
    rows: np.ndarray  # table rows of the vocabulary's words, one word after another
    per: np.ndarray  # each word's number of rows

    def pieces(self, most: int = 100_000) -> Iterator[slice]:
        """Runs of whole texts with about `most` words each."""
        start, count = 0, len(self.firsts) - 1
        while start < count:
            stop = max(start + 1, int(np.searchsorted(self.firsts, self.firsts[start] + most, "right")) - 1)
            yield slice(start, stop)
            start = stop


def train(sample: Sample, rounds: int = 100, rate: float = 0.05, seed: int = 7) -> tuple[np.ndarray, float]:
    """Fit the table and the softmax together by Adam on the log loss of each text's worst passage.

    Every text has a word. Gradients are summed over pieces of the sample, so memory is that of one piece. An empty
    bag counts as clean with the weight of a share EMPTY of the texts, so that words of which no label speaks don't
    make a text toxic.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (2**TABLE_BITS, WIDTH)).astype(np.float32)
    softmax = rng.normal(0, 0.1, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    params, first, second = [table, softmax, bias], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]
    begin_of = np.cumsum(sample.per) - sample.per
    for step in range(1, rounds + 1):
        gain = table @ (softmax[:, 1] - softmax[:, 0])
        of_word = np.add.reduceat(gain[sample.rows], begin_of)
        weight = np.zeros(len(sample.per))
        offset = float(bias[1] - bias[0])
        lift = EMPTY / (1 + np.exp(-offset))
        for piece in sample.pieces():
            firsts = sample.firsts[piece.start : piece.stop + 1]
            word = sample.word[firsts[0] : firsts[-1]]
            firsts = firsts - firsts[0]
            means, begin, end = passages(of_word[word], sample.per[word], firsts)
            worst = np.maximum.reduceat(means, firsts[:-1])
            top = np.flatnonzero(means == np.repeat(worst, np.diff(firsts)))
            chosen = np.zeros(len(worst), np.int64)
            chosen[(np.searchsorted(firsts, top, "right") - 1)[::-1]] = top[::-1]
            slope = (1 / (1 + np.exp(-(worst + offset))) - sample.toxic[piece]) / len(sample.toxic)
            # the words of the chosen passages, each with its share of the text's slope
            sizes = end[chosen] - begin[chosen]
            own = np.repeat(np.arange(len(worst)), sizes)
            picked = word[np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin[chosen], sizes)]
            shared = slope / np.maximum(np.bincount(own, sample.per[picked], len(worst)), 1)
            weight += np.bincount(picked, shared[own], len(weight))
            lift += float(slope.sum())
        pull = np.bincount(sample.rows, np.repeat(weight, sample.per), 2**TABLE_BITS).astype(np.float32)
        inner = pull @ table
        grads = [np.outer(pull, softmax[:, 1] - softmax[:, 0]) + 1e-7 * table, np.stack([-inner, inner], 1), np.array([-lift, lift], np.float32)]
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            p -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return (table @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = BYTES) -> Model:
    """A model from at most `sample` labelled rows that aren't held out, of `most` bytes of text together at most.

    The rows are those with the smallest hashes of doc_id, as far as the bytes go. Of rows that share a
    doc_id the text that sorts first counts. Null labels and null texts teach nothing. Texts without a word
    score the share of toxic ones among such rows of the sample, 0 if it has none. Without a worded row of
    either class the model gives every text the share of toxic rows (0 without rows).

    Only numbers come to the driver: a hash of each running word of the sample, and its distinct words.
    """
    known = labels.select("doc_id", "toxic").where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    held = written(texts.withColumn("upto", upto).where(F.col("upto") <= most).drop("upto"))

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            _, _, _, firsts, hashed = _hashed(batch.column("text"))
            parts = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((firsts * 8).astype(np.int32)), pa.py_buffer(hashed.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), parts], names=["doc_id", "toxic", "words"])

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            data, starts, ends, _, hashed = _hashed(batch.column("text"))
            keys, one = np.unique(hashed, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(keys)), pa.array([data[starts[i] : ends[i]].tobytes() for i in one], pa.binary())], names=["key", "word"])

    got = held.mapInArrow(numbered, "doc_id long, toxic int, words binary").toArrow().sort_by("doc_id")
    y = (got.column("toxic").to_numpy() > 0).astype(np.float32)
    sizes = pc.binary_length(got.column("words")).to_numpy().astype(np.int64) // 8
    worded = sizes > 0
    blank = float(y[~worded].mean()) if (~worded).any() else 0.0
    toxic = y[worded]
    if not 0 < toxic.sum() < len(toxic):
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(2**TABLE_BITS, np.float32), float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), share)
    vocabulary = held.select("text").mapInArrow(distinct, "key long, word binary").dropDuplicates(["key"]).toArrow().sort_by("key")
    removed(held)
    keys = vocabulary.column("key").to_numpy()
    word = np.concatenate([np.searchsorted(keys, np.frombuffer(w, np.int64)).astype(np.int32) for w in got.column("words").to_pylist()])
    listed = vocabulary.column("word").to_pylist()
    del got, vocabulary, keys
    rows, per = [], []
    for i in range(0, len(listed), 10_000):
        part, own, _ = features(pa.array([b" ".join(listed[i : i + 10_000])], pa.binary()))
        rows.append(part.astype(np.int32))
        per.append(own)
    rows, per = np.concatenate(rows), np.concatenate(per)
    del listed
    gain, bias = train(Sample(word, np.concatenate([[0], np.cumsum(sizes[worded])]), toxic, rows, per))
    return Model(gain, bias, blank)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for each whole text of `docs`, repeated rows included.

    The model is one number per table row (half a megabyte), sent to executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, most=500_000):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that aren't toxic, with all their columns. Null and wordless texts go only if most labelled ones of them are toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, most=500_000):
            clean = shared.value.score(batch.column("text")) < THRESHOLD
            yield batch.select(["row"]).filter(pa.array(clean))

    return packed.mapInArrow(work, packed.select("row").schema).select("row.*")
