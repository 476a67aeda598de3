"""Quality rules with thresholds that adapt to language and source.

Each document is measured in one pass over its bytes. The measures go into quantile sketches per
language and source: a sketch counts values in buckets whose bounds grow by a constant factor (as in
DDSketch), so it has a bounded number of counters, a relative error of one per cent at any rank, and
two sketches merge by adding counters. Merging doesn't depend on order, so reruns agree. To each group's
sketch that of its language is added, scaled to the weight of PRIOR documents, and to that of a language
the one of everything: the fewer documents a group has, the more it follows its parent. A document stays if it
passes the fixed base rules and if each rate lies within the fences of its group: a tail quantile, and
beyond it a multiple of its distance from the median.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.llm import words as W

#: Growth of the sketch's bucket bounds: one per cent to either side of a bucket's middle.
GROWTH = 1.02
#: Documents as which a parent's sketch counts in that of a group.
PRIOR = 50
#: Of each rate: the tail quantile that its fences start from, and how many times its distance from the
#: median they lie beyond it. Up to a share of 1 - tail, junk in a group doesn't move its upper fence.
#: Few documents repeat lines at all, so that rate's tail lies far out.
TAILS = {"symbols_per_word": (0.9, 4.0), "dup_line_share": (0.98, 1.0), "chars_per_word": (0.9, 4.0)}
#: Fences are wider by this much, and by twice the sketch's error, so that groups without any spread keep what is like them.
SLACK = {"symbols_per_word": 0.05, "dup_line_share": 0.05, "chars_per_word": 0.25}
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether an equal one comes before it, and whether there is an equal one at all."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    before, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return before, any_


def measure_batch(column: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """The measures of each text of an Arrow column."""
    data, offsets = W.raw(column)
    starts, ends, firsts = W.spans(data, offsets)
    out = {"n_words": np.diff(firsts), "n_symbols": _per_row(SYMBOLS[data], offsets)}
    out["word_chars"] = _per_row(((data & 0xC0) != 0x80) & ~W.SPACES[data], offsets)
    # lines that have a word, as stretches of bytes
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < len(data)], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    row = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[row + 1])
    line_ends = line_ends - ((line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 10))
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    row, line_starts, line_ends = row[worded], line_starts[worded], line_ends[worded]
    salt = W.mix(np.arange(len(offsets), dtype=np.uint64))
    before, _ = _again(W.hashes(data, line_starts, line_ends) ^ salt[row])
    out["n_lines"] = np.bincount(row, minlength=len(column))
    out["n_dup_lines"] = np.bincount(row[before], minlength=len(column))
    # words covered by a window of words that the text has twice
    at, row = W.window_rows(firsts, window)
    found = W.windows(W.hashes(data, starts, ends), window)
    _, twice = _again(found[at] ^ salt[row]) if len(at) else (None, np.zeros(0, bool))
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + window, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(cover[:-1]) > 0, firsts)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of each whole text (see MEASURES), all long. A null has none: zeros."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches):
            found = measure_batch(batch.column("text"))
            kept = [batch.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[m], pa.int64()) for m in MEASURES)], names=["doc_id", "lang", "source", *MEASURES])

    columns = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return columns.mapInArrow(work, "doc_id long, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES))


RATES = {
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "chars_per_word": "word_chars / n_words",
}


def sketches(measured: DataFrame) -> DataFrame:
    """Mergeable sketches: (lang, source, rate, bucket, n); the bucket -2^31 holds zeros."""
    rates = F.explode(F.create_map(*[x for name, rule in RATES.items() for x in (F.lit(name), F.expr(rule))])).alias("rate", "value")
    bucket = F.when(F.col("value") <= 0, F.lit(-(2**31))).otherwise(F.ceil(F.ln("value") / F.ln(F.lit(GROWTH)))).cast("int")
    return measured.select("lang", "source", rates).groupBy("lang", "source", "rate", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _of_rate(values: dict[str, float], rate: str) -> Column:
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), F.col(rate))


def pooled(sketch: DataFrame, parent: DataFrame, by: list[str], up: list[str]) -> DataFrame:
    """The sketches merged by `by`, each with its parent's (merged by `up`) as PRIOR documents: (*by, rate, bucket, n)."""
    own = sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").cast("double").alias("n"))
    scale = parent.groupBy(*up, "rate").agg((PRIOR / F.sum("n")).alias("scale"))
    named = lambda frame: frame.select(*[F.col(c).alias(f"up_{c}") for c in [*up, "rate"]], *[c for c in frame.columns if c not in [*up, "rate"]])
    same = lambda: [F.col(c).eqNullSafe(F.col(f"up_{c}")) for c in [*up, "rate"]]
    groups = own.select(*by, "rate").distinct().join(named(scale), same()).drop(*[f"up_{c}" for c in [*up, "rate"]])
    prior = groups.join(named(parent.select(*up, "rate", "bucket", "n")), same()).select(*by, "rate", "bucket", (F.col("n") * F.col("scale")).alias("n"))
    return own.unionByName(prior).groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Median and tails (see TAILS) of sketches with one row per `by`, rate and bucket: (*by, rate, under, mid, over)."""
    group = Window.partitionBy(*by, "rate")
    value = F.when(F.col("bucket") == -(2**31), 0.0).otherwise(2 * F.pow(F.lit(GROWTH), F.col("bucket")) / (1 + GROWTH))
    tail = _of_rate({k: t for k, (t, _) in TAILS.items()}, "rate")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketch.withColumn("upto", upto).withColumn("value", value).withColumn("tail", tail)
    total = ranked.groupBy(*[F.col(c).alias(f"of_{c}") for c in [*by, "rate"]]).agg(F.max("upto").alias("docs"))
    ranked = ranked.join(total, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in [*by, "rate"]])
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("docs") * q * (1 - 1e-12), F.col("value")))
    return ranked.groupBy(*by, "rate").agg(at(1 - F.col("tail")).alias("under"), at(F.lit(0.5)).alias("mid"), at(F.col("tail")).alias("over"))


def fences(sketch: DataFrame) -> DataFrame:
    """Upper and lower fences of each group (lang, source): one map of rates to (low, high)."""
    everything = sketch.groupBy("rate", "bucket").agg(F.sum("n").cast("double").alias("n"))
    langs = pooled(sketch, everything, ["lang"], [])
    found = quantiles(pooled(sketch, langs, ["lang", "source"], ["lang"]), ["lang", "source"])
    under, mid, over = F.col("under"), F.col("mid"), F.col("over")
    reach, slack = _of_rate({k: r for k, (_, r) in TAILS.items()}, "rate"), _of_rate(SLACK, "rate")
    # too few symbols or repeated lines are no fault
    low = F.when(F.col("rate") == "chars_per_word", (under - reach * (mid - under)) * (2 - GROWTH) - slack).otherwise(F.lit(-1.0))
    high = (over + reach * (over - mid)) * GROWTH + slack
    return found.select("lang", "source", "rate", low.alias("low"), high.alias("high")).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("rate", F.struct("low", "high")))).alias("fence"))


def apply(docs: DataFrame, least_words: int = 20, most_repeats: int = 30) -> DataFrame:
    """doc_id, lang, source, the measures, base_failed and kept, one row per row of `docs`.

    base_failed: fewer than `least_words` words, or over `most_repeats` per cent of them in windows of
    eight words that the text has twice. The sketches hold the documents that pass that. A null text
    fails it. Null languages and sources are groups like others.
    """
    from pliego.llm.common import cut

    failed = F.expr(f"n_words < {int(least_words)} or 100 * n_repeat_words > {int(most_repeats)} * n_words")
    measured = cut(measure(docs).withColumn("base_failed", failed))
    limits = fences(cut(sketches(measured.where("not base_failed")))).select(F.col("lang").alias("l"), F.col("source").alias("s"), "fence")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    passes = [F.expr(rule).between(F.col("fence")[name]["low"], F.col("fence")[name]["high"]) for name, rule in RATES.items()]
    kept = ~F.col("base_failed")
    for x in passes:
        kept = kept & F.coalesce(x, F.lit(False))
    return joined.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(kept)).drop("l", "s", "fence")
