"""Mixing sources to target weights, by thresholds on a hash.

Every document has a hash of 60 bits, from its key. A source that is to give x times its size gives
floor(x) copies of each document, and one more of those whose hash is below a threshold. The
threshold comes from histograms: words by source and leading bits of the hash; the bucket in which
the running sum passes the budget is looked at again by the next bits, and so on until single
documents remain. No step sorts documents, and a source of any size has 4096 buckets at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pliego.llm.common import cut, word_count

#: Bits that each look at the histogram adds, and the number of looks: 60 bits in all.
BITS, LOOKS = 12, 5
#: Sources whose rows are broadcast at most, and parts into which documents of each are dealt otherwise.
SMALL, SALTS = 50_000, 64


def place(key: Column) -> Column:
    """A document's place in 0 .. 2^60 - 1, the same in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Each source's target: (source, source_size, target), of a table (source, source_size).

    Sources in order of code points, null last, take `weights` in turn and share `share` times the
    words of all; none gets over `most` times its own words, and what is above is shared out anew by
    weight. That has one solution, found in a single pass over the sources by size per weight. The
    table has a row for each source; documents aren't touched.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    full = F.lit(float(most)) * F.col("source_size")
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = weighed.withColumn("level", left / rest).withColumn("capped", F.col("level") * F.col("weight") >= full)
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)  # the first that isn't capped
    return ranked.withColumn("target", F.when(F.col("capped"), full).otherwise(level * F.col("weight"))).select("source", "source_size", "target")


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Each source's copies of every document and the place below which there is one more: (source, copies, below).

    `sized`: (source, place, size), one row per document; `goals`: what `targets` returns. At the last
    bucket the nearer side of the budget is taken, so a source misses its target by half of one
    document at most.
    """
    per = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.select(_key(F.col("source")).alias("key"), per.alias("copies"), (F.col("target") - per * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("edge"))
    docs = sized.select(_key(F.col("source")).alias("key"), "place", "size")
    for look in range(1, LOOKS + 1):
        shift = BITS * (LOOKS - look)
        held = per_document(docs, state.select("key", "edge")).where(F.shiftright("place", shift + BITS) == F.col("edge"))
        sums = held.groupBy("key", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("key").orderBy("bucket")))
        passed = sums.join(state.select("key", "budget"), "key").where(F.col("upto") > F.col("budget"))
        first = passed.groupBy("key").agg(F.min(F.struct("bucket", "upto", "words")).alias("at"))
        spent = F.coalesce(F.col("at.upto") - F.col("at.words"), F.lit(0))
        state = state.drop("edge").join(first, "key", "left").select(
            "key", "copies", (F.col("budget") - spent).alias("budget"), F.coalesce("at.bucket", F.lit(-1).cast("long")).alias("edge"), F.coalesce("at.words", F.lit(0)).alias("words")
        )
        # a row per source: written, so that the plan doesn't grow with each look
        state = cut(state.drop("words") if look < LOOKS else state)
    below = F.col("edge") + F.when(F.col("budget") * 2 > F.col("words"), 1).otherwise(0)
    return state.select("key", "copies", F.when(F.col("edge") < 0, 0).otherwise(below).cast("long").alias("below"))


def per_document(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its source's row, by `key`, so that no source's documents meet in one task.

    A table of sources is broadcast if it has SMALL rows at most, with keys of 64 bytes each on average; a larger
    one is joined, with its rows once for each of SALTS parts into which documents are dealt.
    """
    rows, size = sources.agg(F.count("*"), F.sum(F.octet_length("key").cast("long"))).first()
    if rows <= SMALL and (size or 0) <= 64 * SMALL:
        return docs.join(F.broadcast(sources), "key")
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)))
    return salted.join(sources.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["key", "salt"]).drop("salt")


def _key(source: Column) -> Column:
    """A source's name as a join key that also stands for null."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def plan(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies.

    Size is the number of words (runs other than space and 09 to 0D; none in a null). Documents
    without words, and all documents of a source without words, have no copies. Rows with the same
    doc_id and source share a place, so they are taken alike. Other columns have no effect.
    """
    sized = cut(docs.select("doc_id", "source", place(F.col("doc_id")).alias("place"), word_count(F.col("text")).alias("size")))
    goals = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    limits = thresholds(sized, goals)
    per_source = cut(goals.select(_key(F.col("source")).alias("key"), "source_size", "target").join(limits, "key"))
    taken = F.col("copies") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)
    return (
        sized.withColumn("key", _key(F.col("source")))
        .transform(per_document, per_source)
        .select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("copies"))
    )


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus: each row of `docs` as often as `plan` says, with all its columns and no others."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sized = cut(row.select("row.source", place(F.col("row.doc_id")).alias("place"), word_count(F.col("row.text")).alias("size")))
    goals = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    rows = row.withColumn("key", _key(F.col("row.source"))).withColumn("place", place(F.col("row.doc_id")))
    taken = F.col("copies") + F.when(F.col("place") < F.col("below"), 1).otherwise(0)
    worded = F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = per_document(rows, thresholds(sized, goals)).where(worded).withColumn("taken", taken.cast("int")).where("taken > 0")
    return kept.select(F.explode(F.array_repeat("row", F.col("taken"))).alias("row")).select("row.*")
