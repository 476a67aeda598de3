"""Structured Streaming over event files (an extension: the batch operators don't need it).

Sinks write each micro-batch to a folder of its own by overwriting, so a batch that is run again after
a failure leaves the same rows. Readers take the last version of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pliego.operators import ranking


#: Event times without a zone count as UTC, since only instants can have a watermark.
INSTANT = "timestamp'1970-01-01 00:00:00Z' + (ts - timestamp_ntz'1970-01-01 00:00:00')"
LOCAL = "timestamp_ntz'1970-01-01 00:00:00' + (w.start - timestamp'1970-01-01 00:00:00Z')"


def follow(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder, as a stream with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, keys: list[str], width: str, late: str) -> DataFrame:
    """Number of events and sum of values of each key and window of event time; state ends `late` after a window."""
    grouped = events.withColumn("ts", F.expr(INSTANT)).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum("amount").alias("amount")).select(F.expr(LOCAL).alias("start"), *keys, "n", "amount")


def once(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each event once, though it may be sent again up to `late` later."""
    return events.withColumn("at", F.expr(INSTANT)).withWatermark("at", late).dropDuplicatesWithinWatermark([key]).drop("at")


def run_available(stream: DataFrame, folder: str, mode: str = "update") -> None:
    """Work on all that is there, then stop; the next call with this folder goes on from there."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The last version of each key that the stream has written."""
    return ranking.latest(spark.read.parquet(f"{folder}/out"), keys, ["batch"]).drop("batch")


def remembered(answers: DataFrame, now: Column, found_for: str, missing_for: str) -> DataFrame:
    """Cached answers (key, found, at) that still hold: those of nothing found expire sooner."""
    last = ranking.latest(answers, ["key"], ["at"])
    return last.where(now < F.col("at") + F.when(F.col("found"), F.expr(f"interval {found_for}")).otherwise(F.expr(f"interval {missing_for}")))
