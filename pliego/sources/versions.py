"""Versioned datasets: a load is written beside the others and becomes visible by one row of a manifest.

Readers take the newest published version, or the one that was pinned last. The manifest is a Parquet folder
that only grows, so the switch is the commit of one small file. Each run writes to a folder of its own, which the
manifest names, so a failed load leaves all that was published as it was, even if it has the id of a former one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "load_id string, status string, n_rows long, detail string, path string, at timestamp"


class CountMismatch(ValueError):
    """A load whose written rows aren't those expected."""


class GateClosed(ValueError):
    """A load that is too small, or too much smaller than the one before."""


def _note(spark: SparkSession, root: str, load_id: str, status: str, n_rows: int | None, detail: str | None, path: str | None = None) -> None:
    row = spark.createDataFrame([(load_id, status, n_rows, detail, path)], "load_id string, status string, n_rows long, detail string, path string")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def publish(rows: DataFrame, root: str, load_id: str, expected: int | None = None, keys: list[str] | None = None) -> int:
    """Write one version, count what was written and make it active; returns its number of rows.

    The count must be `expected` and, with `keys`, no key may be null or come twice. If not, or if writing
    fails, the run is logged as failed, CountMismatch (or the failure) is raised and nothing changes for readers.
    An id that is published already may be given again: its new run takes its place once it has passed.
    """
    spark = rows.sparkSession
    path = f"{root}/load_id={load_id}/run={uuid.uuid4().hex}"
    try:
        rows.write.parquet(path)
        made = spark.read.parquet(path)
        if keys:  # one pass: rows, keys that come twice, keys that are null
            per_key = made.groupBy(*keys).agg(F.count("*").alias("n"))
            null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
            n, wrong = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if((F.col("n") > 1) | null)).first()
        else:
            n, wrong = made.count(), 0
        if expected is not None and n != expected:
            raise CountMismatch(f"{n} rows written, {expected} expected")
        if wrong:
            raise CountMismatch("a key is null or comes twice")
    except Exception as failure:
        _note(spark, root, load_id, "failed", None, str(failure)[:500], path)
        raise
    _note(spark, root, load_id, "published", n, None, path)
    return n


def pin(spark: SparkSession, root: str, load_id: str) -> None:
    """Make a published version the active one, until another is published or pinned."""
    found = log(spark, root).where((F.col("load_id") == load_id) & (F.col("status") == "published")).agg(F.max_by(F.struct("n_rows", "path"), "at").alias("m")).first().m
    if found is None:
        raise FileNotFoundError(f"{load_id} was never published in {root}")
    _note(spark, root, load_id, "published", found.n_rows, "pinned", found.path)


def volume_gate(sources: DataFrame, source: str, whole: int = 400_000, each: int = 50_000, expected: list[str] | None = None) -> DataFrame:
    """Rows of each source: (source, n). Raises GateClosed if all are under `whole` or one (or an absent one of `expected`) is under `each`."""
    counts = sources.groupBy(source).agg(F.count("*").alias("n"))
    kind = sources.schema[source].dataType
    asked = sources.sparkSession.createDataFrame([(e,) for e in expected or []], "source string").select(F.col("source").cast(kind).alias(source), F.lit(0).cast("long").alias("n"))
    sums = counts.unionByName(asked).groupBy(source).agg(F.sum("n").alias("n"))
    total, small = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") < each)).first()
    if small or total < whole:
        named = [str(r[0]) for r in sums.where(F.col("n") < each).orderBy(source).limit(20).collect()]
        raise GateClosed(f"{total} rows; {small} with too few: {', '.join(named) or 'all'}{', ...' if small > len(named) else ''}")
    return counts


def drift_gate(before: int, after: int, fall: float = 0.25, rise: float = 0.5) -> str:
    """ok or warn; raises GateClosed if rows fell by over `fall` of those before."""
    if before and after < before * (1 - fall):
        raise GateClosed(f"{after} rows after {before}")
    return "warn" if before and after > before * (1 + rise) else "ok"


def header_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns that came and went: (column, change), in order of name."""
    rows = [(c, "new") for c in sorted(set(after.columns) - set(before.columns))] + [(c, "removed") for c in sorted(set(before.columns) - set(after.columns))]
    return after.sparkSession.createDataFrame(rows, "column string, change string")


def log(spark: SparkSession, root: str) -> DataFrame:
    """All runs, failed ones included."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def _newest(spark: SparkSession, root: str):
    return log(spark, root).where("status = 'published'").agg(F.max_by(F.struct("load_id", "path"), F.struct("at", "load_id")).alias("m")).first().m


def active(spark: SparkSession, root: str) -> str | None:
    """The version published or pinned last (of two at one time the greater id), None before the first."""
    found = _newest(spark, root)
    return found.load_id if found else None


def resolve(spark: SparkSession, root: str, legacy: str | None = None) -> DataFrame:
    """The active version's rows, or those of a folder from before versions if there is none."""
    try:
        found = _newest(spark, root)
    except Exception as failure:
        if legacy is None or "PATH_NOT_FOUND" not in str(failure):
            raise
        found = None
    if found is None and legacy is None:
        raise FileNotFoundError(f"no published version in {root}")
    return spark.read.parquet(found.path if found is not None else legacy)


def expired(spark: SparkSession, root: str, keep: int) -> DataFrame:
    """Versions to purge (load_id): not among the `keep` newest published ones, which hold the active one."""
    last = log(spark, root).groupBy("load_id").agg(F.max(F.when(F.col("status") == "published", F.col("at"))).alias("at"))
    newest = last.where("at is not null").orderBy(F.desc("at"), F.desc("load_id")).limit(max(keep, 1))
    return last.join(newest.select("load_id"), "load_id", "left_anti").select("load_id")


def purge(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete the folders of all `expired` versions and say which; the manifest keeps their runs."""
    gone = [r.load_id for r in expired(spark, root, keep).orderBy("load_id").toLocalIterator()]
    for load_id in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/load_id={load_id}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def freshness(spark: SparkSession, root: str, days: int) -> DataFrame:
    """One row: missing (no version), refresh_failed (the last run failed), stale (older than `days`) or ok."""
    runs = log(spark, root).agg(
        F.max(F.when(F.col("status") == "published", F.col("at"))).alias("published_at"), F.max_by("status", "at").alias("last_status")
    )
    late = F.col("published_at") < F.current_timestamp() - F.make_dt_interval(F.lit(days))
    state = F.when(F.col("published_at").isNull(), "missing").when(F.col("last_status") == "failed", "refresh_failed").when(late, "stale").otherwise("ok")
    return runs.select(state.alias("state"), "published_at")


def refresh_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Replace just the partitions of the keys that `rows` hold; running it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
