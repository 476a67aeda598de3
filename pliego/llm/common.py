"""What the operators share: cutting lineage, and connected components of pair tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text, none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset: a temporary folder if all runs in one process (as in tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="pliego-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _free(spark: SparkSession) -> None:
    """Let the driver collect its garbage: Spark then drops the shuffle files of steps that nothing refers to any more.

    Else they stay until the driver's heap is full. Files that a running stage still reads are referred to, so they stay.
    """
    spark.sparkContext._jvm.System.gc()


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    spark = frame.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    made = frame.select("*").checkpoint()
    _free(spark)
    return made


def written(frame: DataFrame) -> DataFrame:
    """As `cut`, but as compressed columns: for larger tables of which later steps read a few columns."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.select("*").write.parquet(path)
    _free(spark)
    return spark.read.parquet(path)


def removed(frame: DataFrame) -> None:
    """Delete a table that `written` made, once nothing reads it any more."""
    context = frame.sparkSession.sparkContext
    for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def components(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an undirected pair table, as (node, component): the smallest node reachable.

    Alternates the large-star and small-star steps until the pairs stay the same. Each step is two
    shuffles of the pair table with a partial minimum, so no node's neighbours are gathered in one
    task. Nodes without a pair don't appear; pairs of a node with itself, nulls and repeats have no effect.
    """
    now = cut(
        pairs.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        now = cut(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(pairs: DataFrame) -> tuple:
    """Equal for equal sets of pairs (their number, and a sum of their hashes that can't overflow)."""
    hashed = F.shiftrightunsigned(F.xxhash64("u", "v"), 1).cast("decimal(38,0)")
    return tuple(pairs.agg(F.count("*"), F.sum(hashed)).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest of its neighbours and itself."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
