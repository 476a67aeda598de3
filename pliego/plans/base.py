"""Registration of queries, and the tables that several of them start from."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table reader under its own name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def job(sql: str | None = None):
    """Register a function of the session, the table folder and a new folder for what it writes."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir, own_folder(spark, f.__name__))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def own_folder(spark: SparkSession, name: str) -> str:
    """A new path under the session's spark.checkpoint.dir. Where it is unset: a temporary folder if all runs in one process (as in tests), else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="pliego-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def order_periods(t) -> DataFrame:
    """Each order's period: from its date to its last shipment, where that isn't earlier."""
    last = t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("end"))
    joined = t("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("start")).join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.where("end >= start").select("o_custkey", "o_orderkey", "start", "end")


PERIODS = """periods as (
  select o_custkey, o_orderkey, o_orderdate::date s, max(l_shipdate)::date e
  from orders join lineitem on o_orderkey = l_orderkey group by all having max(l_shipdate)::date >= o_orderdate::date)"""
