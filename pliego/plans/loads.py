"""Queries that go through files: loads, versions, documents, page inventories and streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pliego.plans.base import job, query
from pliego.sources import files, versions
from pliego.streaming import events


@job("select p_partkey::varchar code, p_name title, p_brand brand, null::varchar note, case when p_size > 25 then 'CLOSED' else 'ACTIVE' end tag from part")
def tagged_csv_scan(spark, sf_dir, folder):
    """Two CSV files with other headers, read under logical names and tagged."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size")
    part.where("p_size <= 25").drop("p_size").withColumnsRenamed({"p_partkey": "CODE", "p_name": "Name"}).write.csv(f"{folder}/active", header=True, escape='"')
    part.where("p_size > 25 or p_size is null").drop("p_size").withColumnsRenamed({"p_partkey": "id", "p_name": "TITLE"}).write.csv(f"{folder}/closed", header=True, escape='"')
    aliases = {"code": ["id"], "title": ["name"], "brand": ["p_brand"], "note": ["remark"]}
    return files.tagged_csv(spark, {"ACTIVE": f"{folder}/active", "CLOSED": f"{folder}/closed"}, aliases, {"code", "title"}).drop("source_file")


@job("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus <> 'P'")
def versioned_publish(spark, sf_dir, folder):
    """Two loads of one dataset and a third that fails its check: readers see the second."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    versions.publish(orders, folder, "1", orders.count(), ["o_orderkey"])
    versions.publish(orders.where("o_orderstatus <> 'P'"), folder, "2", keys=["o_orderkey"])
    try:
        versions.publish(orders.union(orders), folder, "3", keys=["o_orderkey"])
    except versions.CountMismatch:
        pass
    return versions.resolve(spark, folder)


@job("""select o_orderstatus, count(*) n, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint refreshed from orders group by 1""")
def partition_refresh(spark, sf_dir, folder):
    """An index by status, of which the partition of one status is written anew."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")
    versions.refresh_partitions(orders.withColumn("load", F.lit(1)), folder, "o_orderstatus")
    versions.refresh_partitions(orders.where("o_orderstatus = 'F'").withColumn("load", F.lit(2)), folder, "o_orderstatus")
    return spark.read.parquet(folder).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("load") == 2).alias("refreshed"))


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k,
  case when props is null or not json_valid(props) then '$' when try_cast(json_extract_string(props, '$.k') as bigint) is null then '$.k' else '' end errors from events""")
def json_contract(t):
    made = files.json_documents(t("events"), "props", StructType([StructField("k", LongType())]), ["k"])
    return made.select("event_id", F.col("document.k").alias("k"), F.array_join("errors", ",").alias("errors"))


@query("""select page_id, (unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))))::int pos, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) link from pages""")
def link_inventory(t):
    """Every link of every page with its place."""
    return t("pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("pos", "link"))


@job("""select time_bucket(interval 1 day, ts) as start, event_type, count(*) n, sum(value::decimal(18,4)) amount from events group by 1, 2""")
def stream_daily_counts(spark, sf_dir, folder):
    """Daily counts and sums by type, kept by a stream that upserts."""
    # a pattern, since a stream can't start from the path of a single file
    rows = events.follow(spark, f"{sf_dir}/event[s].parquet").withColumn("amount", F.col("value").cast("decimal(18,4)"))
    events.run_available(events.windowed_counts(rows, ["event_type"], "1 day", "2 hours"), folder)
    return events.current(spark, folder, ["start", "event_type"]).withColumn("amount", F.col("amount").cast("decimal(38,4)"))
