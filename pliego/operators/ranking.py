"""Choosing rows: first wins, best by a total order, gaps to the runner-up, top lists and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """The first row of each identity, with the number of rows that it stands for."""
    w = Window.partitionBy(*identity)
    return rows.withColumns({"rn": F.row_number().over(w.orderBy(*order)), "copies": F.count("*").over(w)}).where("rn = 1").drop("rn")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key (an upsert's result), by one aggregate without a sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("m")).select(*keys, "m.*")


def top(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def winner(rows: DataFrame, keys: list[str], score: str, tie: str, guard: float) -> DataFrame:
    """Each group's best row, its lead over the next and the number of rivals within `guard`; a lead within it abstains."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.desc(score), tie)
    marked = rows.withColumns({"rn": F.row_number().over(order), "next_score": F.lead(score).over(order), "best": F.max(score).over(w)})
    rivals = F.count_if(F.col("best") - F.col(score) <= guard).over(w) - 1
    lead = F.col(score) - F.col("next_score")
    return marked.withColumn("rivals", rivals).where("rn = 1").withColumn("decision", F.when(F.coalesce(lead, F.lit(guard + 1.0)) <= guard, "abstain").otherwise("accept")).drop("rn", "best")


def overfetch(rows: DataFrame, order: list[Column], n: int, condition: Column, limit: int) -> DataFrame:
    """The best n rows first, then the filter, then the limit: a filter sees the best n only."""
    return rows.orderBy(*order).limit(n).where(condition).orderBy(*order).limit(limit)


def keep_newest(rows: DataFrame, keys: list[str], newest: Column, n: int, pinned: Column) -> DataFrame:
    """Rows to retain: the n newest of each key, and pinned ones."""
    return rows.withColumn("age", F.row_number().over(Window.partitionBy(*keys).orderBy(newest))).where((F.col("age") <= n) | pinned).drop("age")


def best_work(pairs: DataFrame, case: str, id_: str, done: str) -> DataFrame:
    """For each case the work with most shared days, else the one with the nearest start: (case, id, tier, shared).

    `pairs`: (case, s1, e1, id, s2, e2, done). The last day isn't counted, so periods must share two days to overlap.
    Ties: a finished work, then the smaller id. A maximum of a struct, so no case's works are sorted in one task.
    """
    shared = F.datediff(F.least("e1", "e2"), F.greatest("s1", "s2")).cast("long")
    rated = pairs.withColumn("shared", F.greatest(shared, F.lit(0).cast("long")))
    rank = F.struct((F.col("shared") > 0).alias("a"), F.when(F.col("shared") > 0, F.col("shared")).otherwise(-F.abs(F.datediff("s1", "s2"))).alias("b"), F.col(done).alias("c"), (-F.col(id_)).alias("d"))
    best = rated.groupBy(case).agg(F.max_by(F.struct(id_, "shared"), rank).alias("m"))
    return best.select(case, F.col(f"m.{id_}").alias(id_), F.when(F.col("m.shared") > 0, "overlap").otherwise("nearest").alias("tier"), "m.shared")


def completed_first(rows: DataFrame, keys: list[str], order: str, fill: list[str]) -> DataFrame:
    """The first row of each key by `order`, with what it lacks in `fill` from the next row that has it, and the number of rows.

    Minima only, so no key's rows are sorted in one task.
    """
    others = [c for c in rows.columns if c not in (*keys, order, *fill)]
    first = F.min_by(F.struct(order, *others), F.col(order)).alias("_first")
    filled = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fill]
    return rows.groupBy(*keys).agg(first, *filled, F.count("*").alias("copies")).select(*keys, "_first.*", *fill, "copies")


def year_runs(rows: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Stretches of a row of buckets that lie in one year: (keys, year, first, last), places from 0 in order of day. Days are distinct by key."""
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy(day)) - 1).cast("long")
    placed = rows.select(*keys, F.year(day).alias("year"), place.alias("place"))
    return placed.groupBy(*keys, "year").agg(F.min("place").alias("first"), F.max("place").alias("last"))
