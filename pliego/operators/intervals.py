"""Interval algebra on tables of periods (key columns, start, end), days inclusive at both ends.

Every operator is one window or one equi-join on the keys; periods of different keys never meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pliego.functions.dates import inclusive_days, overlap_days


def valid(periods: DataFrame) -> DataFrame:
    """Periods that aren't inverted and have both ends."""
    return periods.where("end >= start")


def union(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Merged periods (keys, start, end, parts, gross_days): those that overlap or touch become one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = valid(periods).withColumn("new", F.when(F.datediff("start", before) > 1, 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    days = F.sum(inclusive_days(F.col("start"), F.col("end"))).cast("long").alias("gross_days")
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("parts"), days).drop("island")


def effective_days(periods: DataFrame, keys: list[str]) -> DataFrame:
    """Gross, overlapping and effective days of each key."""
    merged = union(periods, keys)
    sums = merged.groupBy(*keys).agg(F.sum("gross_days").alias("gross_days"), F.sum(inclusive_days(F.col("start"), F.col("end"))).cast("long").alias("effective_days"))
    return sums.withColumn("overlap_days", F.col("gross_days") - F.col("effective_days"))


def subtract(periods: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """What is left of each period without its key's holes: (keys, start, end). Keys are unique in `periods`."""
    clipped = (
        valid(holes).withColumnsRenamed({"start": "x", "end": "y"})
        .join(valid(periods), keys)
        .where("y >= start and x <= end")
        .select(*keys, F.col("start").alias("a"), F.col("end").alias("b"), F.greatest("x", "start").alias("start"), F.least("y", "end").alias("end"))
    )
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = clipped.withColumn("from", F.coalesce(F.date_add(before, 1), "a")).select(*keys, F.col("from").alias("s"), F.date_sub("start", 1).alias("e"))
    tails = clipped.groupBy(*keys).agg(F.date_add(F.max("end"), 1).alias("s"), F.max("b").alias("e"))
    whole = valid(periods).join(clipped.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("start").alias("s"), F.col("end").alias("e"))
    return gaps.unionByName(tails).unionByName(whole).where("e >= s").withColumnsRenamed({"s": "start", "e": "end"})


def uncovered(periods: DataFrame, covers: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of each period that no cover touches: `subtract` under its other name."""
    return subtract(periods, covers, keys)


def clip(periods: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans cut to the key's period, with all their columns."""
    joined = spans.join(valid(periods).withColumnsRenamed({"start": "a", "end": "b"}), keys).where("end >= a and start <= b")
    return joined.withColumns({"start": F.greatest("start", "a"), "end": F.least("end", "b")}).drop("a", "b")


def month_gaps(months: DataFrame, keys: list[str]) -> DataFrame:
    """Missing months between those present (keys, month): (keys, start, end)."""
    after = F.lead("month").over(Window.partitionBy(*keys).orderBy("month"))
    stepped = months.select(*keys, F.trunc("month", "MM").alias("month")).distinct().withColumn("next", after)
    return stepped.where(F.months_between("next", "month") > 1).select(*keys, F.add_months("month", 1).alias("start"), F.date_sub("next", 1).alias("end"))


def sessions(rows: DataFrame, keys: list[str], order: list[str], active) -> DataFrame:
    """Runs of neighbouring rows for which `active` holds: keys, run, n, first and last of the first order column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changes = rows.withColumn("on", active).withColumn("was", F.lag("on").over(w))
    runs = changes.withColumn("run", F.sum(F.when(F.col("on") & ~F.coalesce("was", F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.where("on").groupBy(*keys, "run").agg(F.count("*").alias("n"), F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"))


def _bucketed(periods: DataFrame) -> DataFrame:
    """Periods once for each quarter that they touch."""
    quarters = F.sequence(F.trunc("start", "quarter"), F.trunc("end", "quarter"), F.expr("interval 3 months"))
    return valid(periods).withColumn("bucket", F.explode(quarters))


def _overlaps(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Pairs of periods (s1, e1) and (s2, e2) of one key that share a day, each once, with shared_days.

    A range join by buckets: only periods of one quarter meet, and a pair counts in the quarter in which it first
    shares a day. So a key with many periods isn't compared as a whole.
    """
    left, right = _bucketed(one).withColumnsRenamed({"start": "s1", "end": "e1"}), _bucketed(two).withColumnsRenamed({"start": "s2", "end": "e2"})
    pairs = left.join(right, [key, "bucket"]).where("s2 <= e1 and s1 <= e2").where(F.trunc(F.greatest("s1", "s2"), "quarter") == F.col("bucket"))
    return pairs.withColumn("shared_days", overlap_days(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")).cast("long")).drop("bucket")


def overlapping_pairs(periods: DataFrame, key: str, id_: str) -> DataFrame:
    """Pairs of periods of one key that share a day: (key, a, b, shared_days), a < b."""
    one, two = (periods.select(key, F.col(id_).alias(name), "start", "end") for name in ("a", "b"))
    return _overlaps(one, two, key).where("a < b").select(key, "a", "b", "shared_days")


def best_match(left: DataFrame, right: DataFrame, key: str, id_: str) -> DataFrame:
    """For each left period the right period of its key with most shared days, else the one with the nearest start.

    Ties: the later end, then the smaller id. (id, match, tier, shared_days); tier is overlap or nearest. The nearest start
    is one of the two next to it in a window over the key's starts; it is never the period's own, as what starts on
    its first day overlaps it.
    """
    a = valid(left).select(key, F.col(id_).alias("id"), "start", "end")
    b = valid(right).select(key, F.col(id_).alias("match"), "start", "end")
    pairs = _overlaps(a, b, key).where("id <> match")
    rank = F.struct("shared_days", "e2", (-F.col("match")).alias("low"))
    best = pairs.groupBy("id").agg(F.max_by(F.struct("match", "shared_days"), rank).alias("m")).select("id", "m.match", F.lit("overlap").alias("tier"), "m.shared_days")
    alone = a.join(best.select("id"), "id", "left_anti").select(key, "id", "start", F.lit(None).cast("long").alias("match"))
    starts = b.groupBy(key, "start").agg(F.min("match").alias("match")).select(key, F.lit(None).cast("long").alias("id"), "start", F.col("match").cast("long"))
    day = F.datediff("start", F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(key).orderBy(day)
    other = F.when(F.col("match").isNotNull(), F.struct("start", "match"))
    near = alone.unionByName(starts).withColumns(
        {"before": F.last(other, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1)), "after": F.first(other, ignorenulls=True).over(w.rangeBetween(1, Window.unboundedFollowing))}
    )
    gap = lambda c: F.struct(F.abs(F.datediff("start", f"{c}.start")).alias("far"), F.col(f"{c}.match").alias("match"))
    nearest = F.array_min(F.array_compact(F.array(F.when(F.col("before").isNotNull(), gap("before")), F.when(F.col("after").isNotNull(), gap("after")))))
    rest = near.where("id is not null").withColumn("m", nearest).where("m is not null").select("id", "m.match", F.lit("nearest").alias("tier"), F.lit(0).cast("long").alias("shared_days"))
    return best.unionByName(rest)


def bucket_overlaps(periods: DataFrame, key: str, unit: str = "quarter") -> DataFrame:
    """Periods laid over calendar buckets: (key, bucket, n, shared): how many touch it, and whether two share a day of it."""
    starts = F.sequence(F.date_trunc(unit, "start").cast("date"), F.col("end"), F.expr("interval 3 months" if unit == "quarter" else "interval 1 month"))
    laid = valid(periods).select(key, "start", "end", F.explode(starts).alias("bucket"))
    stop = F.date_sub(F.add_months("bucket", 3 if unit == "quarter" else 1), 1)
    cut = laid.select(key, "bucket", F.greatest("start", "bucket").alias("start"), F.least("end", stop).alias("end"))
    merged = union(cut, [key, "bucket"])
    gross = F.sum("gross_days") > F.sum(inclusive_days(F.col("start"), F.col("end")))
    return merged.groupBy(key, "bucket").agg(F.sum("parts").cast("long").alias("n"), gross.alias("shared"))


def suspensions(months: DataFrame, keys: list[str]) -> DataFrame:
    """Stopped stretches of works: (keys, start, end), from rows (keys, month, stopped, stopped_on), one per month and key.

    A stopped month reaches from its first day, or the exact day of the stop, to the first day of the next month (the
    last day of December). A next stopped row goes on with it if it begins within 31 days of its end; an active row ends it.
    """
    first = F.trunc("month", "MM")
    end = F.when(F.month(first) == 12, F.last_day(first)).otherwise(F.add_months(first, 1))
    rows = months.select(*keys, first.alias("month"), "stopped", F.coalesce("stopped_on", first).alias("start"), end.alias("end"))
    order = Window.partitionBy(*keys).orderBy("month", "start")
    active = rows.withColumn("block", F.count_if(~F.col("stopped")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("stopped")
    within = Window.partitionBy(*keys, "block").orderBy("month", "start")
    before = F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1))
    marked = active.withColumn("new", F.when(before.isNull() | (F.datediff("start", before) > 31), 1).otherwise(0))
    numbered = marked.withColumn("run", F.sum("new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "block", "run").agg(F.min_by("start", F.struct("month", "start")).alias("start"), F.max("end").alias("end")).drop("block", "run")


def inactivity(months: DataFrame, keys: list[str]) -> DataFrame:
    """All stretches in which a work didn't go on: (keys, start, end, kind), `paralizado` and `sin_valorizacion` (months without a row)."""
    stopped = suspensions(months, keys).withColumn("kind", F.lit("paralizado"))
    missing = month_gaps(months.select(*keys, "month"), keys).withColumn("kind", F.lit("sin_valorizacion"))
    return stopped.unionByName(missing)


def held_throughout(periods: DataFrame, spans: DataFrame, keys: list[str], good: str) -> DataFrame:
    """Whether a state held over a whole period: (keys, verdict): true, false where another state touches it, null where days are unknown.

    `spans`: (keys, start, end, state); keys are unique in `periods`.
    """
    cut = clip(periods, spans, keys)
    bad = cut.groupBy(*keys).agg(F.bool_or(F.col("state") != good).alias("bad"))
    holes = uncovered(periods, cut.select(*keys, "start", "end"), keys).select(*keys).distinct().withColumn("hole", F.lit(True))
    joined = valid(periods).select(*keys).join(bad, keys, "left").join(holes, keys, "left")
    return joined.select(*keys, F.when(F.col("bad"), False).when(F.col("hole") | F.col("bad").isNull(), None).otherwise(True).alias("verdict"))


def axis_range(periods: DataFrame, milestones: DataFrame, keys: list[str], months: int = 6) -> DataFrame:
    """The axis of each key: (keys, start, end) of its periods, stretched to milestones (keys, day) within some months of them."""
    span = valid(periods).groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    near = milestones.join(span, keys).groupBy(*keys).agg(
        F.min(F.when((F.col("day") < F.col("start")) & (F.col("day") >= F.add_months("start", -months)), F.col("day"))).alias("low"),
        F.max(F.when((F.col("day") > F.col("end")) & (F.col("day") <= F.add_months("end", months)), F.col("day"))).alias("high"),
    )
    return span.join(near, keys, "left").select(*keys, F.coalesce("low", "start").alias("start"), F.coalesce("high", "end").alias("end"))
