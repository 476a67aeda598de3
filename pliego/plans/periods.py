"""Queries on periods: effective days, suspensions, gaps, sessions, overlaps and statuses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pliego.functions import dates
from pliego.operators import intervals
from pliego.plans.base import PERIODS, order_periods, query

ISLANDS = """islands as (
  select o_custkey, min(s) s, max(e) e, sum(e - s + 1) gross from (
    select *, sum(new) over (partition by o_custkey order by s, e, o_orderkey rows unbounded preceding) isl from (
      select *, case when s - max(e) over (partition by o_custkey order by s, e, o_orderkey rows between unbounded preceding and 1 preceding) > 1 then 1 else 0 end new from periods))
  group by o_custkey, isl)"""


@query(f"""with {PERIODS}, {ISLANDS}
select o_custkey, sum(gross)::bigint gross_days, sum(e - s + 1)::bigint effective_days, (sum(gross) - sum(e - s + 1))::bigint overlap_days from islands group by 1""")
def effective_days(t):
    return intervals.effective_days(order_periods(t), ["o_custkey"])


@query(f"""with {PERIODS}, {ISLANDS} select o_custkey, s as start, e as "end", gross::bigint gross_days from islands""")
def merged_periods(t):
    return intervals.union(order_periods(t), ["o_custkey"]).select("o_custkey", "start", "end", "gross_days")


@query(f"""with {PERIODS}, c as (
  select o_orderkey, s a, e b, greatest(l_shipdate::date, s) x, least(l_shipdate::date + 14, e) y
  from periods join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R' and l_shipdate::date + 14 >= s and l_shipdate::date <= e),
r as (select *, max(y) over (partition by o_orderkey order by x, y rows between unbounded preceding and 1 preceding) py from c),
o as (select o_orderkey, coalesce(py + 1, a) s, x - 1 e from r union all select o_orderkey, max(y) + 1, max(b) from c group by 1
  union all select o_orderkey, s, e from periods where o_orderkey not in (select o_orderkey from c))
select o_orderkey, s as start, e as "end", (e - s + 1)::bigint as days from o where e >= s""")
def subtract_suspensions(t):
    periods = order_periods(t).select("o_orderkey", "start", "end")
    day = F.to_date("l_shipdate")
    holes = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), day.alias("start"), F.date_add(day, 14).alias("end"))
    return intervals.subtract(periods, holes, ["o_orderkey"]).withColumn("days", dates.inclusive_days(F.col("start"), F.col("end")).cast("long"))


@query("""with m as (select distinct l_partkey, date_trunc('month', l_shipdate)::date m from lineitem),
n as (select *, lead(m) over (partition by l_partkey order by m) nx from m)
select l_partkey, (m + interval 1 month)::date as start, nx - 1 as "end" from n where nx > (m + interval 1 month)::date""")
def month_gaps(t):
    return intervals.month_gaps(t("lineitem").select("l_partkey", F.to_date("l_shipdate").alias("month")), ["l_partkey"])


@query("""with f as (select *, event_type = 'error' is_on, lag(event_type = 'error') over (partition by user_id order by ts, event_id) was from events),
g as (select *, sum(case when is_on and not coalesce(was, false) then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) run from f)
select user_id, run::bigint run, count(*) n, min(ts) first_at, max(ts) last_at from g where is_on group by user_id, run""")
def state_sessions(t):
    return intervals.sessions(t("events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error")


@query(f"""with {PERIODS}, m as (select o_custkey, o_orderkey, s start_, e end_ from periods)
select a.o_custkey, a.o_orderkey a, b.o_orderkey b, (least(a.end_, b.end_) - greatest(a.start_, b.start_) + 1)::bigint shared_days
from m a join m b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and b.start_ <= a.end_ and a.start_ <= b.end_""")
def overlap_pairs(t):
    return intervals.overlapping_pairs(order_periods(t), "o_custkey", "o_orderkey")


@query(f"""with {PERIODS}, x as (
  select a.o_orderkey id, b.o_orderkey match, greatest(0, least(a.e, b.e) - greatest(a.s, b.s) + 1)::bigint shared_days, b.e be, abs(a.s - b.s) far
  from periods a join periods b on a.o_custkey = b.o_custkey and a.o_orderkey <> b.o_orderkey),
r as (select *, row_number() over (partition by id order by case when shared_days > 0 then shared_days else -far - 1 end desc, case when shared_days > 0 then be end desc nulls last, match) rn from x)
select id, match, case when shared_days > 0 then 'overlap' else 'nearest' end tier, shared_days from r where rn = 1""")
def best_overlap(t):
    periods = order_periods(t)
    return intervals.best_match(periods, periods, "o_custkey", "o_orderkey")


@query("""select event_id, user_id, prior as status from (
  select *, lag(event_type) over (partition by user_id order by ts, event_id) prior from events) where event_type = 'purchase'""")
def asof_status(t):
    prior = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").withColumn("status", prior).where("event_type = 'purchase'").select("event_id", "user_id", "status")


SPANS = """spans as (select user_id, event_type, ts::date s, coalesce(lead(ts::date) over (partition by user_id order by ts, event_id) - 1, date '2024-01-21') e from events),
covers as (select * from spans where event_type in ('login', 'view', 'click') and e >= s)"""


def _spans(t):
    after = F.lead(F.to_date("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    end = F.coalesce(F.date_sub(after, 1), F.lit("2024-01-21").cast("date"))
    return t("events").select("user_id", "event_type", F.to_date("ts").alias("start"), end.alias("end")).where("end >= start")


def _windows(t):
    return t("events").select("user_id").distinct().select("user_id", F.lit("2024-01-08").cast("date").alias("start"), F.lit("2024-01-21").cast("date").alias("end"))


@query(f"""with {SPANS} select user_id, event_type, count(*) spans, sum(least(e, date '2024-01-21') - greatest(s, date '2024-01-08') + 1)::bigint as days
from spans where e >= s and e >= date '2024-01-08' and s <= date '2024-01-21' group by 1, 2""")
def clip_status(t):
    cut = intervals.clip(_windows(t), _spans(t), ["user_id"])
    return cut.groupBy("user_id", "event_type").agg(F.count("*").alias("spans"), F.sum(dates.inclusive_days(F.col("start"), F.col("end"))).cast("long").alias("days"))


@query(f"""with {SPANS}, u as (select distinct user_id from events), c as (
  select user_id, greatest(s, date '2024-01-08') x, least(e, date '2024-01-21') y from covers where e >= date '2024-01-08' and s <= date '2024-01-21'),
r as (select *, max(y) over (partition by user_id order by x, y rows between unbounded preceding and 1 preceding) py from c),
o as (select user_id, coalesce(py + 1, date '2024-01-08') s, x - 1 e from r union all select user_id, max(y) + 1, date '2024-01-21' from c group by 1
  union all select user_id, date '2024-01-08', date '2024-01-21' from u where user_id not in (select user_id from c))
select user_id, s as start, e as "end" from o where e >= s""")
def uncovered_gaps(t):
    covers = _spans(t).where(F.col("event_type").isin("login", "view", "click"))
    return intervals.uncovered(_windows(t), covers, ["user_id"])


@query(f"""with {PERIODS}, m as (select o_custkey, o_orderkey, s, e, unnest(generate_series(date_trunc('quarter', s), e, interval 3 month))::date q from periods),
c as (select o_custkey, q, greatest(s, q) s, least(e, (q + interval 3 month)::date - 1) e from m),
r as (select *, max(e) over (partition by o_custkey, q order by s, e rows between unbounded preceding and 1 preceding) pe from c)
select o_custkey, q bucket, count(*) n, bool_or(coalesce(pe >= s, false)) shared from r group by 1, 2""")
def axis_buckets(t):
    return intervals.bucket_overlaps(order_periods(t), "o_custkey")


@query("""with w as (select l_orderkey, min(l_shipdate)::date a, max(l_shipdate)::date b from lineitem group by 1),
j as (select o_orderkey, greatest(0, least(b, o_orderdate::date + 60) - greatest(a, o_orderdate::date) + 1)::bigint shared, (b - a + 1)::bigint as days from orders join w on o_orderkey = l_orderkey)
select o_orderkey, shared, days, case when 5 * shared < days then 'review' else 'ok' end verdict from j""")
def coverage_ratio(t):
    ship = t("lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    joined = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).join(ship, F.col("o_orderkey") == F.col("l_orderkey"))
    shared = dates.overlap_days(F.col("d"), F.date_add("d", 60), F.col("a"), F.col("b")).cast("long")
    out = joined.select("o_orderkey", shared.alias("shared"), dates.inclusive_days(F.col("a"), F.col("b")).cast("long").alias("days"))
    return out.withColumn("verdict", F.when(5 * F.col("shared") < F.col("days"), "review").otherwise("ok"))


@query("""select o_orderkey, (o_orderdate::date - interval 25 year)::date cutoff, last_day(o_orderdate)::date month_end,
  ((year(l) * 12 + month(l)) - (year(o_orderdate) * 12 + month(o_orderdate)) + 1)::bigint as months, (l::date - o_orderdate::date + 1)::bigint as days, l::date < date '1996-07-01' is_old
from orders join (select l_orderkey, max(l_shipdate) l from lineitem group by 1) on o_orderkey = l_orderkey where l::date >= o_orderdate::date""")
def date_arithmetic(t):
    s, e = F.col("start"), F.col("end")
    return order_periods(t).select(
        "o_orderkey", dates.years_before(s, 25).alias("cutoff"), F.last_day(s).alias("month_end"), dates.months_inclusive(s, e).cast("long").alias("months"), dates.inclusive_days(s, e).cast("long").alias("days"), (e < F.lit("1996-07-01").cast("date")).alias("is_old")
    )


@query("""with d as (select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m') || ' (sin dia)' when 2 then '2019-02-30' when 3 then strftime(o_orderdate, '%d/%m/%Y') else 'POR VERIFICAR' end raw, o_orderdate::date d from orders)
select o_orderkey, case when o_orderkey % 5 = 0 then d end hard, case o_orderkey % 5 when 0 then d when 1 then date_trunc('month', d)::date end first_edge,
  case o_orderkey % 5 when 0 then d when 1 then last_day(d) end last_edge, case when o_orderkey % 5 in (0, 3) then d end any_form from d""")
def flexible_dates(t):
    kind = F.col("o_orderkey") % 5
    raw = (
        F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit(" (sin dia)")))
        .when(kind == 2, "2019-02-30").when(kind == 3, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("POR VERIFICAR")
    )
    x = F.col("raw")
    return t("orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", dates.hard_date(x).alias("hard"), dates.month_edge(x, False).alias("first_edge"), dates.month_edge(x, True).alias("last_edge"), dates.any_date(x).alias("any_form"))
