"""Queries that recalculate declared figures, and periods of works and of taxpayers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pliego.functions import dates
from pliego.operators import intervals, recalculation
from pliego.plans.base import PERIODS, order_periods, query

# declared texts of dates: full ones, months only, sentinels and blanks
DECLARED = """d as (select o_orderkey, o_custkey, o_orderdate::date d, o_orderdate::date + (o_orderkey % 400 - 20)::int e, o_orderkey % 13 k, o_totalprice from orders),
t as (select o_orderkey, o_custkey, d, e, case k when 1 then strftime(d, '%Y-%m') when 2 then 'POR VERIFICAR: no consta' when 3 then '' else strftime(d, '%Y-%m-%d') end a,
  case k when 4 then strftime(e, '%Y-%m') || ' (sin dia)' when 5 then null else strftime(e, '%Y-%m-%d') end b, case k when 6 then null when 7 then 'POR VERIFICAR' else strftime(d + 3 - (o_orderkey % 7)::int, '%Y-%m-%d') end c, k, o_totalprice from d),
f as (select o_orderkey, o_custkey, k, (e - d + 1)::bigint said, case when k not in (1, 2, 3) then d end da, case when k not in (4, 5) then e end db, case when k not in (6, 7) then d + 3 - (o_orderkey % 7)::int end dc,
  case k when 1 then 'FECHA_PARCIAL' when 2 then 'FECHA_CENTINELA' when 3 then 'SIN_FECHA' end ca, case k when 4 then 'FECHA_PARCIAL' when 5 then 'SIN_FECHA' end cb from t),
g as (select *, coalesce(ca, cb, case when db < da then 'PERIODO_INVERTIDO' end) motivo from f)"""


def _declared(t):
    k, d = F.col("o_orderkey") % 13, F.to_date("o_orderdate")
    e = F.date_add(d, (F.col("o_orderkey") % 400 - 20).cast("int"))
    c = F.date_add(d, (3 - F.col("o_orderkey") % 7).cast("int"))
    full, month = (lambda x: F.date_format(x, "yyyy-MM-dd")), (lambda x: F.date_format(x, "yyyy-MM"))
    return t("orders").select(
        "o_orderkey", "o_custkey", (F.datediff(e, d) + 1).cast("long").alias("said"),
        F.when(k == 1, month(d)).when(k == 2, "POR VERIFICAR: no consta").when(k == 3, "").otherwise(full(d)).alias("a"),
        F.when(k == 4, F.concat(month(e), F.lit(" (sin dia)"))).when(k == 5, None).otherwise(full(e)).alias("b"),
        F.when(k == 6, None).when(k == 7, "POR VERIFICAR").otherwise(full(c)).alias("c"),
    )


@query(f"""with {DECLARED} select o_orderkey, motivo, case when motivo is null then (db - da + 1)::bigint end dias, case when motivo is null then round_even((db - da + 1) / 30, 2) end meses, case when motivo is null then round_even((db - da + 1) / 365, 2) end anios,
  case when motivo is null then case when da <= date '2020-06-30' and db >= date '2020-03-16' then 'SI' else 'NO' end end incluye_covid,
  case when da is not null and motivo is distinct from 'PERIODO_INVERTIDO' and dc is not null then case when da < dc then 'SI' else 'NO' end end anterior,
  case when da is null or motivo = 'PERIODO_INVERTIDO' then motivo when k = 6 then 'SIN_COLEGIATURA' when k = 7 then 'FECHA_CENTINELA' end motivo_colegiatura from g""")
def field_recalculation(t):
    """Days, months, years and flags of declared periods, or the reason why there are none."""
    out = recalculation.fields(_declared(t), "a", "b", "c")
    return out.select("o_orderkey", "motivo", "dias", "meses", "anios", "incluye_covid", F.col("anterior_colegiatura").alias("anterior"), "motivo_colegiatura")


@query(f"""with {DECLARED} select o_orderkey, case k when 1 then date_trunc('month', da2)::date else da2 end is not null known, case when k in (1, 4) then true else false end deduced,
  case when db2 >= da2 then (db2 - da2 + 1)::bigint end dias from (select o_orderkey, k, case when k in (2, 3) then null when k = 1 then date_trunc('month', d)::date else d end da2, case when k = 5 then null when k = 4 then last_day(e) else e end db2 from t)
where da2 is not null and db2 >= da2""")
def deduced_days(t):
    """Days where a month alone counts as its edge, marked as deduced."""
    out = recalculation.fields(_declared(t), "a", "b", "c", whole_months=True)
    return out.where("motivo is null").select("o_orderkey", F.lit(True).alias("known"), "deduced", "dias")


@query(f"""with {DECLARED}, r as (select o_orderkey, o_custkey, case when motivo is null then (db - da + 1)::bigint end dias, said + case o_orderkey % 9 when 0 then 40 when 1 then 1 else 0 end said from g)
select o_orderkey, case when abs(said - dias) > 1 then 'DIAS_DISCREPANTE' end code from r""")
def day_discrepancies(t):
    """Declared days that are over one day off."""
    out = recalculation.fields(_declared(t), "a", "b", "c")
    said = F.col("said") + F.when(F.col("o_orderkey") % 9 == 0, 40).when(F.col("o_orderkey") % 9 == 1, 1).otherwise(0)
    return out.select("o_orderkey", recalculation.discrepancy(said, F.col("dias")).alias("code"))


@query(f"""with {DECLARED}, r as (select o_custkey, case when motivo is null then (db - da + 1)::bigint end dias, said from g)
select o_custkey, count(*) n, case when count(dias) = count(*) then sum(dias)::bigint end total, case when count(dias) < count(*) then 'TOTAL_INCOMPLETO' end motivo, case when count(dias) = count(*) then abs(sum(said) + o_custkey % 5 - sum(dias)) <= count(*) end cuadra from r group by o_custkey""")
def professional_totals(t):
    """Totals of days, only where every addend is known, and whether the declared total fits."""
    out = recalculation.fields(_declared(t), "a", "b", "c")
    declared = out.groupBy(F.col("o_custkey").alias("k")).agg((F.sum("said") + F.first("o_custkey") % 5).alias("declared"))
    return recalculation.totals(out.join(declared, F.col("o_custkey") == F.col("k")), "o_custkey", "dias", "declared")


@query("""with f as (select l_orderkey k, case when l_returnflag <> 'N' then l_quantity end s, case when l_linenumber % 3 = 0 then l_quantity / 2 end lo, case when l_linenumber % 4 > 0 then l_quantity + 5 end hi, l_tax > 0.06 cond, l_discount < 0.09 app from lineitem),
b as (select k, s, cond, coalesce(hi, s) h, coalesce(lo, s, case when coalesce(hi, s) is not null then 0 end) l from f where app), u as (select k, sum(l) l, sum(h) h, bool_or(l is null or h is null) unb, bool_or(s is null or cond or l is null or h is null) op from b group by 1)
select o.k, round(coalesce(l, 0), 6) minimo, case when not coalesce(unb, false) then round(coalesce(h, 0), 6) end maximo, case when coalesce(op, false) then 'condicionado' else 'definitivo' end estado, case when not coalesce(op, false) then round(coalesce(l, 0), 6) end total
from (select distinct l_orderkey k from lineitem) o left join u using (k)""")
def score_bounds(t):
    """The least and largest score of each order's factors, and the final one where nothing is open."""
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("k"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("s"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") / 2).alias("lo"),
        F.when(F.col("l_linenumber") % 4 > 0, F.col("l_quantity") + 5).alias("hi"), (F.col("l_tax") > 0.06).alias("cond"), (F.col("l_discount") < 0.09).alias("app"),
    )
    return recalculation.score_bounds(rows, "k", "s", "lo", "hi", "cond", "app")


@query("""with o as (select o_orderkey, o_orderdate::date d, case when o_orderkey % 4 > 0 then year(o_orderdate) + (o_orderkey % 3 - 1) end y, case when o_orderkey % 5 = 0 then o_orderdate::date + 1 end c from orders)
select o_orderkey, case when y is not null and not (year(d) = y or (year(d) = y - 1 and month(d) = 12) or (year(d) = y + 1 and month(d) = 1)) then 'ANIO' when d < c then 'CONTRATO' when d > date '2001-06-30' then 'FUTURA' when year(d) < 2000 then 'RANGO' end reason from o""")
def date_plausibility(t):
    """Why the date of a resolution can't be right."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    number = F.when(k % 4 > 0, F.year(d) + (k % 3 - 1))
    return t("orders").select("o_orderkey", recalculation.plausible(d, number, F.when(k % 5 == 0, F.date_add(d, 1)), F.lit("2001-06-30").cast("date")).alias("reason"))


@query("""with c as (select o_custkey, o_orderdate::date i, case when o_orderkey % 6 > 0 then o_orderdate::date + (o_orderkey % 900)::int end x, case when o_custkey % 9 > 0 then date '1997-06-30' end f, o_orderstatus = 'F' has, o_orderkey % 3 > 0 whole from orders),
v as (select o_custkey, case when f is null or x is null or i > f then 'por_verificar' when x < f then 'vencido' else 'vigente' end s, has, whole from c)
select o_custkey, count(*) filter (where s = 'vigente') vigente, count(*) filter (where s = 'vencido') vencido, count(*) filter (where s = 'por_verificar') por_verificar,
  count(*) filter (where not has and whole) missing, count(*) filter (where not has and not whole) to_check, case when count(*) filter (where s = 'vigente') > 0 then 'definitivo' else 'condicionado' end estado from v group by 1""")
def certificates_and_documents(t):
    """Certificates on the day of the offer, and required documents that are missing or still to be looked at."""
    i, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    offer = F.when(F.col("o_custkey") % 9 > 0, F.lit("1997-06-30").cast("date"))
    state = recalculation.validity(i, F.when(k % 6 > 0, F.date_add(i, (k % 900).cast("int"))), offer)
    kept = recalculation.documents(F.lit(True), F.col("o_orderstatus") == "F", k % 3 > 0)
    rows = t("orders").select("o_custkey", state.alias("s"), kept.alias("d"))
    n = lambda c, v: F.count_if(F.col(c) == v)
    return rows.groupBy("o_custkey").agg(
        n("s", "vigente").alias("vigente"), n("s", "vencido").alias("vencido"), n("s", "por_verificar").alias("por_verificar"), n("d", "NO_CUMPLE").alias("missing"), n("d", "REVISION_MANUAL").alias("to_check"),
        F.when(n("s", "vigente") > 0, "definitivo").otherwise("condicionado").alias("estado"),
    )


MONTHS = """m as (select l_partkey p, date_trunc('month', l_shipdate)::date m, bool_and(l_returnflag <> 'A') stopped, min(case when l_linenumber = 1 then l_shipdate::date end) on_ from lineitem group by 1, 2),
r as (select p, m, stopped, coalesce(on_, m) s, case when month(m) = 12 then last_day(m) else (m + interval 1 month)::date end e from m),
b as (select *, count(*) filter (where not stopped) over (partition by p order by m rows unbounded preceding) blk from r), x as (select * from b where stopped),
y as (select *, max(e) over (partition by p, blk order by m rows between unbounded preceding and 1 preceding) pe from x), z as (select *, sum(case when pe is null or s - pe > 31 then 1 else 0 end) over (partition by p, blk order by m rows unbounded preceding) run from y),
st as (select p, min_by(s, m) s, max(e) e from z group by p, blk, run)"""


@query(f"""with {MONTHS}, n as (select p, m, lead(m) over (partition by p order by m) nx from m)
select p as l_partkey, s as "start", e as "end", 'paralizado' kind from st union all select p, (m + interval 1 month)::date, nx - 1, 'sin_valorizacion' from n where nx > (m + interval 1 month)::date""")
def inactivity_list(t):
    """Stretches in which works stood still: stopped months and months without a row."""
    month = F.trunc("l_shipdate", "MM")
    rows = t("lineitem").groupBy("l_partkey", month.alias("month")).agg(F.bool_and(F.col("l_returnflag") != "A").alias("stopped"), F.min(F.when(F.col("l_linenumber") == 1, F.to_date("l_shipdate"))).alias("stopped_on"))
    return intervals.inactivity(rows, ["l_partkey"])


@query("""with s as (select user_id, event_type, ts::date s, lead(ts::date) over (partition by user_id order by ts, event_id) - 1 e from events), v as (select *, case when event_type = 'error' then 'NO HABIDO' else 'HABIDO' end state from s where e >= s),
p as (select user_id, date '2024-01-05' + (user_id % 9)::int a, date '2024-01-05' + (user_id % 9 + user_id % 4)::int b from (select distinct user_id from events)),
d as (select user_id, unnest(generate_series(a, b, interval 1 day))::date d from p), k as (select d.user_id, d.d, bool_or(state = 'NO HABIDO') bad, count(state) n from d left join v on v.user_id = d.user_id and d.d between v.s and v.e group by 1, 2)
select user_id, case when bool_or(coalesce(bad, false)) then false when min(n) > 0 then true end verdict from k group by 1""")
def habido_answer(t):
    """Whether a taxpayer was in good standing over a whole period: yes only if every day is known."""
    after = F.lead(F.to_date("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    spans = t("events").select("user_id", F.when(F.col("event_type") == "error", "NO HABIDO").otherwise("HABIDO").alias("state"), F.to_date("ts").alias("start"), F.date_sub(after, 1).alias("end")).where("end >= start")
    base = F.date_add(F.lit("2024-01-05").cast("date"), (F.col("user_id") % 9).cast("int"))
    periods = t("events").select("user_id").distinct().select("user_id", base.alias("start"), F.date_add(base, (F.col("user_id") % 4).cast("int")).alias("end"))
    return intervals.held_throughout(periods, spans, ["user_id"], "HABIDO")


@query("""with c as (select c_custkey, case when c_custkey % 7 > 0 then date '1992-01-01' + (c_custkey % 2000)::int end i from customer), o as (select o_custkey, min(o_orderdate)::date s, bool_or(o_orderstatus = 'F') active from orders group by 1)
select c_custkey, case when i > s then case when active then 'REINSCRIPCION' else 'ALERTA' end end alt04 from c join o on c_custkey = o_custkey""")
def late_registration(t):
    """Registrations after the work began: an alert, or a new registration where history shows earlier activity."""
    first = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("s"), F.bool_or(F.col("o_orderstatus") == "F").alias("active"))
    i = F.when(F.col("c_custkey") % 7 > 0, F.date_add(F.lit("1992-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int")))
    return t("customer").join(first, "c_custkey").select("c_custkey", F.when(i > F.col("s"), F.when(F.col("active"), "REINSCRIPCION").otherwise("ALERTA")).alias("alt04"))


@query(f"""with {PERIODS}, r as (select o_custkey, min(s) s, max(e) e from periods group by 1), h as (select c_custkey, date '1992-01-01' + (c_custkey * 17 % 3600)::int d from customer),
a as (select o_custkey, case when d < s and d >= (s - interval 6 month)::date then d else s end s, case when d > e and d <= (e + interval 6 month)::date then d else e end e from r join h on c_custkey = o_custkey),
m as (select *, (year(e) * 12 + month(e) - year(s) * 12 - month(s) + 1) n from a)
select o_custkey, s as "start", e as "end", case when n <= 60 then 'mes' when n <= 240 then 'trimestre' else 'anio' end unit, (year(e) - year(s) + 1)::bigint as years from m""")
def time_axes(t):
    """Each customer's axis of time, its unit and the number of years that it runs through."""
    day = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("c_custkey") * 17 % 3600).cast("int"))
    axes = intervals.axis_range(order_periods(t), t("customer").select(F.col("c_custkey").alias("o_custkey"), day.alias("day")), ["o_custkey"])
    years = (F.year("end") - F.year("start") + 1).cast("long")
    return axes.select("o_custkey", "start", "end", dates.axis_unit(dates.months_inclusive(F.col("start"), F.col("end"))).alias("unit"), years.alias("years"))


@query("""with k as (select c_custkey, (c_custkey % 12)::varchar || ':' || (c_nationkey % 11)::varchar k, c_acctbal >= 0 live from customer)
select c_custkey, row_number() over (order by not live, split_part(k, ':', 1)::int, split_part(k, ':', 2)::int, c_custkey) as place from k order by place limit 50""")
def natural_order(t):
    """The first fifty keys `n:m` in the order of their numbers, live ones before the others."""
    key = F.split(F.concat_ws(":", (F.col("c_custkey") % 12).cast("string"), (F.col("c_nationkey") % 11).cast("string")), ":")
    rows = t("customer").select("c_custkey", key.alias("k"), (F.col("c_acctbal") >= 0).alias("live"))
    order = [F.desc("live"), F.col("k")[0].cast("int"), F.col("k")[1].cast("int"), "c_custkey"]
    top = rows.orderBy(*order).limit(50)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("""with b as (select unnest(['alta', 'media', 'baja', 'sin', 'privada']) certainty), o as (select case when o_totalprice >= 300000 then 'alta' when o_totalprice >= 150000 then 'media' when o_totalprice >= 50000 then 'baja' else 'sin' end certainty, o_totalprice::decimal(18,2) v from orders)
select certainty, count(v) n, coalesce(sum(v), 0) total from b left join o using (certainty) group by 1""")
def certainty_filled(t):
    """Counts and sums of every level of certainty, zeros where it has no order (nobody is `privada` here)."""
    v = F.col("o_totalprice")
    level = F.when(v >= 300000, "alta").when(v >= 150000, "media").when(v >= 50000, "baja").otherwise("sin")
    rows = t("orders").select(level.alias("certainty"), v.cast("decimal(18,2)").alias("v"))
    found = rows.groupBy("certainty").agg(F.count("v").alias("n"), F.sum("v").alias("total"))
    levels = found.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("alta", "media", "baja", "sin", "privada")))).alias("certainty"))
    return levels.join(found, "certainty", "left").select("certainty", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))
