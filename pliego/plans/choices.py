"""Queries that choose, count and reconcile rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pliego.operators import ranking, scoring
from pliego.plans.base import query


@query("""select p_partkey, p_name, copies from (select *, row_number() over (partition by p_name order by p_partkey) rn, count(*) over (partition by p_name) copies from part) where rn = 1""")
def first_wins_dedup(t):
    return ranking.first_wins(t("part"), ["p_name"], [F.col("p_partkey")]).select("p_partkey", "p_name", "copies")


@query("""select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) rn from orders) where rn = 1""")
def argmax_rep(t):
    return ranking.top(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""select c_custkey, event_id, event_type from (select user_id c_custkey, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1""")
def latest_upsert(t):
    rows = t("events").select(F.col("user_id").alias("c_custkey"), "ts", "event_id", "event_type")
    return ranking.latest(rows, ["c_custkey"], ["ts", "event_id"]).select("c_custkey", "event_id", "event_type")


@query("""select source, first_doc, fr_chars from (select source, min(doc_id) first_doc, min_by(n_chars, doc_id) filter (where lang = 'fr') fr_chars from documents group by 1)""")
def group_fill(t):
    fr = F.when(F.col("lang") == "fr", F.col("doc_id"))
    return t("documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.min_by("n_chars", fr).alias("fr_chars"))


@query("""with r as (select o_custkey, o_orderkey, o_totalprice::double p, row_number() over w rn, lead(o_totalprice::double) over w nx,
  count(*) filter (where true) over (partition by o_custkey) c from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)),
b as (select o_custkey, max(p) best from r group by 1), v as (select r.o_custkey, count(*) filter (where best - p <= 5000) - 1 rivals from r join b using (o_custkey) group by 1)
select r.o_custkey, o_orderkey, p score, nx next_score, rivals, case when coalesce(p - nx, 5001) <= 5000 then 'abstain' else 'accept' end decision from r join v using (o_custkey) where rn = 1""")
def score_gap(t):
    rows = t("orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("score"))
    return ranking.winner(rows, ["o_custkey"], "score", "o_orderkey", 5000.0)


@query("""select p_partkey, p_retailprice from (select * from part order by p_retailprice desc, p_partkey limit 500) where p_brand like '%1%' order by p_retailprice desc, p_partkey limit 50""")
def overfetch_filter(t):
    order = [F.desc("p_retailprice"), F.col("p_partkey")]
    return ranking.overfetch(t("part"), order, 500, F.col("p_brand").contains("1"), 50).select("p_partkey", "p_retailprice")


@query("""select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) a from orders) where a <= 3 or o_orderpriority = '1-URGENT'""")
def retention(t):
    newest = F.struct("o_orderdate", "o_orderkey").desc()
    return ranking.keep_newest(t("orders"), ["o_custkey"], newest, 3, F.col("o_orderpriority") == "1-URGENT").select("o_custkey", "o_orderkey")


@query("""select o_orderpriority, count(*) filter (where o_orderstatus = 'F') f, count(*) filter (where o_orderstatus = 'O') o, count(*) filter (where o_orderstatus = 'P') p, count(*) filter (where o_orderstatus = 'X') x from orders group by 1""")
def status_pivot(t):
    out = t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P", "X"]).count().fillna(0)
    return out.withColumnsRenamed({"F": "f", "O": "o", "P": "p", "X": "x"})


BUCKETS = [("alta", 300000), ("media", 150000), ("baja", 50000)]


@query("""select case when o_totalprice >= 300000 then 'alta' when o_totalprice >= 150000 then 'media' when o_totalprice >= 50000 then 'baja' else 'sin' end certainty,
  count(*) n, sum(o_totalprice::decimal(18,2)) total from orders group by 1""")
def certainty_buckets(t):
    level = F.lit("sin")
    for name, least in reversed(BUCKETS):
        level = F.when(F.col("o_totalprice") >= least, name).otherwise(level)
    return t("orders").groupBy(level.alias("certainty")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))


@query("""select user_id, count(*) filter (where event_type = 'error') critical, count(*) filter (where event_type = 'click') alerts, count(*) n,
  case when count(*) filter (where event_type = 'error') > 0 then 'no_confiable' when count(*) filter (where event_type = 'click') > 0 then 'revisar' else 'confiable' end verdict from events group by 1""")
def severity_counts(t):
    kind = F.when(F.col("event_type") == "error", "CRITICA").when(F.col("event_type") == "click", "ALERTA")
    return t("events").withColumn("severity", kind).groupBy("user_id").agg(F.count_if(F.col("severity") == "CRITICA").alias("critical"), F.count_if(F.col("severity") == "ALERTA").alias("alerts"), F.count("*").alias("n"), scoring.worst(F.col("severity")).alias("verdict"))


@query("""select c_custkey, c_name, n_name, r_name from customer join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey and r_name <> 'ASIA'
order by r_name nulls last, c_name, c_custkey limit 50""")
def null_ordering_limit(t):
    region = t("region").where("r_name <> 'ASIA'")
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.orderBy(F.asc_nulls_last("r_name"), "c_name", "c_custkey").limit(50).select("c_custkey", "c_name", "n_name", "r_name")


@query("""select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') urgent from customer""")
def semi_anti(t):
    urgent = t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    with_, without = (t("customer").select("c_custkey").join(urgent, "c_custkey", how) for how in ("left_semi", "left_anti"))
    return with_.withColumn("urgent", F.lit(True)).unionByName(without.withColumn("urgent", F.lit(False)))


@query("""select event_id, k from (select event_id, (props::json->>'k')::bigint k from events) where k not in (select n_nationkey from nation)""")
def dangling_references(t):
    refs = t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return refs.join(t("nation").select(F.col("n_nationkey").cast("long").alias("k")), "k", "left_anti").where("k is not null").select("event_id", "k")


@query("""with x as (select l_suppkey, sum(case when l_returnflag <> 'R' then round(l_extendedprice::decimal(18,4), 2) end)::decimal(28,2) confirmed, sum(round(l_extendedprice::decimal(18,4), 2))::decimal(28,2) most from lineitem group by 1)
select l_suppkey, confirmed, most, case when confirmed >= 12000000 then 'CUMPLE' when most < 12000000 then 'NO CUMPLE' else 'POR VERIFICAR' end verdict from x""")
def money_confirmed(t):
    amount = scoring.money(F.col("l_extendedprice"))
    sums = t("lineitem").groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_returnflag") != "R", amount)).cast("decimal(28,2)").alias("confirmed"), F.sum(amount).cast("decimal(28,2)").alias("most"))
    return sums.withColumn("verdict", scoring.amount_verdict(F.col("confirmed"), F.col("most"), F.lit(12000000)))


TRANCHES = [(0, 25, False, 0), (25, 50, False, 5), (50, 100, True, 10)]


@query("""with p as (select s_nationkey, 100.0::double * count(*) filter (where s_acctbal > 5000) / count(*) pct from supplier group by 1)
select s_nationkey, pct percent_, case when pct < 25 then 0.0 when pct < 50 then 5.0 when pct <= 100 then 10.0 end::double points from p""")
def tranche_score(t):
    share = F.count_if(F.col("s_acctbal") > 5000) * F.lit(100.0) / F.count("*")
    return t("supplier").groupBy("s_nationkey").agg(share.alias("percent_")).withColumn("points", scoring.tranche(F.col("percent_"), TRANCHES))


@query("""select x::double as percent, hits from (select x, (case when x < 25 then 1 else 0 end + case when x >= 20 and x < 50 then 1 else 0 end + case when x > 50 and x <= 100 then 1 else 0 end)::bigint hits from range(0, 101) r(x)) where hits <> 1""")
def tranche_validity(t):
    spark = t("region").sparkSession
    rows = spark.createDataFrame([(0.0, 25.0, False), (20.0, 50.0, False), (50.5, 100.0, True)], "low double, high double, closed boolean")
    return scoring.tranche_faults(spark.range(101).select(F.col("id").cast("double").alias("percent")), rows)


@query("""select event_type, count(*) n, quantile_cont(value, 0.5)::decimal(18,4) p50, quantile_cont(value, 0.95)::decimal(18,4) p95, max(value)::decimal(18,4) most from events group by 1""")
def percentiles(t):
    p = lambda q: F.percentile("value", q).cast("decimal(18,4)")
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("value").cast("decimal(18,4)").alias("most"))


@query("""select quality, n_chars >= 500 predicted, count(*) n from labels join documents using (doc_id) group by 1, 2""")
def confusion(t):
    return t("labels").join(t("documents"), "doc_id").groupBy("quality", (F.col("n_chars") >= 500).alias("predicted")).agg(F.count("*").alias("n"))


@query("""with a as (select source, count(*) n from documents where doc_id % 2 = 0 group by 1), b as (select source, count(*) n from documents where doc_id % 2 = 1 group by 1)
select coalesce(a.source, b.source) source, coalesce(a.n, 0)::bigint n_before, coalesce(b.n, 0)::bigint n_after,
 case when coalesce(b.n, 0) * 4 < coalesce(a.n, 0) * 3 then 'abort' when coalesce(b.n, 0) * 2 > coalesce(a.n, 0) * 3 then 'warn' else 'ok' end verdict from a full join b on a.source = b.source""")
def drift(t):
    counts = t("documents").groupBy("source").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("n_before"), F.count_if(F.col("doc_id") % 2 == 1).alias("n_after"))
    verdict = F.when(4 * F.col("n_after") < 3 * F.col("n_before"), "abort").when(2 * F.col("n_after") > 3 * F.col("n_before"), "warn").otherwise("ok")
    return counts.withColumn("verdict", verdict)


@query("""select conv_id, count(*) n, (min(turn) = 0 and max(turn) = count(*) - 1 and count(distinct turn) = count(*)) contiguous,
 coalesce(bool_or(role = p), false) repeated_role from (select *, lag(role) over (partition by conv_id order by turn) p from conversations) group by 1""")
def contiguity(t):
    rows = t("conversations").withColumn("p", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    whole = (F.min("turn") == 0) & (F.max("turn") == F.count("*") - 1) & (F.countDistinct("turn") == F.count("*"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), whole.alias("contiguous"), F.coalesce(F.bool_or(F.col("role") == F.col("p")), F.lit(False)).alias("repeated_role"))


@query("""select o_custkey, count(*) filter (where o_orderdate < p) inversions from (select *, lag(o_orderdate) over (partition by o_custkey order by o_orderkey) p from orders) group by 1""")
def order_check(t):
    rows = t("orders").withColumn("p", F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return rows.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") < F.col("p")).alias("inversions"))


@query("""select l_orderkey, max_by(l_returnflag, (l_linenumber, l_returnflag)) filter (where l_returnflag <> 'N') last_flag, string_agg(distinct l_linestatus, '; ' order by l_linestatus) statuses from lineitem group by 1""")
def latest_and_listed(t):
    flagged = F.when(F.col("l_returnflag") != "N", F.struct("l_linenumber", "l_returnflag"))
    return t("lineitem").groupBy("l_orderkey").agg(F.max_by("l_returnflag", flagged).alias("last_flag"), F.array_join(F.array_sort(F.collect_set("l_linestatus")), "; ").alias("statuses"))


@query("""with s as (select 'A' tag, c_nationkey k, c_acctbal v, c_custkey i from customer union all select 'B', s_nationkey, s_acctbal, s_suppkey from supplier)
select k, count(*) n, bool_or(v < 0) any_negative, case when count(distinct tag) > 1 then 'ambos' else min(tag) end origin from s group by 1""")
def tagged_union(t):
    part = lambda name, p, tag: t(name).select(F.lit(tag).alias("tag"), F.col(f"{p}_nationkey").alias("k"), F.col(f"{p}_acctbal").alias("v"))
    both = part("customer", "c", "A").unionByName(part("supplier", "s", "B"))
    origin = F.when(F.countDistinct("tag") > 1, "ambos").otherwise(F.min("tag"))
    return both.groupBy("k").agg(F.count("*").alias("n"), F.bool_or(F.col("v") < 0).alias("any_negative"), origin.alias("origin"))


@query("""with a as (select p_brand c, count(*) x from part where p_size <= 25 group by 1), b as (select p_brand c, count(*) y from part where p_type like '%BRASS%' group by 1)
select coalesce(a.c, b.c) code, x, y, case when x is null then 'mef' when y is null then 'infoobras' else 'ambos' end origin from a full join b on a.c = b.c""")
def candidate_fusion(t):
    a = t("part").where("p_size <= 25").groupBy(F.col("p_brand").alias("code")).agg(F.count("*").alias("x"))
    b = t("part").where("p_type like '%BRASS%'").groupBy(F.col("p_brand").alias("code")).agg(F.count("*").alias("y"))
    return a.join(b, "code", "full").withColumn("origin", F.when(F.col("x").isNull(), "mef").when(F.col("y").isNull(), "infoobras").otherwise("ambos"))


@query("""select o_orderkey, case when c_acctbal < 0 then 'POR VERIFICAR' when o_orderdate::date >= date '1994-01-01' - 15 then 'SI' when o_orderstatus = 'F' then 'NO' else 'POR VERIFICAR' end cross_a from orders join customer on o_custkey = c_custkey""")
def date_cross(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    known = F.when(F.col("c_acctbal") >= 0, F.to_date("o_orderdate") >= F.date_sub(F.lit("1994-01-01").cast("date"), 15))
    return joined.select("o_orderkey", scoring.three_valued(known, F.col("o_orderstatus") == "F").alias("cross_a"))


@query("""select p_partkey, ceil((p_size / 4.0)::decimal(18,6) * case p_size % 4 when 0 then 365 when 1 then 30 when 2 then 1 end)::bigint as days from part""")
def requirement_days(t):
    unit = F.element_at(F.array(F.lit("anios"), F.lit("meses"), F.lit("dias"), F.lit("otros")), F.col("p_size") % 4 + 1)
    return t("part").select("p_partkey", scoring.minimum_days(F.col("p_size") / 4, unit).alias("days"))


@query("""select l_orderkey, max_by(l_returnflag, (l_linenumber, l_returnflag)) = 'N' and count(*) filter (where l_returnflag <> 'N') > 0 trailing_empty, count(*) filter (where l_returnflag <> 'N') filled, count(*) n from lineitem group by 1""")
def trailing_verdict(t):
    rows = t("lineitem").withColumn("flag", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")))
    last = F.max_by(F.struct("flag"), F.struct("l_linenumber", "l_returnflag"))["flag"]
    return rows.groupBy("l_orderkey").agg((last.isNull() & (F.count("flag") > 0)).alias("trailing_empty"), F.count("flag").alias("filled"), F.count("*").alias("n"))


@query("""select o_custkey, count(*) n, count(flag) filled, case when count(flag) = 0 and count(*) >= 3 then 'blank' when count(flag) = 0 then 'none' when 2 * (count(*) - count(flag)) >= count(*) and count(*) - count(flag) >= 2 then 'CRITICA' when count(flag) < count(*) then 'ALERTA' else 'ok' end finding
from (select o_custkey, case when o_orderpriority <> '5-LOW' then 1 end flag from orders) group by 1""")
def coverage_lock(t):
    flag = F.when(F.col("o_orderpriority") != "5-LOW", 1)
    n, filled = F.col("n"), F.col("filled")
    counts = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count(flag).alias("filled"))
    finding = F.when((filled == 0) & (n >= 3), "blank").when(filled == 0, "none").when((2 * (n - filled) >= n) & (n - filled >= 2), "CRITICA").when(filled < n, "ALERTA").otherwise("ok")
    return counts.withColumn("finding", finding)


@query("""with a as (select doc_id, quality from labels), b as (select doc_id, case when n_chars > 300 then 1 else 0 end quality from documents)
select a.quality old_, b.quality new_, count(*) n from a full join b using (doc_id) group by 1, 2""")
def run_comparison(t):
    a = t("labels").select("doc_id", F.col("quality").alias("old_"))
    b = t("documents").select("doc_id", (F.col("n_chars") > 300).cast("int").alias("new_"))
    return a.join(b, "doc_id", "full").groupBy("old_", "new_").agg(F.count("*").alias("n"))
