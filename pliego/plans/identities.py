"""Queries that decide whether a process, an awardee or a position is the one meant."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pliego.operators import identity, ranking
from pliego.plans.base import query

KINDS = ("expediente", "supervision", "ejecucion", "otro")


def _kind(index):
    return F.element_at(F.array(*map(F.lit, KINDS)), (index % 4 + 1).cast("int"))


PROCESSES = """l as (select l_orderkey, min(l_shipdate)::date vf, max(l_shipdate)::date vt, list(distinct l_suppkey) sup, count(distinct l_returnflag) contracts, sum(l_extendedprice) amount from lineitem group by 1),
p as (select o_orderkey, (o_orderkey * 37) % 101 score, o_orderkey % 100 issuer, sup, contracts, ['expediente', 'supervision', 'ejecucion', 'otro'][o_orderkey % 4 + 1] wanted, ['expediente', 'supervision', 'ejecucion', 'otro'][o_orderkey // 3 % 4 + 1] found,
  case when o_orderkey % 11 > 0 then o_orderdate::date end s, o_orderdate::date + 90 e, case when o_orderkey % 7 > 0 then o_orderdate::date + (o_orderkey % 40 - 15)::int end signed,
  case when o_orderkey % 5 > 0 then vf end vf, vt, o_totalprice a, amount b from orders join l on o_orderkey = l_orderkey)"""


def _processes(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.to_date(F.min("l_shipdate")).alias("vf"), F.to_date(F.max("l_shipdate")).alias("vt"), F.collect_set("l_suppkey").alias("sup"), F.count_distinct("l_returnflag").alias("contracts"), F.sum("l_extendedprice").alias("b")
    )
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = t("orders").select(
        k, ((k * 37) % 101).alias("score"), (k % 100).alias("issuer"), _kind(k).alias("wanted"), _kind(F.expr("o_orderkey div 3")).alias("found"), F.when(k % 11 > 0, d).alias("s"), F.date_add(d, 90).alias("e"),
        F.when(k % 7 > 0, F.date_add(d, (k % 40 - 15).cast("int"))).alias("signed"), F.col("o_totalprice").alias("a"),
    )
    return rows.join(lines, "o_orderkey").withColumn("vf", F.when(k % 5 > 0, F.col("vf")))


@query(f"""with {PROCESSES}, g as (select *, case when score >= 85 then 'a_favor' when score < 60 then 'en_contra' else 'sin_dato' end entity, case when list_contains(sup, issuer) then 'a_favor' else 'sin_dato' end awardee,
  case when found = 'otro' then 'sin_dato' when wanted = found then 'a_favor' else 'en_contra' end object,
  case when s is null or (signed is null and vf is null) then 'sin_dato' when signed - s > 15 then 'en_contra' when vf is not null and least(e, vt) - greatest(s, vf) + 1 <= 0 then 'en_contra' when vf is not null or signed is not null then 'a_favor' else 'sin_dato' end "time",
  case when abs(a - b) / greatest(a, b) <= 0.2 then 'a_favor' else 'sin_dato' end amount from p)
select o_orderkey, entity, awardee, object, "time", amount, case when 'en_contra' in (entity, awardee, object) then 'CONTRADICE' when contracts > 1 then 'POR_CONFIRMAR'
  when awardee = 'a_favor' and (entity = 'a_favor' or object = 'a_favor') then 'CONFIRMADO' else 'POR_CONFIRMAR' end verdict from g""")
def process_identity(t):
    """Five signals of each process, two of them weak, and the verdict on its identity."""
    c = F.col
    rows = _processes(t).select(
        "o_orderkey", "contracts", identity.entity_signal(c("score")).alias("entity"), identity.awardee_signal(c("issuer"), c("sup")).alias("awardee"), identity.object_signal(c("wanted"), c("found")).alias("object"),
        identity.time_signal(c("s"), c("e"), c("signed"), c("vf"), c("vt")).alias("time"), identity.amount_signal(c("a"), c("b")).alias("amount"),
    )
    return rows.withColumn("verdict", identity.process_verdict(c("entity"), c("awardee"), c("object"), c("contracts"))).drop("contracts")


@query("""with p as (select l_orderkey, l_partkey, ['expediente', 'supervision', 'ejecucion', 'otro'][l_partkey % 4 + 1] k from lineitem)
select l_orderkey, case when count(distinct l_partkey) filter (where k = 'supervision') = 1 then min(l_partkey) filter (where k = 'supervision') end l_partkey, count(distinct l_partkey) filter (where k = 'supervision') n,
  case count(distinct l_partkey) filter (where k = 'supervision') when 0 then 'none' when 1 then 'selected' else 'ambiguous' end state from p group by 1""")
def process_selection(t):
    """The one process of the kind looked for, if it is the only one."""
    return identity.selected(t("lineitem").withColumn("kind", _kind(F.col("l_partkey"))), "l_orderkey", "kind", "l_partkey", F.lit("supervision"))


@query("""select l_orderkey, case when count(distinct l_suppkey) = 1 then min(l_suppkey) end l_suppkey, max(l_quantity) l_quantity from (select *, max(l_quantity) over (partition by l_orderkey) best from lineitem) where l_quantity = best group by 1""")
def best_awardee(t):
    """The awardee with the best score; several with that score decide nothing."""
    return identity.only_best(t("lineitem").select("l_orderkey", "l_suppkey", "l_quantity"), "l_orderkey", "l_suppkey", "l_quantity")


@query("""select c_nationkey, case when count(*) = 1 then min(c_custkey) when count(*) filter (where c_acctbal > 8000) = 1 then min(c_custkey) filter (where c_acctbal > 8000) end c_custkey
from customer where c_mktsegment = 'BUILDING' and c_custkey % 3 = 0 group by 1""")
def exact_name(t):
    """Of several registered companies of one name the only one, else the only active one, else none."""
    return identity.exact_or_only_active(t("customer"), "c_nationkey", "c_custkey", (F.col("c_mktsegment") == "BUILDING") & (F.col("c_custkey") % 3 == 0), F.col("c_acctbal") > 8000)


@query("""select l_partkey, min(l_suppkey) filter (where l_returnflag = 'R' and l_linestatus = 'O') l_suppkey from lineitem group by 1
having count(distinct l_suppkey) <= 3 and count(distinct l_suppkey) filter (where l_returnflag = 'R' and l_linestatus = 'O') = 1""")
def official_promotion(t):
    """Cases with three candidates at most of which official evidence names exactly one."""
    rows = t("lineitem").select("l_partkey", "l_suppkey", ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("positive"))
    return identity.promoted(rows, "l_partkey", "l_suppkey", "positive")


PLACED = """r as (select l_orderkey g, l_suppkey w, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_quantity, l_extendedprice) i, count(*) over (partition by l_orderkey) n from lineitem),
own as (select * from r where w in (select w from r x where x.g = r.g group by w having count(*) = 1)),
said as (select a.g, a.i, b.w from r a join r b on a.g = b.g and b.i = (a.i - 1 + case when a.w % 3 = 0 then 0 else a.g % 3 end) % a.n + 1)"""


@query(f"""with {PLACED}, h as (select s.g, s.i, o.i j from said s join own o on s.g = o.g and s.w = o.w where exists (select 1 from own x where x.g = s.g and x.i = s.i)),
k as (select g, j - i step, count(*) times from h where i <> j group by 1, 2), m as (select g, count(*) judged from h group by 1),
b as (select *, row_number() over (partition by g order by times desc, abs(step), step desc) rn from k)
select g as l_orderkey, step::bigint step, times, judged, times >= 2 and 2 * times > judged pattern from b join m using (g) where rn = 1""")
def shifted_verdicts(t):
    """Orders whose rows use words that belong to another row, by the step between them."""
    w = Window.partitionBy("l_orderkey")
    rows = t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("word"), F.row_number().over(w.orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("long").alias("at"), F.count("*").over(w).alias("n"))
    own = rows.join(rows.groupBy("l_orderkey", "word").agg(F.count("*").alias("times")).where("times = 1"), ["l_orderkey", "word"]).select("l_orderkey", "at", "word")
    step = F.when(F.col("word") % 3 == 0, 0).otherwise(F.col("l_orderkey") % 3)
    moved = rows.select("l_orderkey", "at", ((F.col("at") - 1 + step) % F.col("n") + 1).alias("other"))
    said = moved.join(rows.select("l_orderkey", F.col("at").alias("other"), "word"), ["l_orderkey", "other"]).select("l_orderkey", "at", "word")
    return identity.offsets(identity.word_owner(said, own, "l_orderkey", "at"), "l_orderkey", "at", "owner_at")


@query("""with q as (select c_custkey, unnest([c_nationkey % 7, c_nationkey % 5 + 3, c_custkey % 11]) w from customer), r as (select n_nationkey, unnest([n_nationkey % 7, n_nationkey % 5 + 3]) w from nation),
qd as (select distinct * from q), rd as (select distinct * from r), z as (select n_nationkey, count(*) size from rd group by 1),
s as (select c_custkey, n_nationkey, round(count(*) + count(*) / size, 9) score from qd join rd using (w) join z using (n_nationkey) group by 1, 2, size), b as (select *, max(score) over (partition by c_custkey) best from s)
select c_custkey, case when count(distinct n_nationkey) = 1 then min(n_nationkey) end n_nationkey, max(score) score from b where score = best group by 1""")
def position_requirements(t):
    """The requirement that shares most words with a position; two alike decide nothing. Requirements are all nations."""
    n = F.col("c_nationkey").cast("long")
    words = t("customer").select("c_custkey", F.explode(F.array(n % 7, n % 5 + 3, F.col("c_custkey") % 11)).alias("word"))
    k = F.col("n_nationkey").cast("long")
    required = t("nation").select("n_nationkey", F.explode(F.array(k % 7, k % 5 + 3)).alias("word"))
    return identity.position_match(words, required, "c_custkey", "n_nationkey")


@query("""with s as (select doc_id, source, lang, n_chars, row_number() over (partition by source, lang, n_chars % 10 order by doc_id) rn from documents)
select source, lang, n_chars % 10 code, doc_id, (select count(*) from documents d where d.source is not distinct from s.source and d.lang is not distinct from s.lang and d.n_chars % 10 = s.n_chars % 10) copies from s where rn = 1""")
def alert_dedup(t):
    """Alerts of one severity, code and reference once, the first of them, with their number."""
    rows = t("documents").select("source", "lang", (F.col("n_chars") % 10).alias("code"), "doc_id")
    counts = rows.groupBy("source", "lang", "code").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    return counts.select("source", "lang", "code", "doc_id", "copies")


@query("""with w as (select l_partkey, l_orderkey, l_suppkey, l_shipdate::date s, l_shipdate::date + (l_quantity * 10)::int e, l_returnflag = 'A' done, row_number() over (partition by l_orderkey, l_partkey order by l_shipdate, l_suppkey, l_quantity, l_returnflag) r from lineitem),
c as (select p_partkey, date '1996-01-01' + p_size s, date '1996-01-01' + p_size + 200 e from part), j as (select p_partkey, l_orderkey, done, least(w.e, c.e) - greatest(w.s, c.s) shared, abs(w.s - c.s) far from w join c on l_partkey = p_partkey where r = 1),
x as (select *, row_number() over (partition by p_partkey order by case when shared > 0 then shared else -1000000000 - far end desc, done desc, l_orderkey) rn from j)
select p_partkey, l_orderkey, case when shared > 0 then 'overlap' else 'nearest' end tier, greatest(shared, 0)::bigint shared from x where rn = 1""")
def best_work(t):
    """The work of each code that shares most days with a certificate, else the one that starts nearest; finished ones first, then the smaller code.

    A period's last day isn't counted here: periods that share one day only share none.
    """
    first = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_shipdate", "l_suppkey", "l_quantity", "l_returnflag")
    s = F.to_date("l_shipdate")
    works = t("lineitem").withColumn("r", F.row_number().over(first)).where("r = 1").select("l_partkey", "l_orderkey", s.alias("s2"), F.date_add(s, (F.col("l_quantity") * 10).cast("int")).alias("e2"), (F.col("l_returnflag") == "A").alias("done"))
    base = F.date_add(F.lit("1996-01-01").cast("date"), F.col("p_size"))
    certificates = t("part").select("p_partkey", base.alias("s1"), F.date_add(base, 200).alias("e1"))
    return ranking.best_work(works.join(certificates, F.col("l_partkey") == F.col("p_partkey")), "p_partkey", "l_orderkey", "done")


@query("""with p as (select l_partkey, l_suppkey, l_orderkey, l_quantity q from lineitem),
c as (select l_partkey, count(distinct l_suppkey) n, min(q) q from p group by 1), d as (select l_partkey, n_name, c_nationkey from c join customer on c_custkey = l_partkey join nation on n_nationkey = c_nationkey)
select l_partkey, n_name, round(greatest(n * 10.0 - q, 0) + case when c_nationkey in (l_partkey % 25, (l_partkey + 1) % 25) then 10 when q >= 2 then -10 else 0 end + case when n * 9 >= 90 then 15 else 0 end, 1)::double bonus from c join d using (l_partkey)""")
def official_card(t):
    """What the official card of each code that has one adds to a candidate's score."""
    c = t("lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"), F.min("l_quantity").alias("q"))
    d = t("customer").select((F.col("c_custkey")).alias("k"), "c_nationkey").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = c.join(d, F.col("l_partkey") == F.col("k"))
    hints = F.array(F.col("l_partkey") % 25, (F.col("l_partkey") + 1) % 25)
    others = F.when(F.col("q") >= 2, F.lit(-1).cast("long"))
    bonus = identity.card_bonus(F.col("q"), F.col("n") * 10.0, F.col("c_nationkey").cast("long"), others, hints, F.col("n") * 9.0)
    return rows.select("l_partkey", "n_name", bonus.cast("double").alias("bonus"))
