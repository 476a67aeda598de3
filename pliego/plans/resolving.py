"""Queries that resolve names to records through scores, vetoes and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pliego.functions import text
from pliego.operators import resolution
from pliego.plans.base import query
from pliego.plans.texts import STOP


@query("""with p as (select p_name, min(p_partkey) id, min_by(p_brand, p_partkey) brand, min_by(p_size, p_partkey) size from part group by 1),
k as (select id, unnest(list_distinct([x for x in regexp_extract_all(upper(p_name), '[A-Z0-9]+') if length(x) > 2 and x not in ('THE', 'AND', 'FOR')])) w from p),
n as (select id, count(*) c from k group by 1), h as (select a.id q, b.id candidate, count(*) hits from k a join k b using (w) where a.id <> b.id group by 1, 2),
s as (select q, candidate, hits, (n.c + 1) // 2 needed, 100.0 * hits / n.c + case when x.brand = y.brand then 40 else -15 end + case when x.size % 5 = y.size % 5 then 15 else -10 end + case when abs(x.size - y.size) <= 3 then 8 else 0 end score,
  case when abs(x.size - y.size) > 40 then 'ETAPA' end veto from h join n on n.id = q join p x on x.id = q join p y on y.id = candidate),
f as (select *, case when veto is null then score end free from s), b as (select q, max(free) best from f group by 1),
r as (select q, greatest(count(*) filter (where best - free <= 4) - 1, 0) rivals from f join b using (q) group by 1),
o as (select *, row_number() over (partition by q order by free desc nulls last, candidate) rn from f)
select q, candidate, free::double score, rivals::bigint rivals, case when free is null then 'VETADO' when rivals > 0 then 'EMPATE' when hits >= needed and free >= 70 then 'NOMBRE' when hits >= needed or (free >= 90 and hits >= 1) then 'PROBABLE' else 'REVISION' end via
from o join r using (q) where rn = 1""")
def resolver_gate(t):
    names = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.min_by("p_brand", "p_partkey").alias("brand"), F.min_by("p_size", "p_partkey").alias("size"))
    words = names.select("id", F.explode(text.tokens(F.col("p_name"), STOP)).alias("w"))
    sizes = words.groupBy(F.col("id").alias("q")).agg(F.count("*").alias("c"))
    hits = words.select(F.col("id").alias("q"), "w").join(words.select(F.col("id").alias("candidate"), "w"), "w").where("q <> candidate").groupBy("q", "candidate").agg(F.count("*").alias("hits"))
    side = lambda key, p: names.select(F.col("id").alias(key), F.col("brand").alias(f"{p}_brand"), F.col("size").alias(f"{p}_size"))
    joined = hits.join(sizes, "q").join(side("q", "x"), "q").join(side("candidate", "y"), "candidate")
    apart = F.abs(F.col("x_size") - F.col("y_size"))
    scored = resolution.score(100.0 * F.col("hits") / F.col("c"), F.col("x_brand") == F.col("y_brand"), F.col("x_size") % 5 == F.col("y_size") % 5, F.lit(False), apart)
    rows = joined.select("q", "candidate", "hits", F.expr("(c + 1) div 2").alias("needed"), scored.cast("double").alias("score"), resolution.veto(("ETAPA", apart > 40)).alias("veto"))
    return resolution.decide(rows, "q")


@query("""with x as (select n_nationkey, n_name, r_name, count(*) over (partition by r_regionkey) n from nation join region on n_regionkey = r_regionkey)
select n_nationkey, case when n = 1 then n_name end exclusive_, n from x""")
def exclusivity(t):
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("n_regionkey"))
    joined = t("nation").join(t("region").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey")
    return joined.withColumn("n", n).select("n_nationkey", F.when(F.col("n") == 1, F.col("n_name")).alias("exclusive_"), "n")


@query("""with c as (select l_partkey, l_suppkey, l_orderkey, l_extendedprice::decimal(18,2) amount, l_shipdate::date d, row_number() over (partition by l_partkey order by (l_returnflag = 'A') desc, l_extendedprice::decimal(18,2), l_orderkey, l_linenumber) rn, count(*) over (partition by l_partkey) n
 from lineitem where l_shipdate::date <= date '1997-12-31')
select l_partkey, l_suppkey, l_orderkey, amount, n from c where rn = 1""")
def contract_cascade(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey")
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = t("lineitem").where(F.to_date("l_shipdate") <= F.lit("1997-12-31").cast("date")).withColumn("amount", amount)
    order = w.orderBy((F.col("l_returnflag") == "A").desc(), "amount", "l_orderkey", "l_linenumber")
    return rows.withColumns({"rn": F.row_number().over(order), "n": F.count("*").over(w)}).where("rn = 1").select("l_partkey", "l_suppkey", "l_orderkey", "amount", "n")
