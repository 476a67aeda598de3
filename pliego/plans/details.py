"""Queries on contracts, siblings, places, levels of certainty and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pliego.functions import names, text
from pliego.operators import ranking, resolution, scoring
from pliego.plans.base import query
from pliego.plans.features import NAMED, _listed, _named, _pick


@query("""with o as (select o_custkey, o_orderpriority, o_orderkey, o_orderstatus, case when o_orderkey % 3 > 0 then 'url' || o_orderkey end url from orders)
select o_custkey, o_orderpriority, min(o_orderkey) o_orderkey, arg_min(o_orderstatus, o_orderkey) o_orderstatus, arg_min(url, o_orderkey) filter (where url is not null) url, count(*) copies from o group by 1, 2""")
def contracts_completed(t):
    """Contracts of one number and amount once, the first of them, with the address of the first that has one."""
    url = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("url"), F.col("o_orderkey").cast("string")))
    rows = t("orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus", url.alias("url"))
    return ranking.completed_first(rows, ["o_custkey", "o_orderpriority"], "o_orderkey", ["url"])


@query("""select l_orderkey, count(*) total, count(*) filter (where l_returnflag = 'A') resolved, count(*) filter (where l_returnflag = 'R') review,
  case when count(*) filter (where l_returnflag = 'A') = count(*) then 'completa' when count(*) filter (where l_returnflag = 'A') > 0 then 'parcial' else 'ninguna' end state from lineitem group by 1""")
def sub_work_counts(t):
    """How many of an order's works are resolved."""
    n = lambda flag: F.count_if(F.col("l_returnflag") == flag)
    found = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("total"), n("A").alias("resolved"), n("R").alias("review"))
    return found.withColumn("state", F.when(F.col("resolved") == F.col("total"), "completa").when(F.col("resolved") > 0, "parcial").otherwise("ninguna"))


@query("""with m as (select distinct o_custkey, date_trunc('month', o_orderdate)::date m from orders), p as (select *, row_number() over (partition by o_custkey order by m) - 1 place from m)
select o_custkey, year(m)::int as "year", min(place) as "first", max(place) as "last" from p group by 1, 2""")
def year_runs(t):
    """The heading of a time axis: which of its months lie in each year."""
    return ranking.year_runs(t("orders").select("o_custkey", F.trunc("o_orderdate", "MM").alias("m")).distinct(), ["o_custkey"], "m")


@query("""with j as (select o_orderkey, o_orderdate::date s, o_orderdate::date + 60 e, l_shipdate::date d from orders join lineitem on l_orderkey = o_orderkey)
select o_orderkey, count(*) n, count(*) filter (where year(d) between year(s) and year(e)) in_years, count(*) filter (where date_trunc('month', d)::date <= e and last_day(d) >= s) in_months from j group by 1""")
def window_filters(t):
    """Documents by year and by month of a certificate's period."""
    s, e, d = F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 60), F.to_date("l_shipdate")
    joined = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.count_if(F.year(d).between(F.year(s), F.year(e))).alias("in_years"), F.count_if((F.trunc(d, "MM") <= e) & (F.last_day(d) >= s)).alias("in_months"))


@query("""with k as (select c_custkey, (c_custkey % 400)::varchar code from customer), s as (select s_suppkey, s_suppkey::varchar code from supplier)
select s_suppkey, count(*) near, count(*) filter (where k.code = s.code) exact_, min(c_custkey) filter (where k.code = s.code) first_ from s join k on contains(k.code, s.code) group by 1""")
def exact_codes(t):
    """Of a source that answers with all codes that contain the one asked for, those that are it.

    The parts of each code (of three digits) are listed, so codes meet by equality.
    """
    code = (F.col("c_custkey") % 400).cast("string")
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("code")), lambda i: F.transform(F.sequence(F.lit(1), F.length("code") - i + 1), lambda n: F.col("code").substr(i, n)))))
    listed = t("customer").select("c_custkey", code.alias("code")).select("c_custkey", "code", F.explode(parts).alias("part"))
    asked = t("supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("part"))
    same = F.col("code") == F.col("part")
    return asked.join(listed, "part").groupBy("s_suppkey").agg(F.count("*").alias("near"), F.count_if(same).alias("exact_"), F.min(F.when(same, F.col("c_custkey"))).alias("first_"))


@query("""with r as (select o_orderkey, o_custkey, o_orderpriority p, case when o_orderstatus = 'F' then o_orderkey * 10 end code from orders),
m as (select a.o_orderkey, min(b.o_orderkey) source from r a join r b on a.o_custkey = b.o_custkey and a.code is null and b.code is not null and 100 - 100.0 * levenshtein(a.p, b.p) / greatest(length(a.p), length(b.p)) >= 85 group by 1)
select r.o_orderkey, coalesce(r.code, b.code) code, case when r.code is null then m.source end source from r left join m using (o_orderkey) left join r b on b.o_orderkey = m.source""")
def sibling_inheritance(t):
    """Orders without a code take that of the earliest one with the same folio (customer) and an issuer alike (85 of 100)."""
    rows = t("orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("p"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") * 10).alias("code"))
    alike = lambda a, b: 100 - 100.0 * F.levenshtein(a["p"], b["p"]) / F.greatest(F.length(a["p"]), F.length(b["p"])) >= 85
    return resolution.inherit(rows, "o_orderkey", "o_custkey", "code", alike)


REGISTERED = ("TOCACHE", "HUANCAVELICA", "SANTA", "-MUL.DEP-", "LIMA", "TODOS", "EL TAMBO", "")


@query(f"""with {NAMED}, c as (select o_orderkey, upper({_listed(REGISTERED)}[o_orderkey % 8 + 1]) r, [x for x in [trim(regexp_replace(regexp_replace(trim(x), '^(PROVINCIA|PROV|DISTRITO|DIST|DEPARTAMENTO|DPTO|REGION|REG|LOCALIDAD|SECTOR|CENTRO POBLADO)\\s+(DE\\s+)?', ''), '^DE\\s+', ''))
  for x in regexp_split_to_array(replace(p, 'HVCA', 'HUANCAVELICA'), '[,;|()/-]')] if x <> ''] terms from n),
k as (select *, r <> '' and not regexp_matches(trim(regexp_replace(r, '[^A-Z0-9]+', ' ', 'g')), '^(TODOS|MUL\\s*DEP\\w*|MULTI\\w*|NO\\s+APLICA|SIN\\s+\\w+)$') known from c),
f as (select *, list_bool_or([x = r or (length(x) >= 4 and contains(' ' || r || ' ', ' ' || regexp_replace(x, '\\W', ' ', 'g') || ' ')) or (length(r) >= 4 and contains(' ' || regexp_replace(x, '\\W', ' ', 'g') || ' ', ' ' || r || ' ')) for x in terms]) found from k)
select o_orderkey, known and not coalesce(found, false) contradicts from f""")
def place_contradictions(t):
    """Whether a register's place is none of those that a certificate names; sentinels never contradict."""
    rows = _named(t).select("o_orderkey", names.place_terms(F.col("place")).alias("declared"), _pick(REGISTERED, F.col("o_orderkey")).alias("r"))
    return rows.select("o_orderkey", names.place_contradicts(F.col("declared"), F.array().cast("array<string>"), F.col("r")).alias("contradicts"))


@query("""with s as (select l_orderkey, count(*) parts, count(*) filter (where l_returnflag = 'A') resolved from lineitem group by 1)
select o_orderkey, case when o_orderkey % 17 = 0 then 'privada' when o_orderkey % 5 = 0 and o_orderkey % 3 > 0 then 'citado' when parts > 4 then case when resolved = 0 then 'sin_identificar' else 'multi_obra' end
  when o_orderstatus = 'F' then 'confirmado_mef' when o_orderkey % 5 <> 0 and o_orderstatus = 'O' and o_orderkey % 3 > 0 then 'inferido' else 'sin_identificar' end as "level" from orders join s on l_orderkey = o_orderkey""")
def certainty_levels(t):
    """Six levels of certainty about which work is meant."""
    works = t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("parts"), F.count_if(F.col("l_returnflag") == "A").alias("resolved"))
    k = F.col("o_orderkey")
    level = resolution.certainty(k % 17 == 0, k % 5 == 0, F.when(k % 3 > 0, k), F.when(F.col("parts") > 4, F.col("parts")).otherwise(1), F.col("resolved"), F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")
    return t("orders").join(works, k == F.col("l_orderkey")).select("o_orderkey", level.alias("level"))


@query(f"""with {NAMED} select o_orderkey, coalesce(case when o_orderkey % 7 = 0 then 'obra' end, case when o_orderkey % 5 = 0 then 'expediente' end, case when contains(lower(strip_accents("name")), 'expediente tecnico') then 'expediente' else 'obra' end) route,
  case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then 'POR VERIFICAR' when o_orderkey % 300 < 120 then 'NO CUMPLE' else 'CUMPLE' end verdict from n""")
def routes_and_days(t):
    """Whether a certificate goes by documents or by works, and the verdict on its days."""
    k = F.col("o_orderkey")
    way = resolution.route(F.when(k % 7 == 0, "obra"), F.when(k % 5 == 0, "expediente"), F.col("name"))
    verdict = resolution.days_verdict(F.when(k % 11 > 0, k % 300), F.lit(120), k % 13 == 0)
    return _named(t).select("o_orderkey", way.alias("route"), verdict.alias("verdict"))


@query("""select s_suppkey, coalesce(case when s_suppkey % 3 = 0 then s_name end, case when s_suppkey % 5 = 0 then 'alias' end, '-') picked, case when length(s_name) <= 12 then s_name else left(s_name, 11) || '…' end excerpt, round_even(s_acctbal / 7, 1) rounded, round(s_acctbal::decimal(12,2), 1)::double half_up from supplier""")
def picks_and_excerpts(t):
    """The first value that isn't empty, a text cut for display, and numbers rounded to even and half up."""
    k = F.col("s_suppkey")
    picked = text.first_filled(F.when(k % 3 == 0, F.col("s_name")), F.when(k % 5 == 0, "alias"), F.lit(" "), F.lit("-"))
    half = F.round(F.col("s_acctbal").cast("decimal(12,2)"), 1).cast("double")
    return t("supplier").select("s_suppkey", picked.alias("picked"), text.excerpt(F.col("s_name"), 12).alias("excerpt"), scoring.rounded_even(F.col("s_acctbal") / 7, 1).alias("rounded"), half.alias("half_up"))


@query("""select o_custkey, count(*) n, count(*) filter (where o_orderstatus = 'F') cumple, count(*) filter (where o_orderstatus = 'O') no_cumple, count(distinct o_orderpriority) alerts, sum(o_totalprice::decimal(18,2)) total,
  case when count(*) filter (where o_orderstatus = 'O') > 0 then 'NO CUMPLE' when count(*) filter (where o_orderstatus = 'P') > 0 then 'POR VERIFICAR' else 'CUMPLE' end verdict from orders group by 1""")
def job_summary(t):
    """Verdicts, alerts without repeats, scores and the verdict on the whole of each customer."""
    n = lambda status: F.count_if(F.col("o_orderstatus") == status)
    found = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), n("F").alias("cumple"), n("O").alias("no_cumple"), n("P").alias("p"), F.count_distinct("o_orderpriority").alias("alerts"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    verdict = F.when(F.col("no_cumple") > 0, "NO CUMPLE").when(F.col("p") > 0, "POR VERIFICAR").otherwise("CUMPLE")
    return found.withColumn("verdict", verdict).drop("p")


@query("""select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderdate, o_orderkey) contracts, count(*) n from orders group by 1""")
def contract_lists(t):
    """All contracts of a call, in order of date."""
    listed = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    rows = t("orders").groupBy("o_custkey").agg(listed.alias("l"), F.count("*").alias("n"))
    return rows.select("o_custkey", F.array_join(F.transform("l", lambda x: x["o_orderkey"].cast("string")), ",").alias("contracts"), "n")
