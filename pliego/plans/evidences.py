"""Queries on what documents prove."""

from __future__ import annotations

from pyspark.sql import functions as F

from pliego.operators import evidence
from pliego.plans.base import query
from pliego.plans.features import _listed, _pick

SERVICES = (
    "Supervisión de ejecución de la obra", "Residente y supervisor de obra", "Supervisión de la elaboración del expediente técnico", "Elaboración del expediente técnico y ejecución", "Elaboración de estudio definitivo",
    "Perfil de proyecto", "Ejecución del puente", "Consultoría", "supervisora", "",
)
KINDS = ("supervision_obra", "elaboracion_expediente", "ejecucion_obra", "preinversion", "supervision_expediente")


@query(f"""with o as (select o_orderkey, lower(strip_accents({_listed(SERVICES)}[o_orderkey % 10 + 1])) x, {_listed(KINDS)}[o_orderkey // 10 % 5 + 1] d, {_listed(KINDS)}[o_orderkey // 50 % 5 + 1] e, o_orderkey % 7 page, o_orderkey % 3 > 0 src from orders),
k as (select *, contains(x, 'supervis') s, contains(x, 'residente') r, contains(x, 'ejecucion') or contains(x, 'residente') x2, regexp_matches(x, 'elaboracion (de(l| la)? )?(expediente|estudio definitivo)') w from o),
z as (select *, case when r and s then null when regexp_matches(x, 'supervision de la elaboracion del expediente') then 'supervision_expediente' when (s and w) or (w and x2) then null when s then 'supervision_obra' when w then 'elaboracion_expediente' when contains(x, 'perfil de proyecto') then 'preinversion' when x2 then 'ejecucion_obra' end kind from k),
p as (select *, case when x <> '' and page > 0 and src and kind = d then d end proven from z)
select o_orderkey, kind, proven, case when proven is null then 'no_determinado' when proven = e then 'coincide' else 'difiere' end contrast,
  coalesce(case when o_orderkey % 2 = 0 then proven in ('supervision_obra', 'ejecucion_obra') else proven in ('elaboracion_expediente', 'preinversion', 'supervision_expediente') end, false) wrong_phase from p""")
def service_evidence(t):
    """The service that each certificate proves, and whether it is the one expected."""
    k = F.col("o_orderkey")
    text, declared, expected = _pick(SERVICES, k), _pick(KINDS, F.expr("o_orderkey div 10")), _pick(KINDS, F.expr("o_orderkey div 50"))
    proven = evidence.proven_kind(declared, text, k % 7, F.when(k % 3 > 0, "certificado").otherwise("otro"), ("certificado",))
    rows = t("orders").select(k, evidence.service_kind(text).alias("kind"), proven.alias("proven"), expected.alias("e"))
    return rows.select(k, "kind", "proven", evidence.contrast(F.col("e"), F.col("proven")).alias("contrast"), evidence.wrong_phase(F.col("proven"), k % 2 == 0).alias("wrong_phase"))


@query("""with l as (select l_orderkey, case when l_linenumber % 4 = 0 then round(l_extendedprice * 0.1, 2) else l_extendedprice end v, ['acredita', 'obra_supervisada', 'descartado', 'sin_etiqueta', 'acredita'][l_partkey % 5 + 1] label from lineitem union all
  select l_orderkey, l_extendedprice, 'obra_supervisada' from lineitem where l_linenumber % 4 = 0),
x as (select a.*, exists (select 1 from l b where b.l_orderkey = a.l_orderkey and b.v > a.v and abs(a.v - b.v * 0.1) < greatest(1, b.v * 0.001)) tenth from l a), y as (select *, label <> 'descartado' and not tenth live from x)
select l_orderkey, case when count(distinct v) filter (where live and label = 'acredita') = 1 then min(v) filter (where live and label = 'acredita') end amount,
  case when count(distinct v) filter (where live and label = 'acredita') > 1 then 'varios' when count(distinct v) filter (where live and label = 'acredita') = 1 then null when count(*) filter (where live) = 0 then 'ninguno'
  when count(*) filter (where live) = count(*) filter (where live and label = 'obra_supervisada') then 'solo_obra' else 'sin_etiqueta' end reason from y group by 1""")
def rescued_amounts(t):
    """The amount that labelled candidates give, without advances of a tenth."""
    label = _pick(("acredita", "obra_supervisada", "descartado", "sin_etiqueta", "acredita"), F.col("l_partkey"))
    price = F.col("l_extendedprice")
    each = t("lineitem").select("l_orderkey", F.when(F.col("l_linenumber") % 4 == 0, F.round(price * 0.1, 2)).otherwise(price).alias("v"), label.alias("label"))
    whole = t("lineitem").where("l_linenumber % 4 = 0").select("l_orderkey", price.alias("v"), F.lit("obra_supervisada").alias("label"))
    return evidence.rescued_amount(each.unionByName(whole), "l_orderkey", "v", "label")


@query("""with s as (select o_custkey, count(*) filter (where o_orderstatus = 'F') f, count(*) filter (where o_orderstatus = 'O') o, count(*) filter (where o_orderstatus = 'P') p, max(o_totalprice) m from orders group by 1)
select o_custkey, array_to_string([x for x in [case when o > f then 'CONTRATO' end, case when m > 450000 then 'MONTO' end, case when c_acctbal < 0 then 'BAJA' end] if x is not null], ',') alerts,
  case when o > 0 then 'NO CUMPLE' when p > 0 then 'POR VERIFICAR' else 'CUMPLE' end || ': ' || f || ' cumplen, ' || o || ' no cumplen, ' || p || ' por verificar' conclusion from s join customer on c_custkey = o_custkey""")
def alerts_and_conclusions(t):
    """What contradicts each customer's declarations, and the conclusion in a sentence."""
    n = lambda status: F.count_if(F.col("o_orderstatus") == status)
    sums = t("orders").groupBy("o_custkey").agg(n("F").alias("f"), n("O").alias("o"), n("P").alias("p"), F.max("o_totalprice").alias("m"))
    joined = sums.join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    found = evidence.alerts(("CONTRATO", F.col("o") > F.col("f")), ("MONTO", F.col("m") > 450000), ("BAJA", F.col("c_acctbal") < 0))
    return joined.select("o_custkey", F.array_join(found, ",").alias("alerts"), evidence.conclusion(F.col("f"), F.col("o"), F.col("p")).alias("conclusion"))
