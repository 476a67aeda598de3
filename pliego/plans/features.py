"""Queries on names of works, companies and places. Names are put together from parts by order and supplier numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from pliego.functions import dates, names, text
from pliego.plans.base import query

WORKS = (
    "Mejoramiento del Centro de Salud", "Creación de la Institución Educativa Inicial", "Construcción de carretera vecinal", "Elaboración de expediente técnico del hospital",
    "Saldo de obra del coliseo", "Plan de contingencia del puente", "Obra principal de irrigación", "Ampliación de agua potable y letrinas", "Supervisión de la red de energía", "Mantenimiento", "Losa deportiva de la escuela",
)
PARTS = ("III ETAPA", "TRAMO-2", "ETAPA N 4", "COMPONENTE IV", "SEGUNDA ETAPA", "nivel II-1", "PAQUETE 10", "1ra etapa y tramo 3")
PLACES = (
    "distrito de Tocache, provincia de Tocache, San Martín", "Lircay - HVCA", "Municipalidad Distrital de El Tambo, Junín", "Chimbote – Santa – Áncash", "ICA", "dpto de La Libertad; Lima",
    "Municipalidad Provincial de Huari / Municipalidad Distrital de Ate", "sin lugar", "El Agustino, Lima, LIMA",
)
FORMS = (
    "Constructora Ñandú S.A.C.", "INDECONSULT  E.I.R.L.", "Consorcio Vial (A & B S.A.) RUC 20123456789", "Ingenieros, Ltda.", "J. & M. Sociedad Anónima Cerrada", "(sin datos)", "Estudios del Sur S.R.L. RUC 10456789012", "Obras y Servicios",
)
TITLES = ("Supervisión del expediente técnico", "Ejecución de obra:", "Estudio de preinversión", "Elaboración del expediente técnico", "Compra de equipos", "Estudio definitivo")
CATEGORIES = ("works", "goods", " Services ", None)


def _listed(values) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _named(t):
    k = F.col("o_orderkey")
    whole = F.concat_ws(", ", _pick(WORKS, k), _pick(PARTS, F.expr("o_orderkey div 11")), _pick(PLACES, F.expr("o_orderkey div 88")))
    return t("orders").select("o_orderkey", whole.alias("name"), _pick(PLACES, F.expr("o_orderkey div 88")).alias("place"))


def _normed(t):
    return _named(t).withColumn("n", text.norm(F.col("name")))


# the same names in SQL, and them in capital ASCII letters
NAMED = f"""named as (
  select o_orderkey, {_listed(WORKS)}[o_orderkey % 11 + 1] || ', ' || {_listed(PARTS)}[o_orderkey // 11 % 8 + 1] || ', ' || {_listed(PLACES)}[o_orderkey // 88 % 9 + 1] "name", {_listed(PLACES)}[o_orderkey // 88 % 9 + 1] place from orders),
n as (select *, upper(trim(regexp_replace(regexp_replace(strip_accents("name"), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))) n, upper(trim(regexp_replace(regexp_replace(strip_accents(place), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))) p from named)"""
_sectors_sql = ", ".join(f"case when regexp_matches(n, '{rule}') then '{name}' end" for name, rule in sorted(names.SECTORS.items()))
_phase_sql = " ".join(f"when regexp_matches(n, '{rule}') then '{name}'" for name, rule in names.PHASES.items())
_departments_sql = ", ".join(f"case when regexp_matches(replace(n, 'HVCA', 'HUANCAVELICA'), '\\b{d}\\b') then '{d}' end" for d in names.DEPARTMENTS)


@query(f"""with {NAMED} select o_orderkey, array_to_string([x for x in [{_sectors_sql}] if x is not null], ',') sectors, case {_phase_sql} end phase,
  array_to_string([x for x in [{_departments_sql}] if x is not null], ',') departments from n""")
def work_features(t):
    """Sectors, phase and departments that each name speaks of."""
    x = F.col("n")
    return _normed(t).select("o_orderkey", F.array_join(names.sectors(x), ",").alias("sectors"), names.phase(x).alias("phase"), F.array_join(names.departments(x), ",").alias("departments"))


_ORDINAL = "|".join(sorted((w for row in names.ORDINALS for w in row), key=lambda w: (-len(w), w)))
_NUMBERS = "map {" + ", ".join(f"'{w}': {i}" for i, row in enumerate(names.ORDINALS, 1) for w in row) + "}"


@query(f"""with {NAMED}, c as (select o_orderkey, regexp_replace(n, '[A-Z0-9]+\\s*-\\s*\\d+', '-', 'g') n, n as whole from n),
m as (select o_orderkey, n, whole, regexp_extract(whole, '\\b({_ORDINAL})\\.?\\s+(ETAPA|TRAMO|COMPONENTE|PAQUETE)\\b', ['o', 'k']) a,
  regexp_extract(case when regexp_matches(whole, '(TRAMO|ETAPA)-\\d') then whole else n end, '\\b(ETAPA|TRAMO|COMPONENTE|PAQUETE)[\\s.:-]*(?:N(?:O|RO|UM)?\\.?\\s*)?({_ORDINAL})\\b', ['k', 'o']) b from c)
select o_orderkey, case when a.k <> '' and (b.k = '' or position(a.o || ' ' || a.k in whole) <= position(b.k in whole)) then a.k || ' ' || {_NUMBERS}[a.o] when b.k <> '' then b.k || ' ' || {_NUMBERS}[b.o] end stage from m""")
def work_stage(t):
    """The stage, section, component or package that each name gives first."""
    return _normed(t).select("o_orderkey", names.stage(F.col("n")).alias("stage"))


@query(f"""with s as (select s_suppkey, {_listed(FORMS)}[s_suppkey % 8 + 1] || case when s_suppkey % 3 = 0 then ' ' || s_name else '' end raw from supplier),
w as (select *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) whole from s),
v as (select *, trim(regexp_replace(regexp_replace(regexp_replace(whole, '\\(.*?\\)', ' ', 'g'), '(?i)\\bRUC\\b.*$', ' '), '\\s+', ' ', 'g')) bare from w),
c as (select s_suppkey, whole, case when bare = '' then whole else bare end bare, regexp_extract_all(raw, '\\b(\\d{{11}})\\b', 1) numbers from v)
select s_suppkey, bare, case when bare = whole then 1 else 2 end variants, array_to_string(numbers, ',') numbers,
  upper(trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(whole), '{names.LEGAL_FORMS}', '', 'g'), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) company from c""")
def company_names(t):
    """Names of companies as they are compared: without tails, legal forms and marks; and the tax numbers in them."""
    raw = F.concat(_pick(FORMS, F.col("s_suppkey")), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" "), F.col("s_name"))).otherwise(""))
    x = F.col("raw")
    rows = t("supplier").select("s_suppkey", raw.alias("raw"))
    return rows.select("s_suppkey", names.without_tail(x).alias("bare"), F.size(names.variants(x)).alias("variants"), F.array_join(names.tax_numbers(x), ",").alias("numbers"), names.company(x).alias("company"))


@query(f"""with {NAMED}, s as (select o_orderkey, p, regexp_split_to_array(replace(p, 'HVCA', 'HUANCAVELICA'), '[,;|()/-]') parts from n),
c as (select o_orderkey, p, [trim(regexp_replace(regexp_replace(trim(x), '^(PROVINCIA|PROV|DISTRITO|DIST|DEPARTAMENTO|DPTO|REGION|REG|LOCALIDAD|SECTOR|CENTRO POBLADO)\\s+(DE\\s+)?', ''), '^DE\\s+', '')) for x in parts] terms from s),
f as (select o_orderkey, p, [x for x in terms if x <> ''] terms from c),
k as (select *, [list_contains({_listed(names.DEPARTMENTS)}, x) for x in terms] known from f)
select o_orderkey, array_to_string(terms, '|') terms, array_to_string(list_distinct([terms[i - 1] for i in range(3, len(terms) + 1) if known[i] and not known[i - 1] and not known[i - 2]]), '|') provinces,
  array_to_string(list_sort(list_distinct([regexp_extract(m, ' (DISTRITAL|PROVINCIAL) ', 1) || ': ' || trim(regexp_replace(m, '^MUNICIPALIDAD (DISTRITAL|PROVINCIAL) DE ', '')) for m in regexp_extract_all(p, 'MUNICIPALIDAD (?:DISTRITAL|PROVINCIAL) DE [A-Z'' ]+')])), '|') municipalities from k""")
def place_features(t):
    """The terms of a place, provinces anchored by a department, and municipalities."""
    x = F.col("place")
    rows = _named(t).select("o_orderkey", names.place_terms(x).alias("parts"), names.municipalities(x).alias("m"))
    joined = lambda c: F.array_join(c, "|")
    return rows.select("o_orderkey", joined(F.col("parts")).alias("terms"), joined(names.anchored_provinces(F.col("parts"))).alias("provinces"), joined(F.col("m")).alias("municipalities"))


@query(f"""with p as (select p_partkey, lower(strip_accents({_listed(TITLES)}[p_partkey % 6 + 1] || ' ' || p_name)) x, trim(lower(coalesce({_listed(CATEGORIES)}[p_partkey // 6 % 4 + 1], ''))) c from part)
select p_partkey, case when c = 'goods' then 'otro' when x like '%preinversion%' then 'preinversion' when x like '%supervis%' then 'supervision' when x like '%expediente tecnico%' or x like '%estudio definitivo%' then 'expediente'
  when x like '%ejecucion de%' or x like '%construccion%' or x like '%obra:%' or c = 'works' then 'ejecucion' else 'otro' end kind from p""")
def process_kinds(t):
    """What tenders are about."""
    k = F.col("p_partkey")
    return t("part").select("p_partkey", names.process_kind(F.concat_ws(" ", _pick(TITLES, k), "p_name"), _pick(CATEGORIES, F.expr("p_partkey div 6"))).alias("kind"))


@query(f"""with {NAMED}, s as (select o_orderkey, o_custkey, [x for x in [{_sectors_sql}] if x is not null] s from n join orders using (o_orderkey)),
p as (select a.o_custkey, a.s x, b.s y from s a join s b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey where len(a.s) > 0 and len(b.s) > 0),
m as (select o_custkey, bool_or(not list_has_any(x, y)) mixed from p group by 1)
select c_custkey, coalesce(mixed, false) mixed, case when mixed then (select string_agg(distinct u, ',' order by u) from (select unnest(s) u from s where s.o_custkey = c_custkey)) end sectors from customer left join m on o_custkey = c_custkey""")
def sector_mixture(t):
    """Customers with two works of which the sectors have nothing in common, and all their sectors.

    The works of a customer count by distinct sets of sectors, of which there are 2^7 at most, so a customer's pairs are bounded.
    """
    rows = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(_normed(t), "o_orderkey")
    sets = rows.select("c_custkey", names.sectors(F.col("n")).alias("s")).groupBy("c_custkey").agg(F.collect_set(F.when(F.size("s") > 0, F.col("s"))).alias("sets"))
    mixed = F.exists("sets", lambda a: F.exists("sets", lambda b: ~F.arrays_overlap(a, b)))
    found = sets.select("c_custkey", mixed.alias("mixed"), F.array_join(F.array_sort(F.array_distinct(F.flatten("sets"))), ",").alias("all_"))
    out = t("customer").select("c_custkey").join(found, "c_custkey", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    return out.select("c_custkey", "mixed", F.when(F.col("mixed"), F.col("all_")).alias("sectors"))


@query("""with w as (select doc_id, unnest(list_distinct(regexp_extract_all(upper(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[A-Z]{5,}'))) w from documents where lang = 'es')
select w, case when length(w) > 5 and w like '%ES' then left(w, -2) when w like '%S' then left(w, -1) else w end stem, count(*) n from w group by 1, 2""")
def word_stems(t):
    """Singular forms of the words of Spanish texts."""
    words = F.array_distinct(F.regexp_extract_all(text.norm(F.col("text")), F.lit("[A-Z]{5,}"), F.lit(0)))
    each = t("documents").where("lang = 'es'").select(F.explode(words).alias("w"))
    return each.groupBy("w").agg(F.count("*").alias("n")).select("w", names.stem(F.col("w")).alias("stem"), "n")


@query("""with d as (select o_orderkey, o_orderdate::date d from orders)
select o_orderkey, case o_orderkey % 3 when 2 then null else d end said, d <= date '1996-06-30' and d + 60 >= date '1996-03-16' covid from d""")
def long_dates(t):
    """Dates in sentences: `12 de marzo de 1996` and DD/MM/YYYY; a month alone is none."""
    d = F.to_date("o_orderdate")
    month = _pick(dates.MONTHS, F.month(d) - 1)
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Firmado el "), F.dayofmonth(d), F.lit(" de "), month, F.lit(" del "), F.year(d))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Lima, "), F.date_format(d, "dd/MM/yyyy"), F.lit("."))
    ).otherwise(F.concat(month, F.lit(" de "), F.year(d)))
    window = [F.lit(x).cast("date") for x in ("1996-03-16", "1996-06-30")]
    return t("orders").select("o_orderkey", dates.said_date(said).alias("said"), ((d <= window[1]) & (F.date_add(d, 60) >= window[0])).alias("covid"))


@query(f"""with {NAMED}, w as (select o_orderkey, lower(trim(regexp_replace(n, '[^A-Z0-9]+', ' ', 'g'))) w from n)
select o_orderkey, replace(case when length(w) <= 40 then w when substr(w, 41, 1) = ' ' then left(w, 40) else regexp_replace(left(w, 40), '\\s+\\S*$', '') end, ' ', '_') slug from w""")
def file_names(t):
    """File names from names of works, cut at a word's end."""
    return _named(t).select("o_orderkey", names.slug(F.col("name"), 40).alias("slug"))


HELD = ("Supervisor de Obra", "Especialista en Costos", "Ingeniero ambiental", "Jefe", "Residente de planeamiento y costos", "Arquitecta")
ASKED = ("Especialista en Supervisión", "Responsable de Costos y Presupuestos; Planificación", "Especialista ambiental / Residente", "Encargado de obra")
# the terms of each, as the rules give them
HELD_TERMS = (["SUPERVISOR"], ["COSTO"], ["AMBIENTAL"], [], ["RESIDENTE", "PLANEAMIENTO", "COSTO"], [])
ASKED_TERMS = ([["SUPERVISION"]], [["COSTO", "PRESUPUESTO"], ["PLANEAMIENTO"]], [["AMBIENTAL"], ["RESIDENTE"]], [])
_FAMILY = "(a = b or (length(a) >= 7 and length(b) >= 7 and a[:6] = b[:6]))"


@query(f"""with c as (select c_custkey, {list(HELD_TERMS)}[c_custkey % 6 + 1]::varchar[] held, {list(ASKED_TERMS)}[c_custkey // 6 % 4 + 1]::varchar[][] asked from customer),
l as (select c_custkey, held, asked, [[a for a in alt if len([b for b in held if {_FAMILY}]) = 0] for alt in asked] lacks from c),
n as (select *, [len(lacks[k]) * 100 - (len(asked[k]) - len(lacks[k])) for k in range(1, len(asked) + 1)] rate from l)
select c_custkey, array_to_string(case when len(held) = 0 or len(asked) = 0 then [] else lacks[list_position(rate, list_min(rate))] end, ',') missing from n""")
def position_cores(t):
    """What each held position lacks of the nearest alternative that a requirement names."""
    k = F.col("c_custkey")
    rows = t("customer").select("c_custkey", names.position_terms(_pick(HELD, k)).alias("held"), names.alternatives(_pick(ASKED, F.expr("c_custkey div 6"))).alias("asked"))
    return rows.select("c_custkey", F.array_join(names.missing_terms(F.col("held"), F.col("asked")), ",").alias("missing"))


CLIENTS = ("Clínica San Juan", "Colegio particular", "Municipalidad y clínica", "Ingeniería clínica", "Obra privada", "Hospital Regional privado", "Casa", "I.E.P. Sol", "Policlínico de EsSalud")
OWNERS = ("Sr. Juan Pérez", "Gobierno Regional", None, "Donación SAC", "Don Luis")


@query(f"""with c as (select c_custkey, lower(strip_accents({_listed(CLIENTS)}[c_custkey % 9 + 1] || ' ' || coalesce({_listed(OWNERS)}[c_custkey // 9 % 5 + 1], ''))) x, lower({_listed(OWNERS)}[c_custkey // 9 % 5 + 1]) o from customer)
select c_custkey, not regexp_matches(x, 'essalud|municipalidad|gobierno regional|hospital regional') and (regexp_matches(x, 'colegio particular|obra privada|i\\.e\\.p\\.') or regexp_matches(replace(x, 'ingenieria clinica', ''), '\\b(poli)?clinic') or coalesce(regexp_matches(o, '^(sr|don)\\.? [a-z]'), false)) private from c""")
def private_clients(t):
    """Works of private clients; a public name beats every other sign."""
    k = F.col("c_custkey")
    owner = _pick(OWNERS, F.expr("c_custkey div 9"))
    return t("customer").select("c_custkey", names.private_client(F.concat_ws(" ", _pick(CLIENTS, k), owner), owner).alias("private"))
