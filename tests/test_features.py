"""Features of names, verdicts on identity and recalculated figures, by values that are known."""

import datetime as dt
import math
import random
import re
import unicodedata

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pliego.functions import dates, names, similarity, text
from pliego.operators import identity, intervals, recalculation, resolution, search


def values(spark, rows, *columns):
    """What columns made of x (and y) give for each row."""
    rows = [r if isinstance(r, tuple) else (r, None) for r in rows]
    frame = spark.createDataFrame(rows, "x string, y string")
    out = frame.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in out]


def test_compatible_characters(spark):
    assert values(spark, ["Ñandú º±í", "½ taza…", "ﬁn №", "éä", "日本 ok", None], text.norm(F.col("x"))) == ["NANDU OI", "12 TAZA...", "FIN NO", "EA", "OK", None]
    assert values(spark, ["ÁÉ ñ", "é", "ğ Ž ų"], text.fold(F.col("x"))) == ["ae n", "e", "g z u"]


def test_abbreviations(spark):
    said = ["C.S. Tingo", "E.S. I-3", "P. S. Alto", "CMI Lima", "H.R. Cusco", "H. Tingo", "los EE.SS. de"]
    # a dot that ends the abbreviation stays, as before a blank it ends no word
    want = ["Centro de Salud. Tingo", "Establecimiento de Salud. I-3", "Puesto de Salud. Alto", "Centro Materno Infantil Lima", "Hospital Regional. Cusco", "Hospital Tingo", "los Establecimientos de Salud. de"]
    assert values(spark, said, names.expand(F.col("x"))) == want


def test_stages(spark):
    said = ["obra 3RA ETAPA", "obra ETAPA III", "Etapa N° 3 del canal", "TRAMO-2", "hospital nivel ETAPA III-1", "DECIMA etapa", "I ETAPA y TRAMO 4", "sin partes", None]
    assert values(spark, said, names.stage(text.norm(F.col("x")))) == ["ETAPA 3", "ETAPA 3", "ETAPA 3", "TRAMO 2", None, "ETAPA 10", "ETAPA 1", None, None]


def test_sectors_and_phases(spark):
    said = ["Hospital y su acceso vial", "Colegio", "Mantenimiento"]
    assert values(spark, said, names.sectors(text.norm(F.col("x")))) == [["salud", "vial"], ["educacion"], []]
    assert values(spark, ["SALDO DE OBRA PRINCIPAL", "obra principal", "Plan de contingencia", "Elaboración del expediente técnico", "obra"], names.phase(text.norm(F.col("x")))) == ["SALDO", "PRINCIPAL", "CONTINGENCIA", "EXPEDIENTE", None]
    pairs = spark.createDataFrame([(["a"], ["b"]), (["a", "b"], ["b"]), ([], ["b"])], "a array<string>, b array<string>")
    assert [r[0] for r in pairs.select(names.sector_contradicts(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_companies(spark):
    said = ["INSTITUTO DE CONSULTORÍA S.A.C.", "INDECONSULT  E.I.R.L.", "J. & M. Ltda.", None]
    assert values(spark, said, names.company(F.col("x"))) == ["INSTITUTO DE CONSULTORIA", "INDECONSULT", "J M", None]
    said = ["CONSORCIO A (X & Y) RUC 20123456789", "(sin datos)", "Plano"]
    assert values(spark, said, names.without_tail(F.col("x"))) == ["CONSORCIO A", "(sin datos)", "Plano"]
    assert values(spark, said, F.size(names.variants(F.col("x")))) == [2, 1, 1]
    assert values(spark, said, names.tax_numbers(F.col("x"))) == [["20123456789"], [], []]


def test_word_families(spark):
    assert values(spark, ["COSTOS", "VALORIZACIONES", "MES", "PLANIFICACION"], names.canonical(F.col("x"))) == ["COSTO", "VALORIZACION", "MES", "PLANEAMIENTO"]
    pairs = [("SUPERVISION", "SUPERVISOR"), ("PLANEAMIENTO", "PRESUPUESTO"), ("COSTO", "COSTOS"), ("OBRA", "OBRA")]
    assert values(spark, pairs, names.same_family(F.col("x"), F.col("y"))) == [True, False, False, True]


def test_places(spark):
    assert values(spark, ["distrito de Tocache, provincia de Tocache, San Martín", "Lircay - HVCA"], names.place_terms(F.col("x"))) == [["TOCACHE", "TOCACHE", "SAN MARTIN"], ["LIRCAY", "HUANCAVELICA"]]
    frame = spark.createDataFrame([(["A", "HUARI", "ANCASH"],), (["HUARI", "ANCASH"],), (["A", "LIMA", "LIMA"],)], "t array<string>")
    assert [r[0] for r in frame.select(names.anchored_provinces(F.col("t"))).collect()] == [["HUARI"], [], []]
    assert values(spark, [("SANTA", "SANTA"), ("TAMBO", "EL TAMBO"), ("ICA", "HUANCAVELICA"), ("LIMA", "LIMATAMBO"), ("", "A")], names.same_place(F.col("x"), F.col("y"))) == [True, True, False, False, False]
    assert values(spark, ["Municipalidad Distrital de San Agustín, provincia X", "Gobierno Regional"], names.municipalities(F.col("x"))) == [["DISTRITAL: SAN AGUSTIN"], []]
    assert values(spark, ["-MUL.DEP-", "TODOS", "LIMA"], names.no_place(F.col("x"))) == [True, True, False]
    rows = spark.createDataFrame([(["HUARI"], [], "SANTA"), (["HUARI"], ["SANTA"], "SANTA"), ([], [], "SANTA"), (["HUARI"], [], "-MUL.DEP-")], "a array<string>, b array<string>, r string")
    assert [r[0] for r in rows.select(names.place_contradicts(F.col("a"), F.col("b"), F.col("r"))).collect()] == [True, False, False, False]
    words = spark.createDataFrame([(["A", "B", "C", "D"], ["X", "A", "B", "C", "D"]), (["A", "B", "C", "D"], ["A", "B", "X", "C", "D"]), (["A", "B"], ["A", "B"])], "a array<string>, b array<string>")
    assert [r[0] for r in words.select(names.literal_name(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_kinds_slugs_and_dates(spark):
    said = [("Supervisión de la elaboración del expediente técnico", None), ("Ejecución de obra", "goods"), ("algo", "works"), ("Estudio de preinversión", " Works ")]
    assert values(spark, said, names.process_kind(F.col("x"), F.col("y"))) == ["supervision", "otro", "ejecucion", "preinversion"]
    assert values(spark, ["Creación de la I.E. Nº 12", "una palabra-larguísima"], names.slug(F.col("x"), 14)) == ["creacion_de_la", "una_palabra"]
    assert values(spark, ["el 5 de marzo del 2020", "12/04/2019 y", "marzo de 2020", "31 de junio de 2020"], dates.said_date(F.col("x"))) == [dt.date(2020, 3, 5), dt.date(2019, 4, 12), None, None]
    assert values(spark, [" ", "a"], text.first_filled(F.col("x"), F.lit("z"))) == ["z", "a"]
    assert values(spark, ["abcdef", "abc"], text.excerpt(F.col("x"), 4)) == ["abc…", "abc"]


def test_process_verdicts(spark):
    f, a, u = identity.FOR, identity.AGAINST, identity.UNKNOWN
    rows = spark.createDataFrame([(f, f, u, 1), (f, u, f, 1), (f, f, a, 1), (f, f, f, 2), (u, f, u, 1)], "e string, a string, o string, n int")
    got = [r[0] for r in rows.select(identity.process_verdict(F.col("e"), F.col("a"), F.col("o"), F.col("n"))).collect()]
    assert got == ["CONFIRMADO", "POR_CONFIRMAR", "CONTRADICE", "POR_CONFIRMAR", "POR_CONFIRMAR"]
    d = dt.date
    rows = spark.createDataFrame(
        [(d(2020, 1, 1), d(2020, 2, 1), d(2020, 1, 16), None, None), (d(2020, 1, 1), d(2020, 2, 1), d(2020, 1, 17), None, None), (d(2020, 1, 1), d(2020, 2, 1), None, d(2020, 2, 1), d(2020, 3, 1)), (d(2020, 1, 1), d(2020, 2, 1), None, d(2020, 2, 2), d(2020, 3, 1)), (None, None, d(2020, 1, 1), None, None), (d(2020, 1, 1), None, None, None, None)],
        "s date, e date, f date, a date, b date",
    )
    assert [r[0] for r in rows.select(identity.time_signal(*map(F.col, "sefab"))).collect()] == [f, a, f, a, u, u]
    scores = spark.createDataFrame([(85,), (84,), (60,), (59,), (None,)], "s int")
    assert [r[0] for r in scores.select(identity.entity_signal(F.col("s"))).collect()] == [f, u, u, a, u]


def test_recalculated_fields(spark):
    rows = spark.createDataFrame(
        [("2019-01-01", "2019-12-31", "2018-01-01"), ("2019-03", "2019-12-31", None), ("", "2019-12-31", "2019-01-01"), ("2020-05-02", "2020-05-01", "2019-01-01"), ("POR VERIFICAR x", None, None), ("2020-06-30", "2020-07-30", "2020-06-30"), ("2019-02-30", "2020-01-01", "POR VERIFICAR")],
        "a string, b string, c string",
    )
    got = [(r.dias, r.incluye_covid, r.anterior_colegiatura, r.motivo, r.motivo_colegiatura) for r in recalculation.fields(rows, "a", "b", "c").collect()]
    assert got == [
        (365, "NO", "NO", None, None), (None, None, None, "FECHA_PARCIAL", "FECHA_PARCIAL"), (None, None, None, "SIN_FECHA", "SIN_FECHA"), (None, None, None, "PERIODO_INVERTIDO", "PERIODO_INVERTIDO"),
        (None, None, None, "FECHA_CENTINELA", "FECHA_CENTINELA"), (31, "SI", "NO", None, None), (None, None, None, "FECHA_PARCIAL", "FECHA_PARCIAL"),
    ]
    whole = recalculation.fields(rows, "a", "b", "c", whole_months=True).collect()
    assert (whole[1].dias, whole[1].deduced, whole[1].motivo_colegiatura, whole[0].deduced) == (306, True, "SIN_COLEGIATURA", False)


def test_works_stand_still(spark):
    m = lambda y, n: dt.date(y, n, 1)
    rows = [("a", m(2019, 1), False, None), ("a", m(2019, 2), True, dt.date(2019, 2, 10)), ("a", m(2019, 3), True, None), ("a", m(2019, 4), False, None), ("a", m(2019, 7), True, None)]
    got = sorted((r.start, r.end, r.kind) for r in intervals.inactivity(spark.createDataFrame(rows, "k string, month date, stopped boolean, stopped_on date"), ["k"]).collect())
    assert got == [(dt.date(2019, 2, 10), m(2019, 4), "paralizado"), (m(2019, 5), dt.date(2019, 6, 30), "sin_valorizacion"), (m(2019, 7), m(2019, 8), "paralizado")]


def test_search(spark):
    catalogue = spark.createDataFrame([(i, str(2_000_000 + i), f"HOSPITAL COMUN {'RARO' if i < 3 else f'LUGAR{i % 20}'} {i:03}", "Huánuco" if i % 2 else "Lima") for i in range(200)], "id long, code string, name string, place string")
    asked = spark.createDataFrame([(1, "hospital raro 002", None), (2, "2000007", None), (3, "2000007", "lima"), (4, "hospital raro", "huanuco")], "q long, text string, place string")
    found = search.candidates(asked.select("q", "text"), catalogue.select("id", "name"), "q", "id", places=100).collect()
    assert {(r.q, r.id) for r in found if r.q == 1} == {(1, 0), (1, 1), (1, 2)}
    stop = search.candidates(asked.select("q", "text"), catalogue.select("id", "name"), "q", "id", places=100, enough=0).collect()
    assert {(r.q, r.id) for r in stop if r.q == 1} == {(1, 2)}
    got = search.search(asked, catalogue, "q", "id", "code", ["place"], 10, similarity.token_set_of).collect()
    assert {(r.q, r.id) for r in got if r.via == "codigo"} == {(2, 7)}
    assert not [r for r in got if r.q == 3]
    assert {r.id for r in got if r.q == 4 and r.rank_ == 1} == {1} and all(r.score >= 60 for r in got)
    assert next(r.id for r in got if r.q == 1 and r.rank_ == 1) == 2
    with pytest.raises(ValueError):
        search.valid_query(F.col("x"), 51)
    with pytest.raises(Exception, match="2 to 200"):
        values(spark, ["x"], search.valid_query(F.col("x"), 5))


def test_search_cleans_each_text_once(spark):
    """Before pairs are made, so the score gets plain columns; filters are normed there, too, and a blank one has no effect."""
    catalogue = spark.createDataFrame([(i, None if i == 3 else str(i), f"Posta Médica (Río {i % 5}), n.º {i}", [None, "Áncash", "Lima"][i % 3]) for i in range(60)], "id long, code string, name string, place string")
    asked = spark.createDataFrame([(1, "POSTA río 3", "ancash"), (2, "posta medica RIO 4", " "), (3, "Posta río 1", None), (4, "posta", "日本")], "q long, text string, place string")
    given = []
    score = lambda a, b: given.append(f"{a} {b}") or similarity.token_set_of(a, b)
    got = sorted((r.q, r.rank_, r.id, r.score) for r in search.search(asked, catalogue, "q", "id", "code", ["place"], 3, score).collect())
    rows = {r.id: r for r in catalogue.collect()}
    plain = lambda s: " ".join(re.findall("[A-Z0-9]+", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().upper()))
    want = []
    for r in asked.collect():
        rated = [(similarity.token_set_ratio(plain(r.text), plain(c.name)), c) for c in rows.values()]
        best = sorted((x for x in rated if x[0] >= 60), key=lambda x: (-x[0], x[1].code or "~", x[1].id))[:50]
        held = [x for x in best if plain(r.place or "") in plain(x[1].place or "")][:3]
        want += [(r.q, i, c.id, round(s, 1)) for i, (s, c) in enumerate(held, 1)]
    assert len(want) > 8 and [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=0.051)
    assert not [g for g in given if "(" in g.replace("Column<", "")]


def test_ratios_of_batches_equal_single_ones():
    rng = random.Random(11)
    odd = [None, "", " ", "a", " a  b ", "a\tb", "a\x1fb c", "é b", "b é", "a" * 64, "a" * 65, "b" + "a" * 64, "x " * 40, "ab " * 30 + "c" * 70, "c" * 90 + " d", "-_ ~!"]
    words = lambda: " ".join("".join(rng.choices("AB01", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 12)))
    texts = odd + [words() for _ in range(60)]
    pairs = [(a, b) for a in texts for b in texts]
    want = [None if None in p else similarity.token_set_ratio(*p) for p in pairs]
    for part in (pairs, pairs[:1], pairs[:0], pairs[20:29]):
        got = similarity.token_set_ratios(*(pd.Series([p[i] for p in part], dtype=object) for i in (0, 1)))
        assert [None if math.isnan(x) else x for x in got] == want[pairs.index(part[0]) :][: len(part)] if part else len(got) == 0


def test_siblings_and_levels(spark):
    rows = spark.createDataFrame([(1, "f", None, "a"), (2, "f", 20, "a"), (3, "f", 30, "a"), (4, "g", None, "a"), (5, "f", None, "b")], "id long, folio string, code int, issuer string")
    got = {r.id: (r.code, r.source) for r in resolution.inherit(rows, "id", "folio", "code", lambda a, b: a["issuer"] == b["issuer"]).collect()}
    assert got == {1: (20, 2), 2: (20, None), 3: (30, None), 4: (None, None), 5: (None, None)}
