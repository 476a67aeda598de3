"""Phrases in pages and the gates without cuts, against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from pliego.functions.similarity import partial_ratio, ratio, token_set_of
from pliego.operators import phrases, search
from pliego.plans import phrasing
from pliego.sources import versions


def plain_window(phrase, text, least):
    best = None
    for s in range(-len(phrase) + 1, len(text)):
        start, end = max(s, 0), min(s + len(phrase), len(text))
        score = ratio(phrase, text[start:end])
        if score >= least and (best is None or score > best[2]):
            best = start, end, score
    return best


@pytest.mark.parametrize(("least", "size"), [(90, 8), (90, 33), (88, 6), (75, 20)])
def test_windows_equal_all_windows(least, size):
    rng = random.Random(size)
    for _ in range(150):
        phrase = "".join(rng.choices("ABC", k=size))
        hurt = list(phrase)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(hurt))
            hurt[at : at + rng.randint(0, 1)] = rng.choice(["", "X", "A"])
        text = "".join(rng.choices("ABC", k=rng.randint(0, 30))) + "".join(hurt) + "".join(rng.choices("ABC", k=rng.randint(0, 30)))
        text = text[rng.randint(0, 3) :]
        found = phrases.best_window(phrase, text, least)
        assert found == plain_window(phrase, text, least)
        if len(text) >= size:
            assert (found is not None) == (partial_ratio(phrase, text) >= least)


def test_phrases_of_odd_rows(spark):
    page = "Lima, 3 de mayo. S A N  C A R L O 1 S contratistas generales S.R.L. certifica que el ingeniero prestó servicios"
    name, terms = "SAN CARLOS CONTRATISTAS GENERALES", ["SAN", "CARLOS"]
    rows = [
        (1, page, name, terms), (2, page, "SAN CARLOS", ["SAN"]), (3, "folio 358", name, terms), (4, None, name, terms), (5, page, None, terms), (6, page, name, None), (7, page, name, [None, "HUANUCO"]),
        (8, "San Miguel y el señor Carlos, contratistas de obras en general, dan fe de lo dicho en Lima", name, terms), (9, page.replace("O 1 S", "O S"), name, terms), (9, page.replace("O 1 S", "O S"), name, terms), (10, page, "SAN", terms),
    ]
    table = spark.createDataFrame(rows, "id int, text string, name string, own array<string>").withColumn("state", F.lit("clash")).withColumn("phrase", F.lit("kept"))
    got = sorted(((r.id, r.state, r.missing, r.phrase) for r in phrases.find_phrase(table, "text", "name", "own").collect()), key=str)
    want = [(1, "found", []), (2, "absent", ["SAN"]), (3, "unreadable", terms), (4, "unreadable", terms), (5, "no_phrase", terms), (6, "found", []), (7, "other", ["HUANUCO"]), (8, "absent", terms), (9, "found", []), (9, "found", []), (10, "no_phrase", terms)]
    assert got == sorted(((*w, "kept") for w in want), key=str)
    assert phrases.find_phrase(table.limit(0), "text", "name", "own").count() == 0


def test_page_phrases_equal_all_windows(spark):
    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    got = {(r.page_id, r.phrase): r for r in phrasing.page_phrases(t).collect()}
    texts = phrasing.claims(t).select("page_id", phrases.letters(F.col("text")).alias("text"), phrases.letters(F.col("phrase")).alias("letters"), "phrase").collect()
    states = {r.state for r in got.values()}
    assert len(texts) == phrasing.claims(t).count() and "found" in states and "absent" in states
    for r in texts:
        best, now = plain_window(r.letters, r.text, 90) if len(r.letters) >= 8 else None, got[r.page_id, r.phrase]
        assert now.state in ("no_phrase", "unreadable") or (now.start, now.end) == (best[:2] if best else (None, None))


def test_volume_gate_reads_all_sources(spark):
    rows = spark.range(2400).selectExpr("concat('s', lpad(id % 1200, 4, '0')) source")
    every = [f"s{i:04}" for i in range(1200)]
    assert versions.volume_gate(rows, "source", 2400, 2, every).count() == 1200
    with pytest.raises(versions.GateClosed, match="2400 rows; 1 with too few: t$"):
        versions.volume_gate(rows, "source", 2400, 2, [*every, "t"])
    with pytest.raises(versions.GateClosed, match="1200 with too few: s0000, s0001, .*, \\.\\.\\.$"):
        versions.volume_gate(rows, "source", 2400, 3)


def test_search_cleans_names_and_refuses_alone(spark):
    catalogue = spark.createDataFrame([(1, "2000001", "HOSPITAL, ABANCAY. (II-2)", "x"), (2, "2000002", "«POSTA» ABANCAY II", "x")], "id long, code string, name string, place string")
    asked = spark.createDataFrame([(1, "hospital abancay", None), (2, None, None), (3, "x", None), (4, "y" * 201, None), (5, "de la II", None), (6, "2000002", None)], "q long, text string, place string")
    got = {(r.q, r.id): r.score for r in search.search(asked, catalogue, "q", "id", "code", ["place"], 10, token_set_of).collect()}
    assert got[1, 1] == 100 and got[6, 2] == 100 and {q for q, _ in got} == {1, 6}
    assert {(r.q, r.reason) for r in search.refused(asked, "q").collect()} == {(2, "short"), (3, "short"), (4, "long"), (5, "common")}


def test_second_codes_find_rows_that_no_code_does(spark):
    catalogue = spark.createDataFrame([(1, "10", "77", "PUENTE"), (2, "77", "88", "POSTA"), (3, None, "88", "CANAL"), (4, "", None, "PRESA")], "id long, code string, snip string, name string")
    asked = spark.createDataFrame([(1, "10"), (2, "77"), (3, " 88 "), (4, "99")], "q long, text string")
    got = {(r.q, r.id, r.via) for r in search.search(asked, catalogue, "q", "id", "code", [], 10, token_set_of, second="snip").collect()}
    assert got == {(1, 1, "codigo"), (2, 2, "codigo"), (3, 2, "codigo"), (3, 3, "codigo")}
