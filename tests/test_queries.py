"""Golden values, brute-force interval checks and equality of queries with their SQL."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pliego.functions import dates, similarity, text
from pliego.operators import intervals, scoring
from pliego.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = dt.date.fromisoformat


def frame(spark, rows):
    return spark.createDataFrame([(k, D(a), D(b)) for k, a, b in rows], "k long, start date, end date")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = catalogue.QUERIES[name](spark, SF)
    found = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(out.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in out.collect()))) == sorted(map(str, found.fetchall()))


def test_picks_of_balances_near_halves(spark, tmp_path):
    """Sevenths of these lie beside a half, and their tenths on it (what `bround` gets wrong)."""
    balances = [-1788.85, -1788.15, -1781.85, 1781.15, 1774.85, -0.28, 0.35, 1.05, 4703.96, None]
    rows = [(k, f"Supplier#{k:09}", k, b) for k, b in enumerate(balances)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["picks_and_excerpts"]).fetchall()
    got = catalogue.QUERIES["picks_and_excerpts"](spark, str(tmp_path)).select("s_suppkey", "picked", "excerpt", "rounded", "half_up").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rounding_to_even(spark):
    rows = [(255.45000000000002, 255.4), (255.54999999999998, 255.6), (0.25, 0.2), (-0.35, -0.4), (1e308, 1e308), (float("-inf"), float("-inf")), (None, None)]
    got = spark.createDataFrame(rows, "x double, want double").select(scoring.rounded_even(F.col("x"), 1).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)


def test_inclusive_days(spark):
    pairs = [("2016-06-10", "2017-05-15", 340), ("2019-05-01", "2019-10-31", 184), ("2023-11-22", "2025-07-22", 609), ("2021-05-13", "2023-05-06", 724), ("2020-01-01", "2020-01-01", 1), ("2020-01-02", "2020-01-01", None)]
    got = spark.createDataFrame([(D(a), D(b), n) for a, b, n in pairs], "a date, b date, n int").select(dates.inclusive_days(F.col("a"), F.col("b")).alias("x"), "n")
    assert all(r.x == r.n for r in got.collect())


def test_subtraction_of_three_suspensions(spark):
    holes = frame(spark, [(1, "2021-10-01", "2021-10-31"), (1, "2022-02-01", "2022-04-30"), (1, "2022-07-01", "2022-09-30")])
    left = intervals.subtract(frame(spark, [(1, "2021-05-13", "2023-05-06")]), holes, ["k"]).orderBy("start").collect()
    assert [(r.end - r.start).days + 1 for r in left] == [141, 92, 61, 218]


def test_overlap_counts_once(spark):
    r = intervals.effective_days(frame(spark, [(1, "2021-01-01", "2021-06-30"), (1, "2021-06-01", "2021-12-31")]), ["k"]).first()
    assert (r.overlap_days, r.effective_days) == (30, 365)


def test_random_periods_against_sets_of_days(spark):
    rng, zero = random.Random(5), dt.date(2020, 1, 1)
    spans = lambda n: [(k, a, a + rng.randint(0, 20)) for k in range(40) for a in [rng.randint(0, 60) for _ in range(n)]]
    made = lambda rows: spark.createDataFrame([(k, zero + dt.timedelta(a), zero + dt.timedelta(b)) for k, a, b in rows], "k long, start date, end date")
    days = lambda rows: {(k, d) for k, a, b in rows for d in range(a, b + 1)}
    rows, one, holes = spans(6), spans(1), spans(4)
    got = {r.k: r.effective_days for r in intervals.effective_days(made(rows), ["k"]).collect()}
    assert got == {k: sum(1 for x, _ in days(rows) if x == k) for k in range(40)}
    left = intervals.subtract(made(one), made(holes), ["k"]).collect()
    assert {(r.k, (r.start - zero).days + i) for r in left for i in range((r.end - r.start).days + 1)} == days(one) - days(holes)


def test_flexible_dates(spark):
    rows = [("2019-02-28", D("2019-02-28"), D("2019-02-28")), ("2019-02-30", None, None), ("2019-03 (sin día)", None, D("2019-03-31")), ("POR VERIFICAR", None, None), (None, None, None)]
    got = spark.createDataFrame(rows, "x string, hard date, edge date").select(dates.hard_date(F.col("x")).alias("a"), "hard", dates.month_edge(F.col("x"), True).alias("b"), "edge").collect()
    assert all(r.a == r.hard and r.b == r.edge for r in got)


def test_texts(spark):
    r = spark.range(1).select(text.norm(F.lit(" Ñandú  º±í ")).alias("n"), text.locale_amount(F.lit("1'000,237.56")).alias("m"), text.page_list(F.lit("49-51; 78, x, 9-3")).alias("p"), text.verdict(F.lit("NO: pendiente")).alias("v")).first()
    assert (r.n, str(r.m), r.p, r.v) == ("NANDU OI", "1000237.56", [49, 50, 51, 78], "pend")


def test_similarities(spark):
    assert similarity.common_length("abcde", "xbxdxe") == 3
    assert similarity.ratio("kitten", "sitting") == pytest.approx(100 * 8 / 13)
    assert similarity.token_set_ratio("hospital abancay", "hospital de abancay") == 100
    assert similarity.partial_ratio("lima", "en lima norte") == 100
    assert spark.createDataFrame([("a b", "b a")], "x string, y string").select(similarity.token_sort_of("x", "y")).first()[0] == 100


def test_verdicts_need_verified_data(spark):
    rows = [(True, False, "SI"), (False, True, "NO"), (False, None, "POR VERIFICAR"), (None, True, "POR VERIFICAR")]
    got = spark.createDataFrame(rows, "c boolean, v boolean, want string").select(scoring.three_valued(F.col("c"), F.col("v")).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)
