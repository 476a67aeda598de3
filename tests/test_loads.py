"""Files, versions and streams on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pliego.sources import files, versions
from pliego.streaming import events


def test_aliases_and_required_columns(spark):
    rows = spark.createDataFrame([(1, "a", None)], "ID int, `Código` string, extra string")
    assert files.aliased(rows, {"code": ["código"], "n": ["id"], "gone": []}).first().asDict() == {"code": "a", "n": 1, "gone": None}
    with pytest.raises(files.MissingColumns, match="gone"):
        files.aliased(rows, {"gone": ["missing"]}, {"gone"})


def test_json_contract(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, '{"a": 1}'), (3, "no json"), (4, None), (5, "")], "id int, doc string")
    schema = StructType.fromDDL("a int, b struct<c: string>")
    got = {r.id: r.errors for r in files.json_documents(rows, "doc", schema, ["a", "b.c"]).collect()}
    assert got == {1: [], 2: ["$.b.c"], 3: ["$"], 4: ["$"], 5: ["$"]}


def test_pages(spark):
    html = '<script>var lista = [{"m": 1}, {"m": 2}];</script><table><tr></tr><tr><th>A</th><td> <b>x</b>\n y</td></tr></table>'
    r = spark.createDataFrame([(html,)], "h string").select(files.script_arrays(F.col("h"), "lista").alias("a"), files.script_arrays(F.col("h"), "other").alias("n"), files.table_cells(F.col("h")).alias("t")).first()
    assert (r.a, r.n, r.t) == (['{"m":1}', '{"m":2}'], None, [["A", "x y"]])


def test_answers_have_three_states(spark):
    rows = spark.createDataFrame([([1], False), ([], False), (None, False), ([1], True)], "a array<int>, f boolean")
    assert [r[0] for r in rows.select(files.tri_state(F.col("a"), F.col("f"))).collect()] == ["found", "none", "no_answer", "no_answer"]


def test_versions(spark, tmp_path):
    root, rows = f"file://{tmp_path}/v", spark.range(3)
    rows.write.parquet(f"file://{tmp_path}/old")
    assert versions.resolve(spark, root, f"file://{tmp_path}/old").count() == 3
    for i in range(4):
        versions.publish(spark.range(i), root, str(i), i)
    with pytest.raises(versions.CountMismatch):
        versions.publish(spark.range(9), root, "9", 8)
    assert versions.resolve(spark, root).count() == 3
    assert sorted(r[0] for r in versions.expired(spark, root, 2).collect()) == ["0", "1", "9"]
    assert versions.freshness(spark, root, 30).first().state == "refresh_failed"
    with pytest.raises(versions.CountMismatch):
        versions.publish(spark.createDataFrame([(None,)], "id long"), root, "n", keys=["id"])


def test_a_failed_load_leaves_a_published_id_as_it_was(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    versions.publish(spark.range(5), root, "1", 5)
    with pytest.raises(versions.CountMismatch):
        versions.publish(spark.range(7), root, "1", 8)
    assert versions.resolve(spark, root).count() == 5
    versions.publish(spark.range(7), root, "1", 7)
    versions.publish(spark.range(2), root, "2", 2)
    versions.publish(spark.range(1), root, "3", 1)
    assert versions.resolve(spark, root).count() == 1
    versions.pin(spark, root, "1")
    assert (versions.active(spark, root), versions.resolve(spark, root).count()) == ("1", 7)
    assert versions.purge(spark, root, 2) == ["2"] and not (tmp_path / "v/load_id=2").exists()
    assert versions.resolve(spark, root).count() == 7
    with pytest.raises(FileNotFoundError):
        versions.pin(spark, root, "4")


def test_gates(spark):
    rows = spark.range(60).selectExpr("if(id < 40, 'a', 'b') source", "id", "1 old")
    assert sorted(map(tuple, versions.volume_gate(rows, "source", 60, 20).collect())) == [("a", 40), ("b", 20)]
    for whole, each, expected in ((61, 20, None), (60, 21, None), (60, 20, ["c"])):
        with pytest.raises(versions.GateClosed):
            versions.volume_gate(rows, "source", whole, each, expected)
    assert [versions.drift_gate(100, n) for n in (75, 150, 151)] == ["ok", "ok", "warn"]
    with pytest.raises(versions.GateClosed):
        versions.drift_gate(100, 74)
    changes = versions.header_changes(rows, rows.drop("old").withColumn("fresh", F.lit(1)))
    assert sorted(map(tuple, changes.collect())) == [("fresh", "new"), ("old", "removed")]


def test_contract_rules(spark):
    rows = spark.createDataFrame([(("A", (5,)),), (("X", (50,)),), ((None, (None,)),)], "d struct<k: string, n: struct<v: int>>")
    found = rows.select(files.contract_errors(F.col("d"), {"k": ["A", "B"]}, {"n.v": (0, 10)}).alias("e"), files.contract_errors(F.col("d"), {"k": ["A"]}, {"n.v": (0, 10)}, 1).alias("one"))
    assert [(r.e, r.one) for r in found.collect()] == [([], []), (["$.k: not in list", "$.n.v: out of range"], ["$.k: not in list"]), ([], [])]


def test_stream_resumes_and_upserts(spark, tmp_path):
    path, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    for hours in ([1, 2], [3]):
        spark.createDataFrame([("x", at(h), 1.5) for h in hours], "k string, ts timestamp_ntz, amount double").write.mode("append").parquet(path)
        events.run_available(events.windowed_counts(events.follow(spark, path), ["k"], "1 day", "1 hour"), folder)
    assert [(r.k, r.n, r.amount) for r in events.current(spark, folder, ["start", "k"]).collect()] == [("x", 3, 4.5)]


def test_stream_takes_each_event_once(spark, tmp_path):
    path, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, at), (1, at), (2, at)], "id int, ts timestamp_ntz").write.parquet(path)
    events.run_available(events.once(events.follow(spark, path), "id", "1 hour"), folder, "append")
    assert sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect()) == [1, 2]


def test_remembered_answers(spark):
    rows = spark.createDataFrame([("a", True, dt.datetime(2024, 1, 1)), ("b", False, dt.datetime(2024, 1, 1)), ("b", True, dt.datetime(2023, 1, 1))], "key string, found boolean, at timestamp_ntz")
    assert [r.key for r in events.remembered(rows, F.lit("2024-01-10").cast("timestamp_ntz"), "30 days", "2 days").collect()] == ["a"]
