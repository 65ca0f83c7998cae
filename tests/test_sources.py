"""Stage tables, file artefacts, model answers and the source stream."""

from pyspark.sql import functions as F

from notes_engine.functions import model_json
from notes_engine.plans import models
from notes_engine.sources import artifacts, stages
from notes_engine.streaming import ingest


def test_stages_compute_only_what_is_missing(spark, tmp_path):
    store, seen = stages.Stages(spark, f"file://{tmp_path}/stages"), []

    def stage(df):
        seen.extend(r.k for r in df.collect())
        return df.withColumn("twice", F.col("k") * 2)

    df = spark.range(3).withColumnRenamed("id", "k")
    assert store.run("s", df, ["k"], stage).count() == 3
    assert store.run("s", spark.range(5).withColumnRenamed("id", "k"), ["k"], stage).count() == 5
    assert sorted(seen) == [0, 1, 2, 3, 4]
    store.clear("s")
    assert store.read("s") is None


def test_artifacts_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n1": {"content": "x", "summary": null}}')
    (tmp_path / "b.json").write_text("not json")
    assert sorted(r.doc is None for r in artifacts.read_json(spark, f"file://{tmp_path}").collect()) == [False, True]
    df = spark.createDataFrame([(1, '{"n1": {"content": "x"}, "n2": {"content": "", "summary": "s"}}')], "k int, store string")
    rows = artifacts.store_rows(df, ["k"], "store")
    assert sorted((r.node_id, r.content, r.summary) for r in rows.collect()) == [("n1", "x", ""), ("n2", "", "s")]
    assert artifacts.store_rows(artifacts.store_json(rows, ["k"]), ["k"], "store").exceptAll(rows).count() == 0


def test_model_answers(spark):
    df = spark.createDataFrame([("7, 3,12,3",), ("a, 1",), ("",)], "x string")
    assert [r[0] for r in df.select(model_json.selection(F.col("x"))).collect()] == [[3, 7, 12], None, []]
    df = spark.createDataFrame([('{"items": [{"id": "N1", "markdown": "m"}]}',), ('{"items": [{"id": "N1"}]}',), ("no",)], "x string")
    got = [r[0] for r in df.select(model_json.items(F.col("x"), "markdown")).collect()]
    assert got[0][0].text == "m" and got[1] is None and got[2] is None
    calls = models.call(spark.createDataFrame([("A. B",), (None,)], "p string"), "p", "a", "extractive").collect()
    assert [c.a for c in calls] == ["A", ""] and all(c.success for c in calls)


def test_source_stream(spark, tmp_path):
    path, seen = f"file://{tmp_path}/in", []
    run = lambda: ingest.process_available(ingest.arriving(spark, path, "k long"), f"file://{tmp_path}/ck", lambda df, _: seen.extend(r.k for r in df.collect()))
    spark.range(2).withColumnRenamed("id", "k").write.parquet(path)
    run()
    spark.range(2, 3).withColumnRenamed("id", "k").write.mode("append").parquet(path)
    run()
    assert sorted(seen) == [0, 1, 2]
