"""Progress reporters, histograms, token counts, loose dates, hierarchy rules and stored ids."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from notes_engine.functions import bpe
from notes_engine.functions import text as T
from notes_engine import scratch
from notes_engine.operators import batching, tree
from notes_engine.plans import models, notes
from notes_engine.settings import Settings
from notes_engine.sources import markdown, stages
from notes_engine.streaming import ingest, progress


def test_reporters(caplog):
    kept = progress.Recorded()

    def broken(event):
        raise ValueError("no console")

    p = progress.Progress(broken, kept)
    p.started("clean", "Cleaning")
    p.running("clean", "Cleaning", "chapter", 2, 5)
    p.completed("clean", "Cleaning")
    p.failed("clean", "Cleaning", "quota")
    p.info("clean", "Cleaning", "note")
    assert [(e.status, e.message, e.current, e.total) for e in kept.events] == [
        ("started", "Starting Cleaning", None, None), ("running", "chapter", 2, 5), ("completed", "Cleaning complete", None, None), ("failed", "quota", None, None), ("info", "note", None, None)]
    assert caplog.text.count("no console") == 5


def test_observed_work(spark):
    kept = progress.Recorded()
    p, df = progress.Progress(kept), spark.range(100)
    got = p.observed("n", "Sums", df, lambda d: d.write.format("noop").mode("overwrite").save(), total=F.sum("id"), odd=F.count_if(F.col("id") % 2 == 1))
    assert got == {"rows": 100, "total": 4950, "odd": 50}
    with pytest.raises(ZeroDivisionError):
        p.observed("n", "Fails", df, lambda d: 1 / 0)
    assert [(e.stage, e.status) for e in kept.events] == [("Sums", "started"), ("Sums", "completed"), ("Fails", "started"), ("Fails", "failed")]
    table = kept.table(spark)
    assert table.where("status = 'failed'").first().message.startswith("ZeroDivisionError") and progress.Recorded().table(spark).count() == 0


def test_streams_tell_their_progress(spark, tmp_path):
    spark.range(30).write.parquet(f"{tmp_path}/in")
    kept = progress.Recorded()
    listener = progress.QueryProgress(progress.Progress(lambda e: 1 / 0, kept))
    spark.streams.addListener(listener)
    try:
        df = ingest.arriving(spark, f"{tmp_path}/in", "id long").observe("seen", F.count(F.lit(1)).alias("rows"))
        q = df.writeStream.format("noop").queryName("notes").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if any(e.status == "completed" for e in kept.events):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    told = [(e.node_name, e.status) for e in kept.events]
    assert told[0] == ("notes", "started") and told[-1] == ("notes", "completed")
    assert any("30 rows" in e.message and "seen.rows=30" in e.message for e in kept.events)


def test_histogram(spark):
    df = spark.createDataFrame([("a", v) for v in (-1.0, 0.0, 4.9, 5.0, 99.0, None)] + [("b", 7.0)], "k string, v double")
    got = {(r.k, r.bucket, r.low, r.high): r.n for r in progress.histogram(df, "v", [0, 5, 10], ["k"]).collect()}
    assert got == {("a", 0, None, 0.0): 1, ("a", 1, 0.0, 5.0): 2, ("a", 2, 5.0, 10.0): 1, ("a", 3, 10.0, None): 1, ("b", 2, 5.0, 10.0): 1}


def test_bpe_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    path = str(public.path("byte_bpe_50k.tiktoken"))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "Hello  world\n\n it's 12345 déjà-vu 日本語 🙂🙂 ́x", "a" * 3000, "\t\t x  \n", "<|endoftext|> don't DON'T we'll"]
    try:
        texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    except Exception:  # without the test tables
        pass
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", bpe.counter(path, public.PATTERN)(F.col("t")).alias("n")).collect()}
    assert got == {i: len(own.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert {r.i: r.n for r in df.select("i", bpe.counter(path)(F.col("t")).alias("n")).collect()} == got


DATES = [
    ("March 2024", "2024-03-31T00:00:00"), ("Feb 2023", "2023-02-28T00:00:00"), ("5 March", "2020-03-05T00:00:00"), ("Sept. 3rd", "2020-09-03T00:00:00"), ("2019", "2019-05-31T00:00:00"), ("May", "2020-05-31T00:00:00"),
    ("3/4/2021", "2021-03-04T00:00:00"), ("13/4/2021", "2021-04-13T00:00:00"), ("2021/4/3", "2021-04-03T00:00:00"), ("3.4.98", "1998-03-04T00:00:00"), ("3-4-69", "2069-03-04T00:00:00"), ("4/5", "2020-04-05T00:00:00"),
    ("2021-04", "2021-04-30T00:00:00"), ("04/2021", "2021-04-30T00:00:00"), ("20240229", "2024-02-29T00:00:00"), ("Thursday the 4th of July, 2024 at 9pm", "2024-07-04T21:00:00"), ("4 Jul 24 12:05 a.m.", "2024-07-04T00:05:00"),
    ("Tue, 05 Mar 2024 10:20:30 GMT", "2024-03-05T10:20:30+00:00"), ("2024-03-05T10:20:30.25Z", "2024-03-05T10:20:30+00:00"), ("2024-03-05 10:20 +02:00", "2024-03-05T10:20:00+02:00"), ("31 April 2024", None), ("25:00 5 May 2024", None),
    ("soon", None), ("", None), (None, None), ("version 3.4.5", None), ("1 2 3 4", None), ("June 31", None),
]


def test_loose_dates(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DATES)], "i int, d string")
    got = {r.i: r.p for r in df.select("i", T.lenient_date(F.col("d"), F.lit(datetime.date(2020, 5, 31))).alias("p")).collect()}
    assert {DATES[i][0]: v for i, v in got.items() if v != DATES[i][1]} == {}


def test_hierarchy_rules(spark):
    rows = [  # k, node_pos, parent_pos, child_ord, start, end, is_content
        (1, 1, 0, 1, 1, 10, False), (1, 2, 1, 1, 1, 4, True), (1, 3, 1, 2, 3, 10, True),
        (2, 1, 0, 1, 1, 8, False), (2, 2, 1, 1, 5, 6, True), (2, 3, 1, 2, 2, 9, False), (2, 4, 3, 1, 2, 3, True), (2, 5, 3, 2, 9, 8, True), (2, 6, 0, 2, None, 4, True),
    ]
    nodes = spark.createDataFrame(rows, "k int, node_pos int, parent_pos int, child_ord int, start_point int, end_point int, is_content boolean")
    points = spark.createDataFrame([(1, 10), (2, 8), (3, 2), (4, 0)], "k int, n_points int")
    got = sorted(tuple(r) for r in tree.contract_problems(nodes, points, ["k"]).select("k", "problem", "node_pos", "low", "high").na.fill(0).collect())
    assert got == [
        (2, "beyond", 3, 2, 9), (2, "order", 3, 2, 9), (2, "outside", 3, 2, 9), (2, "range", 5, 9, 8), (2, "range", 6, 0, 4),
        (2, "uncovered", 0, 1, 1), (2, "uncovered", 0, 4, 4), (2, "uncovered", 0, 7, 8), (3, "uncovered", 0, 1, 2)]


def test_content_nodes_and_stored_ids(spark):
    doc = '{"hierarchy":[{"name":"A","start_point":1,"end_point":4,"children":[{"name":"B","start_point":1,"end_point":2,"children":[{"name":"c","start_point":1,"end_point":1},{"name":"d","start_point":2,"end_point":2}]},{"name":"e","start_point":3,"end_point":4}]},{"name":"f","start_point":5,"end_point":5}]}'
    held = '[{"type":"topic","name":"A","subtopics":[{"type":"content","id":"x"},{"type":"content","id":"y"}]},{"type":"content","id":"z"}]'
    df = spark.createDataFrame([(1, doc, held, "T"), (2, '{"hierarchy":[]}', held, "U"), (3, "{", "[]", "V")], "k int, hierarchy string, nodes string, title string")
    nodes = tree.topic_nodes(df, ["k"], "hierarchy")
    leaves = tree.content_nodes(nodes, ["k"])
    assert [(r.ord, r.hierarchy_path, r.content) for r in leaves.orderBy("ord").collect()] == [(1, ["A", "B", "c"], ""), (2, ["A", "B", "d"], ""), (3, ["A", "e"], ""), (4, ["f"], "")]
    run = notes.from_cache(df, spark.createDataFrame([(1, i, f"p{i}") for i in range(1, 6)], "k int, point_no int, point string"), spark.createDataFrame([(1, "x", " cx \n"), (1, "z", "cz")], "k int, node_id string, content string"), ["k"])
    assert [(r.node_id, r.hierarchy_path, r.points) for r in run.payloads.orderBy("ord").collect()] == [("x", ["A", "B", "c"], ["p1"]), ("y", ["A", "B", "d"], ["p2"]), ("z", ["A", "e"], ["p3", "p4"])]
    assert [(r.k, r.document) for r in run.documents.collect()] == [(1, "# T\n\n## A\n\n### B\n\ncx\n\ncz\n")]
    assert [tuple(r) for r in run.lacking.collect()] == [(1, "y")]
    assert sorted((r.k, r.ord, r.problem) for r in run.unmatched.collect()) == [(1, 4, "no id"), (2, 1, "no node"), (2, 2, "no node"), (2, 3, "no node")]


def test_values_as_text(spark):
    df = spark.sql("select date'2024-03-05' d, timestamp'2024-03-05 01:02:03' t, timestamp_ntz'2024-03-05 01:02:03.5' n, cast(null as string) z, ' x ' s, 1.50BD as b")
    got = df.select(*[T.value_text(F.col(c), k).alias(c) for c, k in df.dtypes]).first()
    assert tuple(got) == ("2024-03-05", "2024-03-05T01:02:03+00:00", "2024-03-05T01:02:03.500000", "", "x", "1.50")
    d = spark.createDataFrame([("March 5, 2024",), ("May 2021",), ("soon ",)], "d string")
    assert [r[0] for r in d.select(T.dated(F.col("d"), F.lit("2020-05-31").cast("date"))).collect()] == ["2024-03-05T00:00:00", "2021-05-31T00:00:00", "soon"]


def test_repeats(spark):
    df = spark.createDataFrame([("b", "N1", 1), ("b", "N2", 2), ("b", "N1", 3), ("b", "N1", 4), ("c", "N1", 1)], "batch_id string, temp_id string, pos int")
    assert sorted(tuple(r) for r in batching.repeats(df, "pos").collect()) == [("b", "N1", 1, 3), ("b", "N1", 2, 4)]


def test_answers_as_text():
    class Answer:
        content = ["a", {"text": "b"}, {"other": 1}]

    assert [models.text_of(x) for x in ("t", None, 3, Answer())] == ["t", "", "3", "ab"]


def test_markdown_files_with_problems(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a.md", "# A"), ("d/b c+.MD", "b\n"), ("blank.md", " \n"), ("x.txt", "x")):
        (tmp_path / name).write_text(text)
    asked = ["a.md", "./a.md", "d/b c+.MD", "blank.md", "x.txt", "none.md", "d"]
    out = {r.path: (r.raw_content, r.problem) for r in markdown.checked(spark, str(tmp_path), spark.createDataFrame([(p,) for p in asked], "path string")).collect()}
    assert out == {"a.md": ("# A", None), "./a.md": ("# A", None), "d/b c+.MD": ("b\n", None), "blank.md": (None, "empty"), "x.txt": (None, "suffix"), "none.md": (None, "missing"), "d": (None, "missing")}


def test_cleared_stages_keep_their_folder(spark, tmp_path):
    s = stages.Stages(spark, f"file://{tmp_path}")
    s.run("one", spark.range(3), ["id"], lambda df: df)
    assert s.read("one").count() == 3 and s.clear("one") >= 2 and (tmp_path / "one").is_dir() and s.read("one") is None
    assert s.run("one", spark.range(4), ["id"], lambda df: df).count() == 4
    s.clear("one", folder=True)
    assert not (tmp_path / "one").exists() and s.clear("one") == 0


def test_required_settings():
    assert Settings.load({"OPENAI_API_KEY": "k"}, required=("openai_api_key",)).openai_api_key == "k"
    with pytest.raises(ValueError, match="openai_api_key"):
        Settings.load({"OPENAI_API_KEY": " "}, required=("openai_api_key",))


def test_kept_tables_are_deleted(spark, tmp_path):
    a, b = (scratch.kept(spark.range(3), "t") for _ in range(2))
    assert a.count() == 3
    scratch.release(a, spark.range(1))
    assert b.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(a.stored_at)
    assert scratch.drop_kept(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(b.stored_at)
