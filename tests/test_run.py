"""The whole run of notes: good and bad parts, records of calls, files."""

import json

import pytest
from pyspark.sql import functions as F

from notes_engine.operators import usage
from notes_engine.plans import models, notes
from notes_engine.scratch import drop_kept
from notes_engine.sources import files


@models.provider("test groups")
def _(which):
    good = models.model("groups")

    def answer(prompt):
        if "broken" in prompt:
            return "{"
        if "gap" in prompt:
            return json.dumps({"hierarchy": [{"name": "X", "start_point": 1, "end_point": 1, "children": []}]})
        return good(prompt)

    return answer


@models.provider("test outline")
def _(which):
    good = models.model("outline")

    def answer(prompt):
        if "refused" in prompt:
            raise PermissionError("no")
        return good(prompt)

    return answer


@pytest.fixture(scope="module")
def run(spark):
    many = ". ".join(f"point {i}" for i in range(1, 11)) + "."
    rows = [("a", 0, many), ("a", 1, "last one. and more"), ("b", 0, "broken text. x"), ("b", 1, "fine. y"), ("c", 0, "a gap. here"), ("d", 0, "refused"), ("e", 0, None)]
    df = spark.createDataFrame(rows, "k string, part_idx int, transcript string")
    meta = {"title": F.concat(F.lit("Title "), "k"), "url": F.lit("u"), "author": F.lit(""), "upload_date": F.lit("2024"), "content_id": F.col("k")}
    yield notes.full_run(df.withColumns(meta), ["k"], F.lit("now"), outliner="test groups", writer="test outline")
    drop_kept(spark)


def test_documents_of_good_parts(run):
    docs = {r.k: r.document for r in run.content.collect()}
    body = lambda a, b: "\n".join(f"- point {i}" + ("." if i == 10 else "") for i in range(a, b + 1))
    assert docs["a"] == f"# Title a\n\n## Points 1-8\n\n{body(1, 4)}\n\n{body(5, 8)}\n\n## Points 9-10\n\n{body(9, 10)}\n\n## Points 1-2\n\n- last one\n- and more\n"
    assert docs["b"] == "# Title b\n\n## Points 1-2\n\n- fine\n- y\n" and set(docs) == {"a", "b"}
    assert {r.k: r.document for r in run.summary.collect()}["a"] == "# Title a\n\n## Points 1-8\n\npoint 1\n\npoint 5\n\n## Points 9-10\n\npoint 9\n\n## Points 1-2\n\nlast one\n"
    readme = {r.k: r.readme for r in run.readme.collect()}
    assert "- Points 1-8\n- Points 9-10\n- Points 1-2" in readme["a"] and "- **Author:** Unknown" in readme["a"] and set(readme) == {"a", "b"}


def test_problems_and_calls(spark, run):
    assert sorted((r.k, r.part_idx, r.problem) for r in run.problems.collect()) == [("b", 0, "no JSON"), ("c", 0, "uncovered"), ("d", 0, "call: PermissionError")]
    calls = run.calls.collect()
    assert {(r.node_name, r.k, r.part_idx, r.success, r.exception_type) for r in calls if not r.success} == {("content", "d", 0, False, "call: PermissionError")}
    assert sorted(r.node_name for r in calls if r.k == "a") == sorted(["clean", "hierarchy", "content", "summary"] * 2)
    assert all(r.input_tokens > 0 for r in calls if r.k == "a") and all(r.total_tokens == r.input_tokens + r.output_tokens for r in calls)
    prices = spark.createDataFrame([("Bullets", "bullets", 1.0, 2.0), ("groups", "other", 1.0, 1.0)], "provider string, model string, in_per_1k double, out_per_1k double")
    costed = usage.costs(run.calls, prices)
    by = {r.value: r for r in usage.summary(costed, keys=["k"]).where("k = 'a' and dimension = 'node_name'").collect()}
    assert by["clean"].calls == 2 and by["clean"].cost > 0 and by["content"].cost is None and by["summary"].ok == 2


def test_files_of_a_run(run, tmp_path):
    docs = run.content.withColumnRenamed("document", "content").join(run.summary.withColumnRenamed("document", "summary"), "k").join(run.readme, "k")
    files.write(files.rendered_files(docs, files.folder_name(F.col("k"))), str(tmp_path))
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.md")) == [f"{k}/{n}" for k in "ab" for n in ("README.md", "content.md", "summary.md")]
