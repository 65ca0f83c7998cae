"""Content and summary stages, merging, node trees, article sections, fetched pages, settings and routing."""

import json

import pytest
from pyspark.sql import functions as F

from notes_engine.functions import model_json
from notes_engine.functions import text as T
from notes_engine.operators import batching, merge, order, tree, usage
from notes_engine.plans import generate, models, routing
from notes_engine.settings import Prompts, Settings
from notes_engine.sources import article, fetched, video


class Passing(Exception):
    is_transient = True


@models.provider("faulty")
def _faulty(which):
    """Answers that go wrong as the first point of a batch says."""
    state = {"calls": 0}

    def ask(prompt):
        state["calls"] += 1
        items = json.loads(prompt)
        out = [{"id": x["id"], "markdown": "+".join(x["content_points_list"])} for x in items]
        how = items[0]["content_points_list"][0]
        if how == "count" or how == "many" and len(items) > 1:
            out.pop()
        if how == "twice":
            out[-1]["id"] = "N1"
        if how == "once" and state["calls"] == 1:
            out[0]["id"] = "N99"
        if how == "raise":
            raise ValueError("no")
        if how == "passing" and state["calls"] == 1:
            raise Passing
        return json.dumps({"items": out})

    return ask


PAYLOADS = "k string, ord int, node_id string, hierarchy_path array<string>, start int, end int, points array<string>"


def payload_rows(k, *firsts):
    return [(k, i, f"{k}{i}", ["a"], i, i, [f, "x"]) for i, f in enumerate(firsts, 1)]


def test_content_ladder(spark):
    one = lambda k: payload_rows(k, k, "p", "q")
    rows = [r for k in ("good", "count", "many", "twice", "raise") for r in one(k)]
    texts, state = generate.content(spark.createDataFrame(rows, PAYLOADS), ["k"], "faulty", retries=2, budget=10_000, fallback=5, which="")
    got = {r.k: (r.status, r.problem) for r in state.collect()}
    assert got == {"good": ("ok", None), "count": ("failed", "even with fallback batches: count"), "many": ("fallback", None), "twice": ("failed", "exhausted: duplicate"), "raise": ("failed", "call: ValueError")}
    assert {(r.k, r.node_id): r.content for r in texts.collect()} == {(k, f"{k}{i}"): f"{f}+x" for k in ("good", "many") for i, f in ((1, k), (2, "p"), (3, "q"))}


@pytest.mark.parametrize("how", ["once", "passing"])
def test_content_is_asked_again(spark, how):
    df = spark.createDataFrame(payload_rows(how, how, "p"), PAYLOADS).coalesce(1)
    assert generate.content(df, ["k"], "faulty", retries=2)[1].first().status == "ok"
    assert generate.content(df, ["k"], "faulty", retries=1)[1].first().status == "failed"


def test_problems_of_answers():
    ids = lambda *x: [{"id": i, "f": "t"} for i in x]
    assert [generate.problem_of(x, "f", 2) for x in (ids("N1", "N2"), ids("N1"), ids("N1", "N1"), ids("N1", "N3"), [{"id": "N1"}], None)] == [None, "count", "duplicate", "incorrect_ids", "form", "form"]


def test_summaries(spark):
    df = spark.createDataFrame(payload_rows("s", "One", "Two"), PAYLOADS)
    store, _ = generate.content(df, ["k"])
    out, state = generate.summaries(df, store, ["k"])
    assert {r.node_id: r.summary for r in out.collect()} == {"s1": "One", "s2": "Two"} and state.first().status == "ok"
    assert batching.content_length(df, store, ["k"]).count() == 2
    assert [r.node_id for r in batching.without_content(df, store.where("node_id = 's1'"), ["k"]).collect()] == ["s2"]
    assert [r.ord for r in batching.ending_within(df, 2, 9).collect()] == [2]
    both = store.join(out, ["k", "node_id"])
    assert batching.complete(both, ["k"], "content", "summary").first().complete
    assert batching.retryable(F.lit("duplicate"), F.lit(False)) is not None


def test_merge_of_parts(spark):
    nodes = spark.createDataFrame([(1, 1, 1, 0, "b"), (1, 1, 2, 1, "b1"), (1, 0, 1, 0, "a"), (1, 0, 2, 1, "a1"), (1, 0, 3, 1, "a2")], "k int, part_idx int, node_pos int, parent_pos int, name string")
    got = [(r.node_pos, r.parent_pos, r.name) for r in merge.hierarchies(nodes, ["k"]).orderBy("node_pos").collect()]
    assert got == [(1, 0, "a"), (2, 1, "a1"), (3, 1, "a2"), (4, 0, "b"), (5, 4, "b1")]
    store = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "z"), (2, 1, "z"), (2, 1, "w"), (2, 0, "w")], "k int, part_idx int, node_id string")
    rows, problems = merge.stores(store, ["k"])
    assert sorted(r.node_id for r in rows.collect()) == ["x", "y"]
    assert [(r.k, r.problem) for r in problems.collect()] == [(2, "repeated: w, z")]
    assert [r.part_idx for r in merge.missing_parts(spark.createDataFrame([(1, 0), (1, 7)], "k int, part_idx int"), store, ["k"]).collect()] == [7]
    modes = spark.createDataFrame([("single", "t"), ("multi_part", "t")], "m string, t string")
    assert [r[0] for r in modes.select(merge.part_folder(F.col("m"), F.col("t"))).collect()] == ["artifacts", "artifacts/t"]


def test_stored_trees(spark):
    doc = [{"type": "topic", "name": 'A "q"', "subtopics": [{"type": "content", "id": "n1"}, {"type": "topic", "name": "B", "subtopics": [{"type": "content", "id": "n2"}]}]}, {"type": "topic", "name": "C", "subtopics": []}]
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, '[{"type": "list"}, {"type": "content"}]'), (3, "no"), (4, "[]")], "k int, j string")
    got = tree.stored_nodes(df, ["k"], "j")
    one = [(r.node_pos, r.parent_pos, r.depth, r.kind, r.name, r.node_id, r.problem) for r in got.where("k = 1").orderBy("node_pos").collect()]
    assert one == [(1, 0, 0, "topic", 'A "q"', None, None), (2, 1, 1, "content", None, "n1", None), (3, 1, 1, "topic", "B", None, None), (4, 3, 2, "content", None, "n2", None), (5, 0, 0, "topic", "C", None, None)]
    assert [r.problem for r in got.where("k = 2").orderBy("node_pos").collect()] == ["kind: list", "malformed"]
    assert json.loads(tree.nodes_json(got.where("k = 1"), ["k"]).first().nodes) == doc
    deep = "[" * 1 + '{"type": "topic", "name": "x", "subtopics": [' * 70 + "]}" * 70 + "]"
    found = tree.stored_nodes(spark.createDataFrame([(1, deep)], "k int, j string"), ["k"], "j")
    assert found.where("problem is not null").count() == 0 and found.agg(F.max("depth")).first()[0] == 69 and found.count() == 70
    bad = ['{"hierarchy": [{"name": "a", "start_point": 1, "end_point": 2}]}', "x", "{}", '{"hierarchy": [{"name": "a", "start_point": 1}]}', '{"hierarchy": [{"name": "a", "start_point": 1, "end_point": 2, "children": 3}]}']
    assert [r[0] for r in spark.createDataFrame([(b,) for b in bad], "j string").select(tree.hierarchy_problem(F.col("j"))).collect()] == [None, "no JSON", "no hierarchy", "malformed node", "malformed node"]


def test_markdown_payloads(spark):
    s = tree.with_parents(tree.heading_sections(spark.createDataFrame([(1, "# A\nx\n## B\n\n## C\ny")], "k int, md string"), ["k"], "md"), ["k"])
    got = [(r.ord, r.start, r.end, r.hierarchy_path, r.points, r.content) for r in tree.markdown_payloads(s, ["k"]).orderBy("ord").collect()]
    assert got == [(0, 0, 0, ["A"], [], "x"), (1, 1, 1, ["A", "C"], [], "y")]


def test_article_sections(spark):
    md = "lead\n\n# One #\n\na\n```\n# no\n~~~\n```\n\n## \n\n- x\n  - y\n\n### Empty\n\nSet\n===\n\n| a |\n|---|\n| b |\n\nUnder\n---\nz\n\n---\n\nw"
    df = spark.createDataFrame([(1, md), (2, "# only"), (3, "~~~py\n# x\n~~~ no\n# y\n~~~~\n# z\nq")], "k int, md string")
    out = article.markdown_sections(df, ["k"], "md")
    got = [(r.heading, r.level, r.content) for r in out.where("k = 1").orderBy("pos").collect()]
    assert got == [("Introduction", 1, "lead"), ("One", 1, "a\n\n```\n# no\n~~~\n```"), ("Untitled Section 3", 2, "- x\n\n  - y"), ("Set", 1, "| a |\n| --- |\n| b |"), ("Under", 2, "z\n\n---\n\nw")]
    assert [(r.k, r.heading, r.content) for r in out.where("k > 1").orderBy("k", "pos").collect()] == [(3, "Introduction", "~~~py\n# x\n~~~ no\n# y\n~~~"), (3, "z", "q")]
    c = article.section_chapters(out.where("k = 1"), ["k"], tokens=lambda x: F.length(x).cast("long")).orderBy("chapter_idx").collect()
    assert [(r.title, r.display) for r in c[:3]] == [("# Introduction", "00:00:00"), ("# One", "00:00:10"), ("## Untitled Section 3", "00:00:23")] and c[0].transcript == "# Introduction\n\nlead"
    counts = article.section_counts(spark.createDataFrame([(1, "a"), (1, " "), (2, None)], "k int, content string"), ["k"]).orderBy("k").collect()
    assert [(r.chapters, r.skipped, r.problem is None) for r in counts] == [(1, 1, True), (0, 1, False)]
    p = spark.createDataFrame([("h", 1, "c"), (" ", 1, "c"), ("h", 0, "c"), ("h", 1, " # c")], "h string, l int, c string")
    assert [r[0] for r in p.select(article.section_problem(F.col("h"), F.col("l"), F.col("c"))).collect()] == [None, "heading", "level", "content"]


def test_fetched_pages(spark):
    rows = [("ok", 1, 503, None, None, None), ("ok", 2, 200, "Text/HTML; charset=x", " <p>a</p> ", None), ("ok", 3, 500, None, None, None), ("gone", 1, 404, "text/html", "x", None), ("late", 1, None, None, None, "timeout"),
            ("late", 2, None, None, None, "timeout"), ("late", 3, None, None, None, "timeout"), ("late", 4, 200, "text/html", "x", None), ("pdf", 1, 200, "application/pdf", "x", None), ("none", 1, 200, "text/html", " ", None), ("bad", 1, None, None, None, "tls")]
    out = {r.url: r for r in fetched.outcomes(spark.createDataFrame(rows, "url string, attempt int, status int, content_type string, body string, error string")).collect()}
    assert (out["ok"].body, out["ok"].attempts, out["ok"].waited) == ("<p>a</p>", 2, 1)
    assert {k: r.problem for k, r in out.items() if r.problem} == {
        "gone": "status: 404", "late": "timeout", "pdf": "content type: application/pdf", "none": "empty", "bad": "tls"}
    assert out["late"].attempts == 3 and out["late"].body is None


def test_native_chapters_go_first(spark):
    info = '{"chapters": [{"start_time": 0.9, "title": " A "}, {"start_time": "x", "title": "no"}, {"title": "no"}, {"start_time": 3725, "title": " "}]}'
    df = spark.createDataFrame([(1, info, "0:00 D"), (2, '{"chapters": null}', "0:00 D\n0:09 E"), (3, None, None)], "k int, info string, d string")
    got = [(r.k, r.chapter_idx, r.title, r.timestamp_seconds, r.display) for r in video.chapters(df, "k", "info", "d").orderBy("k", "chapter_idx").collect()]
    assert got == [(1, 0, "A", 0, "00:00:00"), (1, 1, "", 3725, "01:02:05"), (2, 0, "D", 0, "00:00:00"), (2, 1, "E", 9, "00:00:09")]
    s = spark.createDataFrame([(1, " "), (1, "x"), (2, "\n")], "k int, text string")
    assert {r.k: r.valid for r in video.spoken(s, "k").collect()} == {1: True, 2: False}


def test_settings_and_prompts(spark, tmp_path):
    (tmp_path / ".env").write_text("# c\nMAX_RETRIES=2\nexport LOG_LEVEL='DEBUG'\nENABLE_LLM_MONITORING=off\n")
    spark.conf.set("spark.notes.content_input_tokens", "77")
    s = Settings.load({"MAX_RETRIES": "3", "OTHER": "x"}, str(tmp_path / ".env"), spark)
    spark.conf.unset("spark.notes.content_input_tokens")
    assert (s.max_retries, s.log_level, s.enable_llm_monitoring, s.content_input_tokens, s.summary_input_tokens) == (3, "DEBUG", False, 77, 5000)
    for bad in ({"MAX_RETRIES": "x"}, {"ARTICLE_MAX_REDIRECTS": "-1"}, {"ARTICLE_VERIFY_SSL": "maybe"}):
        with pytest.raises(ValueError):
            Settings.load(bad)
    (tmp_path / "cleaning.txt").write_text("Clean {text} {{x}}")
    p = Prompts(tmp_path)
    assert p.filled("cleaning", text="a") == "Clean a {x}"
    (tmp_path / "cleaning.txt").unlink()
    assert p.load("cleaning")
    with pytest.raises(FileNotFoundError):
        p.load("none")


def test_routes_and_ends(spark):
    c = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (1, 0, 1), (1, 2, 1), (3, 2, 1), (2, 2, 2)], "t int, c int, p int")
    assert [r[0] or "ok" for r in c.select(routing.context_problem(F.col("t"), F.col("c"), F.col("p"))).collect()] == ["total", "no parts", "current", "beyond total", "beyond parts", "ok"]
    routes = spark.range(1).select(
        routing.after_mode(F.lit("multi_part")), routing.after_mode(F.lit("single")), routing.after_breakpoints(F.lit(0)), routing.after_part(F.lit("multi_part"), F.lit(2), F.lit(2)), routing.after_part(F.lit("multi_part"), F.lit(3), F.lit(2)),
        routing.after_advance(F.lit("article")), routing.after_validation(F.lit(0)), routing.after_validation(F.lit(1))).first()
    assert list(routes) == ["select_transcript_breakpoints", "advance_transcript_part", "invalid_transcript_breakdown", "advance_transcript_part", "render_markdown", "clean_article", "hierarchy_validation_failed", "extract_content_nodes"]
    s = spark.createDataFrame([(1, 5, 1, None), (2, 0, 1, None), (3, None, 0, None), (4, None, 0, "own"), (5, None, None, None)], "k int, content_nodes int, total_parts int, error string")
    got = {r.k: r.error_message for r in routing.ended(s).collect()}
    assert set(got) == {2, 3, 4} and got[2] == "no content nodes" and got[3] == "parts too large" and got[4] == "own"


def test_small_functions(spark):
    one = lambda value, expr, kind="string": spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]
    assert one("Hello, wörld 12!", T.token_estimate) == 5 and one(None, T.token_estimate) == 0
    assert one("a\nb", T.quoted) == "> a\n> b" and one(" a | b ", T.table_cell) == "a \\| b"
    assert one("text-align: center", T.alignment_rule) == ":---:" and one("", T.alignment_rule) == "---"
    assert one('{"selected_indices": [4, 8]}', model_json.resumed_selection) == [4, 8] and one("[]", model_json.resumed_selection) is None
    q = json.loads(one(["[00] x"], lambda c: model_json.question(c, F.lit(9), 7), "array<string>"))
    assert q["summary"] == {"total_chapters": 1, "total_tokens": 9, "max_tokens_per_part": 7} and q["chapters"] == ["[00] x"] and len(q["instructions"]) == 6
    assert one(1.5, usage.money, "double") == "$1.500000" and one(None, usage.money, "double") == "N/A"
    assert one(0, usage.call_tokens, "long") == "N/A" and one(12345, usage.call_tokens, "long") == "12345"
    lines = [("started", None), ("running", 1), ("running", None), ("failed", None), ("info", None), ("completed", None)]
    df = spark.createDataFrame(lines, "s string, c int")
    got = [r[0] for r in df.select(usage.progress_line(F.col("s"), F.lit("Stage"), F.lit("msg"), F.col("c"), F.lit(9))).collect()]
    assert got == ["⟳ Stage", "    msg  (1 / 9)".ljust(48), "    msg", "✗ Stage\n    msg", "· msg", "✓ Stage"]
    p = spark.createDataFrame([(1, i, 10) for i in range(5)], "k int, ord int, w int").withColumn("n", F.lit(2))
    assert [r.b for r in order.equal_weight(p, ["k"], ["ord"], "w", F.col("n"), "b").orderBy("ord").collect()] == [1, 1, 1, 2, 2]
