"""Operators against literal cases and ten-line sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from notes_engine.functions import text as T
from notes_engine.functions import urls as U
from notes_engine.operators import batching, order, tree, usage
from notes_engine.plans import models, notes, routing
from notes_engine.sources import article, markdown, video


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(("text", "points"), [
    ("- a\n- b", ["a", "b"]), ("intro\n- a\n  more\n\n-----\n* b", ["intro", "a more", "b"]), ("-\n- x\n-", ["", "x"]), ("1. one\n2) two", ["one", "two"]),
    ("---\n- a", ["", "a"]), ("- - x\n**bold**", ["- x **bold**"]), ("", []), ("a\r\nb\r- c", ["a b", "c"]), ("• a  \t b\n=_=_=\n▶▶ c", ["a b", "c"]), ("-a", ["-a"]),
])
def test_numbering(spark, text, points):
    got = order.numbered_points(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).orderBy("point_no").collect()
    assert [r.point for r in got] == points
    assert [r.point_no for r in got] == list(range(1, len(got) + 1))


def test_read_points(spark):
    df = spark.createDataFrame([(1, "1. a\nx\n2. b"), (2, "1. a\n3. b")], "k int, text string")
    got = {r.k: r.valid for r in order.read_points(df, ["k"]).collect()}
    assert got == {1: True, 2: False}


def test_windows_against_loops(spark):
    rng = random.Random(1)
    rows, fills, parts, ups = [], {}, {}, {}
    for k in range(200):
        n, reach, items = rng.randint(1, 8), 0, []
        for i in range(n):
            start = rng.randint(1, 20)
            items.append((start, start + rng.randint(0, 6), i, rng.randint(0, 5)))
        items.sort()
        total, before, top = sum(w for *_, w in items), 0, -1
        for s, e, i, w in items:
            fills[k, i] = min(s, reach + 1)
            reach = max(reach, e)
            parts[k, i] = 3 if total == 0 else min(3, before * 3 // total + 1)
            before += w
            if s > top:
                ups.setdefault(k, []).append(i)
                top = s
            rows.append((k, s, e, i, w))
    df = spark.createDataFrame(rows, "k int, start int, end int, node_pos int, w int")
    assert {(r.k, r.node_pos): r.filled for r in order.fill_gaps(df, ["k"]).collect()} == fills
    assert {(r.k, r.node_pos): r.batch for r in order.equal_weight(df, ["k"], ["start", "end", "node_pos"], "w", 3).collect()} == parts
    got = {}
    for r in order.ascending(df, ["k"], ["start", "end", "node_pos"], "start").orderBy("k", "start").collect():
        got.setdefault(r.k, []).append(r.node_pos)
    assert got == ups


def test_segments_never_go_back(spark):
    chapters = spark.createDataFrame([(1, 0, "a", 5), (1, 1, "b", 10), (1, 2, "c", 20), (1, 3, "d", 90)], "v int, chapter_idx int, title string, timestamp_seconds int")
    snippets = spark.createDataFrame([(1, 0, 1.0, "s0"), (1, 1, 25.0, "s1"), (1, 2, 7.0, "s2")], "v int, pos int, start double, text string")
    out = order.segments(chapters, snippets, "v")
    assert [(r.chapter_idx, r.transcript) for r in out.orderBy("chapter_idx").collect()] == [(0, "s0"), (1, ""), (2, "s1 s2")]
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_partition_helpers(spark):
    p = order.numbered_points(spark.createDataFrame([(1, "- A\n- B\n- C")], "k int, text string"), ["k"])
    assert [r["last"] for r in order.last_points(p, ["k"], 2).orderBy("part").collect()] == [2, 3]
    b = spark.createDataFrame([(1, 145), (1, 287), (1, 421)], "k int, last int")
    assert [(r["first"], r["last"]) for r in order.ranges_of(b, ["k"]).orderBy("last").collect()] == [(1, 145), (146, 287), (288, 421)]


def test_chunks_overlap(spark):
    df = spark.createDataFrame([(1, "abcdefghij", 3), (2, "ab", 9), (3, "", 2)], "k int, text string, n int")
    got = {(r.k, r.chunk): r.content for r in order.chunks(df, ["k"], F.col("text"), "n", 1).collect()}
    assert got == {(1, 0): "abcd", (1, 1): "defgh", (1, 2): "hij", (2, 0): "a", (2, 1): "ab"}


def test_breaks(spark):
    df = spark.createDataFrame([([],), ([1, 2],), ([2, 1],), ([1, 1],), ([0, 1],), ([9],)], "s array<int>")
    assert [r[0] for r in df.select(order.breaks_problem(F.col("s"), F.lit(3))).collect()] == [None, None, "order", "duplicate", "range", "range"]


def test_text_functions(spark):
    assert one(spark, 3725, T.hms, "long") == "01:02:05" and one(spark, -4, T.hms, "long") == "00:00:00"
    assert one(spark, "20240102", T.compact_date) == "2024-01-02" and one(spark, "2024", T.compact_date) == "2024"
    assert one(spark, "March 5, 2024", T.iso_date) == "2024-03-05T00:00:00" and one(spark, "soon", T.iso_date) == "soon"
    assert one(spark, "Byron", T.author_name) == "ron" and one(spark, "Author: A B", T.author_name) == "A B"
    assert one(spark, "####### x", T.heading_level) == 0 and one(spark, "  ## x", T.heading_level) == 2
    assert one(spark, "a\r\n\n\n\nb ", T.plain_markdown) == "a\n\nb\n"
    assert one(spark, 18001, lambda x: T.chunk_count(x, 6000), "long") == 4 and one(spark, 0, lambda x: T.chunk_count(x, 6000), "long") == 1


def test_urls(spark):
    assert one(spark, "HTTPS://Ex.org/a/?utm_x=1&b=&gclid=2#f", U.canonical) == "https://ex.org/a?b="
    assert one(spark, "https://youtu.be/abcdefghijk?t=1", U.video_id) == "abcdefghijk" and one(spark, "https://x.org/watch?v=abcdefghijk", U.video_id) is None
    assert one(spark, "https://youtube.com/abcdefghijk/x", U.video_id) == "abcdefghijk" and one(spark, "youtube.com/watch?v=short", U.video_id) is None
    assert one(spark, "https://ex.org/?GCLID=1&a=%7E+b%2F*", U.canonical) == "https://ex.org/?GCLID=1&a=~+b%2F%2A"


def test_refused_addresses(spark):
    import ipaddress

    four = ["8.8.8.8", "10.0.0.1", "192.0.2.1", "198.18.0.1", "198.19.255.255", "198.20.0.0", "198.51.100.7", "203.0.113.9", "172.15.0.1", "172.31.9.9", "172.32.0.1", "192.0.0.9", "192.0.0.8", "100.64.0.1", "224.0.0.1", "169.254.1.1"]
    six = ["::1", "::", "2001:db8::1", "2606:4700::1111", "fe80::1", "fec0::1", "fc00::1", "ff02::1", "2001:4860:4860::8888", "2001::1", "2002::1", "64:ff9b::1", "100::1", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1", "2a00:1450:4001:81b::200e"]
    bad = lambda i: i.is_private or i.is_loopback or i.is_link_local or i.is_reserved or i.is_multicast
    rows = [(f"http://{x}:80/a", "private" if bad(ipaddress.ip_address(x)) else None) for x in four] + [(f"http://[{x}]/a", "private" if bad(ipaddress.ip_address(x)) else None) for x in six]
    rows += [("http://256.1.1.1/", None), ("http://[1::2::3]/", "host"), ("http://LOCALHOST", "local"), ("http://a.localhost/", None), ("ftp://x/", "scheme"), ("http:///x", "host"), (" ", "empty"), (None, "empty"), ("http://x/" + "a" * 4096, "too long")]
    got = spark.createDataFrame(rows, "u string, want string").select("u", "want", U.refusal(F.col("u")).alias("got")).collect()
    assert [(r.u, r.got) for r in got] == [(r.u, r.want) for r in got]


def test_links_of_a_page(spark):
    from urllib.parse import urljoin

    links = ["/a/b", "c", "../z", "../../../z/./k/..", "//o.org/p", "?n=2", "#t", "", "https://e.com/x", "./", "c?x=/../y"]
    rows = [(b, x) for b in ("http://h.org/x/y?q=1#f", "http://h.org") for x in links]
    got = spark.createDataFrame(rows, "b string, x string").select("b", "x", U.resolved(F.col("b"), F.col("x")).alias("got")).collect()
    for r in got:
        want = urljoin(r.b, r.x)
        assert r.got == want or r.b == "http://h.org" and r.got in (want, want.replace("h.org", "h.org/", 1)), (r.b, r.x, r.got, want)


def test_description_chapters(spark):
    d = spark.createDataFrame([(1, "hi\n0:00 Intro\n1:30 - Next\n1:10 Back\n1:02:03 | Late\n5:75 no")], "v int, d string")
    got = [(r.title, r.timestamp_seconds, r.display) for r in video.description_chapters(d, "v", "d").orderBy("chapter_idx").collect()]
    assert got == [("Intro", 0, "00:00:00"), ("Next", 90, "00:01:30"), ("Late", 3723, "01:02:03")]


def test_markdown_tree(spark):
    md = "lost\n# A\nx\n### B\n\ny\n## C\n# D"
    t = tree.with_parents(tree.heading_sections(spark.createDataFrame([(1, md)], "k int, md string"), ["k"], "md"), ["k"])
    got = [(r.heading, r.level, r.content, r.parent_pos, r.path) for r in t.orderBy("pos").collect()]
    assert got == [("A", 1, "x", 0, ["A"]), ("B", 3, "y", 1, ["A", "B"]), ("C", 2, "", 1, ["A", "C"]), ("D", 1, "", 0, ["D"])]


def test_topic_nodes(spark):
    doc = '{"hierarchy": [{"name": "A", "start_point": 1, "end_point": 5, "children": [{"name": "a1", "start_point": 1, "end_point": 3}, {"name": "a2", "start_point": 4, "end_point": 5}]}, {"name": "B", "start_point": 6, "end_point": 10}]}'
    got = tree.topic_nodes(spark.createDataFrame([(1, doc), (2, '{"hierarchy": []}')], "k int, doc string"), ["k"], "doc").orderBy("node_pos").collect()
    assert [(r.name, r.node_pos, r.parent_pos, r.depth, r.is_content) for r in got] == [("A", 1, 0, 0, False), ("a1", 2, 1, 1, True), ("a2", 3, 1, 1, True), ("B", 4, 0, 0, True)]


def test_batch_validation(spark):
    e = spark.createDataFrame([("b", "N1"), ("b", "N2")], "batch_id string, temp_id string")
    status = lambda *ids: batching.checked(e, spark.createDataFrame([("b", i) for i in ids], "batch_id string, temp_id string")).first().status
    assert [status("N1", "N2"), status("N1"), status("N1", "N1"), status("N1", "N3")] == ["ok", "count", "duplicate", "incorrect_ids"]


def test_usage(spark):
    calls = spark.createDataFrame([("n", "o", "OpenAI", "M", 1000, 2000, 3000, 1.5, True), ("n", "o", "x", "y", None, 1, None, 2.0, False)],
                                  "node_name string, operation_name string, provider string, model string, input_tokens long, output_tokens long, total_tokens long, duration_ms double, success boolean")
    prices = spark.createDataFrame([("openai", "m", 0.5, 0.25)], "provider string, model string, in_per_1k double, out_per_1k double")
    rows = {(r.dimension, r.value): r for r in usage.summary(usage.costs(calls, prices)).collect()}
    assert rows["all", None].cost == 1.0 and rows["all", None].total_tokens == 3000 and rows["provider", "x"].cost is None
    assert usage.summary(usage.costs(calls.limit(0), prices)).where("dimension = 'all'").first().calls == 0


def test_article(spark):
    html = "<html><head><title>A &amp; B</title></head><body><nav>no</nav><article><h1>T</h1><p>x <b>y</b></p><ul><li>i</li></ul><script>z</script></article></body></html>"
    assert one(spark, html, article.html_title) == "A & B"
    assert one(spark, html, article.as_markdown) == "# T\n\nx **y**\n\n- i\n"


def test_markdown_metadata(spark):
    m = markdown.metadata(spark.createDataFrame([("n/f.md", "## s\n\n> q\n\nfirst  para\n\nBy: yes\nBy no\nAuthor: Ada"), ("n/g.md", "# T\n")], "path string, raw_content string")).orderBy("path").collect()
    assert [(r.title, r.description, r.author) for r in m] == [("f", "first para", "no"), ("T", "", "")]


def test_routing_and_models(spark):
    s = spark.createDataFrame([("u", "YouTube"), ("u", "book"), ("u", "radio"), (" ", "article")], "source string, source_type string")
    assert [r.branch for r in routing.routed(s, "out").collect()] == ["youtube", "unsupported", "rejected", "rejected"]
    with pytest.raises(ValueError):
        models.model("none")
    turns = spark.createDataFrame([(1, 0, "user", "Hi there. Ok"), (1, 1, "assistant", "Yes")], "conv_id long, turn long, role string, text string")
    assert notes.from_conversations(turns).first().document == "# Conversation 1\n\n## Chapter 1\n\n1. Hi there\n2. Ok Yes\n"
