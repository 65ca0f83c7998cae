"""Articles out of HTML by the table of tags and texts."""

import pytest
from pyspark.sql import functions as F

from notes_engine.sources import article, blocks, html

CASES = [
    ("<p>a</p><p>b <b>c</b> <i>d</i> <code>e f</code></p>", "a\n\nb **c** *d* `e f`"),
    ("<p><b>open<p>next</b>", "open\n\nnext"),
    ("<h1>T\n  x</h1><h3 class=a>U</h3>text", "# T x\n\n### U\n\ntext"),
    ("<ul><li>a<ul><li>b<li>c<ol><li>d</ol></ul><li>e<p>f</p></ul><p>g", "- a\n    - b\n    - c\n        1. d\n- e\n\n    f\n\ng"),
    ("<ol start=4><li><p>a</p><li>b</ol><ol><li>c</ol>", "4. a\n5. b\n1. c"),
    ("<table><thead><tr><th>a<th>b</thead><tr><td>1</td><td>x|y<br>z</td></tr><tr><td><ul><li>l</ul></td></tr></table>after", "| a | b |\n| --- | --- |\n| 1 | x\\|y z |\n| l |\n\nafter"),
    ("<blockquote><p>q<blockquote>r<br>s</blockquote></blockquote>t", "> q\n\n> > r\n> > s\n\nt"),
    ("<pre><code>a &lt;b\n  <b>c</b>\n</code></pre>", "```\na <b\n  c\n```"),
    ("<p>see <a href='/x?a=1&amp;b=2' title='>'>it</a> or <a href=\"#top\">top</a> or <a>none</a>", "see [it](/x?a=1&b=2) or top or none"),
    ("a &amp;lt; &#65;&#x42; &#xD800; &euro; &unknown; &#12", "a &lt; AB � € &unknown; &#12"),
    ("x<!-- <p>no</p> --><script>var a='</p><p>no'</script><style>p{}</style><svg><text>no</text></svg>y", "xy"),
    ("<div class='main ad-box'>no<div>no</div></div><div id=\"cookie\">no</div><div class=shady>yes</div><nav>no<nav>no</nav></nav><header>h</header>", "yes\n\nh"),
    ("out<article><h1>a</h1><div class=share>no</div>b</article>out<article>c</article>", "# a\n\nb"),
    ("out<main>in<article>deep</article></main>", "deep"),
    ("<ul><li><a href=/1>one</a><li><a href=/2>two</a> three<li>four</ul><div><a href=/>x</a></div><p><a href=/y>kept</a></p>", "- [two](/2) three\n- four\n\n[kept](/y)"),
    ("<nav>open for ever<p>text</p>", "open for ever\n\ntext"),
    ("1 < 2 > 0 <", "1 < 2 > 0 <"),
    ("<p>" + "long " * 30 + "</p>", ("long " * 30).strip()),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, h) for i, (h, _) in enumerate(CASES)] + [(100, None), (101, " \n"), (102, "<nav>x</nav>"), (103, "<p>" + "again " * 20 + "</p>" + ("<div>" + "again " * 20 + "</div>") * 3 + "<p>s</p>" * 4)]
    df = spark.createDataFrame(rows, "i int, html string").withColumn("at", F.lit("x")).withColumn("block", F.lit(1))
    return {r.i: r for r in html.articles(df, ["i"], "html").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_articles(found, i):
    assert found[i].markdown == CASES[i][1] + "\n" and found[i].problem is None
    assert found[i].short == (len(CASES[i][1]) + 1 < 80)


def test_pages_without_articles(found):
    assert [(found[i].markdown, found[i].problem) for i in (100, 101, 102)] == [(None, "empty"), (None, "empty"), (None, "no content")]


def test_repeated_blocks(found):
    long = ("again " * 20).strip()
    assert found[103].markdown == "\n\n".join([long, long, "s", "s", "s", "s"]) + "\n"


def test_article_to_sections(spark):
    page = "<article><h1>A</h1><p>x</p><ul><li>i<ol><li>j</ol></ul><h2>B</h2><table><tr><th>k</th></tr><tr><td>v</td></tr></table><pre># no heading</pre></article>"
    md = html.articles(spark.createDataFrame([(1, page)], "k int, html string"), ["k"], "html")
    got = [(r.heading, r.level, r.content) for r in blocks.sections(md, ["k"], "markdown").orderBy("pos").collect()]
    assert got == [("A", 1, "x\n\n- i\n\n  1. j"), ("B", 2, "| k |\n| --- |\n| v |\n\n```\n# no heading\n```")]


def test_linked_data(spark):
    ld = lambda *docs: "".join(f"<script type='application/ld+json'>{d}</script>" for d in docs)
    rows = [
        (1, ld('{"@type":"Article","headline":" A &amp; b ","author":"Eve","datePublished":"2024"}')),
        (2, ld("{broken", '[{"@type":"Person","name":"No"},{"@type":["X","Report"],"name":"R","author":[{"name":"P"},"Q",{"x":1}]}]')),
        (3, ld('{"@graph":[{"@type":"WebPage","description":"d"},{"@type":"BlogPosting","headline":"h","author":{"name":"N"}}]}')),
        (4, ld('{"@type":"Product","name":"x"}')), (5, "<p>none</p>"), (6, None), (7, ld('{"@type":"Article","headline":{"a":1},"author":{"x":2}}')),
    ]
    out = {r.k: r.d for r in spark.createDataFrame(rows, "k int, h string").select("k", article.linked_data(F.col("h")).alias("d")).collect()}
    shown = {k: tuple(d) if d else None for k, d in out.items()}
    none = (None, None, None, None)
    assert shown == {1: ("A & b", None, "Eve", "2024"), 2: ("R", None, "P, Q", None), 3: ("h", "d", "N", None), 4: none, 5: None, 6: None, 7: none}


def test_tasks_follow_the_characters_of_pages(spark, monkeypatch):
    """Five times the pages are five times the tasks, however small their rows are when written."""
    monkeypatch.setattr(html, "TASK_CHARS", 2000, raising=False)
    page = "<article><h1>t</h1><ul><li>one<li>two</ul><p>" + "same " * 100 + "</p></article>"
    for n in (100, 500):
        df = spark.range(n).select(F.col("id").alias("k"), F.lit(page).alias("html"))
        tasks = html.blocks(df, ["k"], "html").groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("k").alias("pages")).collect()
        assert sum(r.pages for r in tasks) == n and max(r.pages for r in tasks) < 20 and len(tasks) > n // 5
    assert html.articles(df, ["k"], "html").select("markdown").distinct().count() == 1
