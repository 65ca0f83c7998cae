"""Articles: metadata and sections of fetched HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import blocks
from .html import unescaped

# Meta keys in order of preference.
KEYS = {
    "title": ["og:title", "twitter:title", "dc.title", "headline"],
    "description": ["description", "og:description", "twitter:description", "dc.description"],
    "author": ["author", "article:author", "og:author", "parsely-author", "dc.creator", "dc.creator.author", "dc.contributor", "byl", "byline"],
    "upload_date": ["article:published_time", "article:modified_time", "publish_date", "publication_date", "date", "dc.date", "dc.date.issued", "pubdate"],
}

def html_title(html: Column) -> Column:
    return T.squeeze(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def meta_tags(html: Column) -> Column:
    """Map of lower-case name or property to content; the last of a key wins, blank content is skipped, name beats property."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0)
    attr = lambda t, a: F.regexp_extract(t, rf"(?is)\b{a}\s*=\s*[\"']([^\"']*)[\"']", 1)
    entry = lambda t, a: F.struct(F.lower(F.trim(attr(t, a))).alias("key"), T.strip(unescaped(attr(t, "content"))).alias("value"))
    good = lambda e: (e["key"] != "") & (e["value"] != "")
    both = F.concat(F.filter(F.transform(tags, lambda t: entry(t, "property")), good), F.filter(F.transform(tags, lambda t: entry(t, "name")), good))
    return F.map_from_entries(F.filter(both, lambda e, i: ~F.exists(F.slice(both, i + 2, F.size(both)), lambda o: o["key"] == e["key"])))


# Types of linked data that describe an article.
ARTICLES = ["Article", "NewsArticle", "BlogPosting", "Blog", "Report", "TechArticle", "ScholarlyArticle", "LiveBlogPosting", "WebPage"]


def linked_data(html: Column) -> Column:
    """struct(title, description, author, upload_date) of a page's linked data; null where it has none.

    The first article among its objects that has a field gives it: an object, a
    list of them, or a graph.  Authors of a list are joined by commas.
    """
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*\btype\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)
    docs = F.filter(F.transform(scripts, lambda x: F.try_parse_json(T.strip(x))), lambda d: d.isNotNull())
    many = lambda d, path: F.try_variant_get(d, path, "array<variant>")
    text = lambda d, path: F.try_variant_get(d, path, "string")
    nodes = F.flatten(F.transform(docs, lambda d: F.coalesce(many(d, "$['@graph']"), many(d, "$"), F.array(d))))
    kinds = lambda n: F.coalesce(F.try_variant_get(n, "$['@type']", "array<string>"), F.array(text(n, "$['@type']")))
    own = F.filter(nodes, lambda n: F.arrays_overlap(F.array_compact(kinds(n)), F.array(*map(F.lit, ARTICLES))))

    def told(articles: Column) -> Column:
        plain = lambda x: F.when(~x.rlike(r"^\s*[\[{]"), F.nullif(T.strip(x), F.lit("")))
        names = lambda n: F.array_join(F.array_compact(F.transform(many(n, "$.author"), lambda a: F.coalesce(text(a, "$.name"), plain(text(a, "$"))))), ", ")
        first = lambda f: F.get(F.filter(F.transform(articles, f), lambda x: x.isNotNull()), F.lit(0))
        field = lambda *paths: first(lambda n: F.coalesce(*[plain(text(n, p)) for p in paths]))
        author = first(lambda n: F.coalesce(plain(text(n, "$.author.name")), F.nullif(names(n), F.lit("")), plain(text(n, "$.author"))))
        fields = F.array(field("$.headline", "$.name"), field("$.description"), author, field("$.datePublished", "$.dateCreated", "$.dateModified"))
        return T.let(F.transform(fields, unescaped), lambda x: F.struct(*[F.get(x, F.lit(i)).alias(n) for i, n in enumerate(("title", "description", "author", "upload_date"))]))

    return F.when(html.contains("ld+json"), T.let(own, told))


def canonical_link(html: Column) -> Column:
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: t.rlike(r"(?is)\brel\s*=\s*(?:[\"'](?:[^\"']*\s)?canonical(?:\s[^\"']*)?[\"']|canonical[\s/>])"))
    there = F.filter(F.transform(links, lambda t: unescaped(F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']([^\"']*)[\"']", 1))), lambda x: x != "")
    return T.strip(F.get(there, F.lit(0)))


def resolved(pairs: list[tuple[str, Column]], default: str) -> tuple[Column, Column]:
    """The first value that is there, and the name of where it came from."""
    value, source = F.lit(default), F.lit("default")
    for name, c in reversed(pairs):
        there = F.coalesce(T.strip(c), F.lit("")) != ""
        value, source = F.when(there, T.strip(c)).otherwise(value), F.when(there, name).otherwise(source)
    return value, source


def metadata(pages: DataFrame, key: str, reference: Column | None = None) -> DataFrame:
    """key, content_id, url, title, title_source, description, author, upload_date of pages (key, url, html).

    A field is taken from linked data, else from meta tags, a title else from the
    page's.  With a ``reference`` date, dates of loose form are read too, with what they lack from it.
    """
    m = pages.withColumn("_m", meta_tags(F.col("html")))
    m = m.withColumn("_ld", linked_data(F.col("html")))
    m = m.withColumns({f"_{field}": F.coalesce(*[F.try_element_at("_m", F.lit(k)) for k in keys]) for field, keys in KEYS.items()} | {"_html_title": html_title(F.col("html")), "_link": canonical_link(F.col("html"))})
    title, source = resolved([("linked data", F.col("_ld.title")), ("meta", F.col("_title")), ("html", F.col("_html_title"))], "Untitled Article")
    m = m.withColumn("_url", U.canonical(F.coalesce(U.resolved(F.col("url"), F.col("_link")), F.col("url"))))
    raw = F.coalesce("_ld.upload_date", "_upload_date", F.lit(""))
    return m.select(
        key, F.substring(F.sha2("_url", 256), 1, 16).alias("content_id"), F.col("_url").alias("url"), title.alias("title"), source.alias("title_source"),
        T.squeeze(F.coalesce("_ld.description", "_description", F.lit(""))).alias("description"), T.author_name(F.coalesce("_ld.author", "_author", F.lit(""))).alias("author"),
        (T.iso_date(raw) if reference is None else T.dated(raw, reference)).alias("upload_date"))


def as_markdown(html: Column) -> Column:
    """The article as markdown: scripts, styles, navigation, footers and comments go; headings, paragraphs, lists and code stay."""
    x = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|footer|aside|form|noscript|head)\b.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"(?is)<div[^>]*class\s*=\s*[\"'][^\"']*\b(?:ad|ads|advert)\b[^\"']*[\"'][^>]*>.*?</div>", "")
    x = F.coalesce(F.nullif(F.regexp_extract(x, r"(?is)<article[^>]*>(.*?)</article>", 1), F.lit("")), x)
    for k in range(1, 7):
        x = F.regexp_replace(x, rf"(?is)<h{k}[^>]*>\s*(.*?)\s*</h{k}>", "\n\n" + "#" * k + " $1\n\n")
    x = F.regexp_replace(x, r"(?is)<li[^>]*>\s*(.*?)\s*</li>", "\n- $1")
    x = F.regexp_replace(x, r"(?is)<pre[^>]*>(.*?)</pre>", "\n\n```\n$1\n```\n\n")
    x = F.regexp_replace(F.regexp_replace(x, r"(?is)<(?:code)[^>]*>(.*?)</code>", "`$1`"), r"(?is)<(strong|b)\b[^>]*>(.*?)</\1>", "**$2**")
    x = F.regexp_replace(x, r"(?is)<a\b[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    x = F.regexp_replace(F.regexp_replace(x, r"(?is)<br\s*/?>", "\n"), r"(?is)</?(?:p|ul|ol|table|tr|blockquote|div|section)\b[^>]*>", "\n\n")
    return T.plain_markdown(F.regexp_replace(unescaped(F.regexp_replace(x, r"(?s)<[^>]*>", "")), r"[ \t]*\n[ \t]*", "\n"))


def markdown_sections(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, heading, level, content: the sections of markdown texts, in order; ``blocks.sections`` says how."""
    return blocks.sections(df, keys, text)


def section_problem(heading: Column, level: Column, content: Column) -> Column:
    """Why a section is not valid, or null: no heading, a level below 1, or content that starts with a heading mark."""
    return F.when(F.coalesce(T.strip(heading), F.lit("")) == "", "heading").when(F.coalesce(level, F.lit(0)) < 1, "level").when(T.strip(content).startswith("#"), "content")


def with_chapters(sections: DataFrame, keys: list[str], tokens=T.token_estimate) -> DataFrame:
    """``sections`` with content, as chapters: chapter_idx, title, display, transcript and tokens beside their columns; shown by the time at which reading reaches them."""
    from pyspark.sql import Window

    good = sections.where(T.strip(F.col("content")) != "")
    title = F.concat(T.heading_mark(F.col("level")), F.lit(" "), T.strip(F.col("heading")))
    full = good.withColumn("title", title).withColumn("transcript", F.concat("title", F.lit("\n\n"), T.strip(F.col("content")))).withColumn("tokens", tokens(F.col("transcript")))
    return reading_chapters(full, keys).withColumn("chapter_idx", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1)


def section_chapters(sections: DataFrame, keys: list[str], tokens=T.token_estimate) -> DataFrame:
    """keys, chapter_idx, title, display, transcript, tokens of the chapters that sections become."""
    return with_chapters(sections, keys, tokens).select(*keys, "chapter_idx", "title", "display", "transcript", "tokens")


def section_counts(sections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chapters, skipped, problem: sections that become chapters, those that are empty, and what is wrong with a source without any."""
    full = F.count_if(T.strip(F.coalesce("content", F.lit(""))) != "")
    return sections.groupBy(*keys).agg(full.alias("chapters"), (F.count(F.lit(1)) - full).alias("skipped")).withColumn("problem", F.when(F.col("chapters") == 0, "No chapters could be extracted from the article."))


def reading_chapters(sections: DataFrame, keys: list[str], tokens: str = "tokens", rate: float = 2.0) -> DataFrame:
    """Sections with ``display``: the time at which reading reaches them, half seconds to even."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("display", T.hms(F.bround(F.coalesce(F.sum(tokens).over(before), F.lit(0)) / rate)))
