"""Articles out of HTML by a table of tags and texts.

A page becomes rows of tags, texts and raw elements.  Running sums over them say
where each row lies (depth of lists and quotes, table cell, boilerplate, the
article element); a matching pair of tags is two neighbours at one depth of
their name.  Rows between block tags are one block, with its text and the share
of it that is links.  All windows and groups are within a page, so the rows are
dealt out once, by page, to as many tasks as the pages' characters ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

PIECE = r"(?is)<!--.*?-->|<(script|style|noscript|template|svg|head|select|iframe|button)\b[^>]*>.*?</\1\s*>|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<![a-z][^>]*>|[^<]++|<"
RAW = ["script", "style", "noscript", "template", "svg", "head", "select", "iframe", "button"]
# Elements and words of classes and ids that are not part of an article.
BOILERPLATE = ["nav", "footer", "aside", "form", "menu", "dialog"]
WORDS = "ad|ads|advert|advertisement|banner|breadcrumb|breadcrumbs|comments|cookie|menu|navbar|newsletter|pagination|popup|promo|related|share|sharing|sidebar|social|sponsored|subscribe"
PAIRED = [*BOILERPLATE, "div", "section", "ul", "ol", "header", "article", "main"]
BLOCK = [*BOILERPLATE, "address", "article", "blockquote", "body", "dd", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "table", "tbody", "tfoot", "thead", "tr", "ul"]
MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`", "tt": "`", "a": "["}
# Named characters beside the ones that mark tags.
NAMED = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "euro": "€", "middot": "·", "bull": "•"}
LINKS = 0.8  # of the text of a list item or plain block that may be links, at most
REPEATS, REPEATED = 2, 100  # times that a block of so many characters or more is kept
SHORT = 80  # characters below which an article is suspect
TASK_CHARS = 1 << 23  # of pages that one task gets, about: its sorts hold them several times over


def unescaped(x: Column) -> Column:
    """Named, decimal and hexadecimal characters; others stay as they are."""
    raw = x
    for name, c in NAMED.items():
        x = F.replace(x, F.lit(f"&{name};"), F.lit(c))
    parts = F.regexp_extract_all(x, F.lit(r"(?s)&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});|(?:(?!&#).)+|&#"), 0)
    number = lambda p: F.when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(p, "([0-9]+);", 1)).cast("long")
    fits = lambda n: ((n > 0) & (n < 0xD800)) | ((n > 0xDFFF) & (n < 0x110000))
    char = lambda p: F.when(fits(number(p)), F.decode(F.unhex(F.lpad(F.hex(number(p)), 8, "0")), "UTF-32")).otherwise("�")
    decoded = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^&#[0-9xX]+[0-9a-fA-F]*;$"), char(p)).otherwise(p)), "")
    return F.when(raw.contains("&"), F.replace(F.when(raw.contains("&#"), decoded).otherwise(x), F.lit("&amp;"), F.lit("&"))).otherwise(raw)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute as it is written, or an empty text."""
    m = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, m, k) for k in (1, 2, 3)])


def events(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """keys, at, piece, name, opens, closes: tags and texts in order; a text has no name, raw elements and comments are left out."""
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(PIECE), 0)).alias("at", "piece"))
    name = F.lower(F.regexp_extract("piece", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    rows = rows.withColumn("name", name).where(~F.col("piece").startswith("<!") & ~F.col("name").isin(RAW))
    tag = F.col("name") != ""
    return rows.withColumns({"opens": tag & ~F.col("piece").startswith("</"), "closes": tag & F.col("piece").startswith("</")})


def _one(x: Column) -> Column:
    return F.coalesce(x, F.lit(False)).cast("int")


def _partners(e: DataFrame, by: list[str], names: list[str], prefix: str) -> DataFrame:
    """``e`` with the partner of each tag of these names: struct(at, piece), or null if none matches within ``by``."""
    w = Window.partitionBy(*by, "name").orderBy("at")
    mine = F.col("name").isin(names)
    depth = F.sum(_one(mine & F.col("opens")) - _one(mine & F.col("closes"))).over(w) - _one(F.col("opens"))
    deep = Window.partitionBy(*by, "name", f"{prefix}_depth").orderBy("at")
    e = e.withColumn(f"{prefix}_depth", F.when(mine, depth))
    there = lambda f, flag: F.when(f(flag).over(deep), f(F.struct("at", "piece")).over(deep))
    return e.withColumn(prefix, F.when(mine, F.when(F.col("opens"), there(F.lead, "closes")).otherwise(there(F.lag, "opens")))).drop(f"{prefix}_depth")


def _tasks(pages: DataFrame, html: str) -> int:
    """Tasks for pages, of about ``TASK_CHARS`` characters each; a number that is given is not made smaller by adaptive execution."""
    chars = pages.agg(F.sum(F.length(html).cast("long"))).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))


def placed(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Events of the article of each page with where they lie.

    The article is what the first matching ``article`` (else ``main``) element
    holds, or the page; elements of boilerplate, by name or by class and id, are
    left out with all that they hold.
    """
    e = _partners(events(pages, keys, html).repartition(_tasks(pages, html), *keys), keys, PAIRED, "_pair")
    order = Window.partitionBy(*keys).orderBy("at")
    page = Window.partitionBy(*keys)
    tag = F.when(F.col("opens"), F.col("piece")).otherwise(F.col("_pair")["piece"])
    named = F.concat_ws(" ", attribute(tag, "class"), attribute(tag, "id")).rlike(rf"(?i)(?:^|[\s_-])(?:{WORDS})(?:[\s_-]|$)")
    matched = F.col("_pair").isNotNull()
    junk = matched & (F.col("name").isin(BOILERPLATE) | named)
    e = e.withColumn("_skip", F.sum(_one(junk & F.col("opens")) - _one(junk & F.col("closes"))).over(order))
    first = lambda name: F.min(F.when(matched & F.col("opens") & (F.col("name") == name) & (F.col("_skip") == 0), F.struct("at", F.col("_pair")["at"].alias("to")))).over(page)
    e = e.withColumn("_body", F.coalesce(first("article"), first("main")))
    inside = F.col("_body").isNull() | F.col("at").between(F.col("_body")["at"], F.col("_body")["to"])
    e = e.where(inside & (F.col("_skip") <= 0)).drop("_skip", "_body", "_pair")

    def depth(*names: str) -> Column:
        mine = F.col("name").isin(*names)
        return F.greatest(F.sum(_one(mine & F.col("opens")) - _one(mine & F.col("closes"))).over(order), F.lit(0))

    table = F.when(F.col("name").isin("td", "th", "tr", "table"), F.col("name").isin("td", "th") & F.col("opens"))
    e = e.withColumns({"lists": depth("ul", "ol"), "quotes": depth("blockquote"), "pre": depth("pre"), "cell": F.coalesce(F.last(table, ignorenulls=True).over(order), F.lit(False))})
    listed = Window.partitionBy(*keys, "lists").orderBy("at")
    opened = F.when(F.col("name").isin("ul", "ol") & F.col("opens"), F.struct("at", "name", F.coalesce(attribute(F.col("piece"), "start").try_cast("int"), F.lit(1)).alias("start")))
    item = F.when((F.col("name") == "li") & F.col("opens"), F.col("at"))
    e = e.withColumns({
        "list": F.when(F.col("lists") > 0, F.last(opened, ignorenulls=True).over(listed)), "item": F.when(F.col("lists") > 0, F.last(item, ignorenulls=True).over(listed)),
        "table": F.last(F.when((F.col("name") == "table") & F.col("opens"), F.col("at")), ignorenulls=True).over(order),
    })
    e = e.withColumn("item", F.when(F.col("item") > F.col("list")["at"], F.col("item")))
    e = e.withColumn("number", F.sum(_one(item.isNotNull())).over(Window.partitionBy(*keys, "list").orderBy("at")))
    cut = F.col("name").isin(BLOCK) & ~(F.col("cell") & ~F.col("name").isin("tr", "table"))
    return e.withColumn("cut", cut).withColumn("block", F.sum(_one(cut)).over(order))


def _shown(e: DataFrame, keys: list[str]) -> DataFrame:
    """``e`` with what each row adds to its block (``out``), and how many characters of it are text and links."""
    e = _partners(e, [*keys, "block"], list(MARKS), "_mark")
    order = Window.partitionBy(*keys, "block").orderBy("at")
    matched = F.col("_mark").isNotNull()
    link = matched & (F.col("name") == "a")
    href = F.when(link, F.trim(unescaped(attribute(F.when(F.col("opens"), F.col("piece")).otherwise(F.col("_mark")["piece"]), "href"))))
    text = F.when(F.col("name") == "", unescaped(F.when(F.col("pre") > 0, F.col("piece")).otherwise(F.regexp_replace("piece", r"\s+", " "))))
    e = e.withColumns({"_href": href, "_text": text})
    href, text = F.col("_href"), F.col("_text")
    target = link & (href != "") & ~href.rlike("(?i)^(?:#|javascript:)")
    e = e.withColumn("_link", F.sum(_one(link & F.col("opens")) - _one(link & F.col("closes"))).over(order))
    marks = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    out = F.when(F.col("name") == "", text).when(F.col("name") == "br", "\n").when(F.col("name").isin("td", "th") & F.col("opens"), "\u0001").when(F.col("cell") & F.col("name").isin(BLOCK), " ")
    out = out.when(target & F.col("closes"), F.concat(F.lit("]("), href, F.lit(")"))).when(target, "[").when(link | (F.col("pre") > 0), "").when(matched, F.try_element_at(marks, F.col("name"))).otherwise("")
    size = F.when(F.col("name") == "", F.length(F.trim(text))).otherwise(0)
    return e.withColumns({"out": out, "chars": size, "linked": F.when(F.col("_link") > 0, size).otherwise(0)})


def blocks(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """keys, block, kind, text, chars, linked, lists, list, item, number, quotes, table: the blocks of articles, in order, boilerplate and empty ones left out.

    ``kind`` is the name of the tag that starts a block, or empty.  Dropped: list
    items and plain blocks that are links for the most part, and long blocks from
    their third time on.
    """
    e = _shown(placed(pages, keys, html), keys)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "out"))), lambda x: x["out"]), "")
    kept = [F.max(F.when(~F.col("cell"), F.col(c))).alias(c) for c in ("lists", "list", "item", "number", "quotes", "pre", "table")]  # lists within a cell are text
    b = e.groupBy(*keys, "block").agg(text.alias("text"), F.max(F.when(F.col("cut") & F.col("opens"), F.col("name"))).alias("kind"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), *kept)
    squeezed = T.strip(F.regexp_replace(F.regexp_replace("text", r"[ \t]+", " "), r" *\n *", "\n"))
    b = b.withColumns({"kind": F.coalesce("kind", F.lit("")), "text": F.when(F.col("pre") > 0, F.regexp_replace("text", r"^\n|\s+$", "")).otherwise(squeezed)}).where("trim(text) != ''")
    b = b.where(~(F.col("kind").isin("", "li", "div", "ul", "ol", "section") & (F.col("linked") > F.lit(LINKS) * F.col("chars"))))
    times = F.row_number().over(Window.partitionBy(*keys, "text").orderBy("block"))
    return b.withColumn("_times", times).where((F.length("text") < REPEATED) | (F.col("_times") <= REPEATS)).drop("_times")


def articles(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """keys, markdown, problem, short: the article of every page as markdown.

    ``problem`` is ``empty`` for a blank or null page and ``no content`` where
    nothing is left of one; their markdown is null.  ``short``: an article of
    fewer than 80 characters.
    """
    b = blocks(pages, keys, html)
    order = Window.partitionBy(*keys).orderBy("block")
    starts = F.col("item").isNotNull() & (F.row_number().over(Window.partitionBy(*keys, "item").orderBy("block")) == 1)
    row = (F.col("kind") == "tr") & F.col("table").isNotNull()
    b = b.withColumns({"_starts": starts, "_row": row})
    b = b.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "table", "_row").orderBy("block")))
    cells = F.transform(F.filter(F.split("text", "\u0001"), lambda c, i: i > 0), lambda c: F.replace(T.squeeze(c), F.lit("|"), F.lit("\\|")))
    line = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    ruled = F.concat(line, F.lit("\n| "), F.array_join(F.transform(cells, lambda _: F.lit("---")), " | "), F.lit(" |"))
    level = F.regexp_extract("kind", r"^h([1-6])$", 1)
    body = F.when(F.col("_row") & F.col("text").contains("\u0001"), F.when(F.col("_nth") == 1, ruled).otherwise(line)).when(F.col("pre") > 0, F.concat(F.lit("```\n"), "text", F.lit("\n```")))
    body = body.when(level != "", F.concat(T.heading_mark(level.try_cast("int")), F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" ")))).otherwise(F.replace("text", F.lit("\u0001"), F.lit(" ")))
    mark = F.when(F.col("list")["name"] == "ol", F.concat((F.col("list")["start"] + F.col("number") - 1).cast("string"), F.lit(". "))).otherwise("- ")
    space = F.repeat(F.lit(" "), (4 * F.col("lists")).cast("int"))
    lead = F.when(F.col("_starts"), F.concat(F.repeat(F.lit(" "), (4 * (F.col("lists") - 1)).cast("int")), mark)).otherwise(space)
    quote = F.repeat(F.lit("> "), F.col("quotes").cast("int"))
    piece = F.concat(quote, lead, F.regexp_replace(body, "\n", F.concat(F.lit("\n"), quote, space)))
    before = F.lag(F.struct("_starts", "lists", "_row", "table", "quotes")).over(order)
    near = (F.col("_starts") & (before["lists"] > 0) & (before["quotes"] == F.col("quotes"))) | (F.col("_row") & before["_row"] & (before["table"] == F.col("table")))
    b = b.withColumn("_piece", F.concat(F.when(before.isNull(), "").when(near, "\n").otherwise("\n\n"), piece))
    whole = b.groupBy(*keys).agg(T.plain_markdown(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "_piece"))), lambda x: x["_piece"]), "")).alias("markdown"))
    blank = T.strip(F.coalesce(html, F.lit(""))) == ""
    out = pages.select(*keys, blank.alias("_blank")).join(whole, keys, "left")
    problem = F.when(F.col("_blank"), "empty").when(F.coalesce(T.strip(F.col("markdown")), F.lit("")) == "", "no content")
    return out.select(*keys, F.when(problem.isNull(), F.col("markdown")).alias("markdown"), problem.alias("problem"), F.coalesce(F.length("markdown") < SHORT, F.lit(False)).alias("short"))
