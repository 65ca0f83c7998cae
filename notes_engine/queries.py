"""Queries over the test tables, one or more operators each, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import urls as U
from .operators import batching, nesting, order, tree, usage
from .sources import article, blocks, html, markdown, video

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Sentences of a document as bullets.
def _bullets(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("- "), F.replace("text", F.lit(". "), F.lit(".\n- "))).alias("text"))


POINTS = r"""l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS pos
  FROM (SELECT doc_id, '- ' || replace(text, '. ', '.' || chr(10) || '- ') AS t FROM documents)),
b AS (SELECT doc_id, pos, rtrim(raw) AS line, regexp_matches(rtrim(raw), '^\s*(?:[-*•●○◦▪▸►▶▫]+|\d+[.)])(?:\s+(.*))?$') AS bullet FROM l
  WHERE trim(raw) <> '' AND NOT regexp_matches(raw, '^\s*[-=*_~]{5,}\s*$')),
g AS (SELECT doc_id, pos, sum(bullet::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS grp,
  CASE WHEN bullet THEN trim(regexp_extract(line, '^\s*(?:[-*•●○◦▪▸►▶▫]+|\d+[.)])(?:\s+(.*))?$', 1)) ELSE trim(line) END AS piece FROM b),
j AS (SELECT doc_id, grp, trim(regexp_replace(coalesce(string_agg(nullif(piece, ''), ' ' ORDER BY pos), ''), '[ \t]+', ' ', 'g')) AS point FROM g GROUP BY doc_id, grp),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp)::INT AS point_no, point FROM
  (SELECT *, max(grp) OVER (PARTITION BY doc_id) AS last FROM j) WHERE NOT (grp = last AND point = ''))"""


@query(f"WITH {POINTS} SELECT doc_id, point_no, point, point_no || '. ' || point AS line FROM p")
def numbered_points(spark, sf_dir):
    p = order.numbered_points(_bullets(spark, sf_dir), ["doc_id"])
    return p.select("doc_id", "point_no", "point", F.concat(F.col("point_no").cast("string"), F.lit(". "), F.col("point")).alias("line"))


@query(f"""WITH {POINTS}, w AS (SELECT doc_id, point_no, length(point)::BIGINT AS weight FROM p),
c AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY doc_id ORDER BY point_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev, sum(weight) OVER (PARTITION BY doc_id) AS tot FROM w)
SELECT doc_id, point_no, weight, (CASE WHEN tot = 0 THEN 4 ELSE least(4, prev * 4 // tot + 1) END)::INT AS batch FROM c""")
def equal_weight_batches(spark, sf_dir):
    p = order.numbered_points(_bullets(spark, sf_dir), ["doc_id"]).select("doc_id", "point_no", F.length("point").cast("long").alias("weight"))
    return order.equal_weight(p, ["doc_id"], ["point_no"], "weight", 4)


@query(f"""WITH {POINTS}, w AS (SELECT doc_id, point_no, length(point)::BIGINT AS weight FROM p),
c AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY doc_id ORDER BY point_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev, sum(weight) OVER (PARTITION BY doc_id) AS tot FROM w),
m AS (SELECT doc_id, (CASE WHEN tot = 0 THEN 4 ELSE least(4, prev * 4 // tot + 1) END)::INT AS batch, max(point_no)::INT AS last FROM c GROUP BY ALL)
SELECT doc_id, batch, (coalesce(lag(last) OVER (PARTITION BY doc_id ORDER BY last), 0) + 1)::INT AS first, last FROM m""")
def boundary_ranges(spark, sf_dir):
    b = equal_weight_batches(spark, sf_dir).groupBy("doc_id", "batch").agg(F.max("point_no").alias("last"))
    return order.ranges_of(b, ["doc_id"])


@query(f"""WITH {POINTS}, s AS (SELECT doc_id, point_no, sum(length(point_no || '. ' || point) + 1) OVER (PARTITION BY doc_id ORDER BY point_no) - 1 AS reach, length(point_no || '. ' || point) AS size FROM p),
t AS (SELECT *, max(reach) OVER (PARTITION BY doc_id) AS total, max(point_no) OVER (PARTITION BY doc_id) AS n FROM s)
SELECT doc_id, part::INT AS part, (CASE WHEN part = 4 THEN max(n) ELSE coalesce(max(point_no) FILTER (WHERE reach - size <= ceil(total * part / 4)), 1) END)::INT AS last
FROM t, (SELECT unnest([1, 2, 3, 4]) AS part) GROUP BY doc_id, part""")
def last_points(spark, sf_dir):
    return order.last_points(order.numbered_points(_bullets(spark, sf_dir), ["doc_id"]), ["doc_id"], 4)


@query(f"""WITH {POINTS} SELECT doc_id, count(*) AS points, list(point_no ORDER BY point_no) = range(1, count(*) + 1) AS valid FROM p GROUP BY doc_id""")
def read_numbered_points(spark, sf_dir):
    p = order.numbered_points(_bullets(spark, sf_dir), ["doc_id"])
    lines = F.array_sort(F.collect_list(F.struct("point_no", F.format_string("%d. %s", "point_no", "point").alias("line"))))
    text = p.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
    return order.read_points(text, ["doc_id"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("points"), F.bool_and("valid").alias("valid"))


@query("""WITH r AS (SELECT conv_id, turn, (turn * 3 + 1)::INT AS start, (turn * 3 + 1 + turn % 3)::INT AS e FROM conversations)
SELECT conv_id, turn, start, e AS "end", least(start, coalesce(max(e) OVER (PARTITION BY conv_id ORDER BY start, e, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::INT AS filled FROM r""")
def gap_filled_ranges(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 3 + 1).cast("int").alias("start"), (F.col("turn") * 3 + 1 + F.col("turn") % 3).cast("int").alias("end"))
    return order.fill_gaps(c, ["conv_id"], tie="turn")


@query(f"""WITH {POINTS}, leaf AS (SELECT doc_id, k, (k * 3 + 2)::INT AS start, (k * 3 + 3)::INT AS e FROM (SELECT DISTINCT doc_id FROM p), (SELECT unnest([0, 1, 2]) AS k)),
f AS (SELECT doc_id, k, least(start, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY start, e, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::INT AS start, e FROM leaf)
SELECT f.doc_id, (k + 1)::INT AS ord, any_value(start)::INT AS start, any_value(e)::INT AS "end", coalesce(string_agg(point, chr(10) ORDER BY point_no), '') AS points
FROM f LEFT JOIN p ON p.doc_id = f.doc_id AND p.point_no BETWEEN f.start AND f.e GROUP BY f.doc_id, k""")
def payloads(spark, sf_dir):
    p = order.numbered_points(_bullets(spark, sf_dir), ["doc_id"])
    k = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    leaf = p.select("doc_id").distinct().withColumn("node_pos", k).select("doc_id", "node_pos", (F.col("node_pos") * 3 + 2).alias("start_point"), (F.col("node_pos") * 3 + 3).alias("end_point"), F.lit(True).alias("is_content"))
    out = tree.payloads(leaf, p, ["doc_id"])
    return out.select("doc_id", "ord", "start", "end", F.array_join("points", "\n").alias("points"))


# Turns of a conversation as snippets; the user's turns start chapters.
def _chapters(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return c.select("conv_id", idx.alias("chapter_idx"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"), F.col("turn").alias("timestamp_seconds"))


def _segments(spark, sf_dir):
    snippets = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("turn").alias("start"), "text")
    return order.segments(_chapters(spark, sf_dir), snippets, "conv_id")


SEGMENTS = """c AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chapter_idx, 'turn ' || turn AS title, turn AS ts FROM conversations WHERE role = 'user'),
h AS (SELECT s.conv_id, s.turn, s.text, coalesce(max(c.chapter_idx), 0) AS hit FROM conversations s LEFT JOIN c ON c.conv_id = s.conv_id AND c.ts <= s.turn GROUP BY ALL),
r AS (SELECT conv_id, turn, text, max(hit) OVER (PARTITION BY conv_id ORDER BY turn) AS chapter_idx FROM h),
t AS (SELECT conv_id, chapter_idx, string_agg(text, ' ' ORDER BY turn) AS transcript FROM r GROUP BY ALL),
m AS (SELECT conv_id, max(chapter_idx) AS reached FROM r GROUP BY conv_id),
seg AS (SELECT c.conv_id, c.chapter_idx, c.title, coalesce(t.transcript, '') AS transcript FROM c JOIN m ON m.conv_id = c.conv_id AND c.chapter_idx <= m.reached
  LEFT JOIN t ON t.conv_id = c.conv_id AND t.chapter_idx = c.chapter_idx)"""


@query(f"WITH {SEGMENTS} SELECT * FROM seg")
def transcript_segments(spark, sf_dir):
    return _segments(spark, sf_dir)


@query(f"WITH {SEGMENTS} SELECT conv_id, sum(length(transcript))::BIGINT AS tokens, CASE WHEN sum(length(transcript)) <= 600 THEN 'single' ELSE 'multi_part' END AS mode FROM seg GROUP BY conv_id")
def processing_mode(spark, sf_dir):
    return video.mode(_segments(spark, sf_dir).withColumn("tokens", F.length("transcript")), "conv_id", 600)


@query(f"""WITH {SEGMENTS}, g AS (SELECT conv_id, chapter_idx, printf('%02d:%02d:%02d', chapter_idx * 75 // 3600, chapter_idx * 75 % 3600 // 60, chapter_idx * 75 % 60) AS display, transcript,
  sum((chapter_idx IN (1, 3))::INT) OVER (PARTITION BY conv_id ORDER BY chapter_idx)::INT AS part_idx FROM seg),
q AS (SELECT conv_id, part_idx, min_by(display, chapter_idx) AS first, string_agg(transcript, chr(10) || chr(10) ORDER BY chapter_idx) AS content, sum(length(transcript))::BIGINT AS tokens FROM g GROUP BY ALL)
SELECT conv_id, part_idx, replace(first, ':', '-') || '_' || replace(coalesce(lead(first) OVER (PARTITION BY conv_id ORDER BY part_idx), 'END'), ':', '-') AS part_title, content, tokens, tokens > 300 AS too_large FROM q""")
def content_parts(spark, sf_dir):
    s = _segments(spark, sf_dir).withColumn("display", T.hms(F.col("chapter_idx") * 75)).withColumn("tokens", F.length("transcript").cast("long")).withColumn("breaks", F.array(F.lit(1), F.lit(3)))
    return order.content_parts(order.chapter_groups(s, "conv_id", "breaks"), "conv_id", 300)


@query("""WITH s AS (SELECT conv_id, list(DISTINCT turn % 4 ORDER BY turn % 4) AS sel FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(sel) = 0 THEN NULL WHEN list_bool_and(list_transform(sel, lambda x: x >= 1 AND x <= 2)) THEN NULL ELSE 'range' END AS problem FROM s""")
def breakpoint_check(spark, sf_dir):
    s = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set((F.col("turn") % 4).cast("int"))).alias("sel"))
    return s.select("conv_id", order.breaks_problem(F.col("sel"), F.lit(2)).alias("problem"))


@query("""WITH t AS (SELECT conv_id, turn, turn AS m, (turn * 37) % 70 AS s, role FROM conversations), v AS (SELECT conv_id, turn, (m * 60 + s)::INT AS sec, role FROM t WHERE s < 60),
k AS (SELECT *, coalesce(max(sec) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM v)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chapter_idx, role AS title, sec AS timestamp_seconds,
  printf('%02d:%02d:%02d', sec // 3600, sec % 3600 // 60, sec % 60) AS display FROM k WHERE sec > top""")
def description_chapters(spark, sf_dir):
    line = F.format_string("%02d:%02d - %s", "turn", (F.col("turn") * 37) % 70, "role")
    d = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda x: x["x"]), "\n").alias("description"))
    return video.description_chapters(d, "conv_id", "description")


@query(f"""WITH {SEGMENTS}, w AS (SELECT *, length(transcript)::BIGINT * 11 AS n FROM seg),
a AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY chapter_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM w),
d AS (SELECT *, round_even(b / 2.0, 0)::BIGINT AS sec FROM a), e AS (SELECT *, printf('%02d:%02d:%02d', sec // 3600, sec % 3600 // 60, sec % 60) AS display, format('{{:,}}', n) AS num FROM d)
SELECT conv_id, chapter_idx, display, '[' || printf('%02d', chapter_idx) || '] ' || display || ' | ' || CASE WHEN length(num) >= 6 THEN num ELSE lpad(num, 6, ' ') END || ' tokens | ' || title AS menu FROM e""")
def chapter_menu(spark, sf_dir):
    s = _segments(spark, sf_dir).withColumn("tokens", F.length("transcript").cast("long") * 11).withColumnRenamed("chapter_idx", "pos")
    s = article.reading_chapters(s, ["conv_id"])
    return s.select("conv_id", F.col("pos").alias("chapter_idx"), "display", T.menu_row(F.col("pos"), F.col("display"), F.col("tokens"), F.col("title")).alias("menu"))


CANONICAL = r"""u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) AS h,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM addresses),
n AS (SELECT *, list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: {'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')),
  'v': CASE WHEN contains(x, '=') THEN url_decode(replace(substring(x, strpos(x, '=') + 1), '+', ' ')) ELSE '' END}) AS pairs FROM u),
k AS (SELECT *, CASE WHEN p = '/' THEN '/' ELSE regexp_replace(p, '/+$', '') END AS path,
  array_to_string(list_transform(list_filter(pairs, lambda x: NOT (starts_with(x.k, 'utm_') OR x.k IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid'))),
    lambda x: replace(url_encode(x.k), '%20', '+') || '=' || replace(url_encode(x.v), '%20', '+')), '&') AS query FROM n),
c AS (SELECT page_id, url, s || '://' || h || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM k)"""


@query(f"""WITH addresses AS (SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN (CASE WHEN contains(url, '#') THEN '' WHEN contains(url, '?') THEN '&UTM_a=%C3%A9+x&b*~' ELSE '?q=a%2Fb&c' END) ELSE '' END AS url FROM pages), {CANONICAL}
SELECT page_id, canonical, substring(sha256(canonical), 1, 16) AS content_id, regexp_matches(url, '^(?i)https?://[^/]+') AS remote FROM c""")
def canonical_urls(spark, sf_dir):
    tail = F.when(F.col("url").contains("#"), "").when(F.col("url").contains("?"), "&UTM_a=%C3%A9+x&b*~").otherwise("?q=a%2Fb&c")
    p = read(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.when(F.col("page_id") % 3 == 0, tail).otherwise("")))
    return p.select("page_id", U.canonical(F.col("url")).alias("canonical"), U.short_id(F.col("url")).alias("content_id"), U.is_address(F.col("url")).alias("remote"))


# Addresses of all kinds, made of the ids and addresses of the pages.
_BYTES = [[0, 8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240], [0, 2, 16, 18, 19, 31, 32, 51, 113, 168, 254], [0, 2, 100, 113]]


def _address():
    n = F.col("page_id")
    pick = lambda k, at: F.element_at(F.array(*map(F.lit, _BYTES[k])), (at % len(_BYTES[k]) + 1).cast("int")).cast("string")
    four = F.concat(F.lit("http://"), F.concat_ws(".", pick(0, n), pick(1, F.floor(n / 3)), pick(2, F.floor(n / 5)), (n % 12).cast("string")), F.lit(":80/x"))
    return F.when(n % 7 == 0, F.col("url")).when(n % 7 == 1, F.concat(F.lit("ftp"), F.col("url"))).when(n % 7 == 2, F.concat(F.lit("HTTP://LocalHost/"), n)).otherwise(four)


@query(f"""WITH a AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN 'ftp' || url WHEN 2 THEN 'HTTP://LocalHost/' || page_id ELSE
  'http://' || ({_BYTES[0]})[page_id % 12 + 1] || '.' || ({_BYTES[1]})[page_id // 3 % 11 + 1] || '.' || ({_BYTES[2]})[page_id // 5 % 4 + 1] || '.' || page_id % 12 || ':80/x' END AS u FROM pages),
h AS (SELECT page_id, u, lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(u, '://([^/:?#]*)', 1)) AS h FROM a),
n AS (SELECT *, CASE WHEN regexp_matches(h, '^[0-9]+([.][0-9]+){{3}}$') THEN split_part(h, '.', 1)::BIGINT * 16777216 + split_part(h, '.', 2)::BIGINT * 65536 + split_part(h, '.', 3)::BIGINT * 256 + split_part(h, '.', 4)::BIGINT END AS ip FROM h)
SELECT page_id, u AS address, CASE WHEN s NOT IN ('http', 'https') THEN 'scheme' WHEN h = '' THEN 'host' WHEN length(u) > 4096 THEN 'too long' WHEN h = 'localhost' THEN 'local'
  WHEN ip // 16777216 IN (0, 10, 127) OR ip // 65536 = 169 * 256 + 254 OR ip // 1048576 = (172 * 256 + 16) // 16 OR (ip // 256 = 192 * 65536 AND ip % 256 NOT IN (9, 10)) OR ip // 256 = 192 * 65536 + 2 OR ip // 65536 = 192 * 256 + 168
    OR ip // 131072 = (198 * 256 + 18) // 2 OR ip // 256 = (198 * 256 + 51) * 256 + 100 OR ip // 256 = 203 * 65536 + 113 OR ip >= 224::BIGINT * 16777216 THEN 'private' END AS refused FROM n""")
def url_guard(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", _address().alias("address"), U.refusal(_address()).alias("refused"))


_FORMS = ["%s", "https://www.youtube.com/watch?t=3&v=%s", "youtu.be/%s?x=1", "https://m.youtube.com/embed/%s", "https://youtube.com/shorts/%s/", "http://www.youtube.com/live/%s", "https://example.org/watch?v=%s",
          "https://youtube.com/watch?v=%sxx", "https://youtube.com/%s", "https://youtube.com/playlist/%s"]


@query(f"""WITH v AS (SELECT page_id, replace(({_FORMS})[page_id % {len(_FORMS)} + 1], '%s', substring(sha256(page_id::VARCHAR), 1, 11)) AS raw FROM pages),
f AS (SELECT page_id, raw, CASE WHEN regexp_matches(raw, '^(?i)https?://') THEN raw ELSE 'https://' || raw END AS u FROM v),
p AS (SELECT page_id, raw, lower(regexp_extract(u, '://([^/:?#]*)', 1)) AS h, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '[?&]v=([^&#]+)', 1) AS q FROM f),
i AS (SELECT page_id, CASE WHEN regexp_full_match(raw, '[A-Za-z0-9_-]{{11}}') THEN raw WHEN h NOT IN ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'music.youtube.com', 'youtu.be', 'www.youtu.be') THEN NULL
  WHEN path = '/watch' AND regexp_full_match(q, '[A-Za-z0-9_-]{{11}}') THEN q ELSE nullif(regexp_extract(path, '^/(?:(?:embed|shorts|live|v)/)?([A-Za-z0-9_-]{{11}})(?:/|$)', 1), '') END AS id FROM p)
SELECT page_id, id AS video, 'https://www.youtube.com/watch?v=' || id AS watch FROM i""")
def video_ids(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("id", F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 11))
    url = F.element_at(F.array(*[F.format_string(f, F.col("id")) for f in _FORMS]), (F.col("page_id") % len(_FORMS) + 1).cast("int"))
    vid = U.video_id(url)
    return p.select("page_id", vid.alias("video"), U.watch_address(vid).alias("watch"))


TITLE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, CASE WHEN {TITLE} = '' THEN 'Untitled Article' ELSE {TITLE} END AS title, CASE WHEN {TITLE} = '' THEN 'default' ELSE 'html' END AS title_source, '' AS author, '' AS upload_date FROM pages")
def article_metadata(spark, sf_dir):
    return article.metadata(read(spark, sf_dir, "pages"), "page_id").select("page_id", "title", "title_source", "author", "upload_date")


# Pages with meta tags and a relative canonical link.
_HEAD = ('<meta property="og:title" content="no"><META name="og:title" content="D%d"><meta name="description" content=" "><meta property="og:description" content=" x%d"><meta name="byl" content="By: Ada  %d">'
         '<meta name="pubdate" content="March %d, 2024"><link href="/feed/%d" rel="alternate"><link rel="x CANONICAL" href="../a/./%d?utm_b=1&amp;k=%d">')  # fmt: skip


@query(f"""WITH m AS (SELECT page_id, regexp_extract(url, '^([^/]*//[^/?#]*)', 1) AS site, regexp_extract(url, '^[^/]*//[^/?#]*(/[^?#]*)?', 1) AS path,
  replace(replace('{_HEAD}', 'March %d', 'March ' || (1 + page_id % 9)), '%d', page_id::VARCHAR) AS html FROM pages),
addresses AS (SELECT page_id, site || list_reduce(list_prepend('', list_slice(string_split(regexp_replace(coalesce(path, '/'), '[^/]*$', ''), '/'), 2, -3)), lambda a, b: a || '/' || b) || '/a/' || page_id || '?utm_b=1&k=' || page_id AS url FROM m),
{CANONICAL}
SELECT page_id, canonical AS url, substring(sha256(canonical), 1, 16) AS content_id, regexp_extract(html, 'name="og:title" content="([^"]*)"', 1) AS title, 'meta' AS title_source, trim(regexp_extract(html, 'og:description" content="([^"]*)"', 1)) AS description,
  regexp_replace(regexp_extract(html, 'byl" content="By: ([^"]*)"', 1), ' +', ' ', 'g') AS author, strftime(strptime(regexp_extract(html, 'pubdate" content="([^"]*)"', 1), '%B %-d, %Y'), '%Y-%m-%dT00:00:00') AS upload_date FROM m JOIN c USING (page_id)""")
def article_meta_tags(spark, sf_dir):
    n = F.col("page_id")
    head = F.format_string(_HEAD, n, n, n, 1 + n % 9, n, n, n)
    return article.metadata(read(spark, sf_dir, "pages").select("page_id", "url", head.alias("html")), "page_id").select("page_id", "url", "content_id", "title", "title_source", "description", "author", "upload_date")


WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+|[^\s\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_PLAIN = "replace(replace(replace(replace(replace(replace(replace({}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"


ARTICLES = rf"""a AS (SELECT page_id, regexp_extract(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<article[^>]*>(.*?)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, regexp_extract(a, '(?is)<h1[^>]*>\s*(.*?)\s*</h1>', 1) AS h, regexp_replace(regexp_replace(a, '(?is)<h1[^>]*>.*?</h1>', '', 'g'), '(?is)<b\b[^>]*>(.*?)</b>', '**\1**', 'g') AS c FROM a),
t AS (SELECT page_id, {_PLAIN.format("regexp_replace(h, '<[^>]*>', '', 'g')")} AS heading,
  {_PLAIN.format(r"regexp_replace(regexp_replace(regexp_replace(c, '(?is)<br\s*/?>', chr(10), 'g'), '(?is)</?(?:p|ul|ol|table|tr|blockquote|div|section)\b[^>]*>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g')")} AS c FROM b),
n AS (SELECT page_id, trim(heading) AS heading, trim(regexp_replace(regexp_replace(c, '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS content FROM t)"""


@query(rf"""WITH {ARTICLES}
SELECT page_id, 1 AS pos, 0 AS chapter_idx, heading, 1 AS level, content, '# ' || heading AS title, '00:00:00' AS display, len(regexp_extract_all('# ' || heading || ' ' || content, '{WORD}'))::BIGINT AS tokens FROM n WHERE content <> ''""")
def article_sections(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", article.as_markdown(F.col("html")).alias("md"))
    s = article.with_chapters(article.markdown_sections(p, ["page_id"], "md"), ["page_id"])
    return s.select("page_id", "pos", "chapter_idx", "heading", "level", "content", "title", "display", "tokens")


# What each page's article gets at its end, and how it reads as markdown; boilerplate and lists of links go.
_TAIL = """<h2>Lists &#38; &#x74;ables</h2><ul><li>one <a href="/a?x=1&amp;y=%d">link %d</a></li><li><p>two</p><ol start="3"><li>three<li>four</ol>tail</li></ul><table><tr><th>k</th><th>v|w</th></tr><tr><td>%d</td><td><p>x</p><p><b>y</b></p></td></tr></table><blockquote><p>quoted <em>%d</em></p></blockquote><pre>a  &lt; b
  c</pre><div class="share box"><p>share</p><div>inner</div></div><div><a href="/1">more</a> <a href="/2">links</a></div><nav>up</nav><p>last <code>x_y</code><br>line</p>"""
_TAIL_TEXT = """## Lists & tables

- one [link %d](/a?x=1&y=%d)
- two
    3. three
    4. four

    tail

| k | v\\|w |
| --- | --- |
| %d | x **y** |

> quoted *%d*

```
a  < b
  c
```

last `x_y`
line
"""


@query(f"""WITH {ARTICLES}, ps AS (SELECT page_id, heading, unnest(string_split(content, chr(10) || chr(10))) AS p, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS i FROM n),
pk AS (SELECT *, row_number() OVER (PARTITION BY page_id, p ORDER BY i) AS times FROM ps),
pd AS (SELECT page_id, heading, coalesce(string_agg(p, chr(10) || chr(10) ORDER BY i) FILTER (length(p) < 100 OR times <= 2), '') AS content FROM pk GROUP BY ALL)
SELECT page_id, '# ' || heading || chr(10) || chr(10) || CASE WHEN content <> '' THEN content || chr(10) || chr(10) ELSE '' END || replace('{_TAIL_TEXT}', '%d', page_id::VARCHAR) AS markdown, NULL::VARCHAR AS problem, false AS short FROM pd""")
def page_articles(spark, sf_dir):
    tail = F.replace(F.lit(_TAIL + "</article>"), F.lit("%d"), F.col("page_id").cast("string"))
    return html.articles(read(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("</article>"), tail).alias("html")), ["page_id"], "html")


# Tags of pages as opening and closing tokens; elements that HTML leaves open are not among them, but some bodies are cut off.
_PAIRED = "html|head|title|style|script|body|nav|ul|li|a|div|article|h1|footer"
TAGS = f"""t AS (SELECT page_id, unnest(regexp_extract_all(html, '</?(?:{_PAIRED})\\b[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '</?(?:{_PAIRED})\\b[^>]*>'), 1)::INT AS pos FROM pages),
k AS (SELECT page_id, pos, regexp_extract(tag, '\\w+') AS name, starts_with(tag, '</') AS closes FROM t),
d AS (SELECT *, (sum(CASE WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) - CASE WHEN closes THEN 0 ELSE 1 END)::INT AS depth FROM k)"""


def _tags(spark, sf_dir):
    tags = F.regexp_extract_all("html", F.lit(rf"</?(?:{_PAIRED})\b[^>]*>"), 0)
    t = read(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("at", "tag"))
    kind = F.concat(F.regexp_extract("tag", r"\w+", 0), F.when(F.col("tag").startswith("</"), "_close").otherwise("_open"))
    return t.select("page_id", (F.col("at") + 1).alias("pos"), kind.alias("type"))


@query(f"""WITH {TAGS} SELECT a.page_id, a.pos AS open_pos, b.pos AS close_pos, a.name, a.depth FROM d a JOIN d b ON a.page_id = b.page_id AND a.depth = b.depth AND a.name = b.name AND NOT a.closes AND b.closes AND b.pos > a.pos
  WHERE NOT EXISTS (SELECT 1 FROM d c WHERE c.page_id = a.page_id AND c.depth = a.depth AND c.pos > a.pos AND c.pos < b.pos)""")
def token_pairs(spark, sf_dir):
    return nesting.pairs(_tags(spark, sf_dir), ["page_id"]).withColumn("depth", F.col("depth").cast("int"))


@query(f"""WITH {TAGS}, x AS (SELECT *, lag(name) OVER w AS b_name, lead(pos) OVER w AS after FROM d WINDOW w AS (PARTITION BY page_id, depth ORDER BY pos)),
p AS (SELECT page_id, pos, name, b_name, CASE WHEN closes AND depth < 0 THEN 'closed' WHEN closes AND b_name IS DISTINCT FROM name THEN 'crossed' WHEN NOT closes AND after IS NULL THEN 'unclosed' END AS problem FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY problem = 'unclosed', CASE WHEN problem = 'unclosed' THEN -pos ELSE pos END) AS n FROM p WHERE problem IS NOT NULL)
SELECT page_id, problem, pos, CASE problem WHEN 'unclosed' THEN name || '_close' WHEN 'crossed' THEN b_name || '_close' END AS expected, CASE WHEN problem <> 'unclosed' THEN name || '_close' END AS found FROM r WHERE n = 1""")
def token_problems(spark, sf_dir):
    return nesting.problems(_tags(spark, sf_dir), ["page_id"])


# Markdown of each turn, with words in place of %c (the text), %r (the role) and %t (the turn), and the same normalized.
_WILD = """%r *first*
===

* %c
  lazy __%r__
* two
    1) %c
    2) b

       more
  ~~~py
  # %c

  ~~~
* * *
> %c
tail
> - in %t

| %r | n |
|:-:|--|
| %c | %t |
| a \\| b |

7. seven
7. %c
## ##
\tcode %c
"""
_TAME = """* %c
  lazy **%r**
* two

  1) %c
  2) b

     more

  ~~~py
  # %c
  ~~~

***

> %c
> tail
>
> - in %t

| %r | n |
| :---: | --- |
| %c | %t |
| a \\| b |  |

7. seven
8. %c"""
_WILD_INLINE = "_%c_ **%r *x*** ``%c`` [%r](<a b.md> 't') ![%c](i.png) \\*%t\\* ~~%c~~  \nnext &lt;%r&gt; <u>%c</u> <http://e.org/%t> [%t] *open"
_TAME_INLINE = "*%c* **%r *x*** `%c` [%r](a%20b.md) ![%c](i.png) *%t* ~~%c~~  \nnext <%r> <u>%c</u> [http://e.org/%t](http://e.org/%t) [%t] *open"


def _filled(template: str) -> str:
    """SQL for a template, with the words of columns c, role and turn."""
    return f"replace(replace(replace('{template.replace(chr(39), chr(39) * 2)}', '%c', c), '%r', role), '%t', turn::VARCHAR)"


_WORDS = "w AS (SELECT conv_id, turn, role, coalesce(nullif(trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ''), 'none') AS c FROM conversations)"


def _templated(spark, sf_dir, template):
    words = F.coalesce(F.nullif(F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")), F.lit("")), F.lit("none"))
    md = F.lit(template)
    for mark, value in (("%c", words), ("%r", F.col("role")), ("%t", F.col("turn").cast("string"))):
        md = F.replace(md, F.lit(mark), value)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", md.alias("md"))


@query(f"""WITH {_WORDS} SELECT conv_id, turn, 1 AS pos, 1 AS level, role || ' *first*' AS heading, {_filled(_TAME)} AS content FROM w
UNION ALL SELECT conv_id, turn, 2, 2, 'Untitled Section 2', 'code ' || c FROM w""")
def markdown_blocks(spark, sf_dir):
    return blocks.sections(_templated(spark, sf_dir, _WILD), ["conv_id", "turn"], "md").select("conv_id", "turn", "pos", "level", "heading", "content")


@query(f"WITH {_WORDS} SELECT conv_id, turn, {_filled(_TAME_INLINE)} AS text, NULL::VARCHAR AS problem FROM w")
def inline_markup(spark, sf_dir):
    return blocks.inline_text(blocks.inline_tokens(_templated(spark, sf_dir, _WILD_INLINE), ["conv_id", "turn"], "md"), ["conv_id", "turn"])


# A markdown file of each conversation: headings of levels 1 to 3, text below.
def _files(spark, sf_dir):
    block = F.concat(F.repeat(F.lit("#"), (1 + (F.col("turn") * 2) % 3).cast("int")), F.lit(" "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.col("text"))
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("md"))


SECTIONS = r"""s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS pos, (1 + (turn * 2) % 3)::INT AS level, role || ' ' || turn AS heading, trim(text, ' ' || chr(10) || chr(9)) AS content FROM conversations),
up AS (SELECT a.conv_id, a.pos, coalesce(max(b.pos), 0)::INT AS parent_pos FROM s a LEFT JOIN s b ON b.conv_id = a.conv_id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL)"""


@query(f"WITH {SECTIONS} SELECT conv_id, pos, level, heading, content, parent_pos FROM s JOIN up USING (conv_id, pos)")
def markdown_tree(spark, sf_dir):
    return tree.with_parents(tree.heading_sections(_files(spark, sf_dir), ["conv_id"], "md"), ["conv_id"]).drop("path")


def _nodes(spark, sf_dir):
    """Topics of the files and a leaf below each."""
    s = tree.heading_sections(_files(spark, sf_dir), ["conv_id"], "md")
    topic = s.select("conv_id", (F.col("pos") * 2).alias("node_pos"), (F.col("level") - 1).alias("depth"), F.lit("topic").alias("kind"), F.col("heading").alias("name"), F.lit("").alias("content"))
    leaf = s.select("conv_id", (F.col("pos") * 2 + 1).alias("node_pos"), F.col("level").alias("depth"), F.lit("content").alias("kind"), F.lit("").alias("name"), "content")
    return topic.unionByName(leaf)


@query(f"""WITH {SECTIONS} SELECT conv_id, '# Talk ' || conv_id || chr(10) || chr(10) || string_agg(repeat('#', level + 1) || ' ' || heading || CASE WHEN content = '' THEN '' ELSE chr(10) || chr(10) || content END, chr(10) || chr(10) ORDER BY pos) || chr(10) AS document FROM s GROUP BY conv_id""")
def rendered_documents(spark, sf_dir):
    n = _nodes(spark, sf_dir).withColumn("title", F.concat(F.lit("Talk "), F.col("conv_id").cast("string")))
    return tree.render(n, ["conv_id"], "title")


@query(f"""WITH {SECTIONS}, toc AS (SELECT conv_id, string_agg(repeat('  ', level - 1) || '- ' || heading, chr(10) ORDER BY pos) AS toc FROM s GROUP BY conv_id)
SELECT conv_id, '# Talk ' || conv_id || chr(10) || chr(10) || '## Metadata' || chr(10) || chr(10) || '- **Content ID:** `c' || conv_id || '`' || chr(10) || '- **Author:** Unknown' || chr(10) || '- **Upload Date:** 2024-01-01' || chr(10)
 || '- **Source:** https://talks.example/' || conv_id || chr(10) || chr(10) || '## Generated Notes' || chr(10) || chr(10) || '- [📘 Full Structured Notes](content.md)' || chr(10) || '- [📝 Summary Notes](summary.md)' || chr(10) || chr(10)
 || '## Table of Contents' || chr(10) || chr(10) || toc || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*This document was automatically generated by notes-engine on now*' || chr(10) AS readme FROM toc""")
def rendered_readme(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    meta = n.select("conv_id").distinct().select("conv_id", F.concat(F.lit("Talk "), F.col("conv_id").cast("string")).alias("title"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("content_id"), F.lit("").alias("author"), F.lit("2024-01-01").alias("upload_date"), F.concat(F.lit("https://talks.example/"), F.col("conv_id").cast("string")).alias("url"))
    return tree.readme(meta, tree.contents(n, ["conv_id"]), ["conv_id"], F.lit("now"))


@query(r"""WITH f AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN '> q' || chr(10) || chr(10) || '**Author:** Ada ' || conv_id || chr(10) || '  last updated: 2024-05-0' || (1 + conv_id % 9) || chr(10) || chr(10)
  WHEN 1 THEN 'by Eve' || chr(10) || '**Author:** Ada' || chr(10) || '**Date:** 2024-05-0' || (1 + conv_id % 9) || chr(10) || 'Published on: 2020-01-01' || chr(10) || chr(10) ELSE '**Author**: Ada' || chr(10) || 'Dates: never' || chr(10) || chr(10) END
  || string_agg(repeat('#', (1 + (turn * 2) % 3)::INT) || ' ' || role || ' ' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS raw FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, coalesce(nullif(regexp_extract(raw, '(?m)^\s*#\s+(.+?)\s*$', 1), ''), 'talk' || conv_id) AS title, list_transform(string_split(raw, chr(10)), lambda x: trim(x)) AS lines FROM f)
SELECT conv_id, sha256('notes/talk' || conv_id || '.md::' || title) AS content_id, title,
  coalesce(list_filter(list_transform(lines, lambda x: regexp_extract(x, '(?i)^(?:\*\*Author:\*\*\s*|Author:\s*|By\s+)(.+)$', 1)), lambda x: x <> '')[1], '') AS author,
  coalesce(list_filter(list_transform(lines, lambda x: regexp_extract(x, '(?i)^(?:\*\*Date:\*\*|Date:|Published:|Published on:|Last updated:|Updated:)\s*(.+)$', 1)), lambda x: x <> '')[1], '') AS upload_date FROM l""")
def markdown_metadata(spark, sf_dir):
    day = (1 + F.col("conv_id") % 9).cast("string")
    head = (
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("> q\n\n**Author:** Ada "), F.col("conv_id").cast("string"), F.lit("\n  last updated: 2024-05-0"), day, F.lit("\n\n")))
        .when(F.col("conv_id") % 3 == 1, F.concat(F.lit("by Eve\n**Author:** Ada\n**Date:** 2024-05-0"), day, F.lit("\nPublished on: 2020-01-01\n\n")))
        .otherwise(F.lit("**Author**: Ada\nDates: never\n\n"))
    )
    f = _files(spark, sf_dir).select("conv_id", F.format_string("notes/talk%d.md", "conv_id").alias("path"), F.concat(head, F.col("md")).alias("raw_content"))
    m = markdown.metadata(f)
    return m.select(F.regexp_extract("path", r"talk(\d+)", 1).cast("long").alias("conv_id"), "content_id", "title", "author", "upload_date")


@query("""WITH t AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, (2 * n)::BIGINT AS nodes, n::BIGINT AS leaves, (n * (n + 1) // 2)::BIGINT AS point_sum FROM t""")
def hierarchy_nodes(spark, sf_dir):
    n = read(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    kids = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("name"), i.alias("start_point"), i.alias("end_point"), F.array(F.struct(F.lit("leaf").alias("name"), i.alias("start_point"), i.alias("end_point"))).alias("children")))
    t = tree.topic_nodes(n.select("conv_id", F.to_json(F.struct(kids.alias("hierarchy"))).alias("doc")), ["conv_id"], "doc")
    return t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("is_content").alias("leaves"), F.sum(F.when(F.col("is_content"), F.col("end_point"))).cast("long").alias("point_sum"))


@query("""SELECT a.conv_id, a.turn::BIGINT AS node_pos, false AS mismatch FROM conversations a WHERE turn % 5 <> 4 UNION ALL
SELECT conv_id, turn::BIGINT, true FROM conversations WHERE turn % 5 = 4""")
def zipped_trees(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("node_pos"), F.lit("topic").alias("kind"), F.col("role").alias("name"))
    ids = c.where("node_pos % 5 != 4").select("conv_id", "node_pos", "kind", T.node_uuid(F.col("conv_id"), F.col("node_pos")).alias("node_id"))
    return tree.zip_trees(c, ids, ["conv_id"]).select("conv_id", "node_pos", "mismatch")


@query("""SELECT conv_id, (turn // 2)::VARCHAR AS node_id, count(*)::BIGINT AS times FROM conversations GROUP BY conv_id, turn // 2 HAVING count(*) > 1""")
def repeated_part_ids(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).cast("string").alias("node_id"), "turn")
    return tree.repeated_ids([c.where("turn % 2 = 0").drop("turn"), c.where("turn % 2 = 1").drop("turn")], ["conv_id"])


# Events as a log of calls.
def _calls(spark, sf_dir):
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("node_name"), F.concat(F.lit("op"), (F.col("user_id") % 3).cast("string")).alias("operation_name"),
        F.when(F.col("event_id") % 2 == 0, "OpenAI").otherwise("nvidia").alias("provider"), F.when(F.col("event_id") % 5 == 0, "other").otherwise("GPT-mini").alias("model"),
        F.col("value").alias("duration_ms"), tokens.alias("input_tokens"), (tokens % 7).alias("output_tokens"), (tokens + tokens % 7).alias("total_tokens"), (F.col("event_type") != "error").alias("success"))
    prices = spark.createDataFrame([("openai", "gpt-mini", 0.25, 2.0), ("nvidia", "GPT-MINI", 0.5, 1.0)], "provider string, model string, in_per_1k double, out_per_1k double")
    return usage.costs(e, prices)


CALLS = """c AS (SELECT event_type AS node_name, 'op' || (user_id % 3) AS operation_name, CASE WHEN event_id % 2 = 0 THEN 'OpenAI' ELSE 'nvidia' END AS provider,
  CASE WHEN event_id % 5 = 0 THEN 'other' ELSE 'GPT-mini' END AS model, value AS duration_ms, coalesce((props->>'$.k')::BIGINT, 0) AS i, event_type <> 'error' AS success, event_id FROM events),
k AS (SELECT *, i % 7 AS o, CASE WHEN model = 'other' THEN NULL WHEN provider = 'OpenAI' THEN round(i / 1000.0 * 0.25 + (i % 7) / 1000.0 * 2.0, 8) ELSE round(i / 1000.0 * 0.5 + (i % 7) / 1000.0 * 1.0, 8) END AS cost FROM c),
u AS (SELECT CASE WHEN grouping(node_name) = 0 THEN 'node_name' WHEN grouping(operation_name) = 0 THEN 'operation_name' WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(model) = 0 THEN 'model' ELSE 'all' END AS dimension,
  coalesce(node_name, operation_name, provider, model) AS value, count(*)::BIGINT AS calls, count(*) FILTER (WHERE success)::BIGINT AS ok, count(*) FILTER (WHERE NOT success)::BIGINT AS failed,
  sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(i + o)::BIGINT AS total_tokens, sum(cost) AS cost, sum(duration_ms) AS duration_ms
  FROM k GROUP BY GROUPING SETS ((node_name), (operation_name), (provider), (model), ()))"""


@query(f"WITH {CALLS} SELECT dimension, value, calls, ok, failed, input_tokens, output_tokens, total_tokens, round(cost, 2) AS cost, round(duration_ms, 1) AS duration_ms FROM u")
def usage_summary(spark, sf_dir):
    s = usage.summary(_calls(spark, sf_dir))
    return s.withColumn("cost", F.round("cost", 2)).withColumn("duration_ms", F.round("duration_ms", 1))


# Each user is a run with a report of its own.
REPORT = """c AS (SELECT user_id, event_id, event_type AS node_name, 'op' || (user_id % 3) AS operation_name, CASE WHEN event_id % 2 = 0 THEN 'OpenAI' ELSE 'nvidia' END AS provider,
  CASE WHEN event_id % 5 = 0 THEN 'other' ELSE 'GPT-mini' END AS model, round(value, 0) AS ms, coalesce((props->>'$.k')::BIGINT, 0) AS i, event_type <> 'error' AS success FROM events),
k AS (SELECT *, i % 7 AS o, CASE WHEN model = 'other' THEN NULL ELSE i * 0.5 END AS cost FROM c),
u AS (SELECT user_id, CASE WHEN grouping(node_name) = 0 THEN 'Node' WHEN grouping(operation_name) = 0 THEN 'Operation' WHEN grouping(provider) = 0 THEN 'Provider' WHEN grouping(model) = 0 THEN 'Model' ELSE 'all' END AS dimension,
  coalesce(node_name, operation_name, provider, model) AS value, count(*) AS calls, count(*) FILTER (WHERE success) AS ok, count(*) FILTER (WHERE NOT success) AS failed, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o, sum(i + o)::BIGINT AS t,
  CASE WHEN sum(cost) IS NULL THEN 'N/A' ELSE '$' || printf('%.6f', sum(cost)) END AS cost, sum(ms) AS ms
  FROM k GROUP BY GROUPING SETS ((user_id, node_name), (user_id, operation_name), (user_id, provider), (user_id, model), (user_id)))"""


def _run_calls(spark, sf_dir):
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    model = F.when(F.col("event_id") % 5 == 0, "other").otherwise("GPT-mini")
    return read(spark, sf_dir, "events").select(
        "user_id", "event_id", F.col("event_type").alias("node_name"), F.concat(F.lit("op"), (F.col("user_id") % 3).cast("string")).alias("operation_name"), F.when(F.col("event_id") % 2 == 0, "OpenAI").otherwise("nvidia").alias("provider"),
        model.alias("model"), F.round("value", 0).alias("duration_ms"), tokens.alias("input_tokens"), (tokens % 7).alias("output_tokens"), (tokens + tokens % 7).alias("total_tokens"),
        F.when(model != "other", tokens * 0.5).alias("estimated_cost"), (F.col("event_type") != "error").alias("success"), F.when(F.col("event_type") == "error", "Lost").alias("exception_type"))


_TABLES = "".join(f""" || '## Per-{d} Breakdown' || chr(10) || chr(10) || '| {d} | Calls | Success | Failed | Input Tokens | Output Tokens | Total Tokens | Cost | Duration (ms) |' || chr(10) || '|---|---|---|---|---|---|---|---|---|' || chr(10)
  || (SELECT string_agg('| ' || value || ' | ' || calls || ' | ' || ok || ' | ' || failed || ' | ' || format('{{:,}}', i) || ' | ' || format('{{:,}}', o) || ' | ' || format('{{:,}}', t) || ' | ' || cost || ' | ' || format('{{:,.1f}}', ms) || ' |', chr(10) ORDER BY value)
      FROM u WHERE dimension = '{d}' AND u.user_id = a.user_id) || chr(10) || chr(10)""" for d in ("Node", "Operation", "Provider", "Model"))


@query(f"""WITH {REPORT}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM k)
SELECT user_id, '# LLM Usage Report' || chr(10) || chr(10) || '_Generated at now_' || chr(10) || chr(10) || '## Pipeline Summary' || chr(10) || chr(10) || '| Metric | Value |' || chr(10) || '|---|---|' || chr(10) || '| Total Calls | ' || calls || ' |' || chr(10)
  || '| Successful Calls | ' || ok || ' |' || chr(10) || '| Failed Calls | ' || failed || ' |' || chr(10) || '| Total Input Tokens | ' || format('{{:,}}', i) || ' |' || chr(10) || '| Total Output Tokens | ' || format('{{:,}}', o) || ' |' || chr(10)
  || '| Total Tokens | ' || format('{{:,}}', t) || ' |' || chr(10) || '| Estimated Total Cost | ' || cost || ' |' || chr(10) || '| Total Duration | ' || format('{{:,.1f}}', ms) || ' ms |' || chr(10) || chr(10) {_TABLES}
  || '## Individual Calls' || chr(10) || chr(10) || '| # | Node | Operation | Provider | Model | Input | Output | Tokens | Cost | Duration (ms) | Status |' || chr(10) || '|---|---|---|---|---|---|---|---|---|---|---|' || chr(10)
  || (SELECT string_agg('| ' || pos || ' | ' || node_name || ' | ' || operation_name || ' | ' || provider || ' | `' || model || '` | ' || coalesce(nullif(n.i, 0)::VARCHAR, 'N/A') || ' | ' || coalesce(nullif(n.o, 0)::VARCHAR, 'N/A') || ' | '
       || coalesce(nullif(n.i + n.o, 0)::VARCHAR, 'N/A') || ' | ' || CASE WHEN n.cost IS NULL THEN 'N/A' ELSE '$' || printf('%.6f', n.cost) END || ' | ' || printf('%.1f', n.ms) || ' | ' || CASE WHEN success THEN '✅' ELSE '❌ `Lost`' END || ' |', chr(10) ORDER BY pos)
      FROM n WHERE n.user_id = a.user_id) || chr(10) AS report FROM u a WHERE dimension = 'all'""")
def usage_report(spark, sf_dir):
    return usage.report(_run_calls(spark, sf_dir), ["user_id"], F.lit("now"), order="event_id")


@query(f"""WITH {REPORT} SELECT a.user_id, calls::BIGINT AS total_calls, failed::BIGINT AS failed_calls, t AS total_tokens, (SELECT max(calls) FROM u n WHERE n.user_id = a.user_id AND n.dimension = 'Node')::BIGINT AS most_of_a_node,
  (SELECT count(*) FROM u n WHERE n.user_id = a.user_id AND n.dimension = 'Model')::BIGINT AS models, (SELECT min(event_id) FROM k WHERE k.user_id = a.user_id)::BIGINT AS first_call FROM u a WHERE dimension = 'all'""")
def usage_json_report(spark, sf_dir):
    r = usage.json_report(_run_calls(spark, sf_dir), ["user_id"], order="event_id")
    per = "map<string, struct<calls: bigint, successful: bigint, failed: bigint, total_tokens: bigint, estimated_cost: double>>"
    x = F.from_json("report", f"struct<calls: array<struct<event_id: bigint>>, summary: struct<total_calls: bigint, failed_calls: bigint, total_tokens: bigint>, per_node: {per}, per_model: {per}>")
    return r.select("user_id", x.alias("x")).select("user_id", "x.summary.total_calls", "x.summary.failed_calls", "x.summary.total_tokens",
        F.array_max(F.transform(F.map_values("x.per_node"), lambda v: v["calls"])).alias("most_of_a_node"), F.size("x.per_model").cast("long").alias("models"), F.col("x.calls")[0]["event_id"].alias("first_call"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN '⟳ stage' WHEN 'view' THEN '✓ stage' WHEN 'error' THEN '✗ stage' || chr(10) || '    ' || event_type ELSE
  CASE WHEN event_id % 3 = 0 THEN '    ' || event_type ELSE rpad('    ' || event_type || '  (' || event_id || ' / 9)', 48, ' ') END END AS line FROM events""")
def progress_lines(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "click", "started").when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return e.select("event_id", usage.progress_line(status, F.lit("stage"), F.col("event_type"), F.when(F.col("event_id") % 3 != 0, F.col("event_id")), F.lit(9)).alias("line"))


BATCHES = f"""{POINTS}, w AS (SELECT doc_id, point_no, point, length(point)::BIGINT AS weight FROM p),
c AS (SELECT *, coalesce(sum(weight) OVER (PARTITION BY doc_id ORDER BY point_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev, sum(weight) OVER (PARTITION BY doc_id) AS tot FROM w),
n AS (SELECT doc_id, point_no, (CASE WHEN tot = 0 THEN 3 ELSE least(3, prev * 3 // tot + 1) END)::INT AS batch_no FROM c),
bt AS (SELECT doc_id, point_no, doc_id || '/' || batch_no AS batch_id, 'N' || row_number() OVER (PARTITION BY doc_id, batch_no ORDER BY point_no) AS temp_id FROM n)"""


def _batched(spark, sf_dir):
    p = order.numbered_points(_bullets(spark, sf_dir), ["doc_id"]).select("doc_id", F.col("point_no").alias("ord"), F.length("point").alias("weight"), "point")
    return batching.batches(p, ["doc_id"], "weight", 3)


@query(f"WITH {BATCHES} SELECT doc_id, point_no AS ord, batch_id, temp_id FROM bt")
def model_batches(spark, sf_dir):
    return _batched(spark, sf_dir).select("doc_id", "ord", "batch_id", "temp_id")


# Answers to the batches: some items are lost, some twice, some under another id.
def _answers(spark, sf_dir):
    b = _named(spark, sf_dir)
    return b, b.where("back").select("batch_id", F.col("name").alias("temp_id"))


def _named(spark, sf_dir):
    """Batches with the name under which each id comes back, if it does."""
    name = F.when((F.col("doc_id") % 4 == 3) & (F.col("temp_id") == "N1"), "N99").when((F.col("doc_id") % 4 == 2) & (F.col("temp_id") == "N2"), "N1").otherwise(F.col("temp_id"))
    return _batched(spark, sf_dir).withColumns({"name": name, "back": ~((F.col("doc_id") % 4 == 1) & (F.col("temp_id") == "N1"))})


ANSWERS = f"""{BATCHES}, rt AS (SELECT batch_id, CASE WHEN doc_id % 4 = 3 AND temp_id = 'N1' THEN 'N99' WHEN doc_id % 4 = 2 AND temp_id = 'N2' THEN 'N1' ELSE temp_id END AS temp_id FROM bt WHERE NOT (doc_id % 4 = 1 AND temp_id = 'N1'))"""


@query(f"""WITH {ANSWERS}, e AS (SELECT batch_id, count(*) AS n FROM bt GROUP BY 1), r AS (SELECT batch_id, count(*) AS n, count(DISTINCT temp_id) AS d FROM rt GROUP BY 1),
x AS (SELECT DISTINCT batch_id FROM ((SELECT batch_id, temp_id FROM bt EXCEPT SELECT batch_id, temp_id FROM rt) UNION ALL (SELECT batch_id, temp_id FROM rt EXCEPT SELECT batch_id, temp_id FROM bt)))
SELECT e.batch_id, e.n::BIGINT AS n_expected, coalesce(r.n, 0)::BIGINT AS n_returned, CASE WHEN e.n <> coalesce(r.n, 0) THEN 'count' WHEN r.n <> r.d THEN 'duplicate' WHEN x.batch_id IS NOT NULL THEN 'incorrect_ids' ELSE 'ok' END AS status
FROM e LEFT JOIN r USING (batch_id) LEFT JOIN x USING (batch_id)""")
def batch_validation(spark, sf_dir):
    side = lambda name, e, r: F.struct(F.col(name).alias("temp_id"), F.lit(e).alias("expected"), F.when(F.col("back"), r).otherwise(0).alias("returned"))
    return batching.tallied(_named(spark, sf_dir).select("batch_id", F.inline(F.array(side("temp_id", 1, 0), side("name", 0, 1)))))


@query(f"""WITH {ANSWERS} SELECT batch_id, temp_id, 'missing' AS side FROM (SELECT batch_id, temp_id FROM bt EXCEPT SELECT batch_id, temp_id FROM rt) UNION ALL
SELECT batch_id, temp_id, 'unexpected' FROM (SELECT batch_id, temp_id FROM rt EXCEPT SELECT batch_id, temp_id FROM bt)""")
def batch_id_differences(spark, sf_dir):
    return batching.missing_and_unexpected(*_answers(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, text, length(text) AS n, greatest(1, ceil(n_chars / 900.0))::INT AS k FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, text, n, least(k, n) AS k, ceil(n / least(k, n)::DOUBLE)::INT AS step FROM d), e AS (SELECT *, unnest(range(k)) AS i FROM c)
SELECT doc_id, i::INT AS chunk, substring(text, greatest(0, i * step - 100) + 1, least(n, (i + 1) * step) - greatest(0, i * step - 100)) AS content FROM e WHERE least(n, (i + 1) * step) > greatest(0, i * step - 100)""")
def overlapping_chunks(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", T.chunk_count(F.col("n_chars"), 900).alias("n"))
    return order.chunks(d, ["doc_id"], F.col("text"), "n", overlap=100)


@query("""SELECT doc_id, greatest(1, ceil((n_chars + 5 * 60) / 8000.0))::BIGINT AS content_batches, greatest(1, ceil((n_chars + 5 * 50) / 5000.0))::BIGINT AS summary_batches FROM documents""")
def batch_budgets(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", batching.batch_count(F.col("n_chars"), F.lit(5), 8000, 60).alias("content_batches"), batching.batch_count(F.col("n_chars"), F.lit(5), 5000, 50).alias("summary_batches"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unfinished_sources(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH t AS (SELECT page_id, url, CASE page_id % 7 WHEN 0 THEN 'youtube' WHEN 1 THEN 'article' WHEN 2 THEN 'markdown' WHEN 3 THEN 'documentation' WHEN 4 THEN 'book' WHEN 5 THEN 'presentation' ELSE 'radio' END AS kind FROM pages)
SELECT page_id, CASE WHEN kind = 'radio' THEN 'rejected' WHEN kind IN ('documentation', 'book', 'presentation') THEN 'unsupported' ELSE kind END AS branch, CASE WHEN kind = 'radio' THEN NULL ELSE 'out/' || kind END AS base_dir FROM t""")
def routed_sources(spark, sf_dir):
    from .plans import routing

    kinds = F.array(*map(F.lit, ["YouTube", " article", "markdown", "documentation", "book", "presentation", "radio"]))
    s = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source"), F.element_at(kinds, (F.col("page_id") % 7 + 1).cast("int")).alias("source_type"))
    return routing.routed(s, "out").select("page_id", "branch", "base_dir")


@query("""SELECT c_custkey, c_name AS author, substring(strftime(DATE '2020-01-01' + (c_custkey % 400)::INT, '%Y%m%d'), 1, 4) || '-' || strftime(DATE '2020-01-01' + (c_custkey % 400)::INT, '%m-%d') AS day,
 strftime(DATE '2020-01-01' + (c_custkey % 400)::INT, '%Y-%m-%d') || 'T00:00:00' AS parsed, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE c_mktsegment END AS segment FROM customer""")
def cleaned_fields(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("d", F.expr("date_add(date'2020-01-01', cast(c_custkey % 400 as int))"))
    return c.select("c_custkey", T.author_name(F.concat(F.lit(" BY - "), F.col("c_name"))).alias("author"), T.compact_date(F.date_format("d", "yyyyMMdd")).alias("day"),
                    T.iso_date(F.date_format("d", "MMMM d, yyyy")).alias("parsed"), T.or_default(F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")), "Unknown").alias("segment"))


@query(f"""WITH {SEGMENTS}, w AS (SELECT conv_id, chapter_idx, p, k FROM (SELECT conv_id, chapter_idx, unnest(list_filter(string_split(transcript, '. '), lambda x: trim(x) <> '')) AS p, generate_subscripts(list_filter(string_split(transcript, '. '), lambda x: trim(x) <> ''), 1) AS k FROM seg)),
l AS (SELECT conv_id, chapter_idx, string_agg(k || '. ' || trim(regexp_replace(regexp_replace(p, '[ ]*\\n[ \\n]*', ' ', 'g'), '[ ]+', ' ', 'g')), chr(10) ORDER BY k) AS body FROM w GROUP BY ALL)
SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## Chapter ' || (c.chapter_idx + 1) || CASE WHEN body IS NULL THEN '' ELSE chr(10) || chr(10) || body END, chr(10) || chr(10) ORDER BY c.chapter_idx) || chr(10) AS document
FROM c LEFT JOIN l USING (conv_id, chapter_idx) GROUP BY conv_id""")
def full_pipeline(spark, sf_dir):
    from .plans import notes

    return notes.from_conversations(read(spark, sf_dir, "conversations"))


@query("""SELECT event_id, nullif(CASE event_id % 3 WHEN 0 THEN k ELSE k + 1 END, 0)::BIGINT AS input_tokens, nullif(k % 3, 0)::BIGINT AS output_tokens
FROM (SELECT event_id, coalesce((props->>'$.k')::BIGINT, 0) AS k FROM events)""")
def response_tokens(spark, sf_dir):
    from .functions import model_json

    e = read(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"))
    forms = ['{"generations": [{"usage_metadata": {"input_tokens": %d, "output_tokens": 0}}, {"usage_metadata": {"input_tokens": 0, "output_tokens": %d}}]}',
             '{"generations": [], "llm_output": {"token_usage": {"prompt_tokens": %d, "completion_tokens": %d}}}', '{"llm_output": {"usage": {"input_tokens": %d, "output_tokens": %d}}}']
    text = F.element_at(F.array(*[F.format_string(f, F.col("k") + (0 if i == 0 else 1), F.col("k") % 3) for i, f in enumerate(forms)]), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", model_json.token_usage(text).alias("u")).select("event_id", "u.input_tokens", "u.output_tokens")


@query("""SELECT conv_id, array_to_string(list_sort(list_distinct(list(turn % 3 + 1))), ',') AS selected FROM conversations GROUP BY conv_id""")
def chapter_selection(spark, sf_dir):
    from .functions import model_json

    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.collect_list((F.col("turn") % 3 + 1).cast("string")), " , ").alias("answer"))
    return c.select("conv_id", F.array_join(model_json.selection(F.col("answer")), ",").alias("selected"))


@query("""SELECT doc_id, doc_id::VARCHAR || '-a' AS node_id, lang AS content, '' AS summary FROM documents UNION ALL SELECT doc_id, doc_id::VARCHAR || '-b', '', source FROM documents""")
def content_store_rows(spark, sf_dir):
    from .sources import artifacts

    d = read(spark, sf_dir, "documents")
    two = F.map_from_arrays(F.array(F.concat(F.col("doc_id").cast("string"), F.lit("-a")), F.concat(F.col("doc_id").cast("string"), F.lit("-b"))),
                            F.array(F.struct(F.col("lang").alias("content"), F.lit(None).cast("string").alias("summary")), F.struct(F.lit("").alias("content"), F.col("source").alias("summary"))))
    return artifacts.store_rows(d.select("doc_id", F.to_json(two).alias("store")), ["doc_id"], "store")


@query("""SELECT date_trunc('hour', ts) AS hour, event_type AS status, count(*)::BIGINT AS events FROM events GROUP BY ALL""")
def hourly_progress(spark, sf_dir):
    from .streaming import ingest

    p = read(spark, sf_dir, "events").select("ts", F.col("event_type").alias("status"))
    return ingest.per_window(p).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "status", "events")


# Turns as content nodes, their sentences as points.
def _turn_payloads(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    node = T.node_uuid(F.col("conv_id"), F.col("turn"))
    return c.select("conv_id", F.col("turn").alias("ord"), node.alias("node_id"), F.array(F.col("role")).alias("hierarchy_path"), F.col("turn").alias("start"), F.col("turn").alias("end"), F.split("text", r"\. ").alias("points"))


NODE = "(SELECT substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) FROM (SELECT sha256(conv_id || '|' || turn) AS h))"
FIRST = "trim(string_split(trim(string_split(text, '. ')[1]), chr(10))[1])"


@query(f"""SELECT conv_id, {NODE} AS node_id, array_to_string(list_transform(string_split(text, '. '), lambda p: '- ' || trim(p)), chr(10)) AS content, {FIRST} AS summary, 'ok' AS status FROM conversations""")
def structured_notes(spark, sf_dir):
    """Content and summaries of all nodes by the default models, in batches, with the state of each source."""
    from .plans import generate
    from .scratch import kept

    p = _turn_payloads(spark, sf_dir)
    store, _ = generate.content(p, ["conv_id"])
    store = kept(store, "content")
    out, state = generate.summaries(p, store, ["conv_id"])
    return store.join(out, ["conv_id", "node_id"]).join(state, "conv_id").select("conv_id", "node_id", "content", "summary", "status")


@query("""SELECT conv_id, (2 * turn + 1)::INT AS node_pos, 0 AS parent_pos, 0 AS depth, 'topic' AS kind, role || ' "' || turn AS name, NULL AS node_id, NULL AS problem FROM conversations
UNION ALL SELECT conv_id, (2 * turn + 2)::INT, (2 * turn + 1)::INT, 1, CASE WHEN turn = 3 THEN 'list' ELSE 'content' END, NULL, 'n' || turn, CASE WHEN turn = 3 THEN 'kind: list' END FROM conversations""")
def stored_trees(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    topic = c.select("conv_id", (2 * F.col("turn") + 1).alias("node_pos"), F.lit(0).alias("depth"), F.lit("topic").alias("kind"), F.concat("role", F.lit(' "'), turn).alias("name"), F.lit(None).cast("string").alias("node_id"))
    leaf = c.select("conv_id", (2 * F.col("turn") + 2).alias("node_pos"), F.lit(1).alias("depth"), F.lit("content").alias("kind"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("n"), turn).alias("node_id"))
    doc = tree.nodes_json(topic.unionByName(leaf), ["conv_id"])
    broken = doc.withColumn("nodes", F.replace("nodes", F.lit('"content","id":"n3"'), F.lit('"list","id":"n3"')))
    return tree.stored_nodes(broken, ["conv_id"], "nodes").drop("child_ord")


@query("""WITH p AS (SELECT conv_id, turn, (turn % 3)::INT AS part_idx, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS n FROM conversations),
d AS (SELECT conv_id, string_agg(id, ', ' ORDER BY id) AS ids FROM (SELECT conv_id, 'n' || (turn // (2 + conv_id % 2)) AS id FROM p GROUP BY ALL HAVING count(DISTINCT part_idx) > 1) GROUP BY conv_id)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part_idx, n)::INT AS node_pos, CASE WHEN n = 1 THEN 0 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY part_idx, n) - n + 1 END::INT AS parent_pos, turn::BIGINT AS turn,
  'repeated: ' || ids AS problem FROM p LEFT JOIN d USING (conv_id)""")
def merged_parts(spark, sf_dir):
    from .operators import merge

    c = read(spark, sf_dir, "conversations").withColumn("part_idx", (F.col("turn") % 3).cast("int"))
    n = F.row_number().over(Window.partitionBy("conv_id", "part_idx").orderBy("turn"))
    nodes = c.select("conv_id", "part_idx", n.alias("node_pos"), F.when(n == 1, 0).otherwise(1).alias("parent_pos"), "turn")
    _, problems = merge.stores(c.select("conv_id", "part_idx", F.concat(F.lit("n"), F.floor(F.col("turn") / (2 + F.col("conv_id") % 2)).cast("string")).alias("node_id")), ["conv_id"])
    return merge.hierarchies(nodes, ["conv_id"]).join(problems, "conv_id", "left").select("conv_id", "node_pos", "parent_pos", "turn", "problem")


@query(f"""WITH {SECTIONS}, x AS (SELECT s.*, up.parent_pos FROM s JOIN up USING (conv_id, pos)),
c AS (SELECT a.conv_id, a.pos, a.content, array_to_string(list_filter([g.heading, p.heading, a.heading], lambda h: h IS NOT NULL), ' > ') AS path FROM x a LEFT JOIN x p ON p.conv_id = a.conv_id AND p.pos = a.parent_pos LEFT JOIN x g ON g.conv_id = a.conv_id AND g.pos = p.parent_pos)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::INT AS start, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::INT AS "end", path, content FROM c WHERE content <> ''""")
def markdown_payloads(spark, sf_dir):
    s = tree.with_parents(tree.heading_sections(_files(spark, sf_dir), ["conv_id"], "md"), ["conv_id"])
    return tree.markdown_payloads(s, ["conv_id"]).select("conv_id", "start", "end", F.array_join("hierarchy_path", " > ").alias("path"), "content")


@query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 2 = 0 THEN turn * 1000 + 59 ELSE turn * 60 END AS sec FROM conversations WHERE conv_id % 2 = 1 OR turn % 3 <> 1)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS chapter_idx, role AS title, sec::INT AS timestamp_seconds, printf('%02d:%02d:%02d', sec // 3600, sec % 3600 // 60, sec % 60) AS display FROM t""")
def source_chapters(spark, sf_dir):
    """Chapters of the info record where it has some, else those of the description."""
    c = read(spark, sf_dir, "conversations")
    start = F.when(F.col("turn") % 3 == 1, F.lit("soon")).otherwise(F.concat((F.col("turn") * 1000 + 59).cast("string"), F.lit(".9")))
    rows = F.array_sort(F.collect_list(F.struct("turn", F.format_string("%02d:00 %s", "turn", "role").alias("line"), F.struct(F.concat(F.lit(" "), "role").alias("title"), start.alias("start_time")).alias("chapter"))))
    one = c.groupBy("conv_id").agg(rows.alias("r"))
    info = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.transform("r", lambda x: x["chapter"]).alias("chapters")))).otherwise('{"chapters": []}')
    return video.chapters(one.select("conv_id", info.alias("info"), F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("description")), "conv_id", "info", "description")


@query("""WITH a AS (SELECT page_id, k AS attempt, CASE (page_id + k) % 5 WHEN 0 THEN 200 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN NULL ELSE 200 END AS status, CASE WHEN (page_id + k) % 5 = 3 THEN 'timeout' END AS error,
  CASE WHEN page_id % 4 = 0 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END AS kind, html FROM pages, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT page_id, min(attempt) AS attempt FROM a WHERE attempt <= 3 AND (attempt = 3 OR NOT (coalesce(status, 0) = 503 OR error IS NOT NULL)) GROUP BY page_id),
p AS (SELECT page_id, attempt, html, CASE WHEN error = 'timeout' THEN 'timeout' WHEN status <> 200 THEN 'status: ' || status WHEN kind = 'text/plain' THEN 'content type: text/plain' END AS problem FROM f JOIN a USING (page_id, attempt))
SELECT page_id, attempt::INT AS attempts, (2 ** (attempt - 1) - 1)::BIGINT AS waited, problem, CASE WHEN problem IS NULL THEN sha256(html) END AS body_hash FROM p""")
def fetched_pages(spark, sf_dir):
    from .sources import fetched

    k, n = F.col("attempt"), F.col("page_id") + F.col("attempt")
    status = F.when(n % 5 == 1, 503).when(n % 5 == 2, 404).when(n % 5 == 3, None).otherwise(200)
    a = read(spark, sf_dir, "pages").select("page_id", "html", F.explode(F.array(*map(F.lit, [1, 2, 3, 4]))).alias("attempt"))
    a = a.select(F.col("page_id").cast("string").alias("url"), k, status.alias("status"), F.when(F.col("page_id") % 4 == 0, "text/plain").otherwise("text/html; charset=utf-8").alias("content_type"), F.col("html").alias("body"), F.when(n % 5 == 3, "timeout").alias("error"))
    return fetched.outcomes(a).select(F.col("url").cast("long").alias("page_id"), "attempts", "waited", "problem", F.sha2("body", 256).alias("body_hash"))


@query("""SELECT conv_id, CASE WHEN n % 4 = 0 THEN 'invalid_transcript_breakdown' WHEN n % 3 = 0 THEN 'hierarchy_validation_failed' ELSE 'go on' END AS state, CASE WHEN n % 4 = 0 THEN 'parts too large'
  WHEN n % 3 = 0 THEN 'no content nodes' END AS error_message FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)""")
def ended_sources(spark, sf_dir):
    from .plans import routing

    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    s = c.select("conv_id", (F.col("n") % 4).cast("int").alias("total_parts"), (F.col("n") % 3).cast("int").alias("content_nodes"), F.lit(None).cast("string").alias("error"))
    first, then = routing.after_breakpoints(F.col("total_parts")), routing.after_validation(F.col("content_nodes"))
    state = F.when(first == "invalid_transcript_breakdown", first).when(then == "hierarchy_validation_failed", then).otherwise("go on")
    return s.withColumn("state", state).join(routing.ended(s).select("conv_id", "error_message"), "conv_id", "left").select("conv_id", "state", "error_message")


@query(f"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS tokens, greatest(1, ceil(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) / 6000.0))::BIGINT AS chunks FROM documents""")
def token_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("tokens", T.token_estimate(F.col("text")))
    return d.select("doc_id", "tokens", T.chunk_count(F.col("tokens"), 6000).alias("chunks"))


_EDGES = [10.0, 25.0, 50.0, 100.0]


@query("""WITH e AS (SELECT date_trunc('hour', ts) AS hour, event_type AS status, (value >= 10)::INT + (value >= 25)::INT + (value >= 50)::INT + (value >= 100)::INT AS bucket FROM events WHERE value IS NOT NULL)
SELECT hour, status, bucket, count(*)::BIGINT AS n, [NULL, 10.0, 25.0, 50.0, 100.0][bucket + 1]::DOUBLE AS low, [10.0, 25.0, 50.0, 100.0, NULL][bucket + 1]::DOUBLE AS high FROM e GROUP BY ALL""")
def progress_histogram(spark, sf_dir):
    from .streaming import progress

    p = read(spark, sf_dir, "events").select(F.window("ts", "1 hour")["start"].cast("timestamp_ntz").alias("hour"), F.col("event_type").alias("status"), "value")
    return progress.histogram(p, "value", _EDGES, ["hour", "status"])


# Hierarchies of one root and a child for each turn, three points a turn; some break the rules.
_NODES = """t AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id), i AS (SELECT conv_id, n, unnest(range(n)) AS i FROM t),
c AS (SELECT conv_id, n, i, (i + 2)::INT AS node_pos, (CASE WHEN conv_id % 5 = 1 AND i = 1 THEN 0 WHEN conv_id % 5 = 3 AND i = 2 THEN 2 ELSE 3 * i + 1 END)::INT AS low,
  (CASE WHEN conv_id % 5 = 2 AND i = 0 THEN 2 WHEN conv_id % 5 = 4 AND i = 1 THEN 3 ELSE 3 * i + 3 END)::INT AS high FROM i),
p AS (SELECT conv_id, unnest(range(1, 3 * n + 1))::INT AS p FROM t), u AS (SELECT conv_id, p FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = p.conv_id AND p.p BETWEEN c.low AND c.high)),
r AS (SELECT conv_id, p, p - row_number() OVER (PARTITION BY conv_id ORDER BY p) AS g FROM u)"""


@query(f"""WITH {_NODES} SELECT conv_id, 'range' AS problem, node_pos, low, high FROM c WHERE low > high
UNION ALL SELECT conv_id, 'outside', node_pos, low, high FROM c WHERE low < 1 OR high > 3 * n UNION ALL SELECT conv_id, 'beyond', node_pos, low, high FROM c WHERE low < 1 OR high > 3 * n
UNION ALL SELECT a.conv_id, 'order', a.node_pos, a.low, a.high FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.i = b.i + 1 WHERE a.low < b.low
UNION ALL SELECT conv_id, 'uncovered', NULL, min(p), max(p) FROM r GROUP BY conv_id, g""")
def hierarchy_contract(spark, sf_dir):
    n = read(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("n"))
    five = F.col("conv_id") % 5
    low = lambda i: F.when((five == 1) & (i == 1), 0).when((five == 3) & (i == 2), 2).otherwise(3 * i + 1)
    high = lambda i: F.when((five == 2) & (i == 0), 2).when((five == 4) & (i == 1), 3).otherwise(3 * i + 3)
    kids = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("name"), low(i).alias("start_point"), high(i).alias("end_point")))
    root = F.struct(F.lit("all").alias("name"), F.lit(1).alias("start_point"), (3 * F.col("n")).alias("end_point"), kids.alias("children"))
    nodes = tree.topic_nodes(n.select("conv_id", F.to_json(F.struct(F.array(root).alias("hierarchy"))).alias("doc")), ["conv_id"], "doc")
    return tree.contract_problems(nodes, n.select("conv_id", (3 * F.col("n")).alias("n_points")), ["conv_id"])


@query("""WITH d AS (SELECT c_custkey, c_custkey % 9 AS k, DATE '2001-01-01' + (c_custkey * 37 % 9000)::INT AS d FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN strftime(d, '%Y-%m-15T00:00:00') WHEN 1 THEN strftime(d, '2021-%m-') || lpad(least(day(d), CASE WHEN month(d) = 2 THEN 28 ELSE 31 END)::VARCHAR, 2, '0') || 'T00:00:00' WHEN 2 THEN strftime(d, '%Y-06-15T00:00:00')
  WHEN 3 THEN strftime(d, '%Y-%m-%dT00:00:00') WHEN 4 THEN strftime(d, '%Y-%m-%dT00:00:00') WHEN 5 THEN strftime(d, '%Y-%m-%dT15:05:00') WHEN 6 THEN strftime(d, '%Y-%m-15T00:00:00') WHEN 7 THEN strftime(d, '%Y-%m-%dT09:08:07+00:00') END AS parsed FROM d""")
def partial_dates(spark, sf_dir):
    """Loose forms of dates, with what they lack from the middle of June 2021."""
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 9).alias("k"), F.expr("date_add(date'2001-01-01', cast(c_custkey * 37 % 9000 as int))").alias("d"))
    of = lambda form: F.date_format("d", form)
    short = F.concat(F.date_format("d", "MMM"), F.lit(" "), F.least(F.dayofmonth("d"), F.when(F.month("d") == 2, 28).otherwise(31)).cast("string"), F.lit("th"))
    forms = [of("MMMM yyyy"), short, of("yyyy"), of("MM/dd/yyyy"), F.concat(of("MMM d"), F.lit("th, "), of("yy")), F.concat(of("EEEE, d"), F.lit("th of "), of("MMMM yyyy"), F.lit(" at 3:05 pm")), of("yyyy-MM"), F.concat(of("EEE, dd MMM yyyy"), F.lit(" 09:08:07 GMT")), F.lit("sometime in spring")]
    text = F.get(F.array(*forms), F.col("k").cast("int"))
    return c.select("c_custkey", T.lenient_date(text, F.lit("2021-06-15").cast("date")).alias("parsed"))


@query("""WITH s AS (SELECT conv_id, string_agg('## ' || role || ' ' || turn || CASE WHEN turn % 5 = 2 OR trim(text, ' ' || chr(10) || chr(9)) = '' THEN '' ELSE chr(10) || chr(10) || trim(text, ' ' || chr(10) || chr(9)) END, chr(10) || chr(10) ORDER BY turn) AS body,
  string_agg(role || ' ' || turn || ' > leaf ' || turn || ' = ' || role, '; ' ORDER BY turn) AS payloads, count(*) FILTER (turn % 5 = 2) AS lacking, count(*) AS n, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || body || chr(10) AS document, payloads, lacking::BIGINT AS lacking, (conv_id % 2)::BIGINT AS unmatched FROM s""")
def cached_documents(spark, sf_dir):
    """Stored hierarchies, ids and texts of conversations to payloads and documents, with what is missing counted."""
    from .plans import notes

    c = read(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("string")
    point = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.select("conv_id", "turn", "text", "role", point.alias("point_no"), F.concat("role", F.lit(" "), turn).alias("name"), F.concat(F.lit("n"), turn).alias("node_id"))
    span = [F.col("point_no").alias("start_point"), F.col("point_no").alias("end_point")]
    topic = F.struct("turn", F.struct("name", *span, F.array(F.struct(F.concat(F.lit("leaf "), turn).alias("name"), *span)).alias("children")).alias("v"))
    held = F.struct("turn", F.struct(F.lit("topic").alias("type"), "name", F.array(F.struct(F.lit("content").alias("type"), F.col("node_id").alias("id"))).alias("subtopics")).alias("v"))
    listed = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda y: y["v"])
    docs = rows.groupBy("conv_id").agg(F.to_json(F.struct(listed(topic).alias("hierarchy"))).alias("hierarchy"), listed(held).alias("_h"))
    # Every other conversation has stored an id too many.
    more = F.array(F.struct(F.lit("topic").alias("type"), F.lit("more").alias("name"), F.array(F.struct(F.lit("content").alias("type"), F.lit("nX").alias("id"))).alias("subtopics")))
    docs = docs.select("conv_id", "hierarchy", F.to_json(F.when(F.col("conv_id") % 2 == 1, F.concat("_h", more)).otherwise(F.col("_h"))).alias("nodes"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"))
    store = rows.where("turn % 5 != 2").select("conv_id", "node_id", F.col("text").alias("content"))
    run = notes.from_cache(docs, rows.select("conv_id", "point_no", F.col("role").alias("point")), store, ["conv_id"])
    shown = F.concat(F.array_join("hierarchy_path", " > "), F.lit(" = "), F.array_join("points", ", "))
    p = run.payloads.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", shown.alias("s")))), lambda x: x["s"]), "; ").alias("payloads"))
    count = lambda df, name: df.groupBy("conv_id").agg(F.count(F.lit(1)).alias(name))
    out = run.documents.join(p, "conv_id").join(count(run.lacking, "lacking"), "conv_id", "left").join(count(run.unmatched, "unmatched"), "conv_id", "left")
    return out.select("conv_id", "document", "payloads", F.coalesce("lacking", F.lit(0)).alias("lacking"), F.coalesce("unmatched", F.lit(0)).alias("unmatched"))


@query()
def bpe_token_counts(spark, sf_dir):
    """Tokens of whole documents by a byte-level vocabulary; beyond SQL, and held against the tokenizer's own library by the tests."""
    import public_tokenizers

    from .functions import bpe

    return read(spark, sf_dir, "documents").select("doc_id", bpe.counter(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))(F.col("text")).alias("tokens"))


# Odd turns are a part of their own, so a conversation has two.
_RUN = r"""tr AS (SELECT conv_id, (turn % 2)::INT AS part_idx, string_agg(text, ' ' ORDER BY turn) AS tr FROM conversations GROUP BY ALL),
w AS (SELECT conv_id, part_idx, unnest(list_filter(string_split(tr, '. '), lambda x: trim(x) <> '')) AS p, generate_subscripts(list_filter(string_split(tr, '. '), lambda x: trim(x) <> ''), 1) AS k FROM tr),
p AS (SELECT conv_id, part_idx, k, trim(regexp_replace(regexp_replace(p, '[ ]*\n[ \n]*', ' ', 'g'), '[ ]+', ' ', 'g')) AS point, max(k) OVER (PARTITION BY conv_id, part_idx) AS n FROM w),
l AS (SELECT conv_id, part_idx, n, (k - 1) // 8 AS t, (k - 1) // 4 AS l, string_agg('- ' || point, chr(10) ORDER BY k) AS content, arg_min(point, k) AS summary FROM p GROUP BY ALL),
b AS (SELECT conv_id, part_idx, t, '## Points ' || (8 * t + 1) || '-' || least(8 * t + 8, n) AS head, string_agg(content, chr(10) || chr(10) ORDER BY l) AS content, string_agg(summary, chr(10) || chr(10) ORDER BY l) AS summary, count(*) AS leaves FROM l GROUP BY ALL)"""


@query(f"""WITH {_RUN} SELECT conv_id, '# Talk ' || conv_id || chr(10) || chr(10) || string_agg(head || chr(10) || chr(10) || content, chr(10) || chr(10) ORDER BY part_idx, t) || chr(10) AS document,
  '# Talk ' || conv_id || chr(10) || chr(10) || string_agg(head || chr(10) || chr(10) || summary, chr(10) || chr(10) ORDER BY part_idx, t) || chr(10) AS summary, (4 * count(DISTINCT part_idx))::BIGINT AS calls, (4 * count(DISTINCT part_idx))::BIGINT AS ok, 0::BIGINT AS problems FROM b GROUP BY conv_id""")
def full_run(spark, sf_dir):
    """From conversations in two parts to rendered notes and the totals of all model calls."""
    from .plans import notes
    from .scratch import kept

    c = read(spark, sf_dir, "conversations")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    s = c.groupBy("conv_id", (F.col("turn") % 2).cast("int").alias("part_idx")).agg(text.alias("transcript"))
    own = F.col("conv_id").cast("string")
    meta = {"title": F.concat(F.lit("Talk "), own), "url": F.concat(F.lit("https://notes.test/"), own), "author": F.lit(""), "upload_date": F.lit(""), "content_id": F.sha2(own, 256)}
    run = notes.full_run(s.withColumns(meta), ["conv_id"], F.lit("now"))
    totals = usage.summary(kept(run.calls, "calls").withColumn("estimated_cost", F.lit(0.0)), keys=["conv_id"]).where("dimension = 'all'").select("conv_id", "calls", "ok")
    wrong = run.problems.groupBy("conv_id").agg(F.count(F.lit(1)).alias("problems"))
    out = run.content.join(run.summary.withColumnRenamed("document", "summary"), "conv_id").join(totals, "conv_id").join(wrong, "conv_id", "left")
    return out.select("conv_id", "document", "summary", "calls", "ok", F.coalesce("problems", F.lit(0)).alias("problems"))


@query("""WITH p AS (SELECT page_id, page_id % 4 AS k, regexp_extract(url, '[^/]*$') AS slug FROM pages)
SELECT page_id, CASE WHEN k = 3 THEN 'Plain ' || page_id ELSE 'About "' || slug || '"' END AS title, CASE WHEN k = 3 THEN 'html' ELSE 'linked data' END AS title_source,
  CASE k WHEN 0 THEN 'Ada Ng' WHEN 1 THEN 'Ada, Bo' WHEN 2 THEN 'Cy' ELSE 'Tagged' END AS author, CASE WHEN k = 3 THEN '2020-01-01T00:00:00' ELSE '2024-05-0' || (1 + page_id % 9) || 'T06:07:08+00:00' END AS upload_date FROM p""")
def article_linked_data(spark, sf_dir):
    """Metadata of pages with linked data in three shapes, and without."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") % 4).cast("int").alias("k"), F.regexp_extract("url", "[^/]*$", 0).alias("slug"))
    lit = lambda v, n: F.lit(v).alias(n)
    date = F.concat(F.lit("2024-05-0"), (1 + F.col("page_id") % 9).cast("string"), F.lit("T06:07:08Z"))
    named = [F.concat(F.lit('About "'), "slug", F.lit('"')).alias("headline"), date.alias("datePublished")]
    one = F.to_json(F.struct(lit("NewsArticle", "@type"), *named, F.struct(lit("Ada Ng", "name")).alias("author")))
    some = F.to_json(F.array(F.struct(F.array(F.lit("Thing"), F.lit("BlogPosting")).alias("@type"), *named, F.array(F.struct(lit("Ada", "name")), F.struct(lit("Bo", "name"))).alias("author"))))
    graph = F.concat(F.lit('{"@graph": [{"@type": "Person", "name": "Nobody"}, '), F.to_json(F.struct(lit("Article", "@type"), *named, lit("By: Cy", "author"))), F.lit("]}"))
    script = F.concat(F.lit('<script type="application/ld+json">'), F.get(F.array(one, some, graph), F.col("k")), F.lit("</script>"))
    page = F.concat(F.lit("<head><title>Plain "), F.col("page_id").cast("string"), F.lit('</title><meta name="author" content="Tagged"><meta name="date" content="2020-01-01">'), F.coalesce(script, F.lit("")), F.lit("</head>"))
    return article.metadata(p.select("page_id", "url", page.alias("html")), "page_id").select("page_id", "title", "title_source", "author", "upload_date")
