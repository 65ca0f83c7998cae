"""Topic trees as adjacency tables: pre-order number, parent, depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MAX_LEVEL = 6


def _before(keys, order):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def heading_sections(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, level, heading, content: headings in order, each with the text up to the next.

    Text before the first heading is dropped.  A heading within a code fence counts.
    """
    lines = df.select(*keys, F.posexplode(F.split(T.unix_newlines(F.col(text)), "\n")).alias("pos", "line")).withColumn("level", T.heading_level(F.col("line")))
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(upto)).where("section > 0")
    body = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line"))))
    out = lines.groupBy(*keys, "section").agg(
        F.min("pos").alias("pos"), F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, T.heading_text(F.col("line")))).alias("heading"),
        T.strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("content"))
    return out.select(*keys, F.col("section").cast("int").alias("pos"), "level", "heading", "content")


def with_parents(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Sections with parent_pos (0 for none) and path: the chain of headings down to each."""
    w = _before(keys, "pos")
    last = {k: F.last(F.when(F.col("level") == k, F.struct("pos", "heading")), ignorenulls=True).over(w) for k in range(1, MAX_LEVEL + 1)}
    out = sections.withColumns({f"_a{k}": v for k, v in last.items()})
    at = lambda k: F.coalesce(F.col(f"_a{k}.pos"), F.lit(0))
    # An ancestor at level k is in force if it is later than everything above it.
    alive = {k: (F.col("level") > k) & (at(k) > F.greatest(F.lit(0), F.lit(0), *[at(j) for j in range(1, k)])) for k in range(1, MAX_LEVEL + 1)}
    parent = F.greatest(F.lit(0), F.lit(0), *[F.when(F.col("level") > k, at(k)).otherwise(0) for k in range(1, MAX_LEVEL + 1)])
    path = F.array_compact(F.array(*[F.when(alive[k], F.col(f"_a{k}.heading")) for k in range(1, MAX_LEVEL + 1)], F.col("heading")))
    return out.withColumn("parent_pos", parent.cast("int")).withColumn("path", path).drop(*last and [f"_a{k}" for k in last])


def unfold(text: Column, root: str, child: str) -> Column:
    """Array of (ord, v) of all nodes of nested JSON: ``ord`` holds the places from the root down, ``v`` the node as a variant.

    The nodes of a level are unfolded from those above it within the row, so a
    source with many nodes needs no recursive query.  There are no more levels
    than the text names ``child``, and one.
    """
    none = F.array().cast("array<struct<ord: array<int>, v: variant>>")
    kids = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    below = lambda ord, items: F.transform(items, lambda v, i: F.struct(F.concat(ord, F.array(i)).alias("ord"), v.alias("v")))
    start = F.struct(none.alias("done"), below(F.array().cast("array<int>"), kids(F.try_parse_json(text), root)).alias("now"))
    step = lambda s, _: F.when(F.size(s["now"]) == 0, s).otherwise(F.struct(F.concat(s["done"], s["now"]).alias("done"), F.flatten(F.transform(s["now"], lambda n: below(n["ord"], kids(n["v"], child)))).alias("now")))
    levels = F.coalesce(F.regexp_count(text, F.lit(f'"{child.removeprefix("$.")}"')), F.lit(0)) + 1
    return F.aggregate(F.sequence(F.lit(1), levels), start, step, lambda s: F.concat(s["done"], s["now"]))


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Unfolded rows (keys, ord, v) with node_pos, parent_pos, child_ord and depth."""
    rows = rows.withColumn("node_pos", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
    up = rows.select(*keys, F.col("ord").alias("_up"), F.col("node_pos").alias("parent_pos"))
    above = F.slice("ord", F.lit(1), F.size("ord") - 1)
    return rows.withColumn("_up", above).join(up, [*keys, "_up"], "left").withColumns({
        "parent_pos": F.coalesce("parent_pos", F.lit(0)), "child_ord": F.element_at("ord", -1) + 1, "depth": F.size("ord") - 1}).drop("_up")


def topic_nodes(df: DataFrame, keys: list[str], hierarchy: str) -> DataFrame:
    """keys, node_pos, parent_pos, child_ord, depth, name, start_point, end_point, is_content of nested JSON.

    ``hierarchy`` holds {"hierarchy": [{name, start_point, end_point, children}]};
    nodes without children are content.  Text that is no JSON gives no nodes
    (``hierarchy_problem`` names it).
    """
    nodes = F.explode(unfold(F.col(hierarchy), "$.hierarchy", "$.children")).alias("n")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    inner = F.coalesce(F.size(get("$.children", "array<variant>")), F.lit(0)) > 0
    rows = df.select(*keys, nodes).select(*keys, "n.ord", "n.v")
    rows = rows.select(*keys, "ord", get("$.name", "string").alias("name"), get("$.start_point", "int").alias("start_point"), get("$.end_point", "int").alias("end_point"), (~inner).alias("is_content"))
    return _placed(rows, keys).select(*keys, "node_pos", "parent_pos", "child_ord", "depth", "name", "start_point", "end_point", "is_content")


def contract_problems(nodes: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem, node_pos, low, high: what breaks the rules for ranges of ``topic_nodes``; ``points`` has keys and n_points.

    ``range``: a node without a range, or with an end before its start;
    ``outside``: a node beyond its parent's range; ``order``: a child that starts
    before the child before it; ``beyond``: a node outside of 1 to n_points;
    ``uncovered``: points from ``low`` to ``high`` that are in no content node.
    """
    own = [F.col("start_point").alias("low"), F.col("end_point").alias("high")]
    told = lambda df, name: df.select(*keys, F.lit(name).alias("problem"), "node_pos", *own)
    bad = F.col("start_point").isNull() | F.col("end_point").isNull() | (F.col("start_point") > F.col("end_point"))
    above = nodes.select(*keys, F.col("node_pos").alias("parent_pos"), F.col("start_point").alias("_low"), F.col("end_point").alias("_high"))
    outside = nodes.join(above, [*keys, "parent_pos"]).where((F.col("start_point") < F.col("_low")) | (F.col("end_point") > F.col("_high")))
    before = F.lag("start_point").over(Window.partitionBy(*keys, "parent_pos").orderBy("child_ord"))
    late = nodes.withColumn("_before", before).where(F.col("start_point") < F.col("_before"))
    beyond = nodes.join(points, keys).where((F.col("start_point") < 1) | (F.col("end_point") > F.col("n_points")))
    # A sweep over content nodes by start: what lies between the farthest end so far and the next start is in none.
    order = Window.partitionBy(*keys).orderBy("start_point", "end_point", "node_pos")
    leaf = nodes.where(F.col("is_content") & ~bad).select(*keys, "node_pos", "start_point", "end_point")
    end = points.select(*keys, F.lit(None).cast("int").alias("node_pos"), (F.col("n_points") + 1).cast("int").alias("start_point"), (F.col("n_points") + 1).cast("int").alias("end_point"))
    reached = F.coalesce(F.max("end_point").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    swept = leaf.unionByName(end).withColumn("_reached", F.greatest(reached, F.lit(0))).join(points, keys)
    high = F.least(F.col("start_point") - 1, F.col("n_points")).cast("int")
    gaps = swept.where(high > F.col("_reached")).select(*keys, F.lit("uncovered").alias("problem"), F.lit(None).cast("int").alias("node_pos"), (F.col("_reached") + 1).cast("int").alias("low"), high.alias("high"))
    return told(nodes.where(bad), "range").unionByName(told(outside, "outside")).unionByName(told(late, "order")).unionByName(told(beyond, "beyond")).unionByName(gaps)


def content_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, node_pos, node_id, hierarchy_path, start_point, end_point, content, summary: content nodes in order, with the names from the root down and empty texts.

    ``nodes``: ``topic_nodes``.  Paths are built a level at a time, from the roots
    down, by as many joins as the tree has levels.
    """
    deepest = nodes.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]
    now = nodes.where("depth = 0").select(*keys, "node_pos", F.array("name").alias("hierarchy_path"))
    all_ = now
    for level in range(1, deepest + 1):
        up = now.select(*keys, F.col("node_pos").alias("parent_pos"), F.col("hierarchy_path").alias("_up"))
        now = nodes.where(F.col("depth") == level).join(up, [*keys, "parent_pos"]).select(*keys, "node_pos", F.concat("_up", F.array("name")).alias("hierarchy_path"))
        all_ = all_.unionByName(now)
    leaf = nodes.where("is_content").join(all_, [*keys, "node_pos"])
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("node_pos"))
    return leaf.select(*keys, number.alias("ord"), "node_pos", T.node_uuid(*[F.col(k) for k in keys], F.col("node_pos")).alias("node_id"), "hierarchy_path", "start_point", "end_point", F.lit("").alias("content"), F.lit("").alias("summary"))


def with_stored_ids(leaves: DataFrame, stored: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (``content_nodes``) under the ids of stored trees (``stored_nodes``), and keys, ord, problem of what has no partner.

    Content nodes of both are matched by their order.  ``no id``: a leaf that the
    stored tree does not have; ``no node``: a stored id without a leaf.
    """
    ids = stored.where("kind = 'content' and problem is null").select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("node_pos")).alias("ord"), F.col("node_id").alias("_id"))
    both = leaves.withColumn("_leaf", F.lit(True)).join(ids, [*keys, "ord"], "full_outer")
    found = both.where(F.col("_leaf") & F.col("_id").isNotNull()).withColumn("node_id", F.col("_id")).drop("_leaf", "_id")
    problem = F.when(F.col("_leaf").isNull(), "no node").when(F.col("_id").isNull(), "no id")
    return found.select(*leaves.columns), both.select(*keys, "ord", problem.alias("problem")).where("problem is not null")


def with_texts(nodes: DataFrame, store: DataFrame, keys: list[str], text: str = "content") -> tuple[DataFrame, DataFrame]:
    """``nodes`` with ``text`` from a content store (keys, node_id, text), empty where it has none, and keys, node_id of content nodes that it lacks."""
    mine = store.select(*keys, "node_id", F.col(text).alias("_text"), F.lit(True).alias("_there"))
    both = nodes.drop(text).join(mine, [*keys, "node_id"], "left")
    lacking = both.where("kind = 'content' and _there is null").select(*keys, "node_id")
    return both.withColumn(text, F.coalesce("_text", F.lit(""))).drop("_text", "_there"), lacking


def hierarchy_problem(hierarchy: Column) -> Column:
    """Why stored hierarchy JSON cannot be read, or null: no JSON, no list, or a node without name, start or end or with bad children."""
    doc = F.try_parse_json(hierarchy)
    get = lambda n, path, kind: F.try_variant_get(n["v"], path, kind)
    kind = lambda n: F.schema_of_variant(F.try_variant_get(n["v"], "$.children", "variant"))
    bad = lambda n: get(n, "$.name", "string").isNull() | get(n, "$.start_point", "int").isNull() | get(n, "$.end_point", "int").isNull() | ~F.coalesce(kind(n), F.lit("ARRAY<VOID>")).startswith("ARRAY")
    return F.when(doc.isNull(), "no JSON").when(F.try_variant_get(doc, "$.hierarchy", "array<variant>").isNull(), "no hierarchy").when(F.exists(unfold(hierarchy, "$.hierarchy", "$.children"), bad), "malformed node")


def stored_nodes(df: DataFrame, keys: list[str], nodes: str) -> DataFrame:
    """keys, node_pos, parent_pos, child_ord, depth, kind, name, node_id, problem of stored node trees.

    ``nodes`` holds a list of {"type": "topic", "name", "subtopics": [...]} and
    {"type": "content", "id"}; another type, a topic without a name or content
    without an id is a problem of that node.
    """
    each = F.explode(unfold(F.col(nodes), "$", "$.subtopics")).alias("n")
    get = lambda path: F.try_variant_get("v", path, "string")
    rows = df.select(*keys, each).select(*keys, "n.ord", "n.v").select(*keys, "ord", get("$.type").alias("kind"), get("$.name").alias("name"), get("$.id").alias("node_id"))
    problem = F.when(~F.coalesce(F.col("kind").isin("topic", "content"), F.lit(False)), F.concat(F.lit("kind: "), F.coalesce("kind", F.lit("None"))))
    problem = problem.when((F.col("kind") == "topic") & F.col("name").isNull() | (F.col("kind") == "content") & F.col("node_id").isNull(), "malformed")
    return _placed(rows.withColumn("problem", problem), keys).select(*keys, "node_pos", "parent_pos", "child_ord", "depth", "kind", "name", "node_id", "problem")


def nodes_json(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, nodes: node trees (node_pos, depth, kind, name, node_id) as the nested JSON that ``stored_nodes`` reads.

    Each node's text opens it; the closings that the next node's depth asks for follow.
    """
    w = Window.partitionBy(*keys).orderBy("node_pos")
    text = F.when(F.col("kind") == "topic", F.concat(F.lit('{"type":"topic","name":'), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2), F.lit(',"subtopics":['))).otherwise(
        F.concat(F.lit('{"type":"content","id":'), F.to_json(F.array("node_id")).substr(F.lit(2), F.length(F.to_json(F.array("node_id"))) - 2), F.lit("}")))
    after = F.coalesce(F.lead("depth").over(w), F.lit(0))
    open_now = F.col("depth") + F.when(F.col("kind") == "topic", 1).otherwise(0)
    last = F.lead("depth").over(w).isNull()
    comma = F.when(last | (after > F.col("depth")), "").otherwise(",")
    piece = F.concat(text, F.repeat(F.lit("]}"), F.greatest(open_now - after, F.lit(0)).cast("int")), comma)
    ordered = F.array_sort(F.collect_list(F.struct("node_pos", "piece")))
    return nodes.withColumn("piece", piece).groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["piece"]), ""), F.lit("]")).alias("nodes"))


def markdown_payloads(sections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, node_id, hierarchy_path, start, end, points, content of the text below the headings of markdown files.

    ``sections``: pos, path and content of ``with_parents``.  Each block of text is
    a content node; they are numbered in order from 0, and each is a range of its
    own number alone, without points.
    """
    leaf = sections.where(T.strip(F.col("content")) != "").withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1)
    return leaf.select(*keys, "ord", T.node_uuid(*[F.col(k) for k in keys], F.col("pos")).alias("node_id"), F.col("path").alias("hierarchy_path"), F.col("ord").alias("start"), F.col("ord").alias("end"),
                       F.array().cast("array<string>").alias("points"), "content")


def render(nodes: DataFrame, keys: list[str], title: str, content: str = "content", out: str = "document") -> DataFrame:
    """keys and one markdown document of pre-ordered ``nodes`` (node_pos, depth, kind, name, content).

    Topics are headings from level two on, by depth; leaves are their text,
    stripped; blank blocks are left out.
    """
    block = F.when(F.col("kind") == "topic", F.concat(T.heading_mark(F.col("depth") + 2), F.lit(" "), F.col("name"))).otherwise(T.strip(F.coalesce(content, F.lit(""))))
    full = nodes.withColumn("_block", block)
    ordered = F.array_sort(F.collect_list(F.when(F.col("_block") != "", F.struct("node_pos", "_block"))))
    body = F.transform(ordered, lambda x: x["_block"])
    return full.groupBy(*keys, title).agg(F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.first(title))), body), "\n\n").alias(out)).select(*keys, F.concat(T.rstrip(F.col(out)), F.lit("\n")).alias(out))


def contents(nodes: DataFrame, keys: list[str], out: str = "toc") -> DataFrame:
    """keys and the nested list of the topics."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.lit("- "), F.col("name"))
    ordered = F.array_sort(F.collect_list(F.struct("node_pos", line.alias("line"))))
    return nodes.where("kind = 'topic'").groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(out))


def readme(meta: DataFrame, toc: DataFrame, keys: list[str], generated: Column, generator: str = "notes-engine") -> DataFrame:
    """keys, readme: an index of the rendered notes of each source, with its metadata and contents.

    ``meta``: keys, title, content_id, author, upload_date, url; ``generated`` is the time to state.
    """
    m = meta.join(toc, keys, "left")
    or_unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    parts = [
        F.concat(F.lit("# "), text("title")), "", "## Metadata", "", F.concat(F.lit("- **Content ID:** `"), text("content_id"), F.lit("`")), F.concat(F.lit("- **Author:** "), or_unknown("author")),
        F.concat(F.lit("- **Upload Date:** "), or_unknown("upload_date")), F.concat(F.lit("- **Source:** "), text("url")), "", "## Generated Notes", "",
        "- [📘 Full Structured Notes](content.md)", "- [📝 Summary Notes](summary.md)", "", "## Table of Contents", "", F.col("toc"), "", "---", "",
        F.concat(F.lit(f"*This document was automatically generated by {generator} on "), generated, F.lit("*")),
    ]
    return m.select(*keys, F.concat(F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit("\n")).alias("readme"))


def zip_trees(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of two trees at the same place; ``mismatch`` where one is absent or of another kind."""
    a, b = left.select(*keys, "node_pos", F.col("kind").alias("kind_a"), "name"), right.select(*keys, "node_pos", F.col("kind").alias("kind_b"), "node_id")
    return a.join(b, [*keys, "node_pos"], "full_outer").withColumn("mismatch", ~F.col("kind_a").eqNullSafe(F.col("kind_b")))


def payloads(nodes: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, start, end, points of content nodes, gaps filled; a start of 0 counts as 1."""
    from .order import fill_gaps

    leaf = nodes.where("is_content").select(*keys, "node_pos", F.greatest("start_point", F.lit(1)).alias("start"), F.col("end_point").alias("end"))
    filled = fill_gaps(leaf, keys).withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "node_pos")))
    p = points.select(*keys, "point_no", "point")
    each = filled.withColumn("point_no", F.explode_outer(F.when(F.col("end") >= F.col("filled"), F.sequence("filled", "end"))))  # the range as rows: an equi-join follows
    got = each.join(p, [*keys, "point_no"], "left").groupBy(*keys, "ord", "node_pos", F.col("filled").alias("start"), "end")
    listed = F.array_sort(F.collect_list(F.when(F.col("point").isNotNull(), F.struct("point_no", "point"))))
    return got.agg(F.transform(listed, lambda x: x["point"]).alias("points"))


def repeated_ids(stores: list[DataFrame], keys: list[str]) -> DataFrame:
    """Node ids that occur in more than one part."""
    union = stores[0]
    for s in stores[1:]:
        union = union.unionByName(s)
    return union.groupBy(*keys, "node_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
