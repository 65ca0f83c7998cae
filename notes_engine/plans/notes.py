"""From transcripts to notes, end to end, with the default models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import merge, order, tree
from ..scratch import kept
from . import generate, models


def from_conversations(turns: DataFrame) -> DataFrame:
    """conv_id and a document for each conversation (conv_id, turn, role, text).

    Turns are snippets, the user's turns chapters; chapters are cleaned to
    bullets, numbered, and rendered as a topic and its points.
    """
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    chapters = turns.where("role = 'user'").select("conv_id", idx.alias("chapter_idx"), F.concat(F.lit("Chapter "), (idx + 1).cast("string")).alias("title"), F.col("turn").alias("timestamp_seconds"))
    parts = order.segments(chapters, turns.select("conv_id", F.col("turn").alias("pos"), F.col("turn").alias("start"), "text"), "conv_id")
    cleaned = models.call(parts.select("conv_id", "chapter_idx", "title", "transcript"), "transcript", "cleaned", "bullets")
    points = order.numbered_points(cleaned, ["conv_id", "chapter_idx"], "cleaned")
    line = F.array_sort(F.collect_list(F.struct("point_no", F.format_string("%d. %s", "point_no", "point").alias("line"))))
    leaf = points.groupBy("conv_id", "chapter_idx").agg(F.array_join(F.transform(line, lambda x: x["line"]), "\n").alias("content"))
    topics = chapters.select("conv_id", (F.col("chapter_idx") * 2).alias("node_pos"), F.lit(0).alias("depth"), F.lit("topic").alias("kind"), F.col("title").alias("name"), F.lit("").alias("content"))
    leaves = leaf.select("conv_id", (F.col("chapter_idx") * 2 + 1).alias("node_pos"), F.lit(1).alias("depth"), F.lit("content").alias("kind"), F.lit("").alias("name"), "content")
    return tree.render(topics.unionByName(leaves).withColumn("title", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))), ["conv_id"], "title")


@dataclass
class Cached:
    payloads: DataFrame  # keys, ord, node_id, hierarchy_path, start, end, points
    documents: DataFrame  # keys, document
    lacking: DataFrame  # keys, node_id without a text
    unmatched: DataFrame  # keys, ord, problem of leaves without an id and ids without a leaf


def from_cache(sources: DataFrame, points: DataFrame, store: DataFrame, keys: list[str]) -> Cached:
    """Payloads and documents of sources whose stages were stored, in one plan.

    ``sources``: keys, title, hierarchy (JSON of nested topics) and nodes (JSON of
    the stored tree, which names the content nodes); ``points``: keys, point_no,
    point; ``store``: keys, node_id, content.
    """
    nodes = tree.topic_nodes(sources, keys, "hierarchy")
    leaves, unmatched = tree.with_stored_ids(tree.content_nodes(nodes, keys), tree.stored_nodes(sources, keys, "nodes"), keys)
    got = tree.payloads(nodes, points, keys).drop("ord")
    payloads = got.join(leaves.select(*keys, "ord", "node_pos", "node_id", "hierarchy_path"), [*keys, "node_pos"]).select(*keys, "ord", "node_id", "hierarchy_path", "start", "end", "points")
    kinds = nodes.select(*keys, "node_pos", "depth", "name", F.when(F.col("is_content"), "content").otherwise("topic").alias("kind"))
    full, lacking = tree.with_texts(kinds.join(leaves.select(*keys, "node_pos", "node_id"), [*keys, "node_pos"], "left"), store, keys)
    documents = tree.render(full.join(sources.select(*keys, "title"), keys), keys, "title")
    return Cached(payloads, documents, lacking.where("node_id is not null"), unmatched)


@dataclass
class Run:
    content: DataFrame  # keys, document
    summary: DataFrame  # keys, document
    readme: DataFrame  # keys, readme
    calls: DataFrame  # keys and a record of each model call
    problems: DataFrame  # keys, part_idx, problem


def _call(df: DataFrame, prompt: str, out: str, node: str, provider: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with the answers, kept, and records of the calls."""
    got = kept(models.call(df, prompt, out, provider), node)
    sizes = [T.token_estimate(F.coalesce(prompt, F.lit(""))).alias("input_tokens"), T.token_estimate(F.coalesce(out, F.lit(""))).alias("output_tokens")]
    calls = models.record(got.select(*keys, *sizes, "duration_ms", "success", "exception_type"), node, "call", provider)
    return got.drop("duration_ms", "success", "exception_type"), calls


def full_run(sources: DataFrame, keys: list[str], generated, cleaner: str = "bullets", outliner: str = "groups", writer: str = "outline", digester: str = "digest") -> Run:
    """Notes of sources in parts, from transcripts to three documents, with all model calls on record.

    ``sources``: keys, part_idx, title, url, author, upload_date, content_id, transcript.  A
    part is cleaned to points, which are numbered; a hierarchy of them is read,
    checked and cut into payloads; texts and summaries are written in batches; the
    parts are merged in order and rendered.  A part with a problem (a hierarchy
    that cannot be read or breaks the rules, or a batch that failed) has no notes.
    """
    part = [*keys, "part_idx"]
    cleaned, calls = _call(sources.select(*part, "transcript"), "transcript", "cleaned", "clean", cleaner, part)
    points = kept(order.numbered_points(cleaned, part, "cleaned"), "points")
    line = F.array_sort(F.collect_list(F.struct("point_no", F.format_string("%d. %s", "point_no", "point").alias("line"))))
    listed = points.groupBy(*part).agg(F.array_join(F.transform(line, lambda x: x["line"]), "\n").alias("points"), F.max("point_no").alias("n_points"))
    outlined, more = _call(listed, "points", "hierarchy", "hierarchy", outliner, part)
    calls = calls.unionByName(more)

    nodes = kept(tree.topic_nodes(outlined, part, "hierarchy"), "nodes")
    unread = outlined.select(*part, tree.hierarchy_problem(F.col("hierarchy")).alias("problem")).where("problem is not null")
    broken = tree.contract_problems(nodes, outlined.select(*part, "n_points"), part).select(*part, "problem")
    wrong = kept(unread.unionByName(broken).groupBy(*part).agg(F.min("problem").alias("problem")), "wrong")
    good = nodes.join(wrong, part, "left_anti")
    leaves = tree.content_nodes(good, part).select(*part, "node_pos", "ord", "node_id", "hierarchy_path")
    payloads = kept(tree.payloads(good, points, part).drop("ord").join(leaves, [*part, "node_pos"]), "payloads")

    written, state = generate.content(payloads, part, writer)
    texts = kept(written, "texts")
    digests, later = generate.summaries(payloads, texts, part, digester)
    calls = calls.unionByName(written.calls).unionByName(digests.calls)
    failed = state.unionByName(later).where("status = 'failed'").groupBy(*part).agg(F.min("problem").alias("problem"))
    problems = wrong.unionByName(failed)

    store = texts.join(digests, [*part, "node_id"], "left")
    kinds = good.join(payloads.select(*part, "node_pos", "node_id"), [*part, "node_pos"], "left").join(failed, part, "left_anti")
    kinds = kinds.select(*part, "node_pos", "parent_pos", "depth", "name", F.when(F.col("is_content"), "content").otherwise("topic").alias("kind"), "node_id")
    whole = kept(merge.hierarchies(kinds, keys).join(store.drop("part_idx"), [*keys, "node_id"], "left"), "merged")
    about = sources.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("title", "url", "author", "upload_date", "content_id")])
    titled = whole.join(about.select(*keys, "title"), keys)
    toc = tree.contents(whole, keys)
    return Run(tree.render(titled, keys, "title"), tree.render(titled, keys, "title", "summary"), tree.readme(about.join(toc.select(*keys), keys, "left_semi"), toc, keys, generated), calls, problems)
