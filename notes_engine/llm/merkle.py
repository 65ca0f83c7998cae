"""Fixity audit of replicas of WARC records by Merkle trees.

Records lie in files, at ordered offsets.  A leaf digests one record and the range
of offsets it takes up; an inner node digests the numbers, offset ranges and
digests of up to ``FANOUT`` children, up to one root.  Children are ranges of
numbers, not of ranks, so that a missing record changes its own branch alone.
Replicas are compared from the roots down: each level joins only children of
branches that differ, and ends at the records that are corrupt, moved, missing or
surplus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stored

FANOUT, FILE_RECORDS = 16, 4096


def warc_record(url: Column, payload: Column) -> Column:
    """A response record as text: header lines and payload; null counts as empty."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """number, length, digest and recorded offset of ``records`` (number: long, record: string, and perhaps offset: long).

    Records that repeat a number form one leaf: its digest is that of their
    number and of the sums of their digests, so that they are never brought
    together.  A null record is empty.  A record without a number cannot be
    addressed and is left out.
    """
    record = F.coalesce(F.col("record").cast("string"), F.lit(""))
    at = F.col("offset").cast("long") if "offset" in records.columns else F.lit(None).cast("long")
    own = records.where("number is not null").select("number", F.octet_length(record).cast("long").alias("length"), F.sha2(record.cast("binary"), 256).alias("digest"), at.alias("offset"))
    sums = [F.sum(F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    out = own.groupBy("number").agg(F.sum("length").alias("length"), F.min("digest").alias("one"), F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.count(F.lit(1)).cast("string"), *sums).alias("all"), F.min("offset").alias("offset"))
    return out.select("number", "length", F.when(F.col("n") == 1, F.col("one")).otherwise(F.sha2("all", 256)).alias("digest"), "offset")


def offsets(leaf: DataFrame, per_file: int = FILE_RECORDS) -> DataFrame:
    """number, file, offset, length, digest: records of a file follow each other by number, unless their offsets are recorded."""
    before = Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    placed = leaf.withColumn("file", _above(F.col("number"), per_file))
    return placed.select("number", "file", F.coalesce("offset", F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest")


def _above(number: Column, fanout: int) -> Column:
    """The range of ``fanout`` numbers that a number lies in, in whole numbers; below zero too."""
    return F.when(number >= 0, F.call_function("div", number, F.lit(fanout))).otherwise(-F.call_function("div", -(number + 1), F.lit(fanout)) - 1)


def ground(leaf: DataFrame) -> DataFrame:
    """The lowest level of a tree: number, low, high and the digest of each leaf with its range of offsets."""
    high = F.col("offset") + F.col("length")
    return leaf.select("number", F.col("offset").alias("low"), high.alias("high"), F.sha2(F.concat_ws(":", F.coalesce("offset", F.lit(-1)), "length", "digest"), 256).alias("digest"))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: at most ``fanout`` children each."""
    kids = F.array_sort(F.collect_list(F.struct("number", F.concat_ws(":", "number", F.coalesce("low", F.lit(-1)), F.coalesce("high", F.lit(-1)), "digest").alias("text"))))
    digest = F.sha2(F.array_join(F.transform(kids, lambda k: k["text"]), "|"), 256)
    return level.groupBy(_above(F.col("number"), fanout).alias("number")).agg(F.min("low").alias("low"), F.max("high").alias("high"), digest.alias("digest"))


def tree(leaf: DataFrame, levels: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The leaves and ``levels`` levels above them, each written."""
    out = [stored(ground(leaf), "merkle")]
    for _ in range(levels):
        out.append(stored(parents(out[-1], fanout), "merkle"))
    return out


def levels_of(*sides: DataFrame, fanout: int = FANOUT) -> int:
    """Levels until one node holds all numbers from 0 on (another holds those below)."""
    most = max((max(abs(r.low), abs(r.high)) for r in (s.agg(F.min("number").alias("low"), F.max("number").alias("high")).first() for s in sides) if r.low is not None), default=0)
    levels = 0
    while fanout**levels <= most:
        levels += 1
    return levels


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """number of the leaves that differ between two trees of equal height, stored."""
    branch = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if branch is not None:
            x, y = (z.withColumn("_up", _above(F.col("number"), fanout)).join(branch.toDF("_up"), "_up", "left_semi") for z in (x, y))
        both = x.select("number", F.col("digest").alias("digest_a")).join(y.select("number", F.col("digest").alias("digest_b")), "number", "full_outer")
        below = stored(both.where("digest_a is null or digest_b is null or digest_a != digest_b").select("number"), "apart")
        release(branch)
        branch = below
    return branch


def audit(records: DataFrame, replica: DataFrame, fanout: int = FANOUT, per_file: int = FILE_RECORDS) -> DataFrame:
    """Every record of either side: number, file, offset, length, digest and status.

    ``records`` and ``replica``: number (long), record (string) and perhaps
    offset (long), the recorded place of each; other columns are ignored.
    Without recorded offsets, records follow each other in their files, and a
    replica is held against the offsets of the records.  status is ok, corrupt
    (another content), moved (the same content at another offset), missing (from
    the replica) or surplus (in it alone, with no place in the files).  Empty
    sides are allowed; numbers may be negative.
    """
    whole = lambda t: t.withColumn("number", F.col("number").cast("long"))
    a = stored(offsets(leaves(whole(records)), per_file), "leaves")
    b = leaves(whole(replica)).join(a.select("number", F.col("offset").alias("_at")), "number", "left")
    b = stored(b.select("number", "length", "digest", F.coalesce("offset", "_at").alias("offset")), "leaves")
    levels = levels_of(a, b, fanout=fanout)
    trees = tree(a, levels, fanout), tree(b, levels, fanout)
    apart = differing(*trees, fanout)
    release(*trees[0], *trees[1])
    theirs = apart.join(b.select("number", F.col("digest").alias("digest_b")), "number", "left")
    marked = a.join(theirs.withColumn("apart", F.lit(True)), "number", "full_outer")
    state = F.when(F.col("digest").isNull(), "surplus").when(F.col("digest_b").isNull(), "missing").when(F.col("digest") == F.col("digest_b"), "moved").otherwise("corrupt")
    return marked.select("number", "file", "offset", "length", "digest", F.when(F.col("apart"), state).otherwise("ok").alias("status"))


#: For the replica of ``op4``: payloads without their first character, and records left out.
ORACLE_SQL = r"""
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages),
l AS (SELECT page_id, (page_id // 4096)::BIGINT AS file, strlen(rec)::BIGINT AS length, sha256(rec) AS digest FROM r)
SELECT page_id AS number, file, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset,
  length, digest, CASE WHEN page_id % 101 = 5 THEN 'missing' WHEN page_id % 50 = 7 THEN 'corrupt' ELSE 'ok' END AS status FROM l
"""
