"""Short test items inside long documents: size-partitioned MinHash containment search.

Similarity of whole sets is useless between an item of 40 shingles and a
document of 20,000, so containment is sought.  Items are partitioned by their
number of shingles, in powers of two.  With upper size u of a partition, at most
a share of (100 - PERCENT) % of u shingles of an item may be missing from a
document; of an item's MinHash sketch, its smallest shingle hashes, one more
than that is kept.  A document that contains PERCENT % of an item must then
contain one hash of the sketch: no match is missed.  Documents are streamed past
the sketches, and the pairs that meet are verified by exact shingle containment.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import may_hold, sieve, stored
from .native_text import shingle_hashes, shingle_texts, words

WIDTH, PERCENT = 5, 80


def _items(items: DataFrame, width: int) -> DataFrame:
    """Items with words: id, words, shingle width (their length where shorter), distinct shingles."""
    w = items.select("item_id", words(F.lower(F.col("text").cast("string"))).alias("w")).where("size(w) > 0").distinct()
    w = w.withColumn("width", F.least(F.size("w"), F.lit(width)))
    shingles = F.lit(None).cast("array<string>")
    for k in range(1, width + 1):
        shingles = F.when(F.col("width") == k, shingle_texts(F.col("w"), k)).otherwise(shingles)
    return w.select("item_id", "width", F.array_distinct(shingles).alias("shingles"))


def _hashed(shingles: str, width: int) -> Column:
    """The hashes that ``shingle_hashes`` gives for shingles of ``width`` words."""
    return F.transform(shingles, lambda s: F.xxhash64(*[F.get(F.split(s, " "), F.lit(j)) for j in range(width)]))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found for each document that holds ``percent`` % of an item.

    ``docs``: doc_id, text; ``items``: item_id, text; more columns are ignored.
    Words are put in lower case.  An item shorter than ``width`` words is one
    shingle of its own length.  Null, empty and blank texts match nothing.  Of
    rows that repeat an id with different texts the best match counts; a null
    doc_id or item_id is an id like others, and is null in the result.  Empty
    tables give an empty table.
    """
    known = stored(_items(items, width), "items")
    widths = sorted(r.width for r in known.select("width").distinct().collect())  # 1 to width at most
    size = F.size("shingles")
    hashed = F.transform("shingles", lambda s: F.lit(0).cast("bigint"))
    for k in widths:
        hashed = F.when(F.col("width") == k, _hashed("shingles", k)).otherwise(hashed)
    upper = F.pow(F.lit(2), F.floor(F.log2("n")) + 1).cast("int") - 1
    sketches = known.select("item_id", size.alias("n"), hashed.alias("h")).withColumn("kept", F.least("n", F.floor(upper * (100 - percent) / 100).cast("int") + 1))
    sketches = stored(sketches.select("item_id", "n", F.explode(F.slice(F.sort_array("h"), F.lit(1), F.col("kept"))).alias("h")), "sketches")

    texts = docs.select(F.col("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    worded = texts.select("doc_id", words(F.col("text")).alias("w"))
    every = F.array().cast("array<bigint>")
    for k in widths:
        every = F.concat(every, shingle_hashes(F.col("w"), k))
    # explode_outer: the filter that explode implies would be pushed below and split each text again and again.
    own = worded.select("doc_id", F.array_distinct(every).alias("hs"))
    shingles = own.select("doc_id", F.size("hs").alias("size"), F.explode_outer("hs").alias("h"))
    # Few shingles of the corpus go on to the join, whatever the size of the sketches.
    met = shingles.where(may_hold(sieve(sketches, F.col("h")), F.col("h"))).join(sketches, "h")
    pairs = stored(met.where(F.col("size") * 100 >= F.col("n") * percent).select("doc_id", "item_id").distinct(), "pairs")

    # Texts of documents in question only.
    pairs = pairs.toDF("_doc", "_item")
    chosen = texts.where(may_hold(sieve(pairs, F.xxhash64("_doc")), F.xxhash64("doc_id"))).join(pairs, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("doc_id", "_item", words(F.col("text")).alias("w"))
    verified = chosen.join(known, F.col("item_id").eqNullSafe(F.col("_item")))
    in_doc = F.lit(None).cast("array<string>")
    for k in widths:
        in_doc = F.when(F.col("width") == k, shingle_texts(F.col("w"), k)).otherwise(in_doc)
    found = verified.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_shingles"), F.size(F.array_intersect("shingles", in_doc)).cast("long").alias("n_found"))
    best = found.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent).groupBy("doc_id", "item_id")
    return best.agg(F.max(F.struct("n_found", "n_shingles")).alias("b")).select("doc_id", "item_id", "b.n_shingles", "b.n_found")


#: Exact containment of every item in every document, for an engine without sketches.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM d WHERE len(w) >= 5),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) AS s FROM i WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id)
SELECT doc_id, item_id, any_value(n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_found
FROM ds JOIN s USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(n) * 80
"""
