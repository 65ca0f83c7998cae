"""A corpus pipeline: quality rules, language, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read back as the documents of the next; all but the last keep the
columns of their documents, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notes_engine.llm import byte_cnn, decision_list, decontaminate, minhash_dedup, packing
from notes_engine.llm.common import documents, may_hold, release, sieve, stored

LEAST_SCORE = 0.5  # of a language, below which it counts as not known


def _held(docs: DataFrame) -> DataFrame:
    """Whole rows as ``_doc``, so that no column of a stage clashes with theirs, beside what stages read of them."""
    text = F.col("text").cast("string")
    return docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_key"))


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of the documents has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and a decision list learned from the labelled ones among them.

    A null or blank text has fewer than ten words and goes.
    """
    rules = decision_list.learned_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return decision_list.judged(_held(docs), rules).where("kept").select("_doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; all are kept if no text has a language to learn from.

    A null text or one without a letter has none and goes.
    """
    net = byte_cnn.trained(docs)
    if net is None:
        return docs
    named, rated = _free(docs, "lang_pred"), _free(docs, "lang_score")
    told = byte_cnn.with_language(docs, net, named, rated)
    return told.where((F.col(named) != byte_cnn.UNKNOWN) & (F.col(rated) >= LEAST_SCORE)).drop(named, rated)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8).

    Different texts of one id are different documents; rows that repeat an id with
    the same words are one, of which the first in a fixed order stays.  A null id
    is an id like others.  Texts without words are alone, but rows that repeat
    id and text are one.  What is decided of each id and text is kept beside the
    rows; a bitmap of what goes, or must be looked at, lets all other rows pass
    the scan, and only the rest are joined.
    """
    signed = minhash_dedup.judged(docs, width=5)
    own = signed.groupBy("doc_id", "key").agg(F.first("n").alias("n"), F.first("rep").alias("rep"), F.first("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    same = Window.partitionBy("doc_id", F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("rep")))
    told = own.withColumn("stays", F.col("kept") & (F.col("key") == F.min("key").over(same)))
    told = stored(told.where("not stays or rows > 1").select(F.col("doc_id").alias("_id"), F.col("key").alias("_told"), "stays"), "told")
    release(*signed.rests_on)

    rows = _held(docs)
    noted = may_hold(sieve(told, F.xxhash64("_id", "_told")), F.xxhash64("doc_id", "_key"))
    looked = rows.where(noted).join(told, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_told")), "left")
    out = rows.where(~noted).select("_doc.*").unionByName(looked.where("stays is null").select("_doc.*"))
    if told.where("stays").isEmpty():
        return out
    first = F.min_by("_doc", F.to_json("_doc")).alias("_doc")
    return out.unionByName(looked.where("stays").groupBy("doc_id", "_key").agg(first).select("_doc.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark, whatever their ids or the item's: texts are told apart by hash.

    Null, empty and blank texts hold none and stay.
    """
    found = decontaminate.contaminated(_held(docs).select(F.col("_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = stored(found.select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    rows = _held(docs)
    noted = may_hold(sieve(leaks, F.xxhash64("_leak")), F.xxhash64("_key"))
    clean = rows.where(noted).join(leaks, F.col("_key") == F.col("_leak"), "left_anti")
    return rows.where(~noted).select("_doc.*").unionByName(clean.select("_doc.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Learned stages and token ids are beyond SQL; the tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage{k}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
