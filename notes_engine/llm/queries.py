"""Queries op1 to op13 of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, compaction, conversation_repair, decision_list, decontaminate, fingerprints, merkle, packing, ppm_scoring, quality_net, token_files, whitening
from .common import documents, fold, scratch_dir
from .minhash_dedup import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scoring.scored(documents(spark, sf_dir), fold("doc_id", 7) == 2)


def op2_elias_fano_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(documents(spark, sf_dir)))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = decision_list.learned_from(docs, _table(spark, sf_dir, "labels"))
    return decision_list.judged(docs.select("doc_id", "text"), rules).select("doc_id", *decision_list.STATS, "base_failed", "kept", "rule")


def op4_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records, against a replica in which some records are damaged and some are gone."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("number"), "url", "html")
    damaged = F.when(F.col("number") % 50 == 7, F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    whole = pages.select("number", merkle.warc_record(F.col("url"), F.col("html")).alias("record"))
    replica = pages.where("number % 101 != 5").select("number", merkle.warc_record(F.col("url"), damaged).alias("record"))
    return merkle.audit(whole, replica)


def op5_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = quality_net.trained(docs.where(fold("doc_id", 5) != 0), _table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    out = quality_net.scored(docs, net)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    net = byte_cnn.trained(docs.where(fold("doc_id", 4) != 2))
    out = byte_cnn.with_language(docs.select("doc_id", "text"), net)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As in its SQL, items without an id are left out."""
    return decontaminate.contaminated(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark").where("item_id is not null"))


def op8_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents appended as small shards and compacted; every row as the last version holds it."""
    docs = documents(spark, sf_dir)
    store = compaction.ShardStore(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}")
    store.append(docs, compaction.arrivals(docs))
    last = store.compact()
    store.vacuum()
    numbers = spark.createDataFrame([(k, i, v["bytes"]) for i, (k, v) in enumerate(sorted(last.shards.items()))], "_shard_id string, shard int, shard_bytes long")
    rows = store.read(last).select("doc_id", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.octet_length("text").alias("text_bytes"), "_shard_id")
    return rows.join(numbers, "_shard_id").select("doc_id", "shard", "shard_bytes", "text_crc32", "text_bytes", F.lit(last.version).alias("version"))


def op9_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def op10_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op11_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(documents(spark, sf_dir))


def op12_trie_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audited(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_merkle_fixity": merkle.ORACLE_SQL, "op7_minhash_containment": decontaminate.ORACLE_SQL}
