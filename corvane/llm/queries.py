"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import align, bpe, chat, embedding_dedup, hard_negatives, line_dedup, mixing, quality, secrets, sharding, simhash, url_filter, warc
from corvane.llm.common import table
from corvane.session import scratch_folder


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = scratch_folder(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), archive)
    return warc.read_records(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_embeddings(table(spark, sf_dir, "embeddings"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_digests(table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.with_probe(spark, table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash_dedup, op3_quality_rules, op4_source_mixing, op5_url_filter, op6_warc_archive, op7_line_dedup, op8_sharding, op9_secret_scan, op10_embedding_dedup, op11_token_align, op12_chat_format, op13_hard_negatives)}
ORACLES = {"op4_source_mixing": mixing.ORACLE, "op5_url_filter": url_filter.ORACLE, "op6_warc_archive": warc.ORACLE, "op8_sharding": sharding.ORACLE, "op12_chat_format": chat.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
