"""Ledger of ingestion, upserts, removal across stores, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEDGER = ("file_hash", "file_path", "status", "collection", "error_msg", "processed_at", "updated_at")


def pending(files: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Files that are not yet ingested with success; failed ones come again."""
    return files if force else files.join(ledger.where("status = 'success'").select("file_hash"), "file_hash", "left_anti")


def mark(ledger: DataFrame, news: DataFrame, at: Column) -> DataFrame:
    """The ledger with ``news`` (file_hash, file_path, status, collection, error_msg): the first time of processing
    stays, success clears the error, and a failure keeps the collection."""
    old = ledger.select(*[F.col(c).alias(f"old_{c}") for c in LEDGER])
    both = old.join(news.withColumn("fresh", F.lit(True)), F.col("old_file_hash") == F.col("file_hash"), "full")
    fresh = F.col("fresh").isNotNull()
    pick = lambda c: F.when(fresh, F.col(c)).otherwise(F.col(f"old_{c}"))
    failed = F.col("status") == "failed"
    return both.select(
        F.coalesce("file_hash", "old_file_hash").alias("file_hash"),
        pick("file_path").alias("file_path"),
        pick("status").alias("status"),
        F.when(fresh & ~(failed & F.col("old_collection").isNotNull()), F.col("collection")).otherwise(F.col("old_collection")).alias("collection"),
        F.when(fresh, F.when(failed, F.col("error_msg"))).otherwise(F.col("old_error_msg")).alias("error_msg"),
        F.coalesce("old_processed_at", at).alias("processed_at"),
        F.when(fresh, at).otherwise(F.col("old_updated_at")).alias("updated_at"),
    )


def successes(ledger: DataFrame, collection: str | None = None) -> DataFrame:
    """Files ingested with success, the first processed first."""
    kept = ledger.where("status = 'success'")
    return (kept.where(F.col("collection") == collection) if collection else kept).orderBy("processed_at", "file_path")


def forget(ledger: DataFrame, gone: DataFrame) -> DataFrame:
    """The ledger without the files in ``gone`` (file_hash)."""
    return ledger.join(gone.select("file_hash").distinct(), "file_hash", "left_anti")


def delete_where(store: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What is left of a store without the rows that meet a condition, and how many these were; a null keeps its row."""
    hit = F.coalesce(condition, F.lit(False))
    return store.where(~hit), store.where(hit).agg(F.count(F.lit(1)).alias("n_deleted"))


def cascade_delete(stores: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove the documents in ``gone`` (doc_hash) from all stores (name to table and its column of the hash).

    Returns what is left of each store and the number of rows that each lost.
    """
    left, counts = {}, None
    for name, (store, column) in stores.items():
        keys = gone.select(F.col("doc_hash").alias(column)).distinct()
        left[name] = store.join(keys, column, "left_anti")
        lost = store.join(keys, column, "left_semi").agg(F.count(F.lit(1)).alias("n_deleted")).select(F.lit(name).alias("store"), "n_deleted")
        counts = lost if counts is None else counts.unionByName(lost)
    return left, counts


def ingestion_summary(ledger: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files by status, and the chunks of all."""
    files = ledger.agg(F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "skipped").alias("n_skipped"))
    return files.join(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("n_chunks"))))


def tolerant_json(text: Column, schema: str) -> Column:
    """JSON in a text: all of it without code fences, else its first braces, else null."""
    bare = F.trim(F.regexp_replace(text, r"```(?:json)?", ""))
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(F.when(bare.startswith("{"), bare), schema), F.from_json(F.nullif(inner, F.lit("")), schema))


def batch_outcomes(chunks: DataFrame, failed: Column, size: int = 10) -> DataFrame:
    """doc_id, batch, n_texts, n_failed, ok: a document's chunks in batches of ``size``; a failed text fails its batch, for all
    outputs alike."""
    if size < 1:
        raise ValueError("a batch holds one text at least")
    batch = F.floor(F.col("chunk_index") / size).alias("batch")
    counted = chunks.groupBy("doc_id", batch).agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(failed).alias("n_failed"))
    return counted.withColumn("ok", F.col("n_failed") == 0)


def batch_totals(outcomes: DataFrame) -> DataFrame:
    """One row over all ``batch_outcomes``: batches and texts, those that failed and their share, the mean and the largest batch, and documents
    of which a batch failed."""
    texts = F.sum("n_texts")
    lost = F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n_texts"))), F.lit(0))
    return outcomes.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.count_if(~F.col("ok")).alias("failed_batches"),
        F.coalesce(texts, F.lit(0)).alias("n_texts"),
        F.coalesce(F.sum("n_failed"), F.lit(0)).alias("failed_texts"),
        lost.alias("lost_texts"),
        F.round(F.coalesce(1 - lost / texts, F.lit(0.0)), 6).alias("success_rate"),
        F.round(F.avg("n_texts"), 4).alias("mean_batch"),
        F.max("n_texts").alias("largest_batch"),
        F.countDistinct(F.when(~F.col("ok"), F.col("doc_id"))).alias("touched_documents"),
    )
