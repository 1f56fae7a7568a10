"""Incremental ingestion: a file stream whose batches are chunked once, and one whose batches go through the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import chunking
from corvane.sources.tables import exists

ENTRY = "file_hash string, file_path string, status string, error_msg string, n_chunks long, attempts int"


def ingest_new(spark: SparkSession, schema: str, source: str, sink: str, checkpoint: str) -> None:
    """Chunk the documents of files that have come to ``source`` since the last call, into ``sink``.

    The checkpoint remembers which files are done, so a call after a failure goes on where it stopped. A batch
    is written under its number and a repeated batch overwrites itself: each document is ingested once.
    """

    def write(batch: DataFrame, number: int) -> None:
        docs = batch.withColumn("source_path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")))
        chunks = chunking.with_chunk_ids(chunking.sections(docs))
        chunks.select("doc_id", "chunk_id", "chunk_index", "text").write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ledger(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The last entry of each file hash (ENTRY) in the ledger below ``root``, of batches before ``before``."""
    if not exists(spark, f"{root}/ledger"):
        return spark.createDataFrame([], ENTRY)
    entries = spark.read.schema(f"{ENTRY}, batch int").parquet(f"{root}/ledger")
    entries = entries if before is None else entries.where(F.col("batch") < before)
    names = [c.split()[0] for c in ENTRY.split(", ")]
    last = entries.groupBy("file_hash").agg(F.max_by(F.struct(*names), "batch").alias("e"))
    return last.select("e.*")


def waiting(spark: SparkSession, root: str, schema: str, before: int) -> DataFrame:
    """The documents whose last entry says failed, as they were kept when they failed."""
    if not exists(spark, f"{root}/failed"):
        return spark.createDataFrame([], schema).withColumn("file_hash", F.lit(""))
    failed = ledger(spark, root, before).where("status = 'failed'").select("file_hash")
    kept = spark.read.schema(f"{schema}, file_hash string, batch int").parquet(f"{root}/failed").where(F.col("batch") < before)
    return kept.join(failed, "file_hash").drop("batch").dropDuplicates(["file_hash"])


def ingest_by_ledger(
    spark: SparkSession,
    schema: str,
    source: str,
    root: str,
    problem: Callable[[int], Column] | None = None,
    before_entry: Callable[[int], None] | None = None,
    files_per_batch: int = 100,
) -> None:
    """Chunk the documents (doc_id, text and others, as in ``schema``) of files that have come to ``source`` since the last call.

    Each batch reads the ledger below ``root`` and writes to it: a text that is in it with success is not chunked again, whatever file it
    comes in; one that has failed comes again with every later batch until it succeeds. A document fails if its text is
    null or blank, or if ``problem`` (of the batch's number) gives a message for it; others go on. Chunks, kept failures and entries
    are written under the batch's number, the entries last. A batch that is repeated after a crash sees the ledger as it
    was before it and overwrites what it had written, so it changes nothing. ``before_entry`` is called between chunks and entries.
    """
    root = root.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        # of equal texts in a batch the one with the least id counts
        first = batch.withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
        names = [c for c in first.columns if c != "file_hash"]
        first = first.groupBy("file_hash").agg(F.min_by(F.struct(*names), "doc_id").alias("d")).select("d.*", "file_hash")
        known = ledger(spark, root, number)
        fresh = first.join(known.select("file_hash"), "file_hash", "left_anti")
        again = waiting(spark, root, schema, number)
        todo = fresh.unionByName(again.select(*fresh.columns))
        wrong = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", F.lit("no text")).otherwise(problem(number) if problem else F.lit(None).cast("string"))
        judged = todo.withColumn("error_msg", wrong).withColumn("source_path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).persist()
        good, bad = judged.where("error_msg is null"), judged.where("error_msg is not null")
        chunks = chunking.with_chunk_ids(chunking.sections(good.select("doc_id", "text", "source_path")))
        chunks.select("doc_id", "chunk_id", "chunk_index", "text").write.mode("overwrite").parquet(f"{root}/chunks/batch={number}")
        bad.select(*names, "file_hash").write.mode("overwrite").parquet(f"{root}/failed/batch={number}")
        if before_entry:
            before_entry(number)
        counts = spark.read.parquet(f"{root}/chunks/batch={number}").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
        entries = judged.join(counts, "doc_id", "left").join(known.select("file_hash", F.col("attempts").alias("before")), "file_hash", "left")
        status = F.when(F.col("error_msg").isNull(), "success").otherwise("failed")
        entries = entries.select("file_hash", F.col("source_path").alias("file_path"), status.alias("status"), "error_msg", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"), (F.coalesce("before", F.lit(0)) + 1).alias("attempts"))
        entries.write.mode("overwrite").parquet(f"{root}/ledger/batch={number}")
        judged.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def chunks_of(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of all batches that have an entry in the ledger: of a batch that has crashed before it, none are shown."""
    schema = "doc_id long, chunk_id string, chunk_index int, text string, batch int"
    done = spark.read.schema(f"{ENTRY}, batch int").parquet(f"{root}/ledger").select("batch").distinct()
    return spark.read.schema(schema).parquet(f"{root}/chunks").join(F.broadcast(done), "batch")
