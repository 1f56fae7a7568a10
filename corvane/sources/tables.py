"""The provided tables in the shapes that the operators take."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for inputs of few and small files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(spark: SparkSession, path: str) -> str:
    """A name for the present state of a table's files: their names, sizes and times of change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    state = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    return hashlib.sha256(repr(state).encode()).hexdigest()[:24]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def source_path(source: Column, doc_id: Column) -> Column:
    return F.concat(F.lit("data/documents/"), source, F.lit("/"), doc_id.cast("string"), F.lit(".md"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, source_path, doc_type, collection, doc_hash: documents as the ingestion sees them."""
    raw = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return raw.select(
        "doc_id",
        "text",
        source_path(F.col("source"), F.col("doc_id")).alias("source_path"),
        F.col("lang").alias("doc_type"),
        F.col("source").alias("collection"),
        F.sha2("text", 256).alias("doc_hash"),
    )
