"""File sources and sinks: discovery, golden sets, traces, versions of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GOLDEN = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("relevant_chunk_ids", T.ArrayType(T.StringType())),
    T.StructField("expected_chunk_ids", T.ArrayType(T.StringType())),
    T.StructField("expected_sources", T.ArrayType(T.StringType())),
    T.StructField("reference_answer", T.StringType()),
    T.StructField("question_type", T.StringType()),
])
TRACE = "trace_id string, trace_type string, started_at string, finished_at string, stages array<struct<stage:string,timestamp:string,elapsed_ms:double>>, metadata map<string,string>"


def discover_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("pdf",)) -> DataFrame:
    """path, length, modificationTime and content of files below ``path`` with one of the extensions, in either case."""
    both = [f(e.lstrip(".")) for e in extensions for f in (str.lower, str.upper)]
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(dict.fromkeys(both)) + "}").load(path)


def file_hashes(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("file_hash"), "length")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """A golden set from JSON lines (relevant_chunk_ids) or from one JSON document with test_cases."""
    if path.endswith(".jsonl"):
        rows = spark.read.schema(GOLDEN).json(path)
    else:
        whole = spark.read.schema(T.StructType([T.StructField("test_cases", T.ArrayType(GOLDEN))])).option("multiLine", True).json(path)
        rows = whole.select(F.explode("test_cases").alias("c")).select("c.*")
    expected = F.coalesce("expected_chunk_ids", "relevant_chunk_ids", F.array().cast("array<string>"))
    return rows.select(F.sha2("query", 256).alias("query_id"), "query", expected.alias("expected_ids"), "expected_sources", "reference_answer", "question_type")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).json(path)


def append_traces(traces: DataFrame, path: str) -> None:
    traces.write.mode("append").json(path)


def write_version(df: DataFrame, root: str) -> str:
    """Write ``df`` as a new version below ``root``; readers of older versions are not disturbed."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def corpus_metadata(papers: DataFrame) -> DataFrame:
    """One row for each full_id, that with the least local id, without those whose local id is 0."""
    kept = papers.where("local_id <> '0'")
    first = F.min(F.struct("local_id", *[c for c in papers.columns if c not in ("full_id", "local_id")])).alias("first")
    return kept.groupBy("full_id").agg(first).select("full_id", "first.*").select(*papers.columns)
