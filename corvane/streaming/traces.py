"""Traces as a stream of JSON lines: stages of requests, each counted once, summed up by trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line of the log: one stage of a trace.
STAGE = "trace_id string, stage string, at timestamp, elapsed_ms double"
LATE, GAP = "10 minutes", "5 minutes"


def stages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The stages that are written below ``path`` as JSON lines, as a stream (STAGE, broken).

    A line that is no JSON, or has no trace or no time, is ``broken`` and keeps its text; it belongs to no trace.
    """
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path)
    parsed = lines.select("value", F.from_json("value", STAGE, {"mode": "PERMISSIVE"}).alias("s"))
    whole = F.col("s.trace_id").isNotNull() & F.col("s.at").isNotNull()
    return parsed.select("s.*", F.when(~F.coalesce(whole, F.lit(False)), F.col("value")).alias("broken"))


def sessions(rows: DataFrame, late: str = LATE, gap: str = GAP) -> DataFrame:
    """trace_id, start, finish, n_stages, elapsed_ms: a stream of the traces that have come to an end.

    A stage that comes twice (trace, stage and time alike) counts once; one that comes later than ``late`` behind the newest of the batches before the last is dropped; a
    trace that pauses for ``gap`` goes on as another row.
    """
    once = rows.where("broken is null").withWatermark("at", late).dropDuplicatesWithinWatermark(["trace_id", "stage", "at"])
    whole = once.groupBy("trace_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_stages"), F.sum("elapsed_ms").alias("elapsed_ms"))
    return whole.select("trace_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n_stages", "elapsed_ms")


def collect_traces(spark: SparkSession, source: str, sink: str, checkpoint: str, late: str = LATE, gap: str = GAP) -> None:
    """Append the traces that have ended since the last call to ``sink`` as Parquet."""
    out = sessions(stages(spark, source, 1), late, gap)
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
