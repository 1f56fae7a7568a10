"""Queries over streams with state: the buffer, promotion into stores, ingestion through the ledger, traces."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.plans import corpus
from corvane.session import scratch_folder
from corvane.sources.tables import table
from corvane.streaming import buffer, ingest, traces

SLICES = 4
MOST_FILES = 1 << 30
CAPACITY, LIVES = 12, 36


def _arriving(rows: DataFrame, by: str, folder: str) -> Iterator[int]:
    """The number of each of SLICES slices of ``by`` of ``rows``, once it has come to ``folder``; an empty one is a file without rows."""
    low, high = rows.agg(F.min(F.col(by).cast("double")), F.max(F.col(by).cast("double"))).first()
    place = F.least(F.lit(SLICES - 1), F.floor((F.col(by).cast("double") - low) / max(high - low, 1e-9) * SLICES))
    for number in range(SLICES):
        rows.where(place == number).write.mode("append").parquet(folder)
        yield number


def _slices(rows: DataFrame, by: str, name: str) -> str:
    """A folder to which ``rows`` have come in SLICES slices of ``by``, one after the other."""
    folder = scratch_folder(rows.sparkSession, name)
    for _ in _arriving(rows, by, folder):
        pass
    return folder


def _buffer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an item of its user's session, and looks up the item two before it."""
    items = corpus._items(spark, sf_dir)
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    looked = items.select("session_id", F.col("ts").alias("at"), F.lit("lookup").alias("kind"), F.lag("event_id", 2).over(order).alias("event_id"), F.lit(None).cast("double").alias("score"))
    own = items.select("session_id", F.col("ts").alias("at"), F.lit("item").alias("kind"), "event_id", "score")
    return own.unionByName(looked.where("event_id is not null"))


def _buffer_stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return spark.readStream.schema(buffer.ROW).option("maxFilesPerTrigger", 1_000).parquet(_slices(rows, "at", "buffer"))


def stream_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that have left their session's buffer an hour before the newest event, with their lookups."""
    gone = buffer.leaving(_buffer_stream(spark, _buffer_rows(spark, sf_dir)), CAPACITY, LIVES, 2.0)
    newest = corpus._as_of(spark, sf_dir)
    out = corpus._drain(gone, "append", "buffer-left").where(F.col("left_at") < newest - F.expr("INTERVAL 1 HOUR"))
    return out.select("session_id", "event_id", "access_count", "reason")


def stream_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two stores after every session has been promoted an hour behind the newest event."""
    rows = _buffer_rows(spark, sf_dir)
    late = corpus._as_of(spark, sf_dir) + F.expr("INTERVAL 1 HOUR")
    asked = rows.select("session_id").distinct().select("session_id", late.alias("at"), F.lit("promote").alias("kind"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("score"))
    root = scratch_folder(spark, "stores")
    buffer.promote_into(_buffer_stream(spark, rows.unionByName(asked)), root, f"{root}-state", capacity=CAPACITY, hours=24 * 3650, threshold=0.5)
    return buffer.stores(spark, root).select("store", "session_id", "event_id", "access_count", F.round("total", 6).alias("total"))


def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger and chunks of documents that came in slices; the run stops once between chunks and entries of its second batch and
    goes on. Documents of one source fail while it is busy, those of another always."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    root, source = scratch_folder(spark, "ledger"), scratch_folder(spark, "documents")
    stopped: list[int] = []

    def stop(number: int) -> None:
        if number == 1 and not stopped:
            stopped.append(number)
            raise InterruptedError("stopped between chunks and entries")

    def problem(number: int) -> F.Column:
        return F.when((F.col("source") == "src1") & F.lit(number < SLICES - 1), "busy").when(F.col("source") == "src2", "closed")

    for _ in _arriving(docs, "doc_id", source):
        for _ in range(2):
            try:
                # all that has come makes one batch, however many files a slice has
                ingest.ingest_by_ledger(spark, "doc_id long, text string, source string", source, root, problem, stop, MOST_FILES)
                break
            except Exception as error:
                if "stopped between" not in str(error):
                    raise
    shown = ingest.chunks_of(spark, root).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_shown"))
    found = ingest.ledger(spark, root).withColumn("doc_id", F.regexp_extract("file_path", r"(\d+)$", 1).cast("long"))
    return found.join(shown, "doc_id", "left").select("file_hash", "status", "error_msg", (F.col("n_chunks") == F.coalesce("n_shown", F.lit(0).cast("long"))).alias("whole"), (F.col("n_chunks") > 0).alias("has_chunks"))


def stream_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages of their user's traces, in JSON lines of which every fifth is doubled and some are broken; traces that have ended
    two hours before the newest event."""
    events = corpus._events(spark, sf_dir).select(F.col("user_id").alias("trace_id"), "event_type", "event_id", "ts", "value")
    line = F.to_json(F.struct(F.col("trace_id").cast("string").alias("trace_id"), F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("stage"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"), F.col("value").alias("elapsed_ms")))
    lines = events.select("ts", F.explode(F.when(F.col("event_id") % 5 == 0, F.array(line, line)).when(F.col("event_id") % 7 == 3, F.array(line, F.concat(F.lit("{"), line))).otherwise(F.array(line))).alias("value"))
    folder = scratch_folder(spark, "traces")
    low, high = lines.agg(F.min(F.col("ts").cast("double")), F.max(F.col("ts").cast("double"))).first()
    for number in range(SLICES):
        place = F.least(F.lit(SLICES - 1), F.floor((F.col("ts").cast("double") - low) / max(high - low, 1e-9) * SLICES))
        lines.where(place == number).select("value").write.mode("append").text(folder)
    traced = traces.sessions(traces.stages(spark, folder, 1_000), "10 minutes", "30 minutes")
    ended = corpus._drain(traced, "append", "traces-out").where(F.col("finish") < corpus._as_of(spark, sf_dir) - F.expr("INTERVAL 2 HOURS"))
    return ended.select("trace_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n_stages", F.round("elapsed_ms", 3).alias("elapsed_ms"))


QUERIES = {f.__name__: f for f in (stream_buffer, stream_stores, stream_ledger, stream_traces)}
ORACLES = {
    "stream_buffer": f"""WITH {corpus._ITEMS},
n AS (SELECT *, lead(ts, {CAPACITY}) OVER w AS pushed, lead(ts, 2) OVER w AS looked, ts + INTERVAL {LIVES} HOURS AS old FROM items WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
l AS (SELECT *, pushed IS NOT NULL AND pushed < old AS evicted FROM n)
SELECT session_id, event_id, (looked IS NOT NULL AND looked < CASE WHEN evicted THEN pushed ELSE old END)::INTEGER AS access_count, CASE WHEN evicted THEN 'evicted' ELSE 'expired' END AS reason
FROM l, as_of WHERE CASE WHEN evicted THEN pushed ELSE old END < now - INTERVAL 1 HOUR""",
    "stream_stores": f"""WITH {corpus._ITEMS},
n AS (SELECT *, row_number() OVER w AS age, (epoch_us(now) + 3600000000 - epoch_us(ts)) / 3600000000 AS hours FROM items, as_of WINDOW w AS (PARTITION BY session_id ORDER BY ts DESC, event_id DESC)),
t AS (SELECT session_id, event_id, (age > 2)::INTEGER AS access_count, 0.3::DOUBLE * greatest(0, 1 - hours / 24) + 0.5::DOUBLE * score + 0.2::DOUBLE * (1 - exp(-((age > 2)::INTEGER::DOUBLE))) AS total FROM n WHERE age <= {CAPACITY})
SELECT unnest(['long_term', 'episodic']) AS store, session_id, event_id, access_count, round(total, 6) AS total FROM t WHERE total >= 0.5 - 1e-9""",
    "stream_ledger": r"""WITH bounds AS (SELECT min(doc_id) AS low, max(doc_id) - min(doc_id) AS width FROM documents),
d AS (SELECT doc_id, coalesce(text, '') AS text, source, least(3, floor((doc_id - low) / greatest(width, 1e-9) * 4)) AS slice, sha256(coalesce(text, '')) AS file_hash FROM documents, bounds),
tries AS (SELECT *, CASE WHEN trim(text) = '' THEN 'no text' WHEN source = 'src2' THEN 'closed' END AS error_msg FROM d),
firsts AS (SELECT file_hash, arg_min(error_msg IS NULL, (slice, doc_id)) AS ok, arg_min(coalesce(error_msg, ''), (slice, doc_id)) AS error_msg FROM tries GROUP BY file_hash)
SELECT file_hash, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, CASE WHEN NOT ok THEN error_msg END AS error_msg, true AS whole, ok AS has_chunks FROM firsts""",
    "stream_traces": """WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum((before IS NULL OR ts >= before + INTERVAL 30 MINUTES)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id::VARCHAR AS trace_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n_stages, round(sum(value), 3) AS elapsed_ms FROM s GROUP BY user_id, session
HAVING max(ts) + INTERVAL 30 MINUTES < (SELECT max(ts) FROM events) - INTERVAL 2 HOURS""",
}
