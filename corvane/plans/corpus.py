"""Queries over document tools, evidence, memory, lifecycle and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import ids, text
from corvane.operators import documents, evaluate, evidence, lifecycle, memory, search
from corvane.plans import retrieval, sql, texts
from corvane.session import scratch_folder, staged
from corvane.sources.tables import source_path, spread, table
from corvane.streaming import memory as stream_memory

AT = "2024-06-01 00:00:00"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each line that isn't blank as a chunk."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    lines = F.filter(F.split("text", "\n"), lambda line: text.strip(line) != "")
    path = source_path(F.col("source"), F.col("doc_id"))
    parts = docs.select("doc_id", F.col("source").alias("collection"), F.col("lang").alias("doc_type"), path.alias("source_path"), F.posexplode(lines).alias("chunk_index", "text"))
    return parts.withColumn("chunk_id", ids.stored_chunk_id(F.col("source_path"), F.col("chunk_index"), F.col("text")))


def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.list_documents(paragraphs(spark, sf_dir))


def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.list_collections(paragraphs(spark, sf_dir))


def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.summary(paragraphs(spark, sf_dir))


def document_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth line is made a heading, so that documents have sections."""
    chunks = paragraphs(spark, sf_dir).withColumn("text", F.when(F.col("chunk_index") % 5 == 3, F.concat(F.lit("## "), "text")).otherwise(F.col("text")))
    return documents.outline(chunks)


def document_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents.full_text(paragraphs(spark, sf_dir))
    return found.select("doc_id", "n_chunks", F.length("full_text").alias("n_chars"), F.sha2("full_text", 256).alias("sha"))


def neighbor_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = paragraphs(spark, sf_dir)
    return documents.neighbours(chunks, chunks, 2)


def read_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.read_chunk(paragraphs(spark, sf_dir), "_0003_a").select("doc_id", "chunk_id")


def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.statistics(paragraphs(spark, sf_dir))


def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = paragraphs(spark, sf_dir).withColumn("tags", F.array(F.col("doc_type"), F.lit("all")))
    return search.metadata_filter(tagged, doc_type="en", tags=["en", "fr"], source_path="/src1").select("doc_id", "chunk_id")


def structural_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("Main").alias("heading"))
    return documents.structural(whole, has_table=True, has_image=False, exclude_references=True, exclude_appendix=True, title="main").select("doc_id")


def has_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", text.has_table(F.col("text")).alias("has_table"), text.has_image(F.col("text")).alias("has_image"), text.is_references(F.lit(""), F.col("text")).alias("is_references"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = retrieval.bm25_batch(spark, sf_dir)
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), source_path(F.col("source"), F.col("doc_id")).alias("source_path"), "text")
    return evidence.citations(results, chunks, 150)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer_id, doc_id: the documents that an answer names, its three best and two that may not exist."""
    top = retrieval.bm25_batch(spark, sf_dir).where("rank <= 3").select(F.col("query_id").alias("answer_id"), F.col("chunk_id").alias("doc_id"))
    more = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), F.explode(F.array(F.col("item_id") * 37, F.col("item_id") * 1_009)).alias("doc_id"))
    return top.union(more).distinct()


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark passages as answers, the documents that they name as evidence."""
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), "text")
    return answers, _evidence(spark, sf_dir, _asked(spark, sf_dir))


def _evidence(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    return asked.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def evidence_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.support(*_answers(spark, sf_dir))


def evidence_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), "text")
    asked = staged(_asked(spark, sf_dir), "asked")  # searched once
    chunks = _evidence(spark, sf_dir, asked)
    weak = evidence.support(answers, chunks).groupBy("answer_id").agg(F.count_if("unsupported").alias("n_unsupported"))
    found = chunks.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_found"), F.count_if(text.is_references(F.lit(""), F.col("text"))).alias("n_references"))
    facts = answers.select("answer_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"), text.has_citation(F.col("text")).alias("cited"))
    known = table(spark, sf_dir, "documents").select("doc_id").distinct()
    missing = asked.join(known, "doc_id", "left_anti").groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_missing"))
    facts = facts.join(weak, "answer_id", "left").join(found, "answer_id", "left").join(missing, "answer_id", "left").na.fill(0)
    return evidence.verdicts(facts, 2).select("answer_id", "n_found", "n_missing", "n_sentences", "n_unsupported", "score", "passed")


def evidence_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries make a session; each is a step of it."""
    hits = staged(retrieval.bm25_batch(spark, sf_dir), "hits")  # searched once
    return evidence.novelty(hits.select(F.floor(F.col("query_id") / 3).alias("session"), (F.col("query_id") % 3).alias("step"), "chunk_id"))


def error_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as lines of a log; refunds and clicks count as errors."""
    events = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type").isin("refund", "click", "error"), F.lit("[ERROR] x")).when(F.col("event_id") % 11 == 0, "  ").otherwise("ok")
    return evidence.error_streaks(events.select(F.col("user_id").alias("session"), F.col("event_id").alias("position"), line.alias("line")))


def eval_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.element_at(F.array(F.lit("ok"), F.lit("needs_replan"), F.lit("hard_fail"), F.lit("odd")), (F.col("event_id") % 4 + 1).cast("int"))
    rows = e.select("event_id", status.alias("status"), (F.col("value") / 50).alias("score"), (F.col("event_id") % 2 == 0).alias("passed"), (F.col("event_id") % 3 == 0).alias("require_more_tools"), F.repeat("props", 30).alias("issues"))
    return evidence.consistent(rows)


def answer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = memory.qa_pairs(table(spark, sf_dir, "conversations"))
    rows = pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "question", "answer")
    return evaluate.answer_overlap(rows)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select(F.col("user_id").alias("session_id"), "event_id", "ts", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("score"))


def _as_of(spark: SparkSession, sf_dir: str) -> F.Column:
    return F.lit(_events(spark, sf_dir).agg(F.max("ts")).first()[0])


def short_term_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.newest(_items(spark, sf_dir), 5).select("session_id", "event_id", "age")


def access_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.access_counts(_items(spark, sf_dir)).select("session_id", "event_id", "access_count")


def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = memory.access_counts(_items(spark, sf_dir))
    return memory.promoted(counted, _as_of(spark, sf_dir)).select("event_id", "total", "promoted")


def episodic_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = memory.recent(_items(spark, sf_dir), _as_of(spark, sf_dir))
    return memory.newest(kept, 2).select("session_id", "event_id", "age")


def memory_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as memory items; every seventh has none and keeps a stored score."""
    v = table(spark, sf_dir, "embeddings")
    query = v.where("vec_id = 0").select("embedding").first()[0]
    items = v.select(F.col("vec_id").alias("item_id"), F.when(F.col("vec_id") % 7 == 3, F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("embedding"), (F.col("vec_id") % 10 / 40).alias("score"))
    return memory.lookup(items, F.array(*[F.lit(float(x)) for x in query])).select("item_id", "similarity")


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.qa_pairs(table(spark, sf_dir, "conversations"))


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = memory.context_window(memory.qa_pairs(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "n_pairs", F.sha2("context", 256).alias("context_sha"))


def compress_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.sha2(memory.compressed(F.col("text")), 256).alias("compressed_sha"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger as after an earlier run: even documents are in it, those divisible by 3 failed."""
    docs = spread(table(spark, sf_dir, "documents"))
    first = docs.groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("collection")).where("doc_id % 2 = 0")
    failed = F.col("doc_id") % 3 == 0
    return first.select(
        "file_hash",
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file_path"),
        F.when(failed, "failed").otherwise("success").alias("status"),
        "collection",
        F.when(failed, "broken").alias("error_msg"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("processed_at"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"),
    )


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    first = docs.groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id")).where("doc_id % 3 <> 1")
    failed = F.col("doc_id") % 5 == 0
    return first.select("file_hash", F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("file_path"), F.when(failed, "failed").otherwise("success").alias("status"), F.lit("fresh").alias("collection"), F.when(failed, "again").alias("error_msg"))


def ledger_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spread(table(spark, sf_dir, "documents")).select(F.sha2("text", 256).alias("file_hash"), "doc_id")
    return lifecycle.pending(files, _ledger(spark, sf_dir)).select("doc_id", "file_hash")


def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lifecycle.mark(_ledger(spark, sf_dir), _news(spark, sf_dir), F.lit(AT).cast("timestamp"))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("processed_at", "updated_at")})


def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators import index

    chunks = paragraphs(spark, sf_dir).groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    incoming = chunks.where("doc_id % 4 = 0").withColumn("doc_id", F.col("doc_id") + 100_000)
    return index.upsert(chunks, incoming)


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("doc_hash"))
    labels = table(spark, sf_dir, "labels").join(hashed, "doc_id").select("doc_id", "doc_hash")
    _, counts = lifecycle.cascade_delete({"documents": (hashed, "doc_hash"), "labels": (labels, "doc_hash"), "ledger": (_ledger(spark, sf_dir), "file_hash")}, hashed.where("doc_id % 10 = 0").select("doc_hash"))
    return counts


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.ingestion_summary(_ledger(spark, sf_dir), paragraphs(spark, sf_dir))


def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties as a model might return them: fenced, within prose, or broken."""
    e = table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), "props", F.lit(" ok"))).otherwise("no json")
    return e.select("event_id", lifecycle.tolerant_json(said, "k bigint")["k"].alias("k"))


def trace_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages of traces: number, share and time of each type."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    return e.groupBy(F.col("user_id").alias("trace_id"), F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("elapsed_ms"), F.round(F.max("value"), 2).alias("longest_ms"))


def memory_inspector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("session_id", "event_id", F.round("score", 6).alias("score"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream: a folder of files, or the one file that a glob names."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there; every batch becomes a folder of rows."""
    spark = stream.sparkSession
    out, checkpoint = scratch_folder(spark, name), scratch_folder(spark, f"{name}-state")
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema.add("batch", T.IntegerType())).parquet(out)


def stream_short_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of every session after all events have come."""
    events = _event_stream(spark, sf_dir).select(F.col("user_id").alias("session_id"), "event_id", "ts", F.col("value").alias("score"))
    states = _drain(stream_memory.short_term(events, 20), "update", "short-term")
    last = states.groupBy("session_id").agg(F.max_by(F.struct("n_held", "evicted", "oldest_event", "newest_event"), F.col("n_held") + F.col("evicted")).alias("s"))
    return last.select("session_id", "s.*")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed once all events have come."""
    found = _drain(stream_memory.windowed_counts(_event_stream(spark, sf_dir)), "append", "windows")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("value", 3).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (list_documents, list_collections, document_summary, document_outline, document_full_text, neighbor_chunks, read_chunk, document_stats, metadata_filter, structural_filter, has_table, citations, evidence_support, evidence_verdict, evidence_novelty, error_streak, eval_consistency, answer_overlap, short_term_fifo, access_counts, promotion, episodic_recent, memory_topk, qa_pairs, context_window, compress_fallback, ledger_skip, ledger_upsert, chunk_upsert, cascade_delete, ingest_summary, json_parse, trace_stages, memory_inspector, stream_short_term, stream_windows)
}

_S = sql.STRIP
_P = f"WITH {sql.PARAGRAPHS}"
_SUPPORT = rf"""{sql.bm25(sql.BENCH_TERMS)},
cut AS (SELECT item_id AS answer_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?])\s+|\n+', '\1' || chr(31), 'g'), chr(31)), lambda s: {_S.format("s")}), lambda s: s <> '') AS parts FROM benchmark),
sent AS (SELECT answer_id, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS position FROM cut),
tok AS (SELECT answer_id, position, {sql.EVIDENCE_TOKENS.format("s")} AS tokens FROM sent),
words AS (SELECT answer_id, position, len(tokens) AS n_tokens, unnest(tokens) AS token FROM tok WHERE len(tokens) >= 4),
asked AS (SELECT query_id AS answer_id, chunk_id AS doc_id FROM sparse WHERE rank <= 3 UNION SELECT item_id, unnest([item_id * 37, item_id * 1009]) FROM benchmark),
ev AS (SELECT answer_id, doc_id, text FROM asked JOIN documents USING (doc_id)),
known AS (SELECT DISTINCT answer_id, unnest({sql.EVIDENCE_TOKENS.format("text")}) AS token, 1 AS hit FROM ev),
support AS (SELECT answer_id, position::INTEGER AS position, any_value(n_tokens)::INTEGER AS n_tokens, count(hit) / any_value(n_tokens) AS raw FROM words LEFT JOIN known USING (answer_id, token) GROUP BY answer_id, position)"""
_ITEMS = "items AS (SELECT user_id AS session_id, event_id, ts, least(1.0, greatest(0.0, value / 100)) AS score FROM events), as_of AS (SELECT max(ts) AS now FROM events)"
_QA = """pairs AS (SELECT conv_id, turn, text AS question, answer FROM (
  SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE role = 'user' AND next_role = 'assistant')"""
_LEDGER = """firsts AS (SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS collection FROM documents GROUP BY 1),
ledger AS (SELECT file_hash, 'doc/' || doc_id AS file_path, CASE WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'success' END AS status, collection, CASE WHEN doc_id % 3 = 0 THEN 'broken' END AS error_msg FROM firsts WHERE doc_id % 2 = 0)"""
ORACLES = {
    "list_documents": f"""{_P},
first AS (SELECT doc_id, source_path, lang AS doc_type, count(*)::BIGINT AS chunk_count, arg_min(text, chunk_index) AS text FROM chunks GROUP BY doc_id, source_path, lang)
SELECT doc_id, source_path, doc_type, chunk_count, {texts.TITLE} AS title FROM first""",
    "document_summary": rf"""{_P},
said AS (SELECT doc_id, chunk_index, {_S.format("text")} AS line FROM chunks)
SELECT doc_id, substr(coalesce(arg_min(line, chunk_index) FILTER (line <> '' AND NOT regexp_matches(line, '^#{{1,6}}\s')), ''), 1, 500) AS summary, count(*)::BIGINT AS chunk_count FROM said GROUP BY doc_id""",
    "list_collections": f"{_P} SELECT source AS collection, count(*)::BIGINT AS n_chunks FROM chunks GROUP BY source",
    "document_outline": rf"""{_P},
marked AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index % 5 = 3 THEN '## ' || text ELSE text END AS text FROM chunks),
own AS (SELECT *, CASE WHEN regexp_matches(text, '^#{{1,6}}\s+') THEN coalesce(nullif({_S.format(r"regexp_replace(regexp_replace(regexp_replace(" + _S.format("string_split(" + _S.format("text") + ", chr(10))[1]") + r", '^#+\s*', ''), '\*\*|__|`', '', 'g'), '<[^>]+>', '', 'g')")}, ''), 'Untitled Section') END AS own FROM marked),
placed AS (SELECT *, count(own) OVER w AS section, coalesce(last_value(own IGNORE NULLS) OVER w, 'Front Matter') AS heading FROM own WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, section::BIGINT AS section, heading, count(*)::BIGINT AS n_chunks, bool_or(false) AS has_table, bool_or(contains(text, '[IMAGE:')) AS has_image FROM placed GROUP BY doc_id, section, heading""",
    "document_full_text": rf"""{_P},
kept AS (SELECT * FROM chunks WHERE NOT regexp_matches(lower({_S.format("text")}), '^(## \*\*|## |# )(references|appendix)')),
joined AS (SELECT doc_id, count(*)::INTEGER AS n_chunks, string_agg({_S.format("text")}, chr(10) || chr(10) ORDER BY chunk_index) AS t FROM kept GROUP BY doc_id),
cut AS (SELECT doc_id, n_chunks, CASE WHEN length(t) > 120000 THEN substr(t, 1, 119980) || chr(10) || '...[truncated]' ELSE t END AS t FROM joined)
SELECT doc_id, n_chunks, length(t)::INTEGER AS n_chars, sha256(t) AS sha FROM cut""",
    "neighbor_chunks": f"""{_P},
placed AS (SELECT doc_id, chunk_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, chunk_id)::INTEGER AS position FROM chunks)
SELECT t.chunk_id AS target_id, c.chunk_id, c.position - t.position AS relative_position FROM placed t JOIN placed c ON c.doc_id = t.doc_id AND abs(c.position - t.position) <= 2""",
    "read_chunk": f"{_P} SELECT doc_id, chunk_id FROM chunks WHERE contains(chunk_id, '_0003_a') ORDER BY chunk_id LIMIT 1",
    "document_stats": rf"{_P} SELECT count(DISTINCT doc_id)::BIGINT AS n_documents, count(*)::BIGINT AS n_chunks, coalesce(sum(len(regexp_extract_all(text, '\[IMAGE:\s*([^\]\s]+)\s*\]'))), 0)::BIGINT AS n_images, floor(avg(length(text)))::BIGINT AS avg_chars FROM chunks",
    "metadata_filter": f"{_P} SELECT doc_id, chunk_id FROM chunks WHERE lang = 'en' AND contains(source_path, '/src1')",
    "structural_filter": rf"SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda l: length(l) - length(replace(l, '|', '')) >= 2)) >= 2 AND NOT contains(text, '[IMAGE:') AND NOT regexp_matches(lower({_S.format('text')}), '^(## \*\*|## |# )(references|appendix)')",
    "has_table": rf"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: length(l) - length(replace(l, '|', '')) >= 2)) >= 2 AS has_table, contains(text, '[IMAGE:') AS has_image, regexp_matches(lower({_S.format('text')}), '^(## \*\*|## |# )references') AS is_references FROM documents",
    "citations": f"""WITH {sql.bm25(sql.BENCH_TERMS)},
flat AS (SELECT doc_id, {sql.PATH} AS source_path, {sql.COLLAPSE.format("text")} AS t FROM documents)
SELECT query_id, rank AS index, chunk_id, source_path AS source, score,
       CASE WHEN length(t) <= 150 THEN t ELSE coalesce(nullif(regexp_extract(substr(t, 1, 150), '(?s)^(.*) [^ ]*$', 1), ''), substr(t, 1, 150)) || '...' END AS text_snippet FROM sparse JOIN flat ON doc_id = chunk_id""",
    "evidence_support": f"WITH {_SUPPORT} SELECT answer_id, position, n_tokens, round(raw, 6) AS overlap, raw < 0.1 AS unsupported FROM support",
    "evidence_verdict": rf"""WITH {_SUPPORT},
weak AS (SELECT answer_id, count_if(raw < 0.1) AS n_unsupported FROM support GROUP BY answer_id),
found AS (SELECT answer_id, count(*) AS n_found, count_if(regexp_matches(lower({_S.format("text")}), '^(## \*\*|## |# )references')) AS n_references FROM ev GROUP BY answer_id),
facts AS (SELECT answer_id, len(parts)::INTEGER AS n_sentences, coalesce(n_unsupported, 0)::BIGINT AS n_unsupported, coalesce(n_found, 0)::BIGINT AS n_found, coalesce(n_references, 0) AS n_references, coalesce(n_missing, 0)::BIGINT AS n_missing FROM cut LEFT JOIN weak USING (answer_id) LEFT JOIN found USING (answer_id)
  LEFT JOIN (SELECT answer_id, count(*) AS n_missing FROM asked WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY answer_id) USING (answer_id))
SELECT answer_id, n_found, n_missing, n_sentences, n_unsupported,
  round(greatest(0, least(1, 0.45 * least(n_found / 2, 1) + 0.4 * CASE WHEN n_unsupported = 0 THEN 1 ELSE greatest(0, 1 - n_unsupported / greatest(n_sentences, 1)) END + 0.15 - least(n_missing * 0.15, 0.45) - CASE WHEN n_references > 0 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS score,
  (n_found >= 2 OR (n_found > 0 AND n_missing > 0 AND n_found / greatest(n_found + n_missing, 1) >= 0.5)) AND n_unsupported <= greatest(1, floor(n_sentences * 0.3)) AS passed FROM facts""",
    "evidence_novelty": f"""WITH {sql.bm25(sql.BENCH_TERMS)},
steps AS (SELECT DISTINCT query_id // 3 AS session, query_id % 3 AS step, chunk_id FROM sparse),
firsts AS (SELECT *, min(step) OVER (PARTITION BY session, chunk_id) AS first FROM steps)
SELECT session, step, count(*)::BIGINT AS n_ids, count_if(step = first)::BIGINT AS n_new FROM firsts GROUP BY session, step""",
    "error_streak": """
WITH lines AS (SELECT user_id AS session, event_id AS position, event_type IN ('refund', 'click', 'error') AS bad FROM events WHERE event_type IN ('refund', 'click', 'error') OR event_id % 11 <> 0),
islands AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY position) - row_number() OVER (PARTITION BY session, bad ORDER BY position) AS island FROM lines),
runs AS (SELECT session, bad, island, count(*) AS n FROM islands GROUP BY session, bad, island)
SELECT session, coalesce(max(CASE WHEN bad THEN n END), 0)::BIGINT AS longest, coalesce(max(CASE WHEN bad THEN n END), 0) >= 3 AS streak FROM runs GROUP BY session""",
    "eval_consistency": """
WITH raw AS (SELECT event_id, ['ok', 'needs_replan', 'hard_fail', 'ok'][(event_id % 4 + 1)::INT] AS status, greatest(0, least(1, value / 50)) AS s, event_id % 2 = 0 AS p, event_id % 3 = 0 AS m, repeat(props, 30) AS i FROM events)
SELECT event_id, status, round(CASE WHEN status = 'hard_fail' THEN least(s, 0.2) ELSE s END, 6)::DOUBLE AS score, p AND status = 'ok' AS passed, m AND status = 'ok' AS require_more_tools, substr(i, 1, 200) AS issues FROM raw""",
    "answer_overlap": f"""WITH {_QA},
w AS (SELECT conv_id * 1000 + turn AS answer_id, length(answer)::INTEGER AS n_chars, list_distinct(regexp_extract_all(question, '[一-鿿]{{2,}}|[a-zA-Z]{{3,}}')) AS q, list_distinct(regexp_extract_all(answer, '[一-鿿]{{2,}}|[a-zA-Z]{{3,}}')) AS a FROM pairs)
SELECT answer_id, n_chars, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / len(q) ELSE 0 END, 6)::DOUBLE AS overlap FROM w""",
    "short_term_fifo": f"WITH {_ITEMS} SELECT session_id, event_id, age FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC)::INTEGER AS age FROM items) WHERE age <= 5",
    "access_counts": f"WITH {_ITEMS} SELECT session_id, event_id, least(10, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC))::INTEGER AS access_count FROM items",
    "promotion": f"""WITH {_ITEMS},
c AS (SELECT *, least(10, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC)) AS n, (epoch_us(now) - epoch_us(ts)) / 3600000000 AS hours FROM items, as_of),
t AS (SELECT event_id, 0.3::DOUBLE * greatest(0, 1 - hours / 24) + 0.5::DOUBLE * score + 0.2::DOUBLE * (1 - exp(-n::DOUBLE)) AS total FROM c)
SELECT event_id, round(total, 6) AS total, total >= 0.7 - 1e-9 AS promoted FROM t""",
    "episodic_recent": f"WITH {_ITEMS} SELECT session_id, event_id, age FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC)::INTEGER AS age FROM items, as_of WHERE ts >= now - INTERVAL 7 DAYS) WHERE age <= 2",
    "memory_topk": """
WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id AS item_id, round(CASE WHEN vec_id % 7 = 3 THEN vec_id % 10 / 40 ELSE greatest(0, list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[])) END, 6)::DOUBLE AS similarity FROM embeddings, q)
SELECT item_id, similarity FROM s ORDER BY similarity DESC, item_id LIMIT 8""",
    "qa_pairs": f"WITH {_QA} SELECT * FROM pairs",
    "context_window": f"""WITH {_QA},
aged AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM pairs)
SELECT conv_id, count(*)::INTEGER AS n_pairs, sha256(string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) || chr(10) ORDER BY turn)) AS context_sha FROM aged WHERE age <= 5 GROUP BY conv_id""",
    "compress_fallback": rf"SELECT doc_id, sha256(substr(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?]\s*'), lambda s: {_S.format('s')}), lambda s: s <> '')[1:5], '. '), 1, 2048)) AS compressed_sha FROM documents",
    "ledger_skip": f"WITH {_LEDGER} SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE sha256(text) NOT IN (SELECT file_hash FROM ledger WHERE status = 'success')",
    "ledger_upsert": f"""WITH {_LEDGER},
news AS (SELECT file_hash, 'new/' || doc_id AS file_path, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN doc_id % 5 = 0 THEN 'again' END AS error_msg FROM firsts WHERE doc_id % 3 <> 1)
SELECT coalesce(n.file_hash, l.file_hash) AS file_hash, coalesce(n.file_path, l.file_path) AS file_path, coalesce(n.status, l.status) AS status,
       CASE WHEN n.file_hash IS NULL OR (n.status = 'failed' AND l.collection IS NOT NULL) THEN l.collection ELSE 'fresh' END AS collection,
       CASE WHEN n.file_hash IS NULL THEN l.error_msg ELSE n.error_msg END AS error_msg,
       CASE WHEN l.file_hash IS NOT NULL THEN '2024-01-01' ELSE '2024-06-01' END AS processed_at, CASE WHEN n.file_hash IS NULL THEN '2024-01-01' ELSE '2024-06-01' END AS updated_at
FROM ledger l FULL JOIN news n ON l.file_hash = n.file_hash""",
    "chunk_upsert": f"{_P}, ones AS (SELECT chunk_id, min(doc_id) AS doc_id FROM chunks GROUP BY chunk_id) SELECT chunk_id, CASE WHEN doc_id % 4 = 0 THEN doc_id + 100000 ELSE doc_id END AS doc_id FROM ones",
    "cascade_delete": f"""WITH {_LEDGER},
gone AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE doc_id % 10 = 0)
SELECT 'documents' AS store, count(*)::BIGINT AS n_deleted FROM documents WHERE sha256(text) IN (SELECT h FROM gone)
UNION ALL SELECT 'labels', count(*)::BIGINT FROM labels JOIN documents USING (doc_id) WHERE sha256(text) IN (SELECT h FROM gone)
UNION ALL SELECT 'ledger', count(*)::BIGINT FROM ledger WHERE file_hash IN (SELECT h FROM gone)""",
    "ingest_summary": f"WITH {_LEDGER}, {sql.PARAGRAPHS} SELECT count_if(status = 'success')::BIGINT AS n_success, count_if(status = 'failed')::BIGINT AS n_failed, count_if(status = 'skipped')::BIGINT AS n_skipped, (SELECT count(*) FROM chunks)::BIGINT AS n_chunks FROM ledger",
    "json_parse": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events",
    "trace_stages": "SELECT user_id AS trace_id, event_type AS stage, count(*)::BIGINT AS n, round(sum(value), 2) AS elapsed_ms, round(max(value), 2) AS longest_ms FROM events GROUP BY user_id, event_type",
    "memory_inspector": f"WITH {_ITEMS} SELECT session_id, event_id, round(score, 6)::DOUBLE AS score FROM items ORDER BY ts DESC, event_id DESC LIMIT 10",
    "stream_short_term": """
WITH r AS (SELECT user_id AS session_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT session_id, least(20, any_value(n))::BIGINT AS n_held, greatest(0, any_value(n) - 20)::BIGINT AS evicted, max(CASE WHEN age = least(20, n) THEN event_id END)::BIGINT AS oldest_event, max(CASE WHEN age = 1 THEN event_id END)::BIGINT AS newest_event FROM r GROUP BY session_id""",
    "stream_windows": """
WITH w AS (SELECT date_trunc('hour', ts) AS s, event_type, value, (SELECT max(ts) FROM events) AS top FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 3) AS value FROM w WHERE s + INTERVAL 1 HOUR <= top - INTERVAL 10 MINUTES GROUP BY s, event_type""",
}
