"""Queries over what tools answer: listings, located documents, summaries of results and memories, stages and their totals, words without spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import chunking, documents, evidence, lexicon, lifecycle, memory, search, stages
from corvane.plans import corpus, retrieval, sql, stores, texts, tools
from corvane.session import scratch_folder, staged
from corvane.sources import files
from corvane.sources.tables import spread, table

#: Letters as characters of runs without spaces; punctuation ends a run.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz ", "".join(chr(0x4E00 + 16 * i) for i in range(26))


def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 documents of a collection, in order."""
    return documents.listed(corpus.paragraphs(spark, sf_dir), "src1", 40).select("position", "doc_id", "source_path", "chunk_count", "title")


def full_text_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents asked for by id, by the hits of a search, and by parts of path and title; some mean several documents or none."""
    chunks = corpus.paragraphs(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), "text")
    kind = F.col("request_id") % 5
    number = F.col("request_id").cast("string")
    requests = items.select(
        "request_id",
        F.when(kind == 0, F.concat(F.lit(" "), (F.col("request_id") * 3).cast("string"))).alias("doc_id"),
        F.when(kind.isin(1, 2), F.col("text")).alias("query"),
        F.when(kind == 3, F.concat(F.lit("/"), number, F.lit(".MD"))).alias("source_path"),
        F.when(kind == 4, F.when(F.col("request_id") % 2 == 0, "the").otherwise(" ")).alias("title"),
    )
    hits = retrieval.bm25_batch(spark, sf_dir).where("query_id % 5 = 1 and rank = 1 or query_id % 5 = 2 and rank <= 2").select(F.col("query_id").alias("request_id"), F.col("chunk_id").alias("doc_id"))
    found = documents.located_texts(chunks, requests, hits, 5_000)
    return found.select("request_id", "how", "doc_id", "n_matched", "n_chunks", F.sha2("full_text", 256).alias("text_sha"))


def section_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under made headings: what each of the three rules says of them."""
    heads = F.array(*[F.lit(h) for h in ("## References\n", "# Appendix A\n", "## **Appendix**\n", "# REFERENCES\n", "\n  ## appendix\n", "### References\n", "")])
    head = F.element_at(heads, (F.col("chunk_index") % 7 + 1).cast("int"))
    title = F.when(F.col("chunk_index") % 11 == 0, "The Appendix").when(F.col("chunk_index") % 13 == 0, "References used").otherwise("")
    lines = corpus.paragraphs(spark, sf_dir).select("doc_id", "chunk_index", F.concat(head, "text").alias("text"), title.alias("title"))
    t, b = F.col("title"), F.col("text")
    return lines.select("doc_id", "chunk_index", text.is_references(t, b).alias("is_references"), text.is_appendix(t, b).alias("is_appendix"), text.is_appendix(t, b, single_hash=False).alias("is_appendix_in_search"), text.section_kind(t, b).alias("kind"))


def compressed_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of a conversation as bodies of a memory, with scores by role and turn."""
    said = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), "text", F.when(F.col("turn") % 4 != 3, (F.col("turn") % 3) / 4 + F.when(F.col("role") == "assistant", 0.25).otherwise(0.0)).alias("score"))
    return memory.compressed_many(said, "conv_id", 1_000).select("conv_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha"))


def result_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines as the content of a tool's result, every third of them an image."""
    kind = lambda i: F.when(i % 3 == 2, "image").otherwise("text")
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.transform(F.split("text", "\n"), lambda line, i: F.struct(kind(i).alias("type"), line.alias("text"))).alias("content"))
    made = evidence.result_summary(F.col("content"), F.col("doc_id") % 4 == 1, 600)
    return docs.select("doc_id", made.alias("s")).select("doc_id", F.length("s").alias("n_chars"), F.sha2("s", 256).alias("summary_sha"))


def trace_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as steps of a task."""
    e = corpus._events(spark, sf_dir)
    steps = e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("position"), F.col("event_type").alias("tool_name"), F.col("props").alias("summary"))
    return evidence.trace_text(steps, most=400).select("task_id", F.length("trace").alias("n_chars"), F.sha2("trace", 256).alias("trace_sha"))


def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.batch_totals(stores.batch_outcomes(spark, sf_dir))


def _stages(spark: SparkSession, sf_dir: str, seen: Observation | None = None) -> DataFrame:
    """Lines through three stages: those over 400 characters and those with a digit fail, each in its stage."""
    chain = [
        stages.Stage("refine", lambda c: F.trim(F.regexp_replace(c, r"[\t\n\f\r ]+", " ")), lambda c: F.when(F.length(c) > 400, "too long")),
        stages.Stage("enrich", lambda c: F.concat(text.capital(F.substring(c, 1, 1)), F.substring(c, 2, 1_000)), lambda c: F.when(c.rlike("[0-9]"), F.concat(F.lit("digit in "), F.substring(c, 1, 10)))),
        stages.Stage("encode", lambda c: F.nullif(F.md5(c), F.lit(""))),
    ]
    return stages.run_stages(corpus.paragraphs(spark, sf_dir).select("doc_id", "chunk_index", "text"), chain, counted=seen)


def stage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), "failed_stage", "error")


def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that reached each stage and failed in it, counted while they were written."""
    seen = Observation("stages")
    staged(_stages(spark, sf_dir, seen), "stages")
    found = seen.get
    rows = [F.struct(F.lit(s).alias("stage"), F.lit(found[f"reached_{s}"]).cast("long").alias("n_reached"), F.lit(found[f"failed_{s}"]).cast("long").alias("n_failed")) for s in ("refine", "enrich", "encode")]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as text files, a file for each remainder of their ids, found again below their folder among others, with their hashes."""
    path = scratch_folder(spark, "files")
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 61).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    found = files.file_hashes(files.discover_files(spark, path, (".TXT",)))
    return found.select(F.regexp_extract("path", r"part=(\d+)/", 1).cast("long").alias("part"), "file_hash", "length")


def golden_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages written as a golden set in JSON lines, and read as one."""
    items = table(spark, sf_dir, "benchmark")
    path = f"{scratch_folder(spark, 'golden')}.jsonl"
    ids = F.when(F.col("item_id") % 3 > 0, F.transform(F.sequence(F.lit(0), F.col("item_id") % 3), lambda i: F.concat(F.lit("c"), (F.col("item_id") + i).cast("string"))))
    items.select(F.col("text").alias("query"), ids.alias("relevant_chunk_ids"), F.when(F.col("item_id") % 2 == 0, "an answer").alias("reference_answer")).write.json(path)
    cases = files.golden_set(spark, path)
    return cases.select("query_id", F.array_join("expected_ids", ",").alias("expected"), "reference_answer", "question_type")


def paper_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers of which several share a full id, one row each."""
    docs = table(spark, sf_dir, "documents")
    papers = docs.select(F.concat("source", F.lit("."), (F.col("doc_id") % 50).cast("string")).alias("full_id"), (F.col("doc_id") % 7).cast("string").alias("local_id"), "lang")
    return files.corpus_metadata(papers)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with letters as characters that stand without spaces between words."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.translate(F.lower("text"), LATIN, HAN).alias("text"))


def lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexicon.learn(_runs(spark, sf_dir), least=50, cohesion=0.5, words=5_000)
    return found.select("word", "n", F.round("cohesion", 5).alias("cohesion"), F.round("entropy", 5).alias("entropy"))


def lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each document, whose runs are cut by the corpus's own lexicon."""
    runs = _runs(spark, sf_dir)
    known = lexicon.Lexicon(lexicon.learn(runs, least=50, cohesion=0.5, words=5_000))
    terms = runs.select("doc_id", known.tokens(F.col("text")).alias("terms"))
    return terms.select("doc_id", F.size("terms").alias("n_terms"), F.sha2(F.array_join("terms", " "), 256).alias("terms_sha"))


def splitter_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the table function and by the splitter that gathers sections, and how many only one of them has."""
    docs = spread(table(spark, sf_dir, "documents"))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 5 == 3, F.concat(F.lit("## "), (i / 5).cast("int").cast("string"), F.lit(" Part\n"), line)).otherwise(line))
    docs = docs.select("doc_id", F.array_join(lines, "\n").alias("text"))
    rows = lambda df, name: df.select("doc_id", "chunk_index", F.sha2("text", 256).alias("sha"), F.lit(1).alias(name))
    both = rows(chunking.split_by_function(docs, 400, 50), "streamed").join(rows(tools.section_pieces(spark, sf_dir), "gathered"), ["doc_id", "chunk_index", "sha"], "full")
    return both.agg(F.count_if(F.col("streamed").isNull()).alias("only_gathered"), F.count_if(F.col("gathered").isNull()).alias("only_streamed"), (F.count(F.lit(1)) > 0).alias("any"))


def episodic_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of the middle of the events: what came in the seven days before it, and nothing after."""
    e = corpus._events(spark, sf_dir)
    low, high = e.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    as_of = F.timestamp_seconds(F.lit(int(low + 0.6 * (high - low))))
    v = table(spark, sf_dir, "embeddings")
    events = e.select(F.col("user_id").alias("session_id"), "event_id", "ts", F.col("props").alias("text"))
    return memory.episodic(events, v.select((F.col("vec_id") + 1).alias("event_id"), "embedding"), v.select(F.col("vec_id").alias("session_id"), "embedding"), as_of).select("session_id", "rank", "event_id", "similarity")


def evidence_ids_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks by their whole id, by a part from its middle, and by an id that no chunk has."""
    chunks = corpus.paragraphs(spark, sf_dir).select("chunk_id").distinct()
    asked = chunks.select(F.explode(F.array("chunk_id", F.substring("chunk_id", 6, 11), F.concat(F.lit("no"), "chunk_id"))).alias("asked_id"))
    return evidence.resolve_ids(asked, chunks)


def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of ``evidence_verdict`` where evidence is named by parts of its ids."""
    named = lambda tail: F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(tail))
    chunks = table(spark, sf_dir, "documents").select(named("-end").alias("chunk_id"), "text")
    asked = corpus._asked(spark, sf_dir).select("answer_id", named("-e").alias("asked_id"))
    return evidence.checked(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("answer_id"), "text"), staged(asked, "asked"), chunks)


def second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a second run over the ledger of the first: those done before are skipped, the others succeed or fail."""
    ledger = corpus._ledger(spark, sf_dir).select("file_hash", "status")
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"))
    todo = lifecycle.pending(found, ledger)
    ran = todo.select("file_hash", F.when(F.col("doc_id") % 5 == 0, "failed").otherwise("success").alias("status"))
    skipped = found.join(todo.select("file_hash"), "file_hash", "left_anti").select("file_hash", F.lit("skipped").alias("status"))
    new = corpus.paragraphs(spark, sf_dir).join(todo.where("doc_id % 5 <> 0").select("doc_id"), "doc_id", "left_semi")
    return lifecycle.ingestion_summary(ran.unionByName(skipped), new)


def knowledge_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their images; a question in three has no rerank scores and falls back on the order of retrieval."""
    lists = tools._staged_lists(spark, sf_dir)
    marked = F.concat(F.lit("[IMAGE: i"), (F.col("chunk_id") % 5).cast("string"), F.lit("] "), "text", F.lit(" [IMAGE: z]"))
    chunks = tools._chunks(spark, sf_dir).withColumn("text", marked)
    scores = tools._rerank_scores(spark, sf_dir, lists).where("query_id % 3 > 0")
    found = search.knowledge_query(*lists, chunks, scores, 4)
    return found.select("query_id", "index", "chunk_id", "score", "rerank_score", "fallback", F.array_join("images", ",").alias("images"), "shown", "n_more")


QUERIES = {
    f.__name__: f
    for f in (discovered_files, episodic_week, evidence_ids_all, evidence_check, second_run, knowledge_response, listed_documents, full_text_located, section_kinds, compressed_memories, result_summaries, trace_texts, batch_totals, stage_outcomes, stage_totals, golden_cases, paper_metadata, lexicon_words, lexicon_terms, splitter_function)
}

_P = f"WITH {sql.PARAGRAPHS}"
_HEADS = "['## References' || chr(10), '# Appendix A' || chr(10), '## **Appendix**' || chr(10), '# REFERENCES' || chr(10), chr(10) || '  ## appendix' || chr(10), '### References' || chr(10), '']"
_FIRST = f"lower({sql.STRIP.format('split_part(' + sql.STRIP.format('text') + ', chr(10), 1)')})"
_STAGES = rf"""{_P},
r AS (SELECT doc_id, chunk_index, text, length(text) > 400 AS long, trim(regexp_replace(text, '\s+', ' ', 'g')) AS refined FROM chunks),
e AS (SELECT *, NOT long AND regexp_matches(refined, '[0-9]') AS digit FROM r)"""
_LISTED = f"""firsts AS (SELECT doc_id, source_path, source, count(*)::BIGINT AS chunk_count, arg_min(text, chunk_index) AS text FROM chunks GROUP BY doc_id, source_path, source),
listing AS (SELECT doc_id, source_path, source, chunk_count, {texts.TITLE} AS title FROM firsts)"""
ORACLES = {
    "episodic_week": """WITH b AS (SELECT to_timestamp(floor(min(epoch(ts)) + 0.6 * (max(epoch(ts)) - min(epoch(ts)))))::TIMESTAMP AS as_of FROM events),
near AS (SELECT e.user_id AS session_id, e.event_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
  FROM events e JOIN b ON e.ts <= as_of AND e.ts >= as_of - INTERVAL 7 DAYS JOIN embeddings v ON v.vec_id + 1 = e.event_id JOIN embeddings q ON q.vec_id = e.user_id)
SELECT session_id, rank, event_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(s, 9) DESC, event_id)::INTEGER AS rank FROM near) WHERE rank <= 2""",
    "evidence_ids_all": f"""{_P},
ids AS (SELECT DISTINCT chunk_id FROM chunks),
asked AS (SELECT DISTINCT unnest([chunk_id, substr(chunk_id, 6, 11), 'no' || chunk_id]) AS asked_id FROM ids),
keys AS (SELECT chunk_id, unnest(list_transform(range(1, length(chunk_id) - 9), lambda i: substr(chunk_id, i, 11))) AS asked_id FROM ids UNION ALL SELECT chunk_id, chunk_id FROM ids),
best AS (SELECT asked_id, coalesce(min(CASE WHEN chunk_id = asked_id THEN chunk_id END), min(chunk_id)) AS chunk_id FROM keys GROUP BY asked_id)
SELECT asked_id, chunk_id, chunk_id = asked_id AS exact FROM asked LEFT JOIN best USING (asked_id)""",
    "discovered_files": "SELECT doc_id % 61 AS part, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS file_hash, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS length FROM documents GROUP BY doc_id % 61",
    "evidence_check": corpus.ORACLES["evidence_verdict"],
    "second_run": f"""WITH {corpus._LEDGER}, {sql.PARAGRAPHS},
r AS (SELECT f.file_hash, f.doc_id, CASE WHEN l.status = 'success' THEN 'skipped' WHEN f.doc_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status FROM firsts f LEFT JOIN ledger l USING (file_hash))
SELECT count_if(status = 'success')::BIGINT AS n_success, count_if(status = 'failed')::BIGINT AS n_failed, count_if(status = 'skipped')::BIGINT AS n_skipped, (SELECT count(*) FROM chunks WHERE doc_id IN (SELECT doc_id FROM r WHERE status = 'success'))::BIGINT AS n_chunks FROM r""",
    "knowledge_response": f"""{retrieval._LISTS}, {sql.RRF.format("1.0::DOUBLE", "1.0::DOUBLE").replace("rank <= 10", "rank <= 8")},
cand AS (SELECT query_id, rank, chunk_id, score FROM fused_top WHERE query_id IN (SELECT query_id FROM dense) AND query_id IN (SELECT query_id FROM sparse)
  UNION ALL SELECT query_id, rank, chunk_id, score FROM dense WHERE rank <= 8 AND query_id NOT IN (SELECT query_id FROM sparse)
  UNION ALL SELECT query_id, rank, chunk_id, score FROM sparse WHERE rank <= 8 AND query_id NOT IN (SELECT query_id FROM dense)),
met AS (SELECT query_id, chunk_id, score, CASE WHEN query_id % 3 > 0 THEN n_chars::DOUBLE END AS rerank_score, query_id % 3 = 0 AS fallback, 'i' || (doc_id % 5) || ',z' AS images, rank FROM cand JOIN documents ON doc_id = chunk_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank, chunk_id)::INTEGER AS index FROM met)
SELECT query_id, index, chunk_id, score, rerank_score, fallback, images, index <= 5 AS shown, greatest(0, count(*) OVER (PARTITION BY query_id) - 5)::BIGINT AS n_more FROM placed WHERE index <= 4""",
    "listed_documents": f"{_P}, {_LISTED} SELECT (row_number() OVER (ORDER BY source_path, title, doc_id::VARCHAR) - 1)::INTEGER AS position, doc_id, source_path, chunk_count, title FROM listing WHERE source = 'src1' ORDER BY position LIMIT 40",
    "full_text_located": rf"""{_P}, {sql.bm25(sql.BENCH_TERMS)}, {_LISTED},
near AS (SELECT * FROM listing ORDER BY source_path, title, doc_id::VARCHAR LIMIT 500),
h AS (SELECT query_id AS request_id, count(DISTINCT chunk_id) AS n, min(chunk_id) AS d FROM sparse WHERE (query_id % 5 = 1 AND rank = 1) OR (query_id % 5 = 2 AND rank <= 2) GROUP BY query_id),
m AS (SELECT item_id AS request_id, count(DISTINCT doc_id) AS n, min(doc_id) AS d FROM benchmark JOIN near ON (item_id % 5 = 3 AND contains(lower(source_path), '/' || item_id || '.md')) OR (item_id % 5 = 4 AND item_id % 2 = 0 AND contains(lower(title), 'the')) GROUP BY item_id),
w AS (SELECT item_id AS request_id, item_id % 5 AS kind, CASE WHEN item_id % 5 = 0 THEN 1 ELSE coalesce(h.n, m.n, 0) END AS n_matched, CASE WHEN item_id % 5 = 0 THEN item_id * 3 ELSE coalesce(h.d, m.d) END AS d
  FROM benchmark LEFT JOIN h ON h.request_id = item_id LEFT JOIN m ON m.request_id = item_id),
kept AS (SELECT * FROM chunks WHERE NOT regexp_matches(lower({sql.STRIP.format("text")}), '^(## \*\*|## |# )(references|appendix)')),
joined AS (SELECT doc_id, count(*)::INTEGER AS n_chunks, string_agg({sql.STRIP.format("text")}, chr(10) || chr(10) ORDER BY chunk_index) AS t FROM kept GROUP BY doc_id),
known AS (SELECT DISTINCT doc_id AS k FROM chunks),
said AS (SELECT *, CASE WHEN kind = 4 AND request_id % 2 = 1 THEN 'empty' WHEN n_matched = 0 OR (kind = 0 AND k IS NULL) THEN 'missing' WHEN n_matched > 1 THEN 'ambiguous' WHEN kind = 0 THEN 'given' WHEN kind IN (1, 2) THEN 'searched' ELSE 'matched' END AS how FROM w LEFT JOIN known ON k = d)
SELECT request_id, how, CASE WHEN how IN ('given', 'searched', 'matched') THEN d::VARCHAR END AS doc_id, n_matched::BIGINT AS n_matched, CASE WHEN how IN ('given', 'searched', 'matched') THEN n_chunks END AS n_chunks,
  CASE WHEN how IN ('given', 'searched', 'matched') THEN sha256(CASE WHEN length(t) > 5000 THEN substr(t, 1, 4980) || chr(10) || '...[truncated]' ELSE t END) END AS text_sha FROM said LEFT JOIN joined ON doc_id = d""",
    "section_kinds": rf"""{_P},
l AS (SELECT doc_id, chunk_index, {_HEADS}[chunk_index % 7 + 1] || text AS text, CASE WHEN chunk_index % 11 = 0 THEN 'The Appendix' WHEN chunk_index % 13 = 0 THEN 'References used' ELSE '' END AS title FROM chunks),
f AS (SELECT doc_id, chunk_index, lower(title) AS title, {_FIRST} AS first FROM l),
k AS (SELECT doc_id, chunk_index, contains(title, 'references') OR regexp_matches(first, '^(## \*\*|## |# )references') AS is_references, contains(title, 'appendix') OR regexp_matches(first, '^(## \*\*|## |# )appendix') AS is_appendix, contains(title, 'appendix') OR regexp_matches(first, '^(## \*\*|## )appendix') AS is_appendix_in_search FROM f)
SELECT *, CASE WHEN is_references THEN 'references' WHEN is_appendix THEN 'appendix' END AS kind FROM k""",
    "compressed_memories": f"""WITH s AS (SELECT conv_id, turn, {sql.STRIP.format("coalesce(text, '')")} AS text, coalesce(CASE WHEN turn % 4 <> 3 THEN (turn % 3) / 4 + CASE WHEN role = 'assistant' THEN 0.25 ELSE 0 END END, 0.5) AS score FROM conversations),
j AS (SELECT conv_id, {sql.STRIP.format("substr(string_agg(text, ' ' ORDER BY score DESC, turn), 1, 1000)")} AS text FROM s WHERE text <> '' GROUP BY conv_id)
SELECT conv_id, length(text)::INTEGER AS n_chars, sha256(text) AS text_sha FROM j""",
    "result_summaries": f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
t AS (SELECT doc_id, list_filter(list_transform(range(1, len(lines) + 1), lambda i: CASE WHEN i % 3 <> 0 THEN lines[i] ELSE '' END), lambda s: s <> '') AS texts, len(lines) // 3 AS n_images FROM l),
s AS (SELECT doc_id, {sql.STRIP.format("array_to_string(list_concat(CASE WHEN doc_id % 4 = 1 THEN ['[error]'] ELSE [] END, texts, CASE WHEN n_images > 0 THEN ['[含 ' || n_images || ' 张图，未展开]'] ELSE [] END), ' ')")} AS s FROM t),
c AS (SELECT doc_id, CASE WHEN length(s) > 600 THEN substr(s, 1, 587) || '…[truncated]' ELSE s END AS s FROM s)
SELECT doc_id, length(s)::INTEGER AS n_chars, sha256(s) AS summary_sha FROM c""",
    "trace_texts": """WITH j AS (SELECT user_id AS task_id, string_agg(coalesce(event_type, '') || ': ' || coalesce(props, ''), chr(10) ORDER BY event_id) AS t FROM events GROUP BY user_id),
c AS (SELECT task_id, CASE WHEN length(t) > 400 THEN substr(t, 1, 387) || '…[truncated]' ELSE t END AS t FROM j)
SELECT task_id, length(t)::INTEGER AS n_chars, sha256(t) AS trace_sha FROM c""",
    "batch_totals": f"""WITH o AS ({stores.ORACLES["batch_outcomes"]})
SELECT count(*)::BIGINT AS n_batches, count_if(NOT ok)::BIGINT AS failed_batches, sum(n_texts)::BIGINT AS n_texts, sum(n_failed)::BIGINT AS failed_texts, coalesce(sum(n_texts) FILTER (NOT ok), 0)::BIGINT AS lost_texts,
  round(1 - coalesce(sum(n_texts) FILTER (NOT ok), 0) / sum(n_texts), 6)::DOUBLE AS success_rate, round(avg(n_texts), 4) AS mean_batch, max(n_texts)::BIGINT AS largest_batch, count(DISTINCT CASE WHEN NOT ok THEN doc_id END)::BIGINT AS touched_documents FROM o""",
    "stage_outcomes": rf"""{_STAGES}
SELECT doc_id, chunk_index, md5(CASE WHEN long THEN text WHEN digit THEN refined ELSE md5(upper(substr(refined, 1, 1)) || substr(refined, 2, 1000)) END) AS text_md5,
  CASE WHEN long THEN 'refine' WHEN digit THEN 'enrich' END AS failed_stage, CASE WHEN long THEN 'too long' WHEN digit THEN 'digit in ' || substr(refined, 1, 10) END AS error FROM e""",
    "stage_totals": rf"""{_STAGES}
SELECT unnest(['refine', 'enrich', 'encode']) AS stage, unnest([count(*), count_if(NOT long), count_if(NOT long AND NOT digit)])::BIGINT AS n_reached, unnest([count_if(long), count_if(digit), 0])::BIGINT AS n_failed FROM e""",
    "golden_cases": """SELECT sha256(text) AS query_id, CASE WHEN item_id % 3 > 0 THEN array_to_string(list_transform(range(0, item_id % 3 + 1), lambda i: 'c' || (item_id + i)), ',') ELSE '' END AS expected,
  CASE WHEN item_id % 2 = 0 THEN 'an answer' END AS reference_answer, NULL::VARCHAR AS question_type FROM benchmark""",
    "paper_metadata": """WITH p AS (SELECT source || '.' || (doc_id % 50) AS full_id, (doc_id % 7)::VARCHAR AS local_id, lang FROM documents)
SELECT full_id, min({'l': local_id, 'g': lang}).l AS local_id, min({'l': local_id, 'g': lang}).g AS lang FROM p WHERE local_id <> '0' AND full_id IS NOT NULL GROUP BY full_id""",
    "lexicon_words": f"""WITH runs AS (SELECT unnest(regexp_extract_all(translate(lower(text), '{LATIN}', '{HAN}'), '[一-鿿]+')) AS run FROM documents),
g AS (SELECT substr(run, i, size) AS gram FROM (SELECT run, size, unnest(range(1, length(run) - size + 2)) AS i FROM (SELECT run, unnest([1, 2, 3, 4, 5]) AS size FROM runs) WHERE length(run) >= size)),
grams AS MATERIALIZED (SELECT gram, count(*) AS n FROM g GROUP BY gram),
total AS (SELECT sum(n) AS t FROM grams WHERE length(gram) = 1),
behind AS (SELECT substr(gram, 1, length(gram) - 1) AS gram, sum(n * ln(n)) AS s FROM grams WHERE length(gram) > 1 GROUP BY 1),
before AS (SELECT substr(gram, 2) AS gram, sum(n * ln(n)) AS s FROM grams WHERE length(gram) > 1 GROUP BY 1),
c AS (SELECT w.gram, w.n, least(ln(w.n) - coalesce(b.s, 0) / w.n, ln(w.n) - coalesce(a.s, 0) / w.n) AS entropy FROM grams w LEFT JOIN behind b ON b.gram = w.gram LEFT JOIN before a ON a.gram = w.gram WHERE length(w.gram) BETWEEN 2 AND 4 AND w.n >= 50),
k AS (SELECT c.gram, c.n, c.entropy, unnest(range(1, length(c.gram))) AS place FROM c WHERE entropy >= 1),
m AS (SELECT k.gram, any_value(k.n) AS n, any_value(k.entropy) AS entropy, min(ln(k.n * t::DOUBLE / (x.n::DOUBLE * y.n::DOUBLE))) AS cohesion FROM k JOIN grams x ON x.gram = substr(k.gram, 1, place) JOIN grams y ON y.gram = substr(k.gram, place + 1), total GROUP BY k.gram)
SELECT gram AS word, n::BIGINT AS n, round(cohesion, 5) AS cohesion, round(entropy, 5) AS entropy FROM m WHERE cohesion >= 0.5 ORDER BY n DESC, gram LIMIT 5000""",
    "splitter_function": "SELECT 0::BIGINT AS only_gathered, 0::BIGINT AS only_streamed, count(*) > 0 AS any FROM documents",
}
