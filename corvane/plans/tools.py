"""Queries over whole search tools, memory stores, document resolution and the smaller text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import ids, scoring, text
from corvane.operators import chunking, documents, evidence, images, lifecycle, memory, search
from corvane.plans import corpus, retrieval, sql
from corvane.session import staged
from corvane.sources.tables import source_path, spread, table


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with all that searches filter by."""
    docs = table(spark, sf_dir, "documents")
    path = source_path(F.col("source"), F.col("doc_id"))
    return docs.select(F.col("doc_id").alias("chunk_id"), "text", path.alias("source_path"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_ref"), F.array("lang", "source").alias("tags"), F.lit("").alias("heading"))


def _staged_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The candidates, searched once for the ranking and the reranker."""
    dense, sparse = retrieval._lists(spark, sf_dir)
    return staged(dense, "dense"), staged(sparse, "sparse")


def _rerank_scores(spark: SparkSession, sf_dir: str, lists: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Lengths of documents stand for a reranker's scores."""
    asked = lists[0].select("query_id", "chunk_id").union(lists[1].select("query_id", "chunk_id")).distinct()
    return asked.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("rerank_score")), "chunk_id")


SHOWN_COLUMNS = ("query_id", "index", "chunk_id", "source", "score", "rerank_score", "text_snippet", "shown", "n_more")


def knowledge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage asked as a question, eight answers each."""
    lists = _staged_lists(spark, sf_dir)
    return search.knowledge_query(*lists, _chunks(spark, sf_dir), _rerank_scores(spark, sf_dir, lists), 8).select(*SHOWN_COLUMNS)


def metadata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _staged_lists(spark, sf_dir)
    found = search.metadata_search(*lists, _chunks(spark, sf_dir), _rerank_scores(spark, sf_dir, lists), 5, source_path="/SRC", tags=["EN"], has_image=False, exclude_references=True)
    return found.select(*SHOWN_COLUMNS)


def filter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters within a query, under those given beside it."""
    docs = table(spark, sf_dir, "documents")
    parsed = text.parse_filters(F.concat(F.lit("col:"), "source", F.lit(" type:"), "lang", F.lit(" words")))
    names = ("collection", "doc_type", "source_path")
    merged = search.merged_filters(F.create_map(*[x for n in names for x in (F.lit(n), parsed[n])]), F.create_map(F.lit("doc_type"), F.col("doc_id").cast("string"), F.lit("tags"), F.lit("given")))
    return docs.select("doc_id", *[merged[n].alias(n) for n in (*names, "tags")])


def document_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a heading below their first line, where this is of even length."""
    docs = spread(table(spark, sf_dir, "documents"))
    first = F.substring_index("text", "\n", 1)
    headed = F.when(F.length(first) % 2 == 0, F.concat(first, F.lit("\n# Named "), "lang", F.lit(" \n"), "text")).otherwise(F.concat(F.lit("\n \n"), "text"))
    return docs.select("doc_id", text.document_title(headed).alias("title"))


_SHOWN = "![fig](images/p1.png) and **==> picture [10 x 20] intentionally omitted <==** "


def image_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", text.image_total(F.replace("text", F.lit("the "), F.lit(_SHOWN)), F.col("doc_id") % 50).cast("long").alias("n_images"))


def image_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of several images of a text by its file's name, the first of any, one left out, and none."""
    docs = spread(table(spark, sf_dir, "documents"))
    body = F.replace("text", F.lit("the "), F.lit("![fig](images/p1.png) the ![fig](images/p2.png) "))
    named = F.when(F.col("doc_id") % 2 == 0, "p2.png").otherwise("other.png")
    found = text.with_image(body, named, F.concat(F.lit("[IMAGE: $1\\"), F.col("doc_id").cast("string"), F.lit("]")))
    return docs.select("doc_id", F.sha2(found, 256).alias("sha"), F.length(found).alias("n_chars"))


def strict_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.slice("embedding", 1, 40).alias("other"))
    return v.join(other, "vec_id").select("vec_id", F.round(scoring.strict_cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def expanded_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first turn with the others, with more space around them too, as its expansions."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", F.col("text").alias("query"))
    firsts = turns.groupBy("query_id").agg(F.min_by("query", "turn").alias("query"))
    loud = turns.select("query_id", (2 * F.col("turn")).alias("position"), F.concat(F.lit("  "), "query", F.lit("\n")).alias("query")).union(turns.select("query_id", (2 * F.col("turn") + 1).alias("position"), "query"))
    return search.expanded_queries(firsts, loud)


def normalized_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    listed = F.concat(F.array(F.lit("  "), F.lit(" ab ")), F.regexp_extract_all("text", F.lit("([a-z]{2})"), F.lit(1)))
    return items.select("item_id", F.array_join(ids.normalized(listed), ",").alias("ids"))


def enrich_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a model's answers: whole, without a title, and as plain prose."""
    docs = spread(table(spark, sf_dir, "documents"))
    tags = F.concat(F.lit("\ntags: "), "lang", F.lit(", ,"), "source", F.lit(" ,x"))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Title:  A "), "source", F.lit(" \nSummary: about\n"), "lang", tags)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Summary: only "), "lang", tags)).otherwise(F.col("text"))
    parts = text.enrichment(said)
    return docs.select("doc_id", parts["title"].alias("title"), F.sha2(parts["summary"], 256).alias("summary_sha"), F.array_join(parts["tags"], "|").alias("tags"))


def rerank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = memory.qa_pairs(table(spark, sf_dir, "conversations"))
    made = text.rerank_query(F.col("question"), F.when(F.col("turn") % 4 == 0, F.array(F.concat(F.lit(" "), "answer"), F.lit("second"))).otherwise(F.array().cast("array<string>")), F.when(F.col("conv_id") % 2 == 0, F.col("answer")))
    return pairs.select("conv_id", "turn", made.alias("query"))


def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("data/"), "source", F.lit("-"), "lang", F.lit("_x.tar.md"))
    word = F.substring_index("text", " ", 1)
    return docs.select("doc_id", text.title_case(path).alias("title"), text.stem(path).alias("stem"), text.safe_int(F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")).otherwise(word), -1).alias("number"), F.round(scoring.distance_similarity(F.col("n_chars") / 3000), 6).alias("similarity"))


def quick_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type").isin("refund", "click", "error"), F.lit("[ERROR] x")).otherwise("ok")
    return evidence.quick_rule(events.select(F.col("user_id").alias("session"), F.col("event_id").alias("position"), line.alias("line")))


def eval_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.element_at(F.array(F.lit("ok"), F.lit("needs_replan"), F.lit("hard_fail")), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), (F.col("event_id") % 2 == 0).alias("passed"), (F.round("value") / 4).alias("score"), (F.col("event_id") % 5 == 0).alias("require_more_tools"), F.array("event_type", F.lit(""), F.repeat("event_type", F.col("event_id").cast("int") % 40)).alias("issues"))
    return evidence.observation(rows).select("event_id", "observation")


def evidence_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as tool results: with citations of several kinds, or with text alone."""
    turns = table(spark, sf_dir, "conversations")
    shape = "struct<chunk_id:string,source:string,doc_id:string,text_snippet:string,text:string,body:string>"
    one = lambda **k: F.struct(*[F.coalesce(k.get(n), F.lit(None)).cast("string").alias(n) if n in k else F.lit(None).cast("string").alias(n) for n in ("chunk_id", "source", "doc_id", "text_snippet", "text", "body")])
    listed = F.array(one(chunk_id=F.col("conv_id"), source=F.col("role"), text_snippet=F.concat(F.lit(" "), "text")), one(doc_id=F.col("turn"), text_snippet=F.lit(" "), text=F.col("role")), one(source=F.lit(""), body=F.lit("")), one(doc_id=F.lit("d"), body=F.col("role"))).cast(f"array<{shape}>")
    results = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("result_id"), F.when(F.col("turn") % 5 == 1, " ").otherwise(F.col("text")).alias("text"), F.col("role").alias("source"), F.when(F.col("turn") % 2 == 0, listed).otherwise(F.array().cast(f"array<{shape}>")).alias("citations"))
    return evidence.normalised(results)


def novelty_stall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector searches as a session's steps, ten questions a session."""
    hits = search.dense(retrieval._vectors(spark, sf_dir), retrieval._query_vectors(spark, sf_dir), 3)
    near = hits.select(F.floor(F.col("query_id") / 10).alias("session"), (F.col("query_id") % 10).alias("step"), (F.col("chunk_id") % 40).alias("chunk_id"))
    return evidence.stalls(near)


def memory_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buffer without the items that a promotion takes out."""
    held = memory.newest(corpus._items(spark, sf_dir), 5)
    gone = memory.promoted(memory.access_counts(corpus._items(spark, sf_dir)), corpus._as_of(spark, sf_dir), 0.5).where("promoted")
    return memory.without(held, gone).select("session_id", "event_id", "age")


def promotion_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = memory.access_counts(corpus._items(spark, sf_dir))
    return memory.promotion_stores(items, corpus._as_of(spark, sf_dir), 0.5).select("event_id", "store", "total")


def memory_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as an item's bodies in one store, each vector an item in the other; every fiftieth vector asks."""
    v = table(spark, sf_dir, "embeddings")
    short = v.select(F.col("label").cast("long").alias("item_id"), "embedding", (F.col("vec_id") % 10 / 40).alias("score"))
    asks = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return memory.recall(short, v.select(F.col("vec_id").cast("long").alias("item_id"), "embedding"), asks)


def episodic_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events with a vector each of another table, asked by the vector of the user's number."""
    e = corpus._events(spark, sf_dir)
    v = table(spark, sf_dir, "embeddings")
    events = e.select(F.col("user_id").alias("session_id"), "event_id", "ts", F.col("props").alias("text"))
    vectors = v.select((F.col("vec_id") + 1).alias("event_id"), "embedding")
    return memory.episodic(events, vectors, v.select(F.col("vec_id").alias("session_id"), "embedding"), corpus._as_of(spark, sf_dir), 3_650)


def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = memory.context_window(memory.qa_pairs(table(spark, sf_dir, "conversations")), 2)
    body = memory.assembled([("Recent turns", F.col("context")), ("Empty", F.lit("")), ("Missing", F.lit(None).cast("string")), ("Count", F.col("n_pairs").cast("string"))])
    return pairs.select("conv_id", F.sha2(body, 256).alias("context_sha"))


def context_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector asks; of these every second has none and gets the newest items."""
    v = table(spark, sf_dir, "embeddings")
    asks = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 100 == 0, F.col("embedding")).alias("embedding"))
    return memory.context_items(v.select(F.col("vec_id").alias("item_id"), F.col("vec_id").alias("at"), "embedding"), asks).select("query_id", F.col("rank").cast("int").alias("rank"), "item_id")


def document_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger entries with the chunks of all documents that have this text, and every chunk's image."""
    hashes = spread(table(spark, sf_dir, "documents")).select("doc_id", F.sha2("text", 256).alias("file_hash"))
    chunks = corpus.paragraphs(spark, sf_dir).join(hashes, "doc_id").select("file_hash", "chunk_index", "chunk_id")
    shown = chunks.select("file_hash", F.concat("chunk_id", F.lit(".png")).alias("image_id"))
    found = documents.detail(corpus._ledger(spark, sf_dir), chunks, shown)
    return found.select("file_hash", "status", F.size("chunk_ids").alias("n_chunks"), F.sha2(F.array_join("chunk_ids", ","), 256).alias("chunks_sha"), F.size("image_ids").alias("n_images"))


def document_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents asked for by reference, by parts of path and hash, and by what none has."""
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat(F.lit("ref-"), F.col("doc_id").cast("string"), F.lit("-")).alias("source_ref"), source_path(F.col("source"), F.col("doc_id")).alias("source_path"), F.sha2("text", 256).alias("doc_hash"))
    asked = docs.select(F.explode(F.array("source_ref", F.substring("source_path", 16, 20), F.substring("doc_hash", 9, 12), F.concat(F.lit("no-"), "doc_hash"))).alias("asked_id"))
    return documents.resolve(docs, asked)


def magic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "424D00", "524946460000000057454250", "00")])
    content = F.concat(F.element_at(heads, (F.col("page_id") % 6 + 1).cast("int")), F.col("html").cast("binary"))
    return pages.select("page_id", images.mime_of_content(content, F.col("url")).alias("mime"))


def section_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through the splitter: every fifth line a numbered heading, and lines with two bars a table."""
    docs = spread(table(spark, sf_dir, "documents"))
    lines = F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 5 == 3, F.concat(F.lit("## "), (i / 5).cast("int").cast("string"), F.lit(" Part\n"), line)).otherwise(line))
    return chunking.split_documents(docs.select("doc_id", F.array_join(lines, "\n").alias("text")), 400, 50)


def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that refer to images of their document, and to some that it doesn't have."""
    chunks = corpus.paragraphs(spark, sf_dir).select("doc_id", "chunk_index", F.concat(F.lit("[IMAGE: i"), (F.col("chunk_index") % 4).cast("string"), F.lit("] "), "text", F.lit(" [IMAGE: i1] [IMAGE: zz]")).alias("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat(F.lit("i"), i.cast("string")).alias("id"), (i * 10 + 1).alias("page"))).alias("images"))
    found = chunking.chunk_records(chunks, docs)
    return found.select("doc_id", "chunk_index", "lang", "source_ref", F.array_join("image_refs", ",").alias("refs"), F.array_join(F.col("images.id"), ",").alias("own"), "page_num")


def ledger_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes of the ledger after an upsert and the removal of some files."""
    ledger = lifecycle.mark(corpus._ledger(spark, sf_dir), corpus._news(spark, sf_dir), F.lit(corpus.AT).cast("timestamp"))
    gone = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.sha2("text", 256).alias("file_hash"))
    return lifecycle.successes(lifecycle.forget(ledger, gone), "fresh").select("file_hash", "file_path", "status")


def delete_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, counts = lifecycle.delete_where(corpus.paragraphs(spark, sf_dir), (F.col("doc_type") == "en") & (F.col("collection") != "src1"))
    return left.groupBy("collection").agg(F.count(F.lit(1)).alias("n_left")).join(F.broadcast(counts))


QUERIES = {
    f.__name__: f
    for f in (knowledge_query, metadata_search, filter_merge, document_title, image_count, image_substitution, strict_cosine, expanded_dedupe, normalized_ids, enrich_parse, rerank_query, small_rules, quick_rule, eval_observation, evidence_normalise, novelty_stall, memory_delete, promotion_split, memory_recall, episodic_recall, context_assembly, context_topk, document_detail, document_resolve, magic_types, section_pieces, chunk_records, ledger_list, delete_by_metadata)
}

_S = sql.STRIP


def _answers_sql(fetched: int, top: int, kept: str) -> str:
    """Rows of an answer: fused candidates, filtered by ``kept``, by the length of the document."""
    rrf = sql.RRF.format("1.0::DOUBLE", "1.0::DOUBLE").replace("rank <= 10", f"rank <= {fetched}")
    return f"""{retrieval._LISTS}, {rrf},
cand AS (SELECT query_id, rank, chunk_id, score FROM fused_top WHERE query_id IN (SELECT query_id FROM dense) AND query_id IN (SELECT query_id FROM sparse)
  UNION ALL SELECT query_id, rank, chunk_id, score FROM dense WHERE rank <= {fetched} AND query_id NOT IN (SELECT query_id FROM sparse)
  UNION ALL SELECT query_id, rank, chunk_id, score FROM sparse WHERE rank <= {fetched} AND query_id NOT IN (SELECT query_id FROM dense)),
met AS (SELECT query_id, chunk_id, score, n_chars::DOUBLE AS rerank_score, {sql.PATH} AS source, {sql.COLLAPSE.format("text")} AS t, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, rank, chunk_id)::INTEGER AS index
  FROM cand JOIN documents ON doc_id = chunk_id WHERE {kept})
SELECT query_id, index, chunk_id, source, score, rerank_score, CASE WHEN length(t) <= 200 THEN t ELSE coalesce(nullif(regexp_extract(substr(t, 1, 200), '(?s)^(.*) [^ ]*$', 1), ''), substr(t, 1, 200)) || '...' END AS text_snippet,
  index <= 5 AS shown, greatest(0, count(*) OVER (PARTITION BY query_id) - 5)::BIGINT AS n_more FROM met WHERE index <= {top}"""


_FLAT = sql.COLLAPSE.format("query")
ORACLES = {
    "knowledge_query": _answers_sql(16, 8, "true"),
    "metadata_search": _answers_sql(20, 5, rf"lang = 'en' AND NOT contains(text, '[IMAGE:') AND NOT regexp_matches(lower({_S.format('text')}), '^(## \*\*|## |# )references')"),
    "filter_merge": "SELECT doc_id, source AS collection, doc_id::VARCHAR AS doc_type, NULL::VARCHAR AS source_path, 'given' AS tags FROM documents",
    "document_title": rf"""
WITH t AS (SELECT doc_id, lang, string_split(text, chr(10))[1] AS first, list_filter(string_split(text, chr(10))[1:8], lambda l: {_S.format('l')} <> '') AS spoken, list_filter(string_split(text, chr(10))[1:18], lambda l: starts_with(l, '# ')) AS heads FROM documents)
SELECT doc_id, CASE WHEN length(first) % 2 = 0 THEN coalesce(CASE WHEN starts_with(first, '# ') THEN {_S.format('substr(first, 3)')} END, 'Named ' || lang) ELSE coalesce({_S.format('substr(heads[1], 3)')}, {_S.format('spoken[1]')}) END AS title FROM t""",
    "image_count": "SELECT doc_id, greatest(doc_id % 50, 2 * ((length(text) - length(replace(text, 'the ', ''))) // 4))::BIGINT AS n_images FROM documents",
    "image_substitution": r"""
WITH b AS (SELECT doc_id, replace(text, 'the ', '![fig](images/p1.png) the ![fig](images/p2.png) ') AS t, '[IMAGE: $1\' || doc_id || ']' AS k FROM documents),
p AS (SELECT *, strpos(t, CASE WHEN doc_id % 2 = 0 THEN '![fig](images/p2.png)' ELSE '![fig](images/p1.png)' END) AS place FROM b),
d AS (SELECT doc_id, CASE WHEN place > 0 THEN substr(t, 1, place - 1) || k || substr(t, place + 21) ELSE t || chr(10) || chr(10) || k END AS t FROM p)
SELECT doc_id, sha256(t) AS sha, length(t)::INTEGER AS n_chars FROM d""",
    "strict_cosine": "SELECT a.vec_id, round(list_dot_product(a.embedding[1:40]::DOUBLE[], b.embedding[1:40]::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding[1:40]::DOUBLE[], b.embedding[1:40]::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "expanded_dedupe": f"""
WITH turns AS (SELECT conv_id AS query_id, turn, text AS query FROM conversations),
rows AS (SELECT query_id, -1 AS position, arg_min(query, turn) AS query FROM turns GROUP BY query_id UNION ALL SELECT query_id, 2 * turn, '  ' || query || chr(10) FROM turns UNION ALL SELECT query_id, 2 * turn + 1, query FROM turns),
firsts AS (SELECT query_id, min(position) AS position, arg_min(query, position) AS query FROM rows WHERE {_FLAT} <> '' GROUP BY query_id, lower({_FLAT}))
SELECT query_id, position, query FROM (SELECT query_id, query, (row_number() OVER (PARTITION BY query_id ORDER BY position) - 1)::INTEGER AS position FROM firsts) WHERE position < 4""",
    "normalized_ids": "SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:12], ',') AS ids FROM (SELECT item_id, list_prepend('ab', regexp_extract_all(text, '[a-z]{2}')) AS l FROM benchmark)",
    "enrich_parse": """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A ' || source ELSE 'Untitled' END AS title,
  sha256(CASE doc_id % 3 WHEN 0 THEN 'about' || chr(10) || lang WHEN 1 THEN 'only ' || lang ELSE substr(text, 1, 500) END) AS summary_sha,
  CASE WHEN doc_id % 3 = 2 THEN '' ELSE lang || '|' || source || '|x' END AS tags FROM documents""",
    "rerank_query": rf"""
WITH {corpus._QA}
SELECT conv_id, turn, concat_ws(chr(10), question, CASE WHEN turn % 4 = 0 THEN 'Expanded query:' || chr(10) || nullif({_S.format('answer')}, '') END, CASE WHEN conv_id % 2 = 0 AND length(answer) > 0 THEN 'Hypothetical evidence passage:' || chr(10) || {_S.format('answer')} END) AS query FROM pairs""",
    "small_rules": r"""
SELECT doc_id, upper(source[1:1]) || lower(source[2:]) || ' ' || upper(lang[1:1]) || lower(lang[2:]) || ' X.tar' AS title, source || '-' || lang || '_x.tar' AS stem,
  coalesce(TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN n_chars::VARCHAR WHEN regexp_matches(string_split(text, ' ')[1], '^\s*[+-]?[0-9]+\s*$') THEN string_split(text, ' ')[1] END AS INTEGER), -1) AS number,
  round(least(1, greatest(0, 1 - n_chars / 3000)), 6)::DOUBLE AS similarity FROM documents""",
    "quick_rule": """
WITH lines AS (SELECT user_id AS session, event_id AS position, event_type IN ('refund', 'click', 'error') AS bad FROM events),
islands AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY position) - row_number() OVER (PARTITION BY session, bad ORDER BY position) AS island FROM lines),
runs AS (SELECT session, bad, island, count(*) AS n FROM islands GROUP BY session, bad, island),
s AS (SELECT session, coalesce(max(CASE WHEN bad THEN n END), 0) AS longest FROM runs GROUP BY session)
SELECT session, CASE WHEN longest >= 3 THEN 'hard_fail' ELSE 'ok' END AS status, CASE WHEN longest >= 3 THEN 0.0::DOUBLE END AS score, CASE WHEN longest >= 3 THEN false END AS passed, CASE WHEN longest >= 3 THEN '3 calls in a row failed, of ' || longest END AS issues FROM s""",
    "eval_observation": """
WITH r AS (SELECT event_id, 'status=' || ['ok', 'needs_replan', 'hard_fail'][(event_id % 3 + 1)::INT] || CASE WHEN event_id % 2 = 1 THEN '; passed=False' ELSE '' END || '; score=' || format('{:,.2f}', round(value) / 4)
  || CASE WHEN event_id % 5 = 0 THEN '; require_more_tools=True' ELSE '' END || '; issues: ' || event_type || CASE WHEN event_id % 40 > 0 THEN '; ' || repeat(event_type, event_id % 40) ELSE '' END AS o FROM events)
SELECT event_id, CASE WHEN length(o) > 200 THEN substr(o, 1, 187) || '…[truncated]' ELSE o END AS observation FROM r""",
    "evidence_normalise": rf"""
WITH r AS (SELECT conv_id * 1000 + turn AS result_id, turn, conv_id, role, {_S.format('text')} AS t FROM conversations),
c AS (SELECT result_id, unnest([{{'p': 1, 'c': conv_id::VARCHAR, 's': role, 't': nullif(t, '')}}, {{'p': 2, 'c': '', 's': turn::VARCHAR, 't': role}}, {{'p': 3, 'c': '', 's': 'd', 't': role}}]) AS x FROM r WHERE turn % 2 = 0),
n AS (SELECT result_id, x.p AS p, x.c AS chunk_id, x.s AS source, x.t AS text_snippet FROM c WHERE x.t IS NOT NULL UNION ALL SELECT result_id, 1, '', role, t FROM r WHERE turn % 2 = 1 AND turn % 5 <> 1 AND t <> '')
SELECT result_id, (row_number() OVER (PARTITION BY result_id ORDER BY p) - 1)::INTEGER AS position, chunk_id, source, text_snippet FROM n""",
    "novelty_stall": f"""WITH {sql.dense(sql.BENCH_VECTORS, 3)},
steps AS (SELECT DISTINCT query_id // 10 AS session, query_id % 10 AS step, chunk_id % 40 AS chunk_id FROM dense),
firsts AS (SELECT *, min(step) OVER (PARTITION BY session, chunk_id) AS first FROM steps),
n AS (SELECT session, step, count(*)::BIGINT AS n_ids, count_if(step = first)::BIGINT AS n_new FROM firsts GROUP BY session, step),
g AS (SELECT *, sum((n_new > 0)::INT) OVER (PARTITION BY session ORDER BY step) AS grp FROM n),
d AS (SELECT session, step, n_ids, n_new, count_if(n_new = 0) OVER (PARTITION BY session, grp ORDER BY step)::BIGINT AS dry FROM g)
SELECT *, dry >= 1 AS stalled FROM d""",
    "memory_delete": f"""WITH {corpus._ITEMS},
c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC)::INTEGER AS age, (epoch_us(now) - epoch_us(ts)) / 3600000000 AS hours FROM items, as_of)
SELECT session_id, event_id, age FROM c WHERE age <= 5 AND NOT 0.3::DOUBLE * greatest(0, 1 - hours / 24) + 0.5::DOUBLE * score + 0.2::DOUBLE * (1 - exp(-least(10, age)::DOUBLE)) >= 0.5 - 1e-9""",
    "promotion_split": f"""WITH {corpus._ITEMS},
c AS (SELECT *, least(10, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC)) AS n, (epoch_us(now) - epoch_us(ts)) / 3600000000 AS hours FROM items, as_of),
t AS (SELECT event_id, 0.3::DOUBLE * greatest(0, 1 - hours / 24) + 0.5::DOUBLE * score + 0.2::DOUBLE * (1 - exp(-n::DOUBLE)) AS total FROM c)
SELECT event_id, unnest(CASE WHEN total >= 0.5 - 1e-9 THEN ['long_term', 'episodic'] ELSE ['short_term'] END) AS store, round(total, 6) AS total FROM t""",
    "memory_recall": """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
near AS (SELECT query_id, vec_id, label, greatest(0, list_cosine_similarity(embedding::DOUBLE[], qv)) AS s FROM embeddings, q),
stores AS (SELECT query_id, 'short' AS store, label::BIGINT AS item_id, max(s) AS s FROM near GROUP BY query_id, label UNION ALL SELECT query_id, 'long', vec_id::BIGINT, s FROM near)
SELECT query_id, rank, store, item_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, store, item_id)::INTEGER AS rank FROM stores) WHERE rank <= 8""",
    "episodic_recall": """
WITH near AS (SELECT e.user_id AS session_id, e.event_id, e.props AS text, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s
  FROM events e JOIN embeddings v ON v.vec_id + 1 = e.event_id JOIN embeddings q ON q.vec_id = e.user_id WHERE e.ts >= (SELECT max(ts) FROM events) - INTERVAL 3650 DAYS)
SELECT session_id, rank, event_id, round(s, 6) AS similarity, text FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(s, 9) DESC, event_id)::INTEGER AS rank FROM near) WHERE rank <= 2""",
    "context_assembly": f"""WITH {corpus._QA},
aged AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM pairs),
c AS (SELECT conv_id, count(*) AS n, string_agg('Q: ' || question || chr(10) || 'A: ' || answer, chr(10) || chr(10) ORDER BY turn) AS context FROM aged WHERE age <= 2 GROUP BY conv_id)
SELECT conv_id, sha256('## Recent turns' || chr(10) || context || chr(10) || chr(10) || '## Count' || chr(10) || n) AS context_sha FROM c""",
    "context_topk": f"""WITH {sql.dense('SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0', 3)},
last AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC)::INTEGER AS rank FROM embeddings)
SELECT query_id, rank, chunk_id AS item_id FROM dense UNION ALL SELECT e.vec_id, rank, last.vec_id FROM embeddings e, last WHERE e.vec_id % 100 = 50 AND rank <= 3""",
    "document_detail": f"""WITH {corpus._LEDGER}, {sql.PARAGRAPHS},
c AS (SELECT sha256(d.text) AS file_hash, count(*)::INTEGER AS n, string_agg(chunk_id, ',' ORDER BY chunk_index, chunk_id) AS s, count(DISTINCT chunk_id)::INTEGER AS m FROM chunks JOIN documents d USING (doc_id) GROUP BY 1)
SELECT file_hash, status, coalesce(n, 0)::INTEGER AS n_chunks, sha256(coalesce(s, '')) AS chunks_sha, coalesce(m, 0)::INTEGER AS n_images FROM ledger LEFT JOIN c USING (file_hash)""",
    "document_resolve": f"""
WITH docs AS (SELECT doc_id, 'ref-' || doc_id || '-' AS source_ref, {sql.PATH} AS source_path, sha256(text) AS doc_hash FROM documents),
asked AS (SELECT DISTINCT unnest([source_ref, substr(source_path, 16, 20), substr(doc_hash, 9, 12), 'no-' || doc_hash]) AS asked_id FROM docs),
exact AS (SELECT asked_id, min(doc_id) AS exact_id FROM asked LEFT JOIN docs ON source_ref = asked_id GROUP BY asked_id),
part AS (SELECT asked_id, count(DISTINCT doc_id) AS n, min(doc_id) AS part_id FROM exact JOIN docs ON contains(source_path, asked_id) OR contains(doc_hash, asked_id) OR contains(source_ref, asked_id) OR contains(doc_id::VARCHAR, asked_id) WHERE exact_id IS NULL GROUP BY asked_id)
SELECT asked_id, coalesce(exact_id, CASE WHEN n = 1 THEN part_id END) AS doc_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'partial' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS how FROM exact LEFT JOIN part USING (asked_id)""",
    "magic_types": r"SELECT page_id, coalesce(CASE lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in images.MIME.items())
    + " END, ['image/png', 'image/jpeg', 'image/gif', 'image/bmp', 'image/webp', 'image/png'][(page_id % 6 + 1)::INT]) AS mime FROM pages",
    "chunk_records": f"""WITH {sql.PARAGRAPHS}
SELECT doc_id, chunk_index, lang, doc_id::VARCHAR AS source_ref, 'i' || (chunk_index % 4) || ',i1,zz' AS refs, CASE chunk_index % 4 WHEN 1 THEN 'i1' WHEN 3 THEN 'i1' ELSE 'i' || (chunk_index % 4) || ',i1' END AS own,
  (CASE WHEN chunk_index % 4 = 3 THEN 11 ELSE chunk_index % 4 * 10 + 1 END)::INTEGER AS page_num FROM chunks""",
    "ledger_list": f"""WITH {corpus._LEDGER}
SELECT file_hash, 'new/' || doc_id AS file_path, 'success' AS status FROM firsts WHERE doc_id % 3 <> 1 AND doc_id % 5 <> 0 AND file_hash NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'fr')""",
    "delete_by_metadata": f"""WITH {sql.PARAGRAPHS}
SELECT source AS collection, count(*)::BIGINT AS n_left, (SELECT count(*) FROM chunks WHERE lang = 'en' AND source <> 'src1')::BIGINT AS n_deleted FROM chunks WHERE NOT (lang = 'en' AND source <> 'src1') GROUP BY source""",
}
