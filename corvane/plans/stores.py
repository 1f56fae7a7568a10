"""Queries over stores: conditions, batches, images, summaries, memory overviews and whole evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scoring, text
from corvane.operators import chunking, documents, images, index, lifecycle, memory, search
from corvane.plans import corpus, extras, retrieval, sql
from corvane.sources.tables import spread, table


def metadata_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus.paragraphs(spark, sf_dir)
    return search.where(chunks, {"doc_type": {"$in": ["en", "de"]}, "collection": {"$ne": "src1"}, "chunk_index": {"$gte": 1, "$lt": 6}}).select("doc_id", "chunk_index", "chunk_id")


def heading_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as sections under numbered headings."""
    lines = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("section_index", "line"))
    number = F.when(F.col("section_index") % 3 == 0, F.floor(F.col("section_index") / 3).cast("string")).otherwise(F.concat(F.floor(F.col("section_index") / 3).cast("string"), F.lit("."), (F.col("section_index") % 3).cast("string")))
    headed = F.when(F.col("section_index") % 7 == 5, F.concat(F.lit("## No number\n"), "line")).otherwise(F.concat(F.lit("## **"), number, F.lit(" Part**\n"), "line"))
    return chunking.heading_links(lines.select("doc_id", "section_index", headed.alias("text")))


def image_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of one collection that are left without those of the documents in French."""
    found = extras._images(spark, sf_dir)
    gone = corpus.paragraphs(spark, sf_dir).where("doc_type = 'fr'").select(F.sha2("source_path", 256).alias("doc_hash"))
    return images.listed(images.removed(found, gone), "src2").select("image_id", "path")


def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = F.when(F.col("doc_id") % 3 > 0, F.array(F.lit("b"), "source", F.lit("a")))
    return docs.select("doc_id", F.array_join(text.tag_union(F.array("lang", "source", F.lit("z")), found), ",").alias("tags"))


def stub_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of passages, every second of which is taken as empty, and their cosine with the flat vector."""
    v = scoring.stub_vector(F.when(F.col("item_id") % 2 == 0, "").otherwise(F.col("text")))
    rows = table(spark, sf_dir, "benchmark").select("item_id", v.alias("v"))
    return rows.select("item_id", F.size("v").alias("size"), F.size(F.filter("v", lambda x: x != 0)).alias("n_filled"), F.round(F.get("v", 0), 6).alias("first"), F.round(scoring.cosine(F.col("v"), scoring.flat_vector()), 6).alias("cosine"))


def summary_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some chunks have a summary and tags."""
    chunks = corpus.paragraphs(spark, sf_dir)
    stored = F.when(F.col("chunk_index") % 4 == 2, F.concat(F.lit("about "), "chunk_id")).when(F.col("chunk_index") % 4 == 1, " ")
    tagged = chunks.withColumn("summary", stored).withColumn("tags", F.array("doc_type", F.concat(F.lit("t"), (F.col("chunk_index") % 3).cast("string"))))
    return documents.stored_summary(tagged).withColumn("tags", F.array_join("tags", ","))


def batch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of chunks, which share some, over those that are there."""
    chunks = corpus.paragraphs(spark, sf_dir).groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    first = chunks.where("doc_id % 4 < 2").withColumn("doc_id", F.col("doc_id") + 100_000)
    second = chunks.where("doc_id % 4 in (1, 2)").withColumn("doc_id", F.col("doc_id") + 200_000)
    return index.upsert_batches(chunks.where("doc_id % 4 <> 2"), [first, second])


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks in batches of four, of which those over 400 characters fail."""
    return lifecycle.batch_outcomes(corpus.paragraphs(spark, sf_dir), F.length("text") > 400, 4)


def memory_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = memory.access_counts(corpus._items(spark, sf_dir))
    return memory.overview(memory.promotion_stores(items, corpus._as_of(spark, sf_dir), 0.5).select("store", "event_id", "ts"))


def batch_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval metrics and answer quality of all test cases in one row."""
    return retrieval.ir_metrics_avg(spark, sf_dir).join(F.broadcast(extras.answer_quality(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (metadata_where, heading_links, image_delete, tag_union, stub_vectors, summary_stored, batch_upsert, batch_outcomes, memory_overview, batch_evaluation)}
_P = f"WITH {sql.PARAGRAPHS}"
_S = sql.STRIP
ORACLES = {
    "metadata_where": f"{_P} SELECT doc_id, chunk_index, chunk_id FROM chunks WHERE lang IN ('en', 'de') AND source <> 'src1' AND chunk_index BETWEEN 1 AND 5",
    "heading_links": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
s AS (SELECT doc_id, (unnest(range(0, len(parts))))::INTEGER AS section_index FROM l),
n AS (SELECT doc_id, section_index, CASE WHEN section_index % 7 = 5 THEN NULL WHEN section_index % 3 = 0 THEN (section_index // 3)::VARCHAR ELSE (section_index // 3) || '.' || (section_index % 3) END AS number FROM s),
x AS (SELECT *, lead(number) OVER (PARTITION BY doc_id ORDER BY section_index) AS next_number FROM n)
SELECT doc_id, section_index, number, next_number, coalesce(starts_with(next_number, number || '.'), false) AS is_parent FROM x WHERE number IS NOT NULL""",
    "image_delete": f"{extras._IMAGES} SELECT image_id, path FROM kept WHERE collection = 'src2' AND path NOT IN (SELECT source_path || '.png' FROM chunks WHERE lang = 'fr')",
    "tag_union": "SELECT doc_id, array_to_string(list_sort(list_distinct(CASE WHEN doc_id % 3 > 0 THEN [lang, source, 'z', 'b', 'a'] ELSE [lang, source, 'z'] END))[1:10], ',') AS tags FROM documents",
    "stub_vectors": """
WITH b AS (SELECT item_id, (i - 1) % 384 AS bin, sum(((ord(substr(text, i, 1)) % 97) + 1) / 100) AS v FROM (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark WHERE item_id % 2 = 1) GROUP BY ALL),
s AS (SELECT item_id, count(*) AS n, max(CASE WHEN bin = 0 THEN v END) AS first, sum(v) / (sqrt(sum(v * v)) * sqrt(384)) AS cosine FROM b GROUP BY item_id)
SELECT item_id, 384 AS size, n::INTEGER AS n_filled, round(first, 6)::DOUBLE AS first, round(cosine, 6)::DOUBLE AS cosine FROM s
UNION ALL SELECT item_id, 384, 1, 0.1::DOUBLE, round(1 / sqrt(384), 6)::DOUBLE FROM benchmark WHERE item_id % 2 = 0""",
    "summary_stored": rf"""{_P},
said AS (SELECT doc_id, chunk_index, chunk_id, lang, {_S.format("text")} AS line FROM chunks),
g AS (SELECT doc_id, arg_min('about ' || chunk_id, chunk_index) FILTER (chunk_index % 4 = 2) AS stored, arg_min(line, chunk_index) FILTER (line <> '' AND NOT regexp_matches(line, '^#{{1,6}}\s')) AS made,
  array_to_string(list_sort(list_distinct(flatten(list([lang, 't' || (chunk_index % 3)])))), ',') AS tags, min(lang) AS doc_type, count(*)::BIGINT AS chunk_count FROM said GROUP BY doc_id)
SELECT doc_id, coalesce(stored, substr(coalesce(made, ''), 1, 500)) AS summary, tags, doc_type, chunk_count FROM g""",
    "batch_upsert": f"{_P}, ones AS (SELECT chunk_id, min(doc_id) AS doc_id FROM chunks GROUP BY chunk_id) SELECT chunk_id, doc_id + CASE WHEN doc_id % 4 IN (1, 2) THEN 200000 WHEN doc_id % 4 = 0 THEN 100000 ELSE 0 END AS doc_id FROM ones",
    "batch_outcomes": f"{_P} SELECT doc_id, (chunk_index // 4)::BIGINT AS batch, count(*)::BIGINT AS n_texts, count_if(length(text) > 400)::BIGINT AS n_failed, count_if(length(text) > 400) = 0 AS ok FROM chunks GROUP BY doc_id, chunk_index // 4",
    "memory_overview": f"""WITH {corpus._ITEMS},
c AS (SELECT *, least(10, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC)) AS n, (epoch_us(now) - epoch_us(ts)) / 3600000000 AS hours FROM items, as_of),
t AS (SELECT event_id, ts, 0.3::DOUBLE * greatest(0, 1 - hours / 24) + 0.5::DOUBLE * score + 0.2::DOUBLE * (1 - exp(-n::DOUBLE)) AS total FROM c),
s AS (SELECT event_id, ts, unnest(CASE WHEN total >= 0.5 - 1e-9 THEN ['long_term', 'episodic'] ELSE ['short_term'] END) AS store FROM t),
o AS (SELECT store, count(*) OVER (PARTITION BY store) AS n_items, row_number() OVER (PARTITION BY store ORDER BY ts DESC, event_id DESC)::INTEGER AS position, event_id FROM s)
SELECT * FROM o WHERE position <= CASE WHEN store = 'short_term' THEN 10 ELSE 5 END""",
    "batch_evaluation": f"SELECT * FROM ({retrieval.ORACLES['ir_metrics_avg']}), ({extras.ORACLES['answer_quality']})",
}
