"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from corvane.functions import text

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 2)"
PATH = "('data/documents/' || source || '/' || doc_id::VARCHAR || '.md')"
EVIDENCE_STOP = " ".join(text.STOPWORDS_EVIDENCE)
EVIDENCE_TOKENS = (
    r"list_filter(list_distinct(list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9_\-]{{2,}}|[一-鿿]{{2,}}'), lambda t: lower(t))), lambda t: NOT list_contains(string_split('"
    + EVIDENCE_STOP
    + "', ' '), t))"
)
POSTINGS = f"""
docs AS (SELECT doc_id AS chunk_id, {TOKENS.format("text")} AS terms FROM documents),
corpus AS (SELECT count(*)::BIGINT AS num_docs, coalesce(sum(len(terms)), 0)::BIGINT AS total_terms, coalesce(avg(len(terms)), 0)::DOUBLE AS avg_doc_length FROM docs),
posted AS MATERIALIZED (SELECT term, chunk_id, count(*)::BIGINT AS tf, any_value(doc_length)::BIGINT AS doc_length
           FROM (SELECT chunk_id, len(terms) AS doc_length, unnest(terms) AS term FROM docs) GROUP BY term, chunk_id),
weights AS (SELECT term, count(*)::BIGINT AS df, ln((any_value(num_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posted, corpus GROUP BY term)"""
PARAGRAPHS = f"""
split AS (SELECT doc_id, source, lang, list_filter(string_split(text, chr(10)), lambda l: {STRIP.format("l")} <> '') AS parts FROM documents),
paragraphs AS (SELECT doc_id, source, lang, {PATH} AS source_path, unnest(parts) AS text, (generate_subscripts(parts, 1) - 1)::INTEGER AS chunk_index FROM split),
chunks AS (SELECT *, concat_ws('_', left(sha256(source_path), 8), printf('%04d', chunk_index), left(sha256(text), 8)) AS chunk_id FROM paragraphs)"""
UNIFIED = "replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
SECTIONS = rf"""
cut AS (SELECT doc_id, source, list_filter(list_transform(string_split(regexp_replace({UNIFIED}, '(?m)^(#{{1,6}}\s+)', chr(31) || '\1', 'g'), chr(31)), lambda s: {STRIP.format("s")}), lambda s: s <> '') AS parts FROM documents),
sections AS (SELECT doc_id, source, unnest(parts) AS text, (generate_subscripts(parts, 1) - 1)::INTEGER AS section_index FROM cut)"""


def bm25(queries: str, k: int = 10) -> str:
    """CTEs ending in ``sparse``: the best k documents by BM25 of ``queries`` (query_id, term)."""
    return f"""{POSTINGS},
times AS (SELECT query_id, term, count(*) AS times FROM ({queries}) GROUP BY query_id, term),
scored AS (
  SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_length / avg_doc_length))) AS score
  FROM times JOIN posted USING (term) JOIN weights USING (term), corpus GROUP BY query_id, chunk_id),
sparse AS (SELECT * FROM (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank FROM scored) WHERE rank <= {k})"""


def dense(queries: str, k: int = 10) -> str:
    """CTEs ending in ``dense``: the best k vectors of ``queries`` (query_id, qv)."""
    return f"""
pairs AS (SELECT query_id, vec_id AS chunk_id, greatest(0, (1 + list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[])) / 2) AS score FROM ({queries}), embeddings),
dense AS (SELECT * FROM (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank FROM pairs) WHERE rank <= {k})"""


BENCH_TERMS = f"SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark"
BENCH_VECTORS = "SELECT item_id AS query_id, embedding AS qv FROM benchmark JOIN embeddings ON item_id = vec_id"
RRF = """
fused AS (SELECT query_id, chunk_id, sum(w / (60 + rank)) AS score FROM (SELECT query_id, chunk_id, rank, {0} AS w FROM dense UNION ALL SELECT query_id, chunk_id, rank, {1} FROM sparse) GROUP BY query_id, chunk_id),
fused_top AS (SELECT * FROM (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank FROM fused) WHERE rank <= 10)"""
