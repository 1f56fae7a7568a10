"""Queries over text transforms, query processing and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import chunking, search
from corvane.plans import sql
from corvane.sources import tables
from corvane.sources.tables import spread, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))


def _hash(column) -> F.Column:
    """Long texts are compared by hash and length."""
    return F.sha2(column, 256)


def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunking.sections(_docs(spark, sf_dir))
    return parts.select("doc_id", "section_index", F.coalesce("heading", F.lit("")).alias("heading"), F.length("text").alias("n_chars"), _hash("text").alias("text_sha"))


def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for sections, so that regions open and close within documents; short ones name an appendix."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("section_index", "line"))
    titled = F.when(F.col("section_index") % 7 == 5, F.lit("## References")).when(F.col("section_index") % 11 == 8, F.lit("## Appendix")).when(F.col("section_index") % 5 == 4, F.concat(F.lit("## A "), "line")).otherwise(F.col("line"))
    parts = lines.select("doc_id", "section_index", titled.alias("text"))
    return chunking.region_kept(parts, include_appendix=True).select("doc_id", "section_index", _hash("text").alias("text_sha"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).select("doc_id", "text", "source_path")
    return chunking.with_chunk_ids(chunking.sections(docs)).select("doc_id", "chunk_index", "draft_id", "chunk_id")


def chunk_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", r"[.] ")).alias("position", "piece"))
    return lines.select("doc_id", "position", text.post_process(F.concat(F.lit(" ,; "), "piece", F.lit("\n\n\n\n \t x"))).alias("chunk"))


def rule_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents between separators, with a comment, tags and entities."""
    dirty = F.concat(F.lit("──────────── Page 3 ────────────\n<b>"), "text", F.lit("</b><br/>&amp;&nbsp;end <!-- note\n -->  \n\n\n\n──────────"))
    return _docs(spark, sf_dir).select("doc_id", _hash(text.refine(dirty)).alias("refined_sha"), F.length(text.refine(dirty)).alias("n_chars"))


def fenced_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with a fenced block, which must come through as it was."""
    fenced = F.concat(F.lit("<i>a</i>   b\n```\n<keep>   this</keep>\n```\n"), F.col("text"), F.lit("<br>   c"))
    return _docs(spark, sf_dir).select("doc_id", _hash(text.refine_fenced(fenced)).alias("refined_sha"), F.length(text.refine_fenced(fenced)).alias("n_chars"))


def html_refine_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", _hash(text.refine(F.col("html"))).alias("refined_sha"), F.length(text.refine(F.col("html"))).alias("n_chars"))


def rule_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.rule_title(F.col("text")).alias("title"))


def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.rule_summary(F.col("text")).alias("summary"))


def rule_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(text.rule_tags(F.col("text")), "|").alias("tags"))


def page_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: with a number, a footer and a copyright line around them."""
    page = F.concat(F.lit("12\n"), "text", F.lit("\nProceedings of the 3rd Annual Meeting of the Association for Computational Linguistics\n© 2024 Association for Computational Linguistics\npages 307–317 August 2024\n\n\n\n 99 "))
    return _docs(spark, sf_dir).select("doc_id", _hash(text.page_noise(page)).alias("page_sha"), F.length(text.page_noise(page)).alias("n_chars"))


def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces after an "e" become breaks with a hyphen first."""
    broken = F.regexp_replace("text", "e ", "e-\n ")
    return _docs(spark, sf_dir).select("doc_id", _hash(text.dehyphenate(broken)).alias("text_sha"), F.length(text.dehyphenate(broken)).alias("n_chars"))


def image_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image tokens in front of every sentence that starts with "The"."""
    marked = F.regexp_replace("text", r"\bThe ", "[IMAGE: img_the] The ")
    found = _docs(spark, sf_dir).select("doc_id", text.image_refs(marked).alias("refs"))
    return found.select("doc_id", F.size("refs").alias("n_refs"), F.array_join(F.array_distinct("refs"), ",").alias("refs"))


def query_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", text.collapse(F.concat(F.lit("  "), "text", F.lit(" \n "))).alias("query"))


def filter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.concat(F.lit("c:first col:"), "source", F.lit(" type:"), "lang", F.lit(" tags:a,b tag:"), "lang", F.lit("  src:data/"), "source", F.lit(" "), text.snippet(F.col("text"), 60))
    found = text.parse_filters(query)
    columns = {name: F.array_join(c, ",") if name == "tags" else F.coalesce(c, F.lit("")) for name, c in found.items()}
    return _docs(spark, sf_dir).select("doc_id", *[c.alias(name) for name, c in columns.items()])


def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


def query_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as queries: of those alike but for case and spaces the first stays."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return search.distinct_queries(turns, "conv_id", "turn").select("conv_id", "turn", F.sha2("query", 256).alias("query_sha"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(
        "doc_id",
        text.snippet(F.col("text"), 120).alias("snippet"),
        text.bounded(F.col("text"), 200).alias("bounded"),
        text.preview(F.col("text"), 100).alias("preview"),
        text.clean_heading(F.concat(F.lit("## **"), F.substring("text", 1, 20), F.lit("**"))).alias("heading"),
    )


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("a"), text.plain_sentences(F.col("text")).alias("b"))
    return found.select("doc_id", F.size("a").alias("n_sentences"), F.size("b").alias("n_plain"), F.sha2(F.array_join("a", "|"), 256).alias("sha"))


def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_chunks(_docs(spark, sf_dir).select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (heading_sections, section_filter, chunk_ids, chunk_postprocess, rule_refine, fenced_refine, html_refine_pages, rule_title, rule_summary, rule_tags, page_noise, dehyphenate, image_refs, query_normalize, filter_parse, keyword_extract, query_dedupe, snippets, sentence_split, recursive_chunks)
}


def _refined(raw: str) -> str:
    out = raw
    for pattern, new, flags in (
        (r"(?is)─{10,}.*?(?:Page \d+|Footer|Section \d+|©|Confidential).*?─{10,}", "", "g"),
        (r"─{10,}", "", "g"),
        (r"(?s)<!--.*?-->", "", "g"),
        (r"(?i)<br\s*/?>", " / ", "g"),
        (r"<[^>]+>", "", "g"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{new}', '{flags}')"
    for entity, new in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, '{entity}', '{new}')"
    out = rf"regexp_replace({out}, '[ \t]{{2,}}', ' ', 'g')"
    out = rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    out = rf"regexp_replace({out}, '[ \t\r\f]+\n', chr(10), 'g')"
    return sql.STRIP.format(out)


_SNIPPET = "CASE WHEN length({0}) <= {1} THEN {0} ELSE (CASE WHEN regexp_extract(substr({0}, 1, {1}), '(?s)^(.*) [^ ]*$', 1) <> '' THEN regexp_extract(substr({0}, 1, {1}), '(?s)^(.*) [^ ]*$', 1) ELSE substr({0}, 1, {1}) END) || '...' END"
_FLAT = sql.COLLAPSE.format("text")
_PAGE = "'12' || chr(10) || text || chr(10) || 'Proceedings of the 3rd Annual Meeting of the Association for Computational Linguistics' || chr(10) || '© 2024 Association for Computational Linguistics' || chr(10) || 'pages 307–317 August 2024' || repeat(chr(10), 4) || ' 99 '"
_NOISE = " OR ".join(
    f"regexp_matches({sql.STRIP.format('l')}, '{p}')"
    for p in (
        r"^\d{1,4}$",
        r"(?i)^_?\s*Proceedings of the .*?(Annual Meeting|Conference|Workshop).*Association for Computational Linguistics",
        r"(?i)(©\s*\d{4}.*Association for Computational Linguistics|Association for Computational Linguistics.*©\s*\d{4})",
        r"(?i)\bpages?\s+\d+\s*[–-]\s*\d+.*\b(19\d{2}|20\d{2})\b",
        r"(?i)\b(copyright|licensed|creative commons)\b.*\b(ACL|Association for Computational Linguistics|Anthology)\b",
    )
)
_NOISE_TEXT = sql.STRIP.format(
    rf"regexp_replace(array_to_string(list_filter(list_transform(string_split(replace(replace({_PAGE}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda l: CASE WHEN {sql.STRIP.format('l')} = '' THEN '' ELSE l END), lambda l: NOT ({_NOISE})), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')"
)
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS_EN) + "]"
_TITLE_FIRST = r"regexp_split_to_array(text, '[.!?]\s+')[1]"
_TITLE_SENTENCE = rf"regexp_replace({sql.STRIP.format(_TITLE_FIRST)}, '[.!?]+$', '')"
_TITLE_LINE = sql.STRIP.format("string_split(text, chr(10))[1]")
#: The title by rule of a column ``text``.
TITLE = rf"""CASE WHEN coalesce(text, '') = '' THEN 'Untitled'
  WHEN regexp_matches(text, '^#{{1,6}}\s+[^\n]+') THEN {sql.STRIP.format(r"regexp_extract(text, '^#{1,6}\s+([^\n]+)', 1)")}
  WHEN {_TITLE_LINE} <> '' AND length({_TITLE_LINE}) <= 100 AND NOT regexp_matches({_TITLE_LINE}, '[.,;]$') THEN {_TITLE_LINE}
  WHEN {_TITLE_FIRST} <> '' THEN CASE WHEN length({_TITLE_SENTENCE}) <= 150 THEN {_TITLE_SENTENCE} ELSE substr({_TITLE_SENTENCE}, 1, 147) || '...' END
  ELSE {sql.STRIP.format("substr(text, 1, 100)")} || CASE WHEN length(text) > 100 THEN '...' ELSE '' END END"""
_QUERY = "'c:first col:' || source || ' type:' || lang || ' tags:a,b tag:' || lang || '  src:data/' || source || ' ' || (" + _SNIPPET.format(_FLAT, 60) + ")"
_BROKEN = "regexp_replace(text, 'e ', 'e-' || chr(10) || ' ', 'g')"
ORACLES = {
    "heading_sections": rf"WITH {sql.SECTIONS} SELECT doc_id, section_index, CASE WHEN regexp_matches(text, '^#{{1,6}}\s+') THEN {sql.STRIP.format('string_split(text, chr(10))[1]')} ELSE '' END AS heading, length(text)::INTEGER AS n_chars, sha256(text) AS text_sha FROM sections",
    "section_filter": rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section_index FROM documents),
parts AS (SELECT doc_id, section_index, CASE WHEN section_index % 7 = 5 THEN '## References' WHEN section_index % 11 = 8 THEN '## Appendix' WHEN section_index % 5 = 4 THEN '## A ' || line ELSE line END AS text FROM lines),
named AS (SELECT *, {sql.STRIP.format("regexp_replace(" + sql.STRIP.format("regexp_replace(regexp_replace(" + sql.STRIP.format("string_split(" + sql.STRIP.format("text") + ", chr(10))[1]") + r", '^#{1,6}\s+', ''), '[*_]', '', 'g')") + ", ':+$', '')")} AS name FROM parts),
flags AS (SELECT *, lower(name) IN ('references', 'reference', 'bibliography') AS is_ref, lower(name) = 'appendix' OR starts_with(lower(name), 'appendix ') AS is_app FROM named),
opened AS (SELECT *, coalesce(max((is_ref OR is_app)::INT) OVER (PARTITION BY doc_id ORDER BY section_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM flags),
opens AS (SELECT *, CASE WHEN is_ref THEN 'references' WHEN is_app OR (seen AND regexp_matches(name, '^[A-Z]\s+.+')) THEN 'appendix' END AS opens FROM opened),
regions AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS region FROM opens)
SELECT doc_id, section_index::INTEGER AS section_index, sha256(text) AS text_sha FROM regions WHERE region IS NULL OR region = 'appendix'""",
    "chunk_ids": f"""WITH {sql.SECTIONS},
placed AS (SELECT *, {sql.PATH} AS source_path FROM sections)
SELECT doc_id, section_index AS chunk_index, concat_ws('_', 'doc_' || left(sha256(source_path), 16), printf('%04d', section_index), left(sha256(text), 8)) AS draft_id,
       concat_ws('_', left(sha256(source_path), 8), printf('%04d', section_index), left(sha256(text), 8)) AS chunk_id FROM placed""",
    "chunk_postprocess": rf"""
WITH pieces AS (SELECT doc_id, unnest(string_split(text, '. ')) AS piece, generate_subscripts(string_split(text, '. '), 1) - 1 AS position FROM documents),
raw AS (SELECT doc_id, position, ' ,; ' || piece || repeat(chr(10), 4) || ' ' || chr(9) || ' x' AS t FROM pieces)
SELECT doc_id, position::INTEGER AS position, regexp_replace(regexp_replace(regexp_replace({sql.STRIP.format("t")}, '^[\s.,;:!?，。；：！？]+', ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g') AS chunk FROM raw""",
    "rule_refine": "WITH dirty AS (SELECT doc_id, '──────────── Page 3 ────────────' || chr(10) || '<b>' || text || '</b><br/>&amp;&nbsp;end <!-- note' || chr(10) || ' -->  ' || repeat(chr(10), 4) || '──────────' AS t FROM documents), "
    f"refined AS (SELECT doc_id, {_refined('t')} AS t FROM dirty) SELECT doc_id, sha256(t) AS refined_sha, length(t)::INTEGER AS n_chars FROM refined",
    # no document has a fence of its own; the block's place is marked while the rest is refined
    "fenced_refine": f"WITH marked AS (SELECT doc_id, '<i>a</i>   b' || chr(10) || chr(30) || chr(10) || text || '<br>   c' AS body FROM documents), refined AS (SELECT doc_id, replace({_refined('body')}, chr(30), '```' || chr(10) || '<keep>   this</keep>' || chr(10) || '```') AS t FROM marked) SELECT doc_id, sha256(t) AS refined_sha, length(t)::INTEGER AS n_chars FROM refined",
    "html_refine_pages": f"WITH refined AS (SELECT page_id, {_refined('html')} AS t FROM pages) SELECT page_id, sha256(t) AS refined_sha, length(t)::INTEGER AS n_chars FROM refined",
    "rule_title": f"SELECT doc_id, {TITLE} AS title FROM documents",
    "rule_summary": rf"""
WITH joined AS (SELECT doc_id, {sql.STRIP.format(r"array_to_string(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))[1:3], ' ')")} AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) > 500 THEN substr(s, 1, 497) || '...' ELSE s END AS summary FROM joined""",
    "page_noise": f"WITH cleaned AS (SELECT doc_id, {_NOISE_TEXT} AS t FROM documents) SELECT doc_id, sha256(t) AS page_sha, length(t)::INTEGER AS n_chars FROM cleaned",
    "dehyphenate": rf"WITH joined AS (SELECT doc_id, regexp_replace(replace({_BROKEN}, chr(13) || chr(10), chr(10)), '([A-Za-z])-\s*(?:\n\s*)+([a-z])', '\1\2', 'g') AS t FROM documents) SELECT doc_id, sha256(t) AS text_sha, length(t)::INTEGER AS n_chars FROM joined",
    "image_refs": r"""
WITH found AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '\bThe ', '[IMAGE: img_the] The ', 'g'), '\[IMAGE:\s*([^\]\s]+)\s*\]', 1) AS refs FROM documents)
SELECT doc_id, len(refs)::INTEGER AS n_refs, CASE WHEN len(refs) > 0 THEN refs[1] ELSE '' END AS refs FROM found""",
    "query_normalize": f"SELECT conv_id, turn, {sql.COLLAPSE.format('text')} AS query FROM conversations",
    "filter_parse": rf"""
WITH q AS (SELECT doc_id, {_QUERY} AS query FROM documents),
p AS (SELECT doc_id, query, list_transform(list_zip(regexp_extract_all(query, '([A-Za-z0-9_]+):([^\s]+)', 1), regexp_extract_all(query, '([A-Za-z0-9_]+):([^\s]+)', 2)), lambda z: {{'n': lower(z[1]), 'v': z[2]}}) AS pairs FROM q)
SELECT doc_id,
       coalesce(list_filter(pairs, lambda p: p.n IN ('collection', 'col', 'c'))[-1].v, '') AS collection,
       coalesce(list_filter(pairs, lambda p: p.n IN ('type', 'doc_type', 't'))[-1].v, '') AS doc_type,
       coalesce(list_filter(pairs, lambda p: p.n IN ('source', 'src', 's'))[-1].v, '') AS source_path,
       array_to_string(flatten(list_transform(list_filter(pairs, lambda p: p.n IN ('tag', 'tags')), lambda p: string_split(p.v, ','))), ',') AS tags,
       {sql.COLLAPSE.format(r"regexp_replace(query, '([A-Za-z0-9_]+):([^\s]+)', '', 'g')")} AS rest FROM p""",
    "keyword_extract": rf"""
WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS w, generate_subscripts(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), 1) AS i FROM benchmark),
f AS (SELECT item_id, arg_min(w, i) AS w, min(i) AS i FROM w WHERE NOT list_contains({_STOP}, lower(w)) GROUP BY item_id, lower(w)),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM f)
SELECT item_id, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (n <= 20), '') AS keywords FROM benchmark LEFT JOIN k USING (item_id) GROUP BY item_id""",
    "query_dedupe": f"""
WITH q AS (SELECT conv_id, turn, {sql.COLLAPSE.format("text")} AS query FROM conversations)
SELECT conv_id, turn, sha256(query) AS query_sha FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, lower(query) ORDER BY turn) AS n FROM q) WHERE n = 1""",
    "snippets": rf"""
SELECT doc_id, {_SNIPPET.format(_FLAT, 120)} AS snippet,
       CASE WHEN length(text) > 200 THEN substr(text, 1, 187) || '…[truncated]' ELSE text END AS bounded,
       CASE WHEN length({_FLAT}) > 100 THEN substr({_FLAT}, 1, 97) || '...' ELSE {_FLAT} END AS preview,
       coalesce(nullif({sql.STRIP.format(r"regexp_replace(regexp_replace(regexp_replace('## **' || substr(text, 1, 20) || '**', '^#+\s*', ''), '\*\*|__|`', '', 'g'), '<[^>]+>', '', 'g')")}, ''), 'Untitled Section') AS heading FROM documents""",
    "sentence_split": rf"""
WITH f AS (SELECT doc_id,
  list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?])\s+|\n+', '\1' || chr(31), 'g'), chr(31)), lambda s: {sql.STRIP.format("s")}), lambda s: s <> '') AS a,
  list_filter(list_transform(regexp_split_to_array(text, '[。！？.!?]\s*'), lambda s: {sql.STRIP.format("s")}), lambda s: s <> '') AS b FROM documents)
SELECT doc_id, len(a)::INTEGER AS n_sentences, len(b)::INTEGER AS n_plain, sha256(array_to_string(a, '|')) AS sha FROM f""",
}
