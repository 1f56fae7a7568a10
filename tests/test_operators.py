import datetime as dt
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import ids, scoring, text
from corvane.operators import chunking, documents, evaluate, evidence, index, lifecycle, memory, search
from corvane.sources import files
from corvane.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_bm25_small_case(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "spark joins data"), ("d2", "spark spark streams"), ("d3", "vector search data"), ("d4", "graph walk")], "chunk_id string, text string")
    stored = index.build(index.term_stats(docs), str(tmp_path / "index"))
    ask = lambda *terms: {r["chunk_id"]: r["score"] for r in search.bm25(stored, spark.createDataFrame([(1, t) for t in terms], "query_id int, term string")).collect()}
    assert ask("vector", "data") == {"d3": 0.813998, "d1": 0.0}
    assert ask("spark") == {"d1": 0.0, "d2": 0.0}
    assert ask("vector", "vector")["d3"] == 1.627996


def test_bm25_reads_only_the_buckets_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha word{i} beta{i % 7}") for i in range(300)], "chunk_id long, text string")
    stored = index.build(index.term_stats(docs), str(tmp_path / "index"))
    found = search.bm25(stored, spark.createDataFrame([(1, "word5"), (1, "beta5"), (2, "nothing")], "query_id int, term string"))
    assert found.first()["chunk_id"] == 5 and {r["query_id"] for r in found.collect()} == {1}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    none = index.build(index.term_stats(docs.limit(0)), str(tmp_path / "none"))
    assert search.bm25(none, spark.createDataFrame([(1, "x")], "query_id int, term string")).count() == 0
    assert search.bm25(stored, spark.createDataFrame([], "query_id int, term string")).count() == 0


def test_index_versions(spark, tmp_path):
    rows = [("a_1", "one two two"), ("a_2", "two three"), ("b_1", "three four"), ("b_2", "")]
    docs = lambda some: index.term_stats(spark.createDataFrame(some, "chunk_id string, text string"))
    whole = index.build(docs(rows), str(tmp_path / "whole"))
    left = index.remove(whole, spark.createDataFrame([("b_1",), ("zz",)], "chunk_id string"), str(tmp_path / "left"))
    assert left.corpus().first()[:] == (3, 5, 5 / 3) and {r["term"]: r["df"] for r in left.terms().collect()} == {"one": 1, "two": 2, "three": 1}
    again = index.add(left, docs([("b_1", "three four"), ("a_2", "four five six")]), str(tmp_path / "again"))
    fresh = index.build(docs([rows[0], ("a_2", "four five six"), rows[2], rows[3]]), str(tmp_path / "fresh"))
    for of in ("postings", "terms", "lengths", "corpus", "weights"):
        assert sorted(map(tuple, getattr(again, of)().collect())) == sorted(map(tuple, getattr(fresh, of)().collect()))


def test_holders_are_those_that_contain_a_passage(spark):
    passages = [(1, "the quick brown fox jumps over it"), (2, "a b c"), (3, "two words"), (4, "x  y z w")]
    texts = [(1, "so the quick brown fox jumps over it!"), (2, "the quick brown fox jumps  over it"), (3, "xa b cx"), (4, "x  y z w"), (5, ""), (6, None)]
    got = evaluate.holders(spark.createDataFrame(texts, "chunk_id int, text string"), spark.createDataFrame(passages, "query_id int, text string"))
    assert {tuple(r) for r in got.collect()} == {(q, c) for q, p in passages for c, t in texts if t and p in t and q != 3}
    assert evaluate.holders(spark.createDataFrame(texts, "chunk_id int, text string"), spark.createDataFrame([], "query_id int, text string")).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "query_id int, rank int, chunk_id string")
    b = spark.createDataFrame([(1, 1, "z"), (1, 2, "x")], "query_id int, rank int, chunk_id string")
    got = [(r["chunk_id"], r["score"]) for r in search.fuse([a, b]).orderBy("rank").collect()]
    assert got == [("x", 0.032522), ("z", 0.016393), ("y", 0.016129)]
    assert [r["chunk_id"] for r in search.interleave(a, b).orderBy("rank").collect()] == ["x", "z", "y"]
    with pytest.raises(ValueError):
        search.fuse([])
    with pytest.raises(ValueError):
        search.fuse([a, b], weights=[1.0])


def test_vector_scores(spark):
    score = lambda a, b: round(value(spark, scoring.cosine_score(scoring.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))), 6)
    assert score([1.0, 1.0], [1.0, 0.0]) == 0.853553
    assert score([1.0, 0.0], [-1.0, 0.0]) == 0
    assert score([2.0, 1.0], [2.0, 1.0]) == 1
    assert value(spark, scoring.cosine(F.array().cast("array<double>"), F.array(F.lit(1.0)))) == 0


@pytest.mark.parametrize("hours,score,uses,total,passed", [(0, 1.0, 5, 0.9987, True), (48, 0.5, 0, 0.25, False), (0, 0.7, 2, 0.8229, True), (0, 0.8, 0, 0.7, True), (0, 0.6, 0, 0.6, False)])
def test_promotion(spark, hours, score, uses, total, passed):
    now = dt.datetime(2024, 1, 10)
    items = spark.createDataFrame([(now - dt.timedelta(hours=hours), score, uses)], "ts timestamp, score double, access_count int")
    got = memory.promoted(items, F.lit(now)).first()
    assert round(got["total"], 4) == total and got["promoted"] is passed


def test_metrics(spark):
    results = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "a")], "query_id int, rank int, chunk_id string")
    truth = spark.createDataFrame([(1, "c"), (1, "x")], "query_id int, chunk_id string")
    rows = {r["query_id"]: r for r in evaluate.per_query(results, truth, spark.createDataFrame([(1,), (2,)], "query_id int")).collect()}
    assert (rows[1]["hit_rate"], rows[1]["mrr"], rows[1]["hit_at_1"], rows[1]["hit_at_5"], rows[1]["recall_at_5"]) == (1, 0.333333, 0, 1, 0.5)
    assert all(rows[2][m] == 0 for m in evaluate.METRICS)


def test_verdict(spark):
    facts = spark.createDataFrame([(2, 1, 4, 1, 0, False)], "n_found long, n_missing long, n_sentences long, n_unsupported long, n_references long, cited boolean")
    got = evidence.verdicts(facts).first()
    assert got["score"] == 0.75 and got["passed"]


def test_filter_syntax(spark):
    found = text.parse_filters(F.lit("c:docs type:pdf tags:a,b tag:c spark joins"))
    got = spark.range(1).select(*[c.alias(n) for n, c in found.items()]).first()
    assert (got["collection"], got["doc_type"], got["tags"], got["rest"]) == ("docs", "pdf", ["a", "b", "c"], "spark joins")


def test_section_filter(spark):
    rows = [(1, i, t) for i, t in enumerate(["# T", "## Intro", "## References", "## A Extra", "## 5 Notes"])]
    parts = spark.createDataFrame(rows, "doc_id int, section_index int, text string")
    assert [r["section_index"] for r in chunking.region_kept(parts).orderBy("section_index").collect()] == [0, 1]


def test_ids(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()[:8]
    assert value(spark, ids.stored_chunk_id(F.lit("p/é.md"), F.lit(12345), F.lit("ü"))) == f"{h('p/é.md')}_12345_{h('ü')}"
    assert value(spark, ids.evidence_ids(F.lit("see ab12cd34_0001_deadbeef and doc_ff01."))) == ["ab12cd34_0001_deadbeef", "doc_ff01"]


def test_neighbours(spark):
    chunks = spark.createDataFrame([("d", i, f"c{i}") for i in range(5)], "doc_id string, chunk_index int, chunk_id string")
    target = chunks.where("chunk_index = 0")
    places = lambda w: sorted(r["relative_position"] for r in documents.neighbours(chunks, target, w).collect())
    assert places(2) == [0, 1, 2]
    assert places(9) == [0, 1, 2, 3, 4]


def test_error_streaks(spark):
    def streak(*lines):
        rows = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "session int, position int, line string")
        return evidence.error_streaks(rows).first()["streak"]

    assert streak("[error] a", "", "[error] b", "[error] c")
    assert not streak("[error]", "[error]", "ok", "[error]")


def test_refine(spark):
    dirty = "a<br>b <i>c</i> &lt;x&gt;  <!-- n -->\n\n\n\nd  \n──────────── Page 1 ────────────"
    assert value(spark, text.refine(F.lit(dirty))) == "a / b c <x>\n\nd"
    fenced = "<b>x</b>\n```\n<keep>  it</keep>\n```\ny<br>z"
    assert value(spark, text.refine_fenced(F.lit(fenced))) == "x\n```\n<keep>  it</keep>\n```\ny / z"


def test_fenced_refine_takes_whole_texts(spark, tmp_path):
    import hashlib

    from corvane.plans import texts

    body = " ".join(f"word{i}" for i in range(100)) + "\n```\n<b>  kept</b>\n```\nlast"
    spark.createDataFrame([(1, body, "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    want = f"a b\n```\n<keep>   this</keep>\n```\n{body} / c"
    got = texts.fenced_refine(spark, str(tmp_path)).first()
    assert (got["refined_sha"], got["n_chars"]) == (hashlib.sha256(want.encode()).hexdigest(), len(want))


def test_full_text_is_whole_up_to_the_references_bound(spark):
    chunks = spark.createDataFrame([(1, i, "x" * 1_000) for i in range(115)], "doc_id long, chunk_index int, text string")
    assert documents.full_text(chunks).select(F.length("full_text")).first()[0] == 115 * 1_000 + 114 * 2


def test_title_summary_tags(spark):
    assert value(spark, text.rule_title(F.lit("## Head line\nmore"))) == "Head line"
    assert value(spark, text.rule_title(F.lit(""))) == "Untitled"
    assert value(spark, text.rule_summary(F.lit("A b. C d! E f? G h."))) == "A b. C d! E f?"
    assert value(spark, text.rule_tags(F.lit("New York has camelCase and snake_case, **bold** too."))) == ["New York", "bold", "camelCase", "snake_case"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n!?;,é|", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_split_keeps_to_its_bounds(body, size, overlap):
    pieces = chunking.split_by_size(body, size, overlap)
    assert all(len(p) <= size for p in pieces)
    assert set("".join(pieces)) - set(" \n") == set(body) - set(" \n")
    if not overlap:
        assert "".join("".join(pieces).split()) == "".join(body.split())


def test_ledger(spark):
    old = spark.createDataFrame([("h1", "p1", "failed", "c1", "bad", 1), ("h2", "p2", "success", "c2", None, 1)], "file_hash string, file_path string, status string, collection string, error_msg string, t int")
    stamp = F.lit("2024-01-01").cast("timestamp")
    old = old.select("file_hash", "file_path", "status", "collection", "error_msg", stamp.alias("processed_at"), stamp.alias("updated_at"))
    news = spark.createDataFrame([("h1", "p1", "success", "c9", None), ("h3", "p3", "failed", "c3", "oops")], "file_hash string, file_path string, status string, collection string, error_msg string")
    got = {r["file_hash"]: r for r in lifecycle.mark(old, news, F.lit("2024-02-02").cast("timestamp")).collect()}
    assert got["h1"]["status"] == "success" and got["h1"]["error_msg"] is None and got["h1"]["processed_at"].month == 1 and got["h1"]["updated_at"].month == 2
    assert got["h3"]["error_msg"] == "oops" and got["h2"]["updated_at"].month == 1
    left = lifecycle.pending(spark.createDataFrame([("h1",), ("h2",), ("h4",)], "file_hash string"), old)
    assert sorted(r[0] for r in left.collect()) == ["h1", "h4"]


def test_tolerant_json(spark):
    parse = lambda s: value(spark, lifecycle.tolerant_json(F.lit(s), "k int")["k"])
    assert (parse('```json\n{"k": 1}\n```'), parse('so: {"k": 2} ok'), parse("none")) == (1, 2, None)


def test_file_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("x.pdf", "a/y.PDF", "z.txt"):
        (tmp_path / name).write_bytes(b"data " + name.encode())
    found = files.file_hashes(files.discover_files(spark, str(tmp_path))).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found) == ["x.pdf", "y.PDF"]
    golden = tmp_path / "g.jsonl"
    golden.write_text('{"query": "q", "relevant_chunk_ids": ["c1"]}\n')
    assert files.golden_set(spark, str(golden)).first()["expected_ids"] == ["c1"]
    whole = tmp_path / "g.json"
    whole.write_text('{"test_cases": [{"query": "q", "expected_chunk_ids": ["c2"]}]}')
    assert files.golden_set(spark, str(whole)).first()["expected_ids"] == ["c2"]
    traces = files.read_traces(spark, str(golden)).limit(0)
    files.append_traces(traces, str(tmp_path / "traces"))


def test_incremental_ingestion(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first = spark.createDataFrame([(1, "# a\nx\n# b\ny"), (2, "plain")], "doc_id long, text string")
    first.write.parquet(source)
    for _ in range(2):  # nothing new comes the second time
        ingest.ingest_new(spark, "doc_id long, text string", source, sink, state)
        assert spark.read.parquet(sink).count() == 3
    spark.createDataFrame([(3, "# c\nz")], "doc_id long, text string").write.mode("append").parquet(source)
    ingest.ingest_new(spark, "doc_id long, text string", source, sink, state)
    assert spark.read.parquet(sink).count() == 4


def test_dense_over_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    vectors = spark.createDataFrame([*rows, (99, None), (98, [1.0])], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame(rows[:7], "query_id long, embedding array<double>")
    monkeypatch.setattr(search, "BLOCK", 16)
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in search.dense(vectors, queries, 4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(7):
        score = np.round((1 + unit[q] @ unit.T) / 2, 6)
        assert [got[(q, k + 1)] for k in range(4)] == list(np.lexsort((np.arange(60), -score))[:4])
    monkeypatch.setattr(search, "BLOCK", 4)  # more queries than one block holds
    assert {(r["query_id"], r["rank"]): r["chunk_id"] for r in search.dense(vectors, queries, 4).collect()} == got


def test_hybrid_keeps_single_lists(spark):
    shape = "query_id int, rank int, chunk_id string, score double"
    a = spark.createDataFrame([(1, 1, "x", 0.9), (1, 2, "y", 0.8), (2, 1, "x", 0.7)], shape)
    b = spark.createDataFrame([(1, 1, "y", 5.0), (3, 1, "z", 4.0)], shape)
    got = [tuple(r) for r in search.hybrid(a, b).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "y", round(1 / 62 + 1 / 61, 6)), (1, 2, "x", round(1 / 61, 6)), (2, 1, "x", 0.7), (3, 1, "z", 4.0)]


def test_rerank_falls_back_to_the_order(spark):
    found = spark.createDataFrame([(1, 1, "x", 0.9), (1, 2, "y", 0.8), (1, 3, "z", 0.7), (2, 1, "x", 0.7), (2, 2, "z", 0.1)], "query_id int, rank int, chunk_id string, score double")
    scores = spark.createDataFrame([(1, "x", 0.1), (1, "z", 0.5)], "query_id int, chunk_id string, rerank_score double")
    got = [(r["query_id"], r["index"], r["chunk_id"], r["fallback"]) for r in search.reranked(found, scores, 5).orderBy("query_id", "index").collect()]
    assert got == [(1, 1, "z", False), (1, 2, "x", False), (2, 1, "x", True), (2, 2, "z", True)]


def test_response_shows_five(spark):
    rows = spark.createDataFrame([(1, i, i, 1.0, 1.0, False) for i in range(1, 8)], "query_id int, index int, chunk_id int, score double, rerank_score double, fallback boolean")
    chunks = spark.createDataFrame([(i, f"p{i}", f"text {i} [IMAGE: im{i}]") for i in range(9)], "chunk_id int, source_path string, text string")
    got = search.response(rows, chunks).orderBy("index").collect()
    assert [r["shown"] for r in got] == [True] * 5 + [False] * 2 and {r["n_more"] for r in got} == {2} and got[0]["images"] == ["im1"]


BLOCKS = """intro
[IMAGE: a]

----- Start of picture text -----
|x|y|
----- End of picture text -----
Figure 1: caption
goes on

normal again
|a|b|
|---|---|
|1|2|

Table 2: what it says
in two lines

|not|a table|
tail
[IMAGE: b]
text behind"""


def test_protected_blocks():
    got = chunking.protected_blocks(BLOCKS)
    assert [k for k, _ in got] == ["normal", "image", "normal", "table", "normal", "image", "normal"]
    assert got[1][1].endswith("Figure 1: caption\ngoes on") and got[3][1].startswith("|a|b|") and got[3][1].endswith("in two lines") and got[4][1] == "|not|a table|\ntail"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["text", "", "[IMAGE: a]", "|a|b|", "|---|---|", "## H", "Figure 1: c", "Table 1: c", "----- Start of picture text -----", "----- End of picture text -----"]), max_size=30))
def test_blocks_keep_every_line(lines):
    blocks = chunking.protected_blocks("\n".join(lines))
    assert [w for _, b in blocks for w in b.split()] == " ".join(lines).split()
    assert all(b for _, b in blocks) and all(k != "table" or "|" in b for k, b in blocks)


def test_short_headings_go_with_what_follows():
    merge = chunking.merged_headings
    assert merge(["# Title", "## 3 Setup", "## 3.1 Low\ntext", "## A", "## B", "body", "## C"]) == ["# Title", "## 3 Setup\n\n## 3.1 Low\ntext", "## A", "## B\n\nbody", "## C"]
    assert merge(["## 6 X", "## 4.4 Y\nt"]) == ["## 6 X", "## 4.4 Y\nt"] and merge(["## " + "x" * 130, "t"]) == ["## " + "x" * 130, "t"]
    assert merge(["## 1 A", "## 1.1 B", "text"]) == ["## 1 A\n\n## 1.1 B", "text"]  # taken along, it takes no more
    assert merge([]) == [] and chunking.heading_number("## **4.2.1 Round**") == "4.2.1"


def test_split_documents_against_plain_rules(spark):
    docs = [(1, "# T\n\n" + "one two three. " * 40 + "\n## References\nref\n## Appendix\napp"), (2, BLOCKS), (3, ""), (4, None), (5, "## A\nx\n## B")]
    got = chunking.split_documents(spark.createDataFrame(docs, "doc_id long, text string"), 120, 20).orderBy("doc_id", "chunk_index").collect()
    by_doc = {}
    for r in got:
        assert r["chunk_index"] == len(by_doc.setdefault(r["doc_id"], []))
        by_doc[r["doc_id"]].append(r["text"])
    assert set(by_doc) == {1, 2, 5} and by_doc[5] == ["## A\nx", "## B"]
    assert not any("ref" in c or "app" in c for c in by_doc[1]) and all(len(c) <= 121 for c in by_doc[1])
    assert [c for c in by_doc[2] if c.startswith("|a|b|")] and sum("[IMAGE:" in c for c in by_doc[2]) == 2
    with pytest.raises(ValueError):
        chunking.split_documents(spark.createDataFrame(docs, "doc_id long, text string"), 10, 10)


def test_recursive_chunks_cover_documents(spark):
    docs = [(i, " ".join(f"w{i}x{k}." for k in range(n))) for i, n in enumerate([0, 1, 30, 400])]
    got = {}
    for r in chunking.recursive_chunks(spark.createDataFrame(docs, "doc_id long, text string"), 200, 0).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, body in docs:
        assert [w for c in got.get(i, []) for w in c.split()] == body.split() and all(len(c) <= 200 for c in got.get(i, []))


def test_rule_tags_against_plain_python(spark):
    import random
    import re

    rng = random.Random(5)
    words = ["New York", "camelCase", "snake_case", "**bold**", "*em*", "__Under__", "plain", "A", "Xy", "_it_", "dot.", "\n"]
    bodies = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(60)]

    def tags(body):
        capital = re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", body)[:5]
        names = re.findall(r"\b[a-z]+(?:[A-Z][a-z]*)+\b|\b[a-z]+_[a-z_]+\b", body)[:5]
        found = re.findall(r"\*\*([^\n]+?)\*\*|\*([^\n]+?)\*|__([^\n]+?)__|_([^\n]+?)_", body)
        strong = [m[g].strip() for g in range(4) for m in found[:5] if m[g]]
        return sorted(set(capital + names + strong))[:10]

    df = spark.createDataFrame(list(enumerate(bodies)), "i long, t string")
    assert {r["i"]: r["tags"] for r in df.select("i", text.rule_tags(F.col("t")).alias("tags")).collect()} == {i: tags(b) for i, b in enumerate(bodies)}


def test_small_functions(spark):
    assert value(spark, text.title_case(F.lit("a/my_file-name.v2.md"))) == "My File Name.v2" and value(spark, text.stem(F.lit("a/b.c.md"))) == "b.c"
    assert value(spark, scoring.distance_similarity(F.lit(1.5))) == 0.0 and value(spark, text.safe_int(F.lit("x"))) == 10**9
    assert value(spark, ids.document_of_chunk(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("d/paper.pdf"), F.lit("c"))) == "doc_paper"
    assert value(spark, ids.normalized(F.array(*[F.lit(x) for x in (" a", "b", "a ", "", "c")]), 2)) == ["a", "b"]


def test_files_and_versions(spark, tmp_path):
    papers = spark.createDataFrame([("f1", "2", "x"), ("f1", "1", "y"), ("f2", "0", "z")], "full_id string, local_id string, title string")
    assert [tuple(r) for r in files.corpus_metadata(papers).collect()] == [("f1", "1", "y")]
    first, second = (files.write_version(papers, str(tmp_path / "v")) for _ in range(2))
    assert first != second and spark.read.parquet(first).count() == 3
    traces = spark.createDataFrame([("t1", "query", "a", "b", [("s", "c", 1.5)], {"k": "v"})], files.TRACE)
    for _ in range(2):
        files.append_traces(traces, str(tmp_path / "traces"))
    assert files.read_traces(spark, str(tmp_path / "traces")).collect() == traces.collect() * 2


def test_no_shared_folder_on_a_cluster_is_an_error():
    from types import SimpleNamespace

    from corvane import session

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(cluster)


def test_discarded_tables_are_gone(spark, tmp_path):
    from corvane import session

    df = session.staged(spark.range(10), "numbers")
    files = df.inputFiles()
    session.discard(df)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    spark.range(3).write.parquet(str(tmp_path / "own"))
    with pytest.raises(ValueError):
        session.discard(spark.read.parquet(str(tmp_path / "own")))
