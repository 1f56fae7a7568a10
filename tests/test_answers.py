"""Small cases of listings, located documents, resolved ids, holders of passages, summaries and recall."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import documents, evaluate, evidence, lifecycle, memory, search

CHUNK = "doc_id long, chunk_index int, chunk_id string, text string, source_path string, doc_type string, collection string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = []
    for i in range(8):
        path = None if i == 7 else f"data/{'b' if i % 2 else 'a'}/Paper{i}.md"
        rows += [(i, k, f"c{i}_{k}", "# Title %d\nbody" % (i % 3) if k == 0 else ("## References\nold" if k == 2 else f"part {k}"), path, "md", f"col{i % 2}") for k in range(3)]
    return spark.createDataFrame(rows, CHUNK)


def test_listing_is_ordered_and_bounded(chunks):
    shown = [(r["position"], r["doc_id"], r["chunk_count"]) for r in documents.listed(chunks).orderBy("position").collect()]
    assert shown == [(k, d, 3) for k, d in enumerate([7, 0, 2, 4, 6, 1, 3, 5])]
    assert [r["doc_id"] for r in documents.listed(chunks, "col1", 2).orderBy("position").collect()] == [7, 1]
    assert documents.listed(chunks, limit=0).count() == 1 and documents.listed(chunks, "none").count() == 0


def test_located_documents(spark, chunks):
    asked = [(1, " 3 ", "ignored", None, None), (2, None, "one hit", None, None), (3, None, "two hits", "x", None), (4, None, "no hit", None, None), (5, None, None, "PAPER4", None), (6, "", " ", "data/a", None), (7, None, None, "data/a", "title 2"), (8, None, None, "zz", None), (9, None, None, None, " "), (10, "99", None, None, None)]
    requests = spark.createDataFrame(asked, "request_id int, doc_id string, query string, source_path string, title string")
    hits = spark.createDataFrame([(2, 5), (2, 5), (3, 1), (3, 2), (5, 1)], "request_id int, doc_id long")
    got = {r["request_id"]: (r["how"], r["doc_id"], r["n_matched"]) for r in documents.located(chunks, requests, hits).collect()}
    assert got == {1: ("given", "3", 1), 2: ("searched", "5", 1), 3: ("ambiguous", None, 2), 4: ("missing", None, 0), 5: ("matched", "4", 1), 6: ("ambiguous", None, 4), 7: ("matched", "2", 1), 8: ("missing", None, 0), 9: ("empty", None, 0), 10: ("given", "99", 1)}
    texts = {r["request_id"]: (r["how"], r["doc_id"], r["full_text"]) for r in documents.located_texts(chunks, requests, hits).collect()}
    assert texts[1] == ("given", "3", "# Title 0\nbody\n\npart 1") and texts[10] == ("missing", None, None) and texts[6] == ("ambiguous", None, None)


def test_ids_that_begin_alike_do_not_all_meet(spark):
    ids = [f"data/documents/{i:05d}.md" for i in range(3_000)]
    chunks = spark.createDataFrame([(c,) for c in [*ids, "x"]], "chunk_id string")
    asked = spark.createDataFrame([(a,) for a in ["data/documents/00042.md", "documents/0123", "/02999", "zzz", "", "x", "data"]], "asked_id string")
    got = {}
    for r in evidence.containing(asked, chunks).collect():
        got.setdefault(r["asked_id"], set()).add(r["chunk_id"])
    assert got == {a: {c for c in [*ids, "x"] if a in c} for a in ["data/documents/00042.md", "documents/0123", "/02999", "x", "data"]}


def test_many_passages_meet_in_a_join(spark, monkeypatch):
    passages = spark.createDataFrame([(1, "the quick brown fox jumps over it"), (2, "a b c"), (3, "two words"), (4, "x  y z w"), (5, "the quick brown fox jumps over it all day")], "query_id int, text string")
    texts = spark.createDataFrame([(1, "so the quick brown fox jumps over it!"), (2, "the quick brown fox jumps  over it"), (3, "xa b cx"), (4, "x  y z w"), (5, ""), (6, None), (7, "the quick brown fox jumps over it all day long")], "chunk_id int, text string")
    rows = lambda: {tuple(r) for r in evaluate.holders(texts, passages).collect()}
    sent = rows()
    monkeypatch.setattr(evaluate, "SENT_PASSAGES", 1)
    assert rows() == sent == {(1, 1), (1, 7), (2, 3), (4, 4), (5, 7)}


def test_result_summaries_and_traces(spark):
    content = "array<struct<type:string,text:string>>"
    rows = [(1, True, [("text", "a"), ("image", None), ("text", ""), ("text", "b")]), (2, False, []), (3, None, None), (4, False, [("image", None), ("image", None)]), (5, False, [("text", "x" * 50)])]
    df = spark.createDataFrame(rows, f"id int, bad boolean, content {content}")
    got = {r["id"]: r["s"] for r in df.select("id", evidence.result_summary(F.col("content"), F.col("bad"), 30).alias("s")).collect()}
    assert got == {1: "[error] a b [含 1 张图，未展开]", 2: "", 3: "", 4: "[含 2 张图，未展开]", 5: "x" * 17 + "…[truncated]"}
    for n in (19, 20, 21, 60):
        steps = spark.createDataFrame([(1, k, "t", "s" * n) for k in range(3)], "task_id int, position int, tool_name string, summary string")
        whole = "\n".join(f"t: {'s' * n}" for _ in range(3))
        (row,) = evidence.trace_text(steps, most=46).collect()
        assert row["trace"] == (whole if len(whole) <= 46 else whole[:33] + "…[truncated]")


def test_many_memories_compressed_by_score(spark):
    rows = [(1, 0, "low", 0.1), (1, 1, "none", None), (1, 2, "high", 0.9), (1, 3, " ", 1.0), (1, 4, "same", 0.5), (2, 0, "x" * 3_000, 0.2), (2, 1, "y", 0.1), (3, 0, None, 1.0)]
    got = {r["m"]: r["text"] for r in memory.compressed_many(spark.createDataFrame(rows, "m int, position int, text string, score double"), "m").collect()}
    assert got == {1: "high none same low", 2: "x" * 2_048}


def test_recall_takes_the_best_body_or_the_stored_score(spark):
    short = spark.createDataFrame([(1, [1.0, 0.0], 0.3), (1, [0.6, 0.8], 0.3), (2, None, 0.7), (2, [], 0.9), (3, [-1.0, 0.0], 0.8), (4, [0.0, 0.0], 0.8)], "item_id long, embedding array<double>, score double")
    long = spark.createDataFrame([(8, [0.8, 0.6]), (9, None)], "item_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query_id int, embedding array<double>")
    got = sorted(tuple(r) for r in memory.recall(short, long, asked, 4).collect())
    assert got == [(1, 1, "short", 1, 1.0), (1, 2, "short", 2, 0.9), (1, 3, "long", 8, 0.8), (1, 4, "short", 3, 0.0), (2, 1, "short", 2, 0.9), (2, 2, "short", 1, 0.8), (2, 3, "long", 8, 0.6), (2, 4, "short", 3, 0.0)]


def test_three_rules_of_sections(spark):
    heads = ["# Appendix", "## appendix b", "## **Appendix**", "# References", "### Appendix", "text"]
    got = spark.createDataFrame([(h,) for h in heads], "t string").select("t", text.is_appendix(F.lit(""), F.col("t")).alias("a"), text.is_appendix(F.lit(""), F.col("t"), single_hash=False).alias("s"), text.section_kind(F.lit(""), F.col("t")).alias("k")).collect()
    assert {r["t"]: (r["a"], r["s"], r["k"]) for r in got} == {"# Appendix": (True, False, "appendix"), "## appendix b": (True, True, "appendix"), "## **Appendix**": (True, True, "appendix"), "# References": (False, False, "references"), "### Appendix": (False, False, None), "text": (False, False, None)}


def test_evidence_is_checked_by_parts_of_ids(spark):
    answers = spark.createDataFrame([(1, "alpha beta gamma delta epsilon."), (2, "nothing here that anyone supports today.")], "answer_id int, text string")
    chunks = spark.createDataFrame([("doc_1_0001_aa", "alpha beta gamma delta epsilon"), ("doc_1_0002_bb", "zeta eta")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "0001_aa"), (1, "doc_1_0001_aa"), (1, "missing"), (2, "0002")], "answer_id int, asked_id string")
    got = {r["answer_id"]: (r["n_found"], r["n_missing"], r["n_unsupported"], r["passed"]) for r in evidence.checked(answers, asked, chunks, 1).collect()}
    assert got == {1: (1, 1, 0, True), 2: (1, 0, 1, True)}


def test_ids_of_evidence_are_resolved_once(spark):
    answers = spark.createDataFrame([(1, "alpha beta gamma delta epsilon.")], "answer_id int, text string")
    chunks = spark.createDataFrame([("doc_1_0001_aa", "alpha beta gamma delta epsilon")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "0001_aa"), (1, "missing")], "answer_id int, asked_id string")
    judged = evidence.checked(answers, asked, chunks, 1)
    assert "Contains(" not in judged._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["n_found"], r["n_missing"]) for r in judged.collect()] == [(1, 1)]


def test_batch_totals_and_distinct_queries(spark):
    parts = spark.createDataFrame([(d, k, "x" * (50 if (d, k) == (1, 3) else 5)) for d in (1, 2) for k in range(5)], "doc_id int, chunk_index int, text string")
    (row,) = lifecycle.batch_totals(lifecycle.batch_outcomes(parts, F.length("text") > 20, 2)).collect()
    assert (row["n_batches"], row["failed_batches"], row["n_texts"], row["failed_texts"], row["lost_texts"], row["success_rate"], row["largest_batch"], row["touched_documents"]) == (6, 1, 10, 1, 2, 0.8, 2, 1)
    asked = spark.createDataFrame([(1, 0, "A  b"), (1, 1, "a B "), (1, 2, " "), (2, 0, "a b")], "s int, turn int, query string")
    assert sorted(map(tuple, search.distinct_queries(asked, "s", "turn").collect())) == [(1, 0, "A b"), (2, 0, "a b")]


def test_located_texts_of_more_documents_than_are_named(spark, chunks, monkeypatch):
    asked = spark.createDataFrame([(i, str(i), None, None, None) for i in range(10)], "request_id int, doc_id string, query string, source_path string, title string")
    none = spark.createDataFrame([], "request_id int, doc_id long")
    got = lambda: sorted(tuple(r) for r in documents.located_texts(chunks, asked, none).collect())
    named = got()
    monkeypatch.setattr(documents, "NAMED", 3)
    assert got() == named and [r[1] for r in named] == ["given"] * 8 + ["missing"] * 2


def test_texts_are_not_moved_to_be_located_or_shown(spark, chunks):
    """What meets few requests or answers is filtered or cut where it stands: no exchange has the texts of all chunks."""
    asked = spark.createDataFrame([(1, "3", None, None, None)], "request_id int, doc_id string, query string, source_path string, title string")
    found = documents.located_texts(chunks, asked, spark.createDataFrame([], "request_id int, doc_id long"))
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()
    answers = spark.createDataFrame([(1, 1, "c1_1", 0.5, 0.5, False)], "query_id int, index int, chunk_id string, score double, rerank_score double, fallback boolean")
    shown = search.response(answers, chunks)
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS text_snippet") < plan.index("Join")  # the plan's last steps come first
    assert [(r["chunk_id"], r["source"], r["text_snippet"]) for r in shown.collect()] == [("c1_1", "data/b/Paper1.md", "part 1")]
