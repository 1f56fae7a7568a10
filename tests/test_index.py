"""The stored index: segments, tombstones, versions, and searches that skip blocks."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvane.operators import index, search


def chunks(spark, rows):
    return index.term_stats(spark.createDataFrame(rows, "chunk_id long, text string"))


def words(rng, n):
    """Words of which some are in nearly every text and some in few."""
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), 4000)}" for _ in range(n))


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def state(stored):
    return {of: sorted(map(tuple, getattr(stored, of)().collect())) for of in ("postings", "terms", "lengths", "corpus", "weights")}


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(0, 90))) for i in range(3_000)]
    return rows, index.build(chunks(spark, rows), str(tmp_path_factory.mktemp("large") / "index"))


def test_segments_and_tombstones(spark, tmp_path):
    rng = random.Random(1)
    rows = {i: words(rng, rng.randint(0, 30)) for i in range(200)}
    root = str(tmp_path / "index")
    first = index.build(chunks(spark, list(rows.items())), root)
    before = state(first)
    fresh = lambda name: state(index.build(chunks(spark, list(rows.items())), str(tmp_path / name)))
    for step in range(4):
        stored = index.Index(spark, root)
        gone = [(i,) for i in range(step * 10, step * 10 + 15)] + [(9_999,)]
        stored = index.remove(stored, spark.createDataFrame(gone, "chunk_id long"))
        for (i,) in gone:
            rows.pop(i, None)
        news = {i: words(rng, 12) for i in (step, step * 10 + 3, 150 + step, 300 + step)}  # new ids, ids that are there, ids that had gone
        rows |= news
        stored = index.add(stored, chunks(spark, list(news.items())))
    assert index.versions(spark, root) == list(range(1, 10)) and len(stored.parts) >= 8
    assert state(stored) == fresh("fresh") and state(first) == before  # who reads an old version keeps it
    assert state(index.Index(spark, root, 1)) == before
    whole = index.compact(stored)
    assert state(whole) == state(stored) and [p["kind"] for p in whole.parts] == ["segment"]
    assert index.vacuum(whole) and index.versions(spark, root) == [10] and state(index.Index(spark, root)) == fresh("again")
    asked = spark.createDataFrame([(q, t) for q in range(3) for t in ("w1", "w2", f"w{q + 3}")], "query_id int, term string")
    rows_of = lambda s: sorted(map(tuple, search.bm25(s, asked).collect()))
    assert rows_of(whole) == rows_of(index.build(chunks(spark, list(rows.items())), str(tmp_path / "third")))


def test_removing_all_and_nothing(spark, tmp_path):
    stored = index.build(chunks(spark, [(1, "one two"), (2, None)]), str(tmp_path / "index"))
    assert state(index.remove(stored, spark.createDataFrame([(7,)], "chunk_id long"))) == state(stored)
    none = index.remove(index.Index(spark, stored.root), spark.createDataFrame([(1,), (2,)], "chunk_id long"))
    assert none.corpus().first()[:] == (0, 0, 0.0) and none.postings().count() == none.terms().count() == none.lengths().count() == 0
    assert search.bm25(none, spark.createDataFrame([(1, "one")], "query_id int, term string")).count() == 0


def test_a_version_is_written_once(spark, tmp_path):
    stored = index.build(chunks(spark, [(1, "one two"), (2, "two")]), str(tmp_path / "index"))
    index.add(stored, chunks(spark, [(3, "three")]))
    with pytest.raises(ValueError, match="by another"):
        index.add(stored, chunks(spark, [(4, "four")]))  # on a version that is no longer the last
    assert sorted(r["chunk_id"] for r in index.Index(spark, stored.root).lengths().collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="no such version"):
        index.Index(spark, stored.root, 5)


def test_a_small_change_writes_little(spark, large, tmp_path):
    rows, stored = large
    whole = size(stored.root)
    added = index.add(stored, chunks(spark, [(i, t) for i, t in rows if i % 100 == 0]), str(tmp_path / "added"))
    removed = index.remove(stored, spark.createDataFrame([(i * 100,) for i in range(30)], "chunk_id long"), str(tmp_path / "removed"))
    # one chunk in a hundred; the rest of the bytes are what each file has besides its rows
    assert size(added.root) < 0.25 * whole and size(removed.root) < 0.1 * whole
    written = spark.read.parquet(f"{added.parts[-1]['path']}/postings").agg(F.sum("n")).first()[0]
    assert written == sum(len(set(t.split())) for i, t in rows if i % 100 == 0) and [p["path"] for p in added.parts[:1]] == [stored.parts[0]["path"]]
    assert state(added)["corpus"] == state(stored)["corpus"]


@pytest.mark.parametrize("k", [1, 5, 10_000])
def test_blocks_that_cannot_count_are_not_read(spark, large, k):
    _, stored = large
    asked = spark.createDataFrame([(1, "w1"), (1, "w700"), (2, "w9"), (2, "w9"), (3, "w9"), (3, "w40"), (4, "w12"), (5, "none"), (6, "w12"), (6, "w7"), (7, "w15"), (7, "w16"), (7, "w8")], "query_id int, term string")
    rows_of = lambda **how: sorted(map(tuple, search.bm25(stored, asked, k, **how).collect()))
    assert rows_of(prune=True) == rows_of(prune=False) != []
    needed = search.needed_blocks(stored, asked, k).groupBy().agg(F.count_if("needed").alias("read"), F.count(F.lit(1)).alias("all")).first()
    assert needed["read"] <= needed["all"] and (k > 5 or needed["read"] < 0.85 * needed["all"])


def test_short_queries_prune_by_themselves(spark, large, monkeypatch):
    _, stored = large
    asked, calls = spark.createDataFrame([(1, "w3")], "query_id int, term string"), []
    plain = search.needed_blocks
    monkeypatch.setattr(search, "needed_blocks", lambda *a: calls.append(1) or plain(*a))
    assert search.bm25(stored, asked).count() == 10 and not calls  # so few postings are sooner read
    monkeypatch.setattr(search, "PRUNED_POSTINGS", 10)
    assert search.bm25(stored, asked).count() == 10 and calls
    many = spark.createDataFrame([(1, f"w{i}") for i in range(30)], "query_id int, term string")
    assert search.bm25(stored, many).count() == 10 and len(calls) == 1


def test_counted_terms(spark):
    rows = [(1, ["b", "a", "b", "c", "b"]), (2, []), (3, ["x"])]
    got = spark.createDataFrame(rows, "id int, terms array<string>").select("id", index.rle(F.col("terms")).alias("c")).collect()
    assert {r["id"]: [tuple(x) for x in r["c"]] for r in got} == {1: [("a", 1), ("b", 3), ("c", 1)], 2: [], 3: [("x", 1)]}
