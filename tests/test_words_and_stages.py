"""The lexicon and its paths, the splitter as a table function, and transform stages."""

import itertools
import math
import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import chunking, index, lexicon, search, stages

LETTERS = "山水火木金土日月星天地人心手足口目耳"


def path_weight(path, weights, unknown):
    return sum(weights.get(w, unknown if len(w) == 1 else -math.inf) for w in path)


def test_best_path_against_all_paths():
    rng = random.Random(3)
    for _ in range(150):
        letters = LETTERS[:4]
        weights = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): -rng.random() * 9 for _ in range(12)}
        run = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        cuts = itertools.chain.from_iterable(itertools.combinations(range(1, len(run)), n) for n in range(len(run)))
        paths = [[run[i:j] for i, j in zip((0, *c), (*c, len(run)), strict=True)] for c in cuts]
        best = max(path_weight(p, weights, -9.5) for p in paths if max(map(len, p)) <= 4)
        got = lexicon.best_path(run, weights, -9.5)
        assert "".join(got) == run and path_weight(got, weights, -9.5) == pytest.approx(best)


@pytest.fixture(scope="module")
def corpus():
    """Texts made of known words without spaces between them."""
    rng = random.Random(7)
    letters = [chr(0x4E00 + i) for i in range(150)]
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([2, 2, 3]))) for _ in range(120)})
    texts = [[rng.choice(words) for _ in range(rng.randint(5, 25))] for _ in range(600)]
    return words, texts


def test_learned_words_and_search(spark, tmp_path, corpus):
    words, texts = corpus
    df = spark.createDataFrame([(i, "".join(t) + f"。word{i % 5} End") for i, t in enumerate(texts)] + [(900, None), (901, "")], "chunk_id long, text string")
    learned = lexicon.learn(df)
    found = {r["word"]: r for r in learned.collect()}
    assert len(set(words) & set(found)) >= 0.9 * len(words)
    # as plainly counted
    runs = ["".join(t) for t in texts]
    count = lambda w: sum(r.startswith(w, i) for r in runs for i in range(len(r)))
    word = words[0]
    total = sum(map(len, runs))
    assert found[word]["n"] == count(word)
    assert found[word]["cohesion"] == pytest.approx(min(math.log(count(word) * total / (count(word[:k]) * count(word[k:]))) for k in range(1, len(word))))
    known = lexicon.Lexicon(learned)
    right = total = 0
    for words_of in texts[:200]:
        ends = lambda ws: set(itertools.accumulate(map(len, ws)))
        got = known.cut("".join(words_of))
        right, total = right + len(ends(words_of) & ends(got)), total + len(ends(words_of) | ends(got))
    assert right / total > 0.9
    tokens = df.select("chunk_id", known.tokens(F.col("text")).alias("t")).collect()
    assert {r["chunk_id"]: r["t"] for r in tokens}[0] == [w for w in known.cut("".join(texts[0])) if len(w) > 1] + ["word0", "end"]
    # index and queries cut alike: a query of words stuck together finds the chunk that has them
    stored = index.build(index.term_stats(df, tokens=known.tokens), str(tmp_path / "index"))
    asked = spark.createDataFrame([(7, "".join(texts[7]))], "query_id int, text string").select("query_id", F.explode(known.tokens(F.col("text"))).alias("term"))
    assert search.bm25(stored, asked, 1).first()["chunk_id"] == 7
    plain = index.term_stats(df).where("chunk_id = 7").first()["terms"]
    assert "".join(texts[7]) in plain  # which stays one term without a lexicon


def test_lexicon_of_nothing(spark):
    none = lexicon.learn(spark.createDataFrame([("no runs here",), (None,)], "text string"))
    assert none.count() == 0
    known = lexicon.Lexicon(none)
    assert known.cut("山水火") == ["山", "水", "火"]
    rows = spark.createDataFrame([("Plain 山水 words",)], "text string").select(known.tokens(F.col("text")).alias("t"), text.tokens(F.col("text")).alias("p"))
    assert rows.first()[:] == (["plain", "words"], ["plain", "山水", "words"])
    with pytest.raises(ValueError):
        lexicon.Lexicon(spark.createDataFrame([("a", 1), ("b", 1)], "word string, n long"), 1)


def test_table_function_gives_the_splitters_rows(spark):
    rng = random.Random(5)
    part = ["## 1 Head\n", "## 1.1 Sub\n", "plain words here. More of them! ", "| a | b |\n|---|---|\n| c | d |\n", "[IMAGE: x1]\n", "\n\n", "# References\nref one\n", "text " * 60]
    docs = spark.createDataFrame([(i, "".join(rng.choice(part) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(99, None)], "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "chunk_index", "text").collect()))
    want = rows(chunking.split_documents(docs, 200, 30))
    assert rows(chunking.split_by_function(docs, 200, 30)) == want and len(want) > 200
    spark.udtf.register("split_sections", chunking.split_function())
    chunking.region_kept(chunking.sections(docs)).select("doc_id", "section_index", "text").createOrReplaceTempView("kept_sections")
    assert rows(spark.sql("SELECT * FROM split_sections(TABLE(kept_sections) PARTITION BY (doc_id) ORDER BY (section_index), 200, 30)")) == want


def test_stages_carry_errors_on(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "stop here"), (3, "12"), (4, None), (5, "x 7")], "id int, text string")
    chain = [
        stages.Stage("clean", lambda c: F.upper(c), lambda c: F.when(c.contains("stop"), F.concat(F.lit("stop in "), c))),
        stages.Stage("number", lambda c: F.concat(c, F.lit("!")), lambda c: F.when(c.rlike(r"^\d+$"), "digits only")),
        stages.Stage("last", lambda c: F.nullif(c, F.lit("X 7!"))),
    ]
    seen = Observation("stages")
    got = {r["id"]: r[1:] for r in stages.run_stages(rows, chain, counted=seen).collect()}
    assert got == {1: ("A B!", None, None), 2: ("stop here", "clean", "stop in stop here"), 3: ("12", "number", "digits only"), 4: (None, "clean", "no result"), 5: ("X 7!", "last", "no result")}
    assert seen.get == {"n_rows": 5, "failed_clean": 2, "reached_clean": 5, "failed_number": 1, "reached_number": 3, "failed_last": 1, "reached_last": 2}
    with pytest.raises(ValueError):
        stages.run_stages(rows, [chain[0], chain[0]])
