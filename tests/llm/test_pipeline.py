import math
import random
from collections import Counter

import corpus_pipeline
from corvane.llm import bpe
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(500)]
    passage = " ".join(f"shared{i}" for i in range(60))
    body = lambda: " ".join(rng.choice(words) for _ in range(60))
    rows = [(i, body(), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, "too short", "en", "s0"), (101, None, "en", "s0"), (102, "", None, None), (103, rows[0][1], "en", "s1"), (104, rows[5][1] + " tail", "en", None)]
    rows += [(105, f"{body()}\n{passage}", "fr", "s2"), (106, f"{body()}\n{passage}\n{body()}", "fr", "s2"), (107, "again and again so on " * 30, "de", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == COLUMNS
    ids = {name: {r["doc_id"] for r in found} for name, found in seen.items()}
    everything = {r[0] for r in rows}
    assert ids["quality rules"] == everything - {100, 101, 102, 107}
    assert ids["line dedup"] == ids["quality rules"] - {103}
    lined = {r["doc_id"]: r for r in seen["line dedup"]}
    assert passage in lined[105]["text"] and passage not in lined[106]["text"] and lined[106]["n_chars"] == len(lined[106]["text"])
    prints = {r["doc_id"]: brute.fingerprint(r["text"]) for r in seen["line dedup"]}
    root = brute.groups(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    firsts = {}
    for i in sorted(prints):
        firsts.setdefault(root[prints[i]], i)
    assert ids["simhash near-dedup"] == set(firsts.values())
    size, mixed = Counter(), Counter()
    for r in seen["simhash near-dedup"]:
        size[r["source"]] += len(brute.WORD.findall(r["text"]))
    whole = {(r["doc_id"], r["text"]) for r in seen["simhash near-dedup"]}
    for r in seen["source mixing"]:
        mixed[r["source"]] += len(brute.WORD.findall(r["text"]))
        assert any(r["doc_id"] == i and t.startswith(r["text"]) for i, t in whole)
    assert mixed == {s: math.floor(t + 1e-9) for s, t in brute.targets(size).items()}
    tokenizer = bpe._tokenizer(bpe.vocabulary_path())
    want = Counter((r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids), brute.sha(r["text"])) for r in seen["source mixing"])
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in seen["bpe encoding"]) == want
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(tuple(r) for r in seen["bpe encoding"])


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
