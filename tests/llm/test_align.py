import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import align, queries
from corvane.llm.bpe import byte_pieces, vocabulary_path

PATH_A, PATH_B = vocabulary_path(align.VOCABULARY_A), vocabulary_path(align.VOCABULARY_B)
SCHEMA = "doc_id long, text string, `row` int, pairs string, n_a int"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def brute(texts, libraries):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by comparing byte ranges of all tokens."""
    a, b = libraries
    piece_a = byte_pieces(PATH_A)
    piece_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spans = []
        for ids, piece in ((ids_a, piece_a.__getitem__), (ids_b, piece_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(piece(i)), i))
                at += len(piece(i))
            spans.append(own)
        raw = (" " + text).encode() if text else b""
        if not text or any(b"".join(p(i) for i in ids) != raw for ids, p in ((ids_a, piece_a.__getitem__), (ids_b, piece_b))):
            found.append(([], [], [], ""))
            continue
        ends = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(i) for x, y, i in own if low <= x and y <= high) for own in spans))
            low = high
        links, j = [], 0
        for x, y, i in spans[0]:
            while spans[1][j][1] <= x:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < y:
                links.append((i, spans[1][k][2]))
                k += 1
        found.append((ids_a, ids_b, links, ";".join(groups)))
    counts = Counter(link for _, _, links, _ in found for link in links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for ids_a, ids_b, links, groups in found:
        n_best = sum(counts[x] == most[x[1]] for x in links)
        out.append((len(ids_a), len(ids_b), groups.count(";") + 1 if groups else 0, len(links), n_best, sum(counts[x] for x in links), groups))
    return out


def texts_of():
    rng = random.Random(5)
    words = ["the", "align", "Überraschung", "it's", "don't", "12345", "3.14", "<|endoftext|>", "<s>", "</s>", "日本語", "emoji😀", "naïve", " ", "　", "\t", "\n\n", "  ", "-->", "a_b", "ﬁ", "½", "\x07", "﻿", "é", "한국어", "שלום"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    texts += [None, "", " ", "   ", "\n", "▁", "a▁b", "one two", "one two", "one two", "x" * 3_000, " " * 2_000 + "y", "\t\n" * 900 + "z", "word " * 4_000, "é" * 700 + " tail"]
    return texts


@pytest.mark.parametrize("bound", [align.HOT_PAIRS, 40])
def test_alignment_is_that_of_brute_force(spark, libraries, monkeypatch, bound):
    monkeypatch.setattr(align, "HOT_PAIRS", bound)  # with 40 most pairs take the way of rare ones
    texts = texts_of()
    df = spark.createDataFrame([(i if i % 9 else None, t, 1, "p", 2) for i, t in enumerate(texts)], SCHEMA)
    want = Counter()
    for i, (row, text) in enumerate(zip(brute(texts, libraries), texts, strict=True)):
        want[(i if i % 9 else None, *row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "")] += 1
        assert text or row[0] == 0
    got = Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in align.alignment_digests(df).collect())
    assert got == want and sum(1 for k in want if k[1]) > 80


def test_alignment_of_an_empty_table(spark):
    assert align.alignment_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_memory_of_windows_is_bounded(libraries, monkeypatch):
    monkeypatch.setattr(align, "KNOWN", 3)
    texts = [t for t in texts_of() if t]
    windows = align.Windows(*align._tokenizers(PATH_A, PATH_B))
    parts = [windows.aligned(texts[i : i + 2]) for i in range(0, len(texts), 2)]
    assert [g for p in parts for g in p["groups"]] == [row[-1] for row in brute(texts, libraries)]


def test_whole_table_against_brute_force(spark, libraries):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (*row[:-1], hashlib.sha256(row[-1].encode()).hexdigest() if row[-1] else "") for r, row in zip(rows, brute([r["text"] for r in rows], libraries), strict=True)}
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in queries.QUERIES["op11_token_align"](spark, sf).collect()}
    assert got == want
