import hashlib
import random

import pytest

from corvane.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, `message` int, turns int"


def rows_of(spark, rows):
    """Conversations with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def messages(rows, conv):
    """Sorted as the operator states: null turns first, then role and text as escaped."""
    mine = [(r[1], r[2], r[3] or "") for r in rows if r[0] == conv]
    return [(role, text) for _, role, text in sorted(mine, key=lambda m: (m[0] is not None, m[0] or 0, m[1] is not None, m[1] or "", m[2]))]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    bits = ["#", "##", "###", "####", "<", ">", "/", "</turn>", "</part>", "</turn>\n", "\\", "\n", ":", "a", "é", "😀", "turn>", "### user:\n", " ", "\\n"]
    roles = ["user", "assistant", "assistant", "a:b\n\\###", None, "", " x", "</turn>\n"]
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(roles), text()) for c in range(120) for t in range(rng.randint(1, 6))]
    rows += [(500, None, "user", "x"), (500, 1, "assistant", None), (501, 3, "user", "same"), (501, 3, "user", "same"), (501, 3, "assistant", "tie"), (501, 2, None, "")]
    rows += [(502, 0, "user", "long ### " * 100_000), (502, 1, "assistant", "\\" * 50_000), (503, 0, "system", "only")]
    rows += [(504, t, "user" if t % 7 else "assistant", f"turn {t} </turn>") for t in range(1_000)]
    return rows


def test_chat_reads_back_what_was_written(spark, odd):
    done = chat.format_conversations(rows_of(spark, odd)).cache()
    formatted = {r["conv_id"]: r for r in done.collect()}
    read = {r["conv_id"]: r for r in chat.read_back(done).collect()}
    assert set(read) == {r[0] for r in odd}
    for conv, got in read.items():
        want = messages(odd, conv)
        assert [(t["role"], t["text"]) for t in got["turns"]] == want
        assert got["trained"] == [text for role, text in want if role == "assistant"]
        whole = formatted[conv]
        heads = 1 + sum(a[0] != b[0] for a, b in zip(want, want[1:], strict=False))
        assert whole["formatted"].count("</turn>") == whole["formatted"].count("###") == heads  # adjacent turns of a role are one
        spans = [whole["formatted"][s["start"] : s["stop"]] for s in whole["loss"]]
        assert [s.replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") for s in spans] == got["trained"]


def test_chat_digests(spark, odd):
    got = {r["conv_id"]: r for r in chat.chat_digests(rows_of(spark, odd)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, row in got.items():
        want = messages(odd, conv)
        loss = "".join(text for role, text in want if role == "assistant")
        assert (row["n_turns"], row["turns_sha256"]) == (len(want), sha("".join(f"{role or ''}\n{text}\n" for role, text in want)))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss))
        assert row["formatted_chars"] >= sum(len(text) for _, text in want)


def test_chat_rows_without_a_conversation_stand_alone(spark):
    df = rows_of(spark, [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, None, None)])
    got = chat.chat_digests(df)
    assert sorted(r["n_turns"] for r in got.collect()) == [1, 1, 1]
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_chat_template(spark):
    df = rows_of(spark, [(1, 0, "user", "a"), (1, 1, "user", "###b"), (1, 2, "assistant", "c</turn>")])
    (row,) = chat.format_conversations(df).collect()
    assert row["formatted"] == "### user:\na</part>\n#\\##b</turn>\n### assistant:\nc<\\/turn></turn>\n"
    assert [tuple(s) for s in row["loss"]] == [(1, 32, 47, 56)]


def test_chat_plan_is_native(spark):
    df = chat.chat_digests(chat.with_probe(spark, spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")))
    plan = df._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD")) and plan.count("Exchange hashpartitioning") <= 2
