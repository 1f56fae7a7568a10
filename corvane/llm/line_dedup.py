"""Line deduplication by pairwise alignment.

Passages count from MIN_WORDS words on, wherever they stand: lines are where runs may start, but a run is of words
and goes on over the ends of lines. A run is MIN_WORDS words. Runs that start a line are looked up, and of every
SPAN - MIN_WORDS + 1 runs in a row the one with the least hash, so that two texts with SPAN words in common look up
one run alike. A run's hash is rare enough to tell where a passage was taken from, and its owner is the first
document that has it. A document is paired with the owners of its runs, so pairs number no more than runs, however
many documents share a passage. Each pair is aligned by patience diff on its common runs, aligned runs grow to common
blocks, compared word by word, and these are cut from the later document. What is left in common has moved, and is
aligned again, and at last block by block, until nothing is left: one law for passages of any length. The first document to have a run never loses it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import ROW, WORD, WORDS, objects, packed, text_key
from corvane.session import discard, staged

MIN_WORDS = 20
#: A passage of this many words is looked up wherever it stands.
SPAN = 50
CHANCE_WORDS = 2
#: Alignments of a pair as a whole: the first finds what stands in order, the others blocks that moved together.
ROUNDS = 8
#: Divisions of a part of two texts in one alignment; what it leaves is aligned in the next.
DEPTH = 40
#: Pairs with one owner that go to a task together.
OWNER_PAIRS = 500
FACTOR = 0x9E3779B97F4A7C15
CUT = "text string, n_cut int"


def word_table(text: str | None) -> tuple[np.ndarray, list[int]]:
    """The hash of each word, and for each line with words the number of its first word; null has no words."""
    words: list[bytes] = []
    starts = []
    for line in (text or "").encode().split(b"\n"):
        found = line.split()  # bytes split at the six ASCII white-space characters
        if found:
            starts.append(len(words))
            words += found
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), starts


def run_hashes(hashes: np.ndarray, least: int = MIN_WORDS) -> np.ndarray:
    """The hash of the run of ``least`` words from each word on, where there are as many."""
    n = max(0, len(hashes) - least + 1)
    out, have = np.zeros(n, np.uint64), 0
    part, size = hashes, 1
    while n:
        if least & size:
            out = out * np.uint64(pow(FACTOR, size, 1 << 64)) + part[have : have + n]
            have += size
        if have == least:
            break
        part = part[:-size] * np.uint64(pow(FACTOR, size, 1 << 64)) + part[size:]
        size *= 2
    for shift in (33, 29):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(0xFF51AFD7ED558CCD)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def _extremes(values: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``n`` values in a row."""
    size = 1
    while 2 * size <= n:
        values = of(values[:-size], values[size:])
        size *= 2
    return of(values[: len(values) - (n - size)], values[n - size :])


def looked_up(runs: np.ndarray, starts: Sequence[int]) -> np.ndarray:
    """Hashes of the runs that start a line, and of the least of each SPAN - MIN_WORDS + 1 in a row."""
    n = SPAN - MIN_WORDS + 1
    at = np.asarray(starts, np.int64)
    out = [runs[at[at < len(runs)]]]
    if len(runs) >= n:
        least = _extremes(runs, n, np.minimum)
        edge = np.full(n - 1, np.iinfo(np.int64).min)
        # a run is the least of some n in a row if it equals the greatest of their least ones
        out.append(runs[runs == _extremes(np.concatenate([edge, least, edge]), n, np.maximum)])
    return np.unique(np.concatenate(out))


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], rising in both: a patience diff.

    Equal ends are matched first. What is left is divided at items that are unique in both, by the longest rising
    sequence of them; where there is none, at the first places of the item that is least frequent. A part that has
    been divided DEPTH times is left to a further alignment, so that the work of one stays below DEPTH passes over both.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b), 0)]
    while todo:
        i, i_end, j, j_end, depth = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i >= i_end or j >= j_end or depth >= DEPTH:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        both = in_a.keys() & in_b.keys()
        if not both:
            continue
        rare = {x for x in both if in_a[x] == 1 and in_b[x] == 1}
        at_a: dict[int, int] = {}
        for k in range(i_end - 1, i - 1, -1):
            at_a[a[k]] = k
        if not rare:
            rare = {min(both, key=lambda x: (in_a[x] * in_b[x], at_a[x]))}
        seen, places = set(), []
        for k in range(j, j_end):
            if b[k] in rare and b[k] not in seen:
                seen.add(b[k])
                places.append((at_a[b[k]], k))
        last_i, last_j = i, j
        for k_a, k_b in _rising(places):
            todo.append((last_i, k_a, last_j, k_b, depth + 1))
            out.append((k_a, k_b))
            last_i, last_j = k_a + 1, k_b + 1
        todo.append((last_i, i_end, last_j, j_end, depth + 1))
    return sorted(out)


def _rising(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of ``places`` (in order of the second number) in which the first rises."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for k, (value, _) in enumerate(places):
        at = bisect_left(tails, value)
        before[k] = ends[at - 1] if at else -1
        tails[at : at + 1] = [value]
        ends[at : at + 1] = [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(places[k])
        k = before[k]
    return out[::-1]


def _agreeing(a: list[bytes], b: list[bytes], i: int, j: int, step: int = 1) -> int:
    """How many words from a[i] and b[j] on are the same, word for word; with step -1 those before them."""
    n, room = 0, min(len(a) - i, len(b) - j) if step > 0 else min(i, j)
    size = 64
    while n < room:  # slices are compared at once, twice as many each time, until they differ
        size = min(size, room - n)
        one, two = (a[i + n : i + n + size], b[j + n : j + n + size]) if step > 0 else (a[i - n - size : i - n], b[j - n - size : j - n])
        if one == two:
            n, size = n + size, 2 * size
            continue
        pairs = zip(one, two, strict=True) if step > 0 else zip(reversed(one), reversed(two), strict=True)
        return n + next(k for k, (x, y) in enumerate(pairs) if x != y)
    return n


def words_of(text: str) -> tuple[list[bytes], np.ndarray]:
    """The words of a text and their hashes, which hold within a process: words themselves decide what is the same."""
    words = text.encode().split()
    return words, np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def aligned_words(earlier: tuple[list[bytes], np.ndarray], later: tuple[list[bytes], np.ndarray], least: int = MIN_WORDS) -> np.ndarray:
    """For each word of a later document: whether it is in a common block of ``least`` words or more.

    Of each stretch of runs that both have, the first is an anchor. Anchors are aligned by patience diff; each aligned
    pair grows to a block as long as the words themselves agree, backwards and forwards. Blocks that moved are out of
    order; they come with ROUNDS further alignments of what is left in common. Blocks that are then still in order with no
    other are aligned one by one, so that no run that both have stays. Every block is compared word by word, not by hash: an anchor
    whose words differ is none.
    """
    (a, a_hashes), (b, b_hashes) = earlier, later
    a_runs, b_runs = run_hashes(a_hashes, least), run_hashes(b_hashes, least)
    gone = np.zeros(len(b), bool)
    common = np.flatnonzero(np.isin(b_runs, a_runs))
    a_places = np.flatnonzero(np.isin(a_runs, b_runs[common]))  # where anchors can be, for all alignments
    for _ in range(ROUNDS):
        if not len(common):
            return gone
        heads = common[np.diff(common, prepend=-2) > 1]
        places = a_places[np.isin(a_runs[a_places], b_runs[heads])]
        differ = []
        for x, y in patience(a_runs[places].tolist(), b_runs[heads].tolist()):
            i, j = int(places[x]), int(heads[y])
            n = _agreeing(a, b, i, j)
            if n >= least:
                gone[j - _agreeing(a, b, i, j, -1) : j + n] = True
            else:
                differ.append(j)
        before = np.concatenate([[0], np.cumsum(gone)])
        common = common[(before[common + least] - before[common] < least) & ~np.isin(common, differ)]
    place = dict(zip(a_runs[a_places[::-1]].tolist(), a_places[::-1].tolist(), strict=True))
    for j in common.tolist():
        if not gone[j : j + least].all():
            i = place[int(b_runs[j])]
            n = _agreeing(a, b, i, j)
            if n >= least:
                gone[j - _agreeing(a, b, i, j, -1) : j + n] = True
    return gone


def without(text: str, gone: Sequence[bool]) -> tuple[str, int]:
    """``text`` without the words that are ``gone``, and the number of lines that lose any.

    A line that loses all its words goes, and so do blank lines between words that go. Where a passage reaches over
    the end of a line by CHANCE_WORDS words or fewer, and other words of that line stay, these stay too: so few agree
    by chance.
    """
    lines = [(line, len(line.encode().split())) for line in text.split("\n")]
    given, gone, at = gone, list(gone), 0
    for _, n_words in lines:
        end = at + n_words
        for n in range(1, min(CHANCE_WORDS, n_words - 1) + 1):
            if at and all(given[at - 1 : at + n]) and not given[at + n]:
                gone[at : at + n] = [False] * n
            if end < len(given) and all(given[end - n : end + 1]) and not given[end - n - 1]:
                gone[end - n : end] = [False] * n
        at = end
    out, n_cut, at = [], 0, 0
    for line, n_words in lines:
        cut = gone[at : at + n_words]
        at += n_words
        if not n_words and 0 < at < len(gone) and gone[at - 1] and gone[at]:
            n_cut += 1
        elif not any(cut):
            out.append(line)
        else:
            n_cut += 1
            if not all(cut):
                out.append(_kept(line, [m.span() for m in WORDS.finditer(line)], cut))
    return "\n".join(out), n_cut


def _kept(line: str, spans: list[tuple[int, int]], cut: Sequence[bool]) -> str:
    """A line without some of its words: each goes with the space behind it, the last ones with that before them."""
    last = max(k for k in range(len(cut)) if not cut[k])
    parts = [line[: spans[0][0]]]
    for k in range(last):
        if not cut[k]:
            parts.append(line[spans[k][0] : spans[k + 1][0]])
    parts.append(line[spans[last][0] : spans[last][1] if last + 1 < len(cut) else len(line)])
    return "".join(parts)


def _looked_up(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        hashes, starts = word_table(text)
        out.append(looked_up(run_hashes(hashes), starts))
    return objects(out)


def _aligned(earlier: pd.Series, later: pd.Series) -> pd.Series:
    """Numbers of the words to cut from the later document: first, behind the last, first, ..."""
    out = []
    for a, b in zip(earlier, later, strict=True):
        later_words = words_of(b)
        gone = np.ones(len(later_words[0]), bool) if a == b and len(later_words[0]) >= MIN_WORDS else aligned_words(words_of(a), later_words)
        out.append(np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))).astype(np.int32))
    return objects(out)


def _cut_texts(texts: pd.Series, edges: pd.Series) -> pd.DataFrame:
    """Texts without the words in their cuts, and the number of lines that lose any; a null text has no cuts."""
    found: list[tuple[str | None, int]] = []
    for text, cuts in zip(texts, edges, strict=True):
        if text is None:
            found.append((None, 0))
            continue
        gone = np.zeros(len(text.encode().split()), bool)
        for cut in cuts:
            for start, stop in zip(cut[::2], cut[1::2], strict=True):
                gone[start:stop] = True
        found.append(without(text, gone.tolist()))
    return pd.DataFrame({"text": objects([t for t, _ in found]), "n_cut": np.array([n for _, n in found], np.int32)})


def _key(id_col: Column, text: Column) -> Column:
    """What names a document and orders documents: id (null last), then a hash of the text."""
    return F.struct(id_col.isNull().alias("nul"), id_col.alias("id"), *text_key(text))


def run_pairs(found: DataFrame) -> DataFrame:
    """later, owner: each document of ``found`` (key, runs) with the first documents of its runs, itself left out.

    Runs are most of what is dealt out, and are dealt out once: their owner is found where all places of a run meet.
    """
    runs = found.where("key is not null").select("key", F.explode("runs").alias("run"))
    owned = runs.select(F.col("key").alias("later"), F.min("key").over(Window.partitionBy("run")).alias("owner"))
    return owned.where("later <> owner").distinct()


def line_cuts(rows: DataFrame) -> DataFrame:
    """key, cuts, owners: for each document of ``rows`` (key, text) that loses words, the numbers of these words and the ids of
    the documents that have them first."""
    found = staged(rows.select("key", F.pandas_udf(_looked_up, "array<long>")("text").alias("runs")), "runs")
    # of one type with what is read again, so that texts are dealt out by key once for all joins
    rows = rows.withColumn("key", F.col("key").cast(found.schema["key"].dataType))
    pairs = staged(run_pairs(found), "pairs")
    discard(found)  # only pairs are read from here on, and runs are a third of what the texts take
    # the first document of a passage that many have is in many pairs: they go to several tasks, with a copy of its text each
    shares = pairs.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / OWNER_PAIRS).cast("int").alias("shares"))
    # equal rows (id and text) are one document
    firsts = rows.select(F.col("key").alias("owner"), F.col("text").alias("a")).join(shares, "owner").groupBy("owner").agg(F.first("a").alias("a"), F.first("shares").alias("shares"))
    firsts = firsts.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    dealt = pairs.join(shares, "owner").withColumn("share", F.pmod(F.xxhash64("later"), F.col("shares")).cast("int")).drop("shares")
    a = dealt.join(firsts, ["owner", "share"]).drop("share")
    both = a.join(rows.select(F.col("key").alias("later"), F.col("text").alias("b")), "later").groupBy("later", "owner").agg(F.first("a").alias("a"), F.first("b").alias("b"))
    cuts = both.select("later", F.col("owner.id").alias("owner_id"), F.pandas_udf(_aligned, "array<int>").asNondeterministic()("a", "b").alias("cut")).where(F.size("cut") > 0)
    # numbers alone travel on: the words go where the whole text is again
    return cuts.groupBy(F.col("later").alias("key")).agg(F.collect_list("cut").alias("cuts"), F.array_sort(F.collect_set("owner_id")).alias("owners"))


def _shortened(text: Column) -> Column:
    """text and n_cut of a document with the column cuts; of one without, nothing is handed to Python."""
    return F.pandas_udf(_cut_texts, CUT).asNondeterministic()(F.when(F.col("cuts").isNotNull(), text), F.col("cuts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_cut, owners, text: one row per row of ``docs``.

    ``text`` is without the passages that an earlier document has too, ``n_cut`` the number of lines that lose words,
    all or some, and ``owners`` the ids of these documents. Ids give the order, null last; documents with one id are
    ordered by a hash of their text. Equal rows are one document and keep their text alike. Null texts stay null,
    texts without words as they are. An empty table gives no rows. Texts of any length are compared whole, in time that
    grows as their length (n log n).
    """
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(_key(doc, text).alias("key"), text.alias("text"))
    cuts = line_cuts(rows)
    # as line_cuts has them, so that its exchange of texts serves here as well
    found = rows.select(F.col("key").cast(cuts.schema["key"].dataType).alias("key"), F.col("text").alias("whole")).join(cuts, "key", "left")
    found = found.select("key", "whole", "cuts", "owners", _shortened(F.col("whole")).alias("new"))
    return found.select(
        F.col("key.id").alias("doc_id"),
        F.coalesce(F.size(F.split("whole", "\n", -1)), F.lit(0)).alias("n_lines"),
        F.coalesce("new.n_cut", F.lit(0)).alias("n_cut"),
        F.coalesce("owners", F.array().cast(f"array<{docs.schema[id_col].dataType.simpleString()}>")).alias("owners"),
        F.when(F.col("cuts").isNull(), F.col("whole")).otherwise(F.col("new.text")).alias("text"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with their columns and without the passages that earlier documents have.

    A document of which no word is left goes; one that had no words before stays. ``chars_col`` follows the text.
    """
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = packed(docs, key=_key(doc, text))
    cuts = line_cuts(docs.select(_key(doc, text).alias("key"), text.alias("text")))
    found = rows.join(cuts, "key", "left")
    found = found.select(ROW, "cuts", _shortened(F.col(f"{ROW}.`{text_col}`")).alias("new"))
    whole, new_text = F.col("cuts").isNull(), F.col("new.text")
    found = found.where(whole | new_text.rlike(WORD))
    columns = []
    for name in docs.columns:
        if name == text_col:
            columns.append(F.when(whole, F.col(f"{ROW}.`{name}`")).otherwise(new_text).alias(name))
        elif name == chars_col:
            columns.append(F.when(whole, F.col(f"{ROW}.`{name}`")).otherwise(F.length(new_text)).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(f"{ROW}.`{name}`").alias(name))
    return found.select(*columns)
