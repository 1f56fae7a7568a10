"""Quality rules with risk-controlled cutoffs.

Each rule is one number of a document and a cutoff: from there on the document is rejected. Cutoffs come from
labelled documents. In each stratum (language) a part of them, TUNE_ROWS at most, is for tuning: cutoffs of all rules
are tightened step by step, each time where most bad documents are caught less COST for each good one lost. That
gives a path along which ever more documents are rejected. All other labelled documents are held out to choose the place
on the path: from its lenient end on, an exact binomial test at level DELTA, divided by the number of strata, has
to reject that the rules together turn away more than RISK of the good documents. The first place where it does not
ends the walk (tests in a fixed order need no further correction), so the bound holds in all strata at once with
chance 1 - DELTA. Of the certified places the one with most caught, less COST for each lost, is taken; a stratum with too
few labels has none, and there only the base rules reject.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ROW, WORDS, packed
from corvane.session import staged

SYMBOLS = "#*$%&|<>"
ENDS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")")
WORD_IN = re.compile(r"[^\x20\x09-\x0D]")
NO_LETTERS = re.compile(r"[\W\d_]+")
STRATA = ("en", "fr", "de", "es")  # every other language, and null, is the stratum "other"
RISK = 0.02  # the most good documents that all rules together may turn away, by stratum
DELTA = 0.05  # the chance that this fails in any stratum
GRID = 64
COST = round(1 / RISK)  # bad documents that losing a good one outweighs: as many as RISK allows for each
TUNE_SHARE, TUNE_ROWS = 0.3, 20_000  # labelled documents of a stratum for tuning: this share, this many expected at most

#: Rules by name: the number, of which more is worse, and the range that the cutoffs divide evenly.
RULES: dict[str, tuple[str, float]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", 2.0),
    "shouting": ("n_upper / greatest(word_chars, 1)", 1.0),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 1.0),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.2),
    "long_words": ("word_chars / greatest(n_words, 1)", 16.0),
    "no_letters": ("1 - n_letters / greatest(word_chars, 1)", 1.0),
    "open_lines": ("n_open_lines / greatest(n_lines, 1)", 1.0),
    "few_words": ("1 - word_bits / greatest(log2(n_words), 1)", 1.0),
}
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lines long, n_letters long, n_open_lines long, word_bits double"
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def text_stats(text: str | None) -> tuple[float, ...]:
    """The numbers of STATS for one text; null and empty texts have none of anything."""
    if not text:
        return (0,) * 10
    words = WORDS.findall(text)
    n = len(words)
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            counts, covered = Counter(windows), 0  # covered: up to where words have been counted
            for at, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += at + 5 - max(at, covered)
                    covered = at + 5
    lines = [line for line in text.split("\n") if WORD_IN.search(line)]
    symbols = sum(map(text.count, SYMBOLS))
    upper = 0 if text.islower() else sum(map(str.isupper, text))
    letters = len(NO_LETTERS.sub("", text))
    open_lines = sum(1 for line in lines if not line.rstrip().endswith(ENDS))
    # words by how often they come, so that few logarithms are taken
    often = Counter(Counter(words).values())
    bits = math.log2(n) - sum(m * c * math.log2(c) for c, m in often.items()) / n if n else 0.0
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated, upper, len(lines), letters, open_lines, max(bits, 0.0)


def _stats_frame(texts: pd.Series) -> pd.DataFrame:
    columns = [c.split() for c in STATS.split(", ")]
    found = pd.DataFrame([text_stats(t) for t in texts], columns=[c for c, _ in columns], dtype="float64")
    return found.astype({c: "int64" for c, kind in columns if kind == "long"})


def _stats(text: Column) -> Column:
    return F.pandas_udf(_stats_frame, STATS)(text)


def stratum(lang: Column) -> Column:
    return F.when(lang.isin(*STRATA), lang).otherwise(F.lit("other"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of the binomial distribution of n trials with chance p, summed exactly."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def tightening_path(steps: np.ndarray, good: np.ndarray, bad: np.ndarray) -> list[tuple[int, int]]:
    """(rule, step) in the order in which cutoffs are tightened. ``steps`` has a row for each kind of document, a column for
    each rule; ``good`` and ``bad`` count the documents of a kind.

    Each time the rule and step are taken at which most is gained (ties: the earlier rule, the more lenient step), and
    all steps of that rule down to it come one by one.
    """
    cutoffs, path = [GRID + 1] * steps.shape[1], []
    while True:
        best, most = None, 0.0
        for rule in range(steps.shape[1]):
            worth = np.bincount(steps[:, rule], bad - COST * good, GRID + 1)[::-1].cumsum()[::-1]  # of documents of a step and above
            for step in range(cutoffs[rule] - 1, -1, -1):
                if worth[step] > most:
                    best, most = (rule, step), worth[step]
        if best is None:
            return path
        rule, step = best
        path += [(rule, s) for s in range(cutoffs[rule] - 1, step - 1, -1)]
        cutoffs[rule] = step
        left = steps[:, rule] < step
        steps, good, bad = steps[left], good[left], bad[left]


def certified(good: list[int], bad: list[int], n_good: int) -> int:
    """The number of places of a path to go: ``good`` and ``bad`` count the documents that each place rejects first.

    From the lenient end on each place is tested; the first that fails ends the walk.
    """
    k = caught = best = most = 0
    for place, (g, b) in enumerate(zip(good, bad, strict=True), 1):
        k, caught = k + g, caught + b
        if not n_good or binomial_cdf(int(k), int(n_good), RISK) > DELTA / (len(STRATA) + 1):
            break
        if caught - COST * k > most:
            best, most = place, caught - COST * k
    return best


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for name, group in pd.concat(list(batches), ignore_index=True).groupby("stratum"):
        path = tightening_path(np.stack(group["steps"].to_numpy()), group["good"].to_numpy(), group["bad"].to_numpy())
        yield pd.DataFrame({"stratum": name, "place": np.arange(len(path)), "rule": [r for r, _ in path], "step": [s for _, s in path]})


def _step(rule: str) -> Column:
    expression, top = RULES[rule]
    return F.greatest(F.lit(0), F.least(F.lit(GRID), F.floor(F.expr(expression) * GRID / top))).cast("int")


def _steps() -> Column:
    return F.array(*[_step(rule) for rule in RULES])


def _rejected_at(paths: dict[str, list[tuple[int, int]]]) -> Column:
    """The first place of its stratum's path that rejects a document; null if none does. Of ``stratum`` and ``steps``."""
    out = F.lit(None).cast("int")
    for name, path in paths.items():
        firsts = []
        for rule in range(len(RULES)):
            first: list[int | None] = [None] * (GRID + 1)
            for place, (r, step) in enumerate(path):
                if r == rule:
                    first[step] = place
            for step in range(1, GRID + 1):  # a document of a higher step is rejected no later
                first[step] = min((x for x in (first[step], first[step - 1]) if x is not None), default=None)
            if any(x is not None for x in first):
                firsts.append(F.get(F.array(*[F.lit(x).cast("int") for x in first]), F.col("steps")[rule]))
        if firsts:
            out = F.when(F.col("stratum") == name, F.array_min(F.array(*firsts))).otherwise(out)
    return out


def calibrate(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict[str, list[tuple[int, int]]]:
    """By stratum the certified part of its path: (rule number, step) from which on documents are rejected.

    ``stats`` has doc_id, stratum and the numbers of STATS. Labelled documents count that pass the base rules; several
    labels of one id count as the lowest; null ids and labels count for nothing. Tuning takes a bounded sample by a
    hash of the id, the test all others. What comes to the driver has a row for each rule and step at most.
    """
    label = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull())
    label = label.groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.min(f"`{label_col}`").alias("label"))
    known = stats.where(~F.expr(BASE_FAILED)).join(label, "doc_id")
    known = staged(known.select("stratum", "label", _steps().alias("steps"), (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)).alias("draw")), "labelled")
    shares = {r["stratum"]: min(TUNE_SHARE, TUNE_ROWS / r["n"]) for r in known.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for name, part in shares.items():
        share = F.when(F.col("stratum") == name, part).otherwise(share)
    counts = (F.count_if(F.col("label") > 0).alias("good"), F.count_if(F.col("label") <= 0).alias("bad"))
    kinds = known.where(F.col("draw") < share).groupBy("stratum", "steps").agg(*counts)
    found = kinds.coalesce(1).mapInPandas(_paths, "stratum string, place int, rule int, step int").collect()
    paths: dict[str, list[tuple[int, int]]] = {}
    for r in sorted(found, key=lambda r: (r["stratum"], r["place"])):
        paths.setdefault(r["stratum"], []).append((r["rule"], r["step"]))
    held = known.where(F.col("draw") >= share).withColumn("place", _rejected_at(paths)).groupBy("stratum", "place").agg(*counts).collect()
    out = {}
    for name, path in paths.items():
        at = {r["place"]: r for r in held if r["stratum"] == name}
        of = lambda kind: [at[k][kind] if k in at else 0 for k in range(len(path))]  # noqa: E731, B023
        n = certified(of("good"), of("bad"), sum(r["good"] for r in at.values()))
        if n:
            out[name] = path[:n]
    return out


def verdict(cutoffs: dict[str, list[tuple[int, int]]]) -> Column:
    """The names of the rules that reject a document, of the columns of STATS and ``stratum``."""
    failed = []
    for name, path in sorted(cutoffs.items()):
        for number, rule in enumerate(RULES):
            if steps := [s for r, s in path if r == number]:
                failed.append(F.when((F.col("stratum") == name) & (_step(rule) >= min(steps)), F.lit(rule)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, stratum and the numbers of STATS, one row per row of ``docs``."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), stratum(F.col(f"`{lang_col}`")).alias("stratum"), _stats(F.col(f"`{text_col}`")).alias("s"))
    return slim.select("doc_id", "stratum", "s.*")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the numbers of STATS, base_failed, kept, failed_rules: one row per row of ``docs``.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. With no or
    few labels nothing is certified, and all that passes the base rules is kept. An empty table gives no rows. Texts
    of any length count whole; a task holds those of one Arrow batch.
    """
    stats = staged(document_stats(docs, id_col, text_col, lang_col), "stats")
    failed = verdict(calibrate(stats, labels))
    judged = stats.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("failed_rules", failed)
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    numbers = [c.split()[0] for c in STATS.split(", ")]
    return judged.select("doc_id", *numbers[:5], "base_failed", kept.alias("kept"), *numbers[5:], F.array_join("failed_rules", ",").alias("failed_rules"))


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    The rows are written with their numbers, so that these are made once.
    """
    rows = packed(docs, doc_id=F.col(f"`{id_col}`"), stratum=stratum(F.col(f"`{lang_col}`")), s=_stats(F.col(f"`{text_col}`"))).select("doc_id", "stratum", "s.*", ROW)
    rows = staged(rows, "judged")
    failed = verdict(calibrate(rows.drop(ROW), labels))
    kept = rows.where(~F.expr(BASE_FAILED) & (F.size(failed) == 0))
    return kept.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns])
