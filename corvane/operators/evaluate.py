"""Retrieval and answer metrics."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("hit_rate", "mrr", "hit_at_1", "hit_at_5", "recall_at_5", "recall_at_10")


def per_query(results: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """Metrics of ranked results (query_id, rank, chunk_id) against truth (query_id, chunk_id) for all queries.

    A query without truth, or without a hit, has zeros.
    """
    wanted = truth.select("query_id", "chunk_id").distinct()
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_truth"))
    hits = results.join(wanted, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= 5).alias("in5"), F.count_if(F.col("rank") <= 10).alias("in10"))
    met = queries.select("query_id").join(size, "query_id", "left").join(hits, "query_id", "left")
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return met.select(
        "query_id",
        flag(F.col("first").isNotNull()).alias("hit_rate"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        flag(F.col("first") <= 1).alias("hit_at_1"),
        flag(F.col("first") <= 5).alias("hit_at_5"),
        F.round(F.coalesce(F.col("in5") / F.col("n_truth"), F.lit(0.0)), 6).alias("recall_at_5"),
        F.round(F.coalesce(F.col("in10") / F.col("n_truth"), F.lit(0.0)), 6).alias("recall_at_10"),
    )


KEY_WORDS = 5  # words of a passage by which texts are found
SENT_PASSAGES = 20_000  # passages that are sent to all tasks, by their first NEEDLE characters
NEEDLE = 48


def _words(c) -> Column:
    return F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def holders(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, chunk_id: the texts of ``docs`` (chunk_id, text) that hold a whole passage of ``passages`` (query_id, text).

    Up to SENT_PASSAGES passages are looked for in each text where it stands, all at once by an automaton of how they begin, and compared
    whole where one begins. More of them meet the texts in a join. A passage of two words or fewer is not found.
    """
    wanted = passages.where(F.size(_words("text")) > 2).select("query_id", "text")
    n = wanted.count()
    if n > SENT_PASSAGES:
        return _joined_holders(docs, wanted)
    id_type, query_type = docs.schema["chunk_id"].dataType.simpleString(), passages.schema["query_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in wanted.collect()])

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begins: dict[str, list[tuple]] = {}
        for query, passage in held.value:
            begins.setdefault(passage[:NEEDLE], []).append((query, passage))
        machine = ahocorasick.Automaton()
        for begin, own in begins.items():
            machine.add_word(begin, own)
        if begins:
            machine.make_automaton()
        for batch in batches:
            pairs = set()
            for chunk, body in zip(batch["chunk_id"], batch["text"], strict=True):
                for end, own in machine.iter(body) if begins and body else ():
                    pairs |= {(query, chunk) for query, passage in own if body.startswith(passage, end + 1 - min(NEEDLE, len(passage)))}
            yield pd.DataFrame({"query_id": pd.Series([q for q, _ in pairs], dtype=object), "chunk_id": pd.Series([c for _, c in pairs], dtype=object)})

    return docs.select("chunk_id", "text").mapInPandas(found, f"query_id {query_type}, chunk_id {id_type}").distinct()


def _joined_holders(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Texts meet passages in KEY_WORDS words in a row, those behind a passage's first word, or in as many inner words as it has, and are then
    searched for all of it."""
    keyed = passages.select("query_id", F.col("text").alias("passage"), _words("text").alias("w"))
    keyed = keyed.select("query_id", "passage", F.slice("w", F.lit(2), F.least(F.lit(KEY_WORDS), F.size("w") - 2)).alias("k"))
    keyed = keyed.select("query_id", "passage", F.size("k").alias("n"), F.array_join("k", " ").alias("key"))
    sizes = [r[0] for r in keyed.select("n").distinct().collect()] or [KEY_WORDS]  # KEY_WORDS numbers at most
    found = docs.select("chunk_id", _words("text").alias("w"), F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    found = found.where(F.size("w") >= F.col("n")).select("chunk_id", "n", F.explode(F.array_distinct(runs)).alias("key"))
    met = found.join(keyed.select("n", "key", "query_id"), ["n", "key"]).select("query_id", "chunk_id").distinct()
    # whole texts join what has met, not every run of words
    whole = met.join(docs.select("chunk_id", "text"), "chunk_id").join(keyed.select("query_id", "passage"), "query_id")
    return whole.where(F.contains("text", "passage")).select("query_id", "chunk_id").distinct()


def averages(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS])


def answer_overlap(answers: DataFrame) -> DataFrame:
    """overlap and length of answers (answer_id, question, answer): shared words of the question."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("([一-鿿]{2,}|[a-zA-Z]{3,})"), F.lit(1)))
    met = answers.withColumn("q", words("question")).withColumn("a", words("answer"))
    share = F.when(F.size("q") > 0, F.size(F.array_intersect("q", "a")) / F.size("q")).otherwise(0.0)
    return met.select("answer_id", F.length("answer").alias("n_chars"), F.round(share, 6).alias("overlap"))


def answer_quality(answers: DataFrame) -> DataFrame:
    """Rates and means over answers (answer_id, question, answer): answered at length, words shared, citations."""
    from corvane.functions import text

    met = answer_overlap(answers).join(answers.select("answer_id", text.has_citation(F.col("answer")).alias("cited")), "answer_id")
    return met.agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.round(F.avg((F.col("n_chars") >= 20).cast("double")), 4).alias("success_rate"),
        F.round(F.avg("n_chars"), 2).alias("avg_chars"),
        F.round(F.avg("overlap"), 4).alias("overlap_rate"),
        F.round(F.avg(F.col("cited").cast("double")), 4).alias("citation_rate"),
    )


def report(averaged: DataFrame) -> DataFrame:
    """Averages as one JSON text."""
    return averaged.select(F.to_json(F.struct(*averaged.columns)).alias("report"))
