"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import discard, staged


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for every node of ``edges`` (a, b: longs) that has an edge.

    Edges may repeat and run either way; loops count for nothing. No group is gathered: a step takes the
    minimum of each node's neighbours and hands it to them by a join. Each round is written to shared storage, and the one
    before it removed.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct()
    pairs = staged(pairs, "edges")
    seen = _sum(pairs)
    while True:
        both = pairs.select(F.col("v").alias("u"), F.col("m").alias("n")).union(pairs.select(F.col("m").alias("u"), F.col("v").alias("n")))
        least = both.groupBy("u").agg(F.least("u", F.min("n")).alias("low"))
        large = both.where("n > u").join(least, "u").select(F.col("n").alias("v"), F.col("low").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        met = large.join(least, "v")
        small = met.where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m")).union(least.select("v", F.col("low").alias("m")))
        before, pairs = pairs, staged(small.distinct(), "edges")
        now = _sum(pairs)
        discard(before)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("m").alias("node"), F.col("m").alias("label")).distinct()
    return pairs.select(F.col("v").alias("node"), F.col("m").alias("label")).union(roots)


def _sum(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "m")), F.bit_xor(F.xxhash64("m", "v", F.lit(7)))).first())
