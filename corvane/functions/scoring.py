"""Scores of retrieval and memory as columns."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, RRF_K = 1.5, 0.75, 60


def idf(n: Column, df: Column) -> Column:
    """Negative where more than half of the documents have the term; that is intended."""
    return F.log((n - df + 0.5) / (df + 0.5))


def bm25(weight: Column, tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    average = F.when(average == 0, 1.0).otherwise(average)
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def rrf(rank: Column, weight: Column | float = 1.0, k: int = RRF_K) -> Column:
    return F.lit(weight) / (k + rank) if isinstance(weight, float) else weight / (k + rank)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Clamped cosine over the shorter vector's length; zero for an empty or zero vector."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), F.greatest(n, F.lit(0))), F.slice(b, F.lit(1), F.greatest(n, F.lit(0)))
    norms = F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y))
    return F.when((n <= 0) | (norms == 0), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(x, y) / norms)))


def cosine_score(cos: Column) -> Column:
    return F.greatest(F.lit(0.0), (1 + cos) / 2)


def distance_similarity(distance: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - distance))


def promotion(hours: Column, score: Column, accesses: Column, weights: tuple[float, float, float] = (0.3, 0.5, 0.2)) -> Column:
    """What recency, importance and use of a memory item add up to; missing values count as none."""
    w_time, w_importance, w_use = weights
    recent = F.coalesce(F.greatest(F.lit(0.0), 1 - hours / 24), F.lit(0.0))
    important = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), F.lit(0.0))
    used = 1 - F.exp(-F.greatest(F.lit(0.0), F.coalesce(accesses, F.lit(0)).cast("double")))
    return w_time * recent + w_importance * important + w_use * used


def stub_bins(text: Column, size: int = 384) -> Column:
    """A deterministic embedding for use without a model: characters' codes summed by position modulo ``size``."""
    codes = F.transform(F.split(text, ""), lambda c, i: F.struct((i % size).alias("bin"), (((F.ascii(c) % 97) + 1) / 100).alias("v")))
    return F.filter(codes, lambda c: c["v"].isNotNull())


def strict_cosine(a: Column, b: Column) -> Column:
    """Dot product over the shorter vector's length by the norms of both whole vectors; zero for a zero vector."""
    n = F.greatest(F.lit(0), F.least(F.size(a), F.size(b)))
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((n <= 0) | (norms == 0), 0.0).otherwise(_dot(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)) / norms)


def stub_vector(text: Column, size: int = 384) -> Column:
    """The vector of ``stub_bins``; a text that leaves all of it zero has 0.1 in its first place."""
    bins = F.aggregate(stub_bins(text, size), F.array_repeat(F.lit(0.0), size), lambda v, c: F.transform(v, lambda x, i: x + F.when(i == c["bin"], c["v"]).otherwise(0.0)))
    filled = F.when(F.length(text) > 0, bins).otherwise(F.array_repeat(F.lit(0.0), size))
    return F.when(F.exists(filled, lambda x: x != 0), filled).otherwise(F.concat(F.array(F.lit(0.1)), F.array_repeat(F.lit(0.0), size - 1)))


def flat_vector(size: int = 384) -> Column:
    """The vector of a context without a model: 0.1 everywhere."""
    return F.array_repeat(F.lit(0.1), size)
