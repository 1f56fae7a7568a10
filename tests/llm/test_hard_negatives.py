import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<double>, label int, `block` int, codes string, asks int"


def rows_of(spark, rows):
    """Vectors with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, v, label, 1, "c", 2) for i, v, label in rows], SCHEMA)


def brute(rows, asks):
    """All pairs, in Python integers."""
    kept = []
    for i, v, label in dict.fromkeys((i, tuple(v) if v is not None else None, label) for i, v, label in rows):
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        codes = [math.floor(256 * x) for x in v]
        if sum(c * c for c in codes) < h.LARGEST:
            kept.append((i, codes, label))
    out = Counter()
    for i, a, label in kept:
        if not asks(i):
            continue
        scored = [(-sum(x * y for x, y in zip(a, b, strict=True)), j, other) for j, b, other in kept if j != i and len(b) == len(a)]
        for score, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            fits = sorted((s, j) for s, j, other in scored if other != label and 30 * -score <= 100 * -s <= 90 * -score)
            for rank, (s, negative) in enumerate(fits[:10], 1):
                out[(i, positive, rank, negative, -score, -s)] += 1
    return out


def found(df, anchor):
    return Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in h.hard_negatives(df, anchor).collect())


def clustered(rng, n, centres, dim, spread=0.04):
    middle = rng.normal(size=(centres, dim))
    x = middle[rng.integers(centres, size=n)] / dim**0.5 + rng.normal(size=(n, dim)) * spread
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture
def small(monkeypatch):
    """Blocks so small that there are many, on many pages and shelves, with several shares."""
    for name, value in (("BLOCK", 16), ("SHELF", 4), ("PAGE", 5), ("PAGE_ANCHORS", 20), ("SLICE", 7), ("SHELF_SLICES", 1)):
        monkeypatch.setattr(h, name, value)


def test_negatives_are_those_of_brute_force(spark, small):
    rng = np.random.default_rng(4)
    x = np.vstack([clustered(rng, 500, 12, 8), rng.normal(size=(100, 8)) * 3])
    rows = [(k, [float(c) for c in v], int(rng.integers(4))) for k, v in enumerate(x)]
    rows += [(1_000 + k, rows[3][1], rows[3][2]) for k in range(60)] + [(2_000 + k, rows[3][1], rows[4][2]) for k in range(60)]  # copies tie
    rows += [(-7, rows[5][1], 1), (-7, rows[5][1], 1), (-7, rows[6][1], 1), (-7, rows[5][1], 2)]  # repeated rows, rows that share an id
    rows += [(None, rows[0][1], 1), (3_000, None, 1), (3_010, rows[0][1], None), (3_020, [1.0] * 7 + [None], 1), (3_030, [1.0] * 7 + [float("nan")], 1), (3_040, [float("inf")] * 8, 1)]
    rows += [(3_050, [1e30] * 8, 1), (3_060, [0.0] * 8, 1), (3_070, [], 1), (3_080, [], 1), (3_090, [], 2), (3_100, [0.5] * 3, 1), (3_110, [0.25] * 3, 1), (3_120, [0.3] * 3, 2)]
    rows += [(4_000 + k, [float(c) * 2e5 for c in v], 3 + k % 2) for k, v in enumerate(x[:30])]  # beyond exact floating point
    got = found(rows_of(spark, rows), F.col("vec_id") % 10 == 0)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 1_000


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.2], 2)]
    assert found(rows_of(spark, rows), F.col("vec_id") == 0) == {(0, 1, 1, 2, 230 * 256, 179 * 256): 1} == brute(rows, lambda i: i == 0)
    df = rows_of(spark, [])
    assert h.hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0
    assert found(rows_of(spark, rows), F.lit(None).cast("boolean")) == {}


def test_bounds_hold_and_zone_maps_prune(spark, monkeypatch):
    monkeypatch.setattr(h, "BLOCK", 32)
    rng = np.random.default_rng(8)
    rows = [(k, [float(c) for c in v], int(rng.integers(3))) for k, v in enumerate(clustered(rng, 12_000, 20, 8))]
    df = rows_of(spark, rows).repartition(4)
    asked = []
    plain = h.Blocks.search
    monkeypatch.setattr(h.Blocks, "search", lambda self, asking, n: (asked.append((self, self.choices(asking, n).select(F.explode("picks").alias("p")).agg(F.sum(F.octet_length("p") / 4)).first()[0])), plain(self, asking, n))[1])
    h.hard_negatives(df, F.col("vec_id") % 100 == 0).count()
    blocks = asked[0][0].n
    # windows and blocks that meet: positives and seeds first, then up to five windows of negatives an anchor
    # of three labels one can have positives and two can have negatives
    assert asked[0][1] < 0.2 * 120 * blocks / 3 and asked[1][1] < 0.4 * 5 * 120 * blocks * 2 / 3


def test_hilbert_curve_visits_neighbours():
    bits, dims = 3, 3
    levels = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = h.hilbert_keys(levels, bits)
    assert sorted(keys) == list(range(len(levels)))
    walk = levels[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
