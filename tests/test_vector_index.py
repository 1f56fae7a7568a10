"""The stored vector index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import search, vector_index

QUERY = "query_id long, embedding array<double>"


def frame(spark, x, schema="chunk_id long, embedding array<double>"):
    return spark.createDataFrame([(i, [float(c) for c in v] if v is not None else None) for i, v in x], schema)


def clustered(rng, n, centres, dim):
    return rng.normal(size=(centres, dim))[rng.integers(centres, size=n)] + rng.normal(size=(n, dim)) * 0.35


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    x = clustered(rng, 4_000, 60, 24)
    rows = list(enumerate(x)) + [(5_000 + i, x[9]) for i in range(60)] + [(6_000, np.zeros(24)), (6_001, None), (6_002, np.ones(5))]
    vectors = frame(spark, rows)
    return x, vectors, vector_index.build(vectors, str(tmp_path_factory.mktemp("vectors") / "index"))


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "rank", "chunk_id", "score").collect()))


def test_all_cells_give_exact_rows(spark, stored):
    x, vectors, index = stored
    asked = frame(spark, [(0, x[0]), (1, x[9]), (2, np.zeros(24)), (3, None), (4, np.ones(3)), (5, x[7] * 1e-9), (6, -x[3])], QUERY)
    for k in (1, 10):
        assert rows_of(vector_index.nearest(index, asked, k, len(index.centroids))) == rows_of(search.dense(vectors, asked, k))
    assert vector_index.nearest(index, asked.limit(0)).count() == 0


def test_probed_cells_suffice_and_others_are_not_read(spark, stored):
    rng = np.random.default_rng(5)
    x, vectors, index = stored
    asked = frame(spark, [(i, x[i] + rng.normal(size=24) * 0.1) for i in range(0, 3_000, 60)], QUERY)
    measured = vector_index.recall(index, vectors, asked).first()
    assert measured["n_queries"] == 50 and measured["recall"] >= 0.95
    assert index.probes < len(index.centroids) / 4
    one = vector_index.nearest(index, asked.limit(1))
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert one.count() == 10 and "ReadSchema: struct<cell:int,chunk_id:bigint,codes:binary,scale:double,error:double>" in plan


def test_blocks_of_queries(spark, stored, monkeypatch):
    monkeypatch.setattr(vector_index, "BATCH", 7)
    x, vectors, index = stored
    asked = frame(spark, [(i, x[i]) for i in range(20)], QUERY)
    assert rows_of(vector_index.nearest(index, asked, 3, len(index.centroids))) == rows_of(search.dense(vectors, asked, 3))


def test_an_index_of_nothing(spark, tmp_path):
    empty = vector_index.build(frame(spark, []), str(tmp_path / "none"))
    assert vector_index.nearest(empty, frame(spark, [(1, np.ones(3))], QUERY)).count() == 0
    same = vector_index.build(frame(spark, [(i, np.ones(3)) for i in range(50)]), str(tmp_path / "same"))
    got = vector_index.nearest(same, frame(spark, [(1, np.ones(3))], QUERY), 5)
    assert [(r["chunk_id"], r["score"]) for r in got.orderBy("rank").collect()] == [(i, 1.0) for i in range(5)]
    assert same.rows().select(F.countDistinct("chunk_id")).first()[0] == 50
