"""A stored vector index: an inverted file of coarse cells with residual codes, verified by exact vectors.

Cells are centroids trained on a bounded sample. Every vector is stored in its nearest cell, with its residual to the
centroid in one byte a component and the length of what that rounds away. A query probes the cells nearest to it: it reads their
codes, which give each vector's cosine up to a known error, and verifies by the vectors themselves all that may be among the
best. Within the probed cells the answer is exact; how many cells to probe is calibrated against exact search when the index is built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import scoring
from corvane.operators import search

CELL_ROOT = 4  # cells: so many times the root of the number of vectors
CENTROID_BYTES = 64 << 20  # of all centroids, which travel to all tasks
TRAIN_ROWS = 64  # vectors of the sample for each cell,
TRAIN_BYTES = 256 << 20  # and bytes of it at most
ROUNDS = 8
PARTS = 1024  # folders at most, each of so many cells
CALIBRATED, CALIBRATED_K = 128, 10  # vectors that are searched exactly to find the number of probes
RECALL = 0.97  # that calibration asks for
BATCH = 2_048
SEED = 7
ROW = "cell int, chunk_id {0}, embedding array<double>, codes binary, scale double, error double, part int"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows by their length; zero rows stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def trained(sample: np.ndarray, cells: int, seed: int = SEED) -> np.ndarray:
    """Centroids of unit vectors by k-means; a cell that loses all its vectors starts anew at one that is far from its own."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest, dots = nearest_cells(sample, centroids, 1)
        own = nearest[:, 0]
        counts = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        far = np.argsort(dots[:, 0])
        centroids = sums / np.maximum(counts, 1)[:, None]
        empty = np.flatnonzero(counts == 0)
        centroids[empty] = sample[far[: len(empty)]]
    return centroids


def nearest_cells(x: np.ndarray, centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the ``n`` nearest centroids, nearest first, and its product with them less half their square length."""
    half = (centroids * centroids).sum(1) / 2
    at, value = [], []
    for start in range(0, len(x), BATCH):
        near = x[start : start + BATCH] @ centroids.T - half
        best = np.argpartition(-near, n - 1, axis=1)[:, :n] if n < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
        shown = np.take_along_axis(near, best, 1)
        order = np.argsort(-shown, axis=1, kind="stable")
        at.append(np.take_along_axis(best, order, 1))
        value.append(np.take_along_axis(shown, order, 1))
    return (np.concatenate(at), np.concatenate(value)) if at else (np.zeros((0, n), np.int64), np.zeros((0, n)))


class VectorIndex:
    """A stored index of vectors: ``centroids`` by cell, and rows (cell, chunk_id, embedding, codes, scale, error) in folders of cells."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.about = json.loads(spark.read.text(f"{self.root}/about").first()[0])
        rows = sorted(spark.read.parquet(f"{self.root}/centroids").collect())
        self.centroids = np.array([r["centroid"] for r in rows], float).reshape(len(rows), self.about["dim"])
        self.probes = self.about["probes"]

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROW.format(self.about["id_type"])).parquet(f"{self.root}/vectors")

    def part(self, cells: np.ndarray) -> np.ndarray:
        return cells * self.about["parts"] // max(1, len(self.centroids))


def build(vectors: DataFrame, root: str, cells: int | None = None, recall: float = RECALL) -> VectorIndex:
    """Store ``vectors`` (chunk_id, embedding) in the new folder ``root``. Null vectors, and those of another length than most, are no
    match of any query and are left out."""
    root, spark = root.rstrip("/"), vectors.sparkSession
    id_type = vectors.schema["chunk_id"].dataType.simpleString()
    given = vectors.where("embedding is not null").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    common = given.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (common["dim"], common["n"]) if common else (0, 0)
    given = given.where(F.size("embedding") == dim)
    cells = min(cells or max(1, int(CELL_ROOT * n**0.5)), max(1, CENTROID_BYTES // (8 * max(dim, 1))))
    wanted = min(TRAIN_ROWS * cells, max(1, TRAIN_BYTES // (8 * max(dim, 1))))
    in_sample = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * wanted / max(1, n))) + 1
    sample = given.where(in_sample).limit(wanted).toPandas() if n else pd.DataFrame({"embedding": []})
    x = unit(np.stack(sample["embedding"].to_numpy()).astype(float)) if len(sample) else np.zeros((0, dim))
    centroids = trained(x, cells) if len(x) else np.zeros((1, dim))
    parts = max(1, min(PARTS, len(centroids) // 8))
    held = spark.sparkContext.broadcast(centroids)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BATCH):
                rows = batch.iloc[start : start + BATCH]
                u = unit(np.stack(rows["embedding"].to_numpy()).astype(float))
                cell = nearest_cells(u, held.value, 1)[0][:, 0]
                residual = u - held.value[cell]
                scale = np.abs(residual).max(1, initial=0) / 127
                codes = np.rint(np.divide(residual, scale[:, None], out=np.zeros_like(residual), where=scale[:, None] > 0)).astype(np.int8)
                error = np.linalg.norm(residual - codes * scale[:, None], axis=1)
                raw = pd.Series([c.tobytes() for c in codes], dtype=object)
                yield pd.DataFrame({"cell": cell, "chunk_id": rows["chunk_id"].to_numpy(), "embedding": rows["embedding"].to_numpy(), "codes": raw, "scale": scale, "error": error, "part": cell * parts // len(held.value)})

    made = given.mapInPandas(coded, ROW.format(id_type))
    # by range, so that a cell of many vectors goes to several files
    order = ("part", "cell", "chunk_id")
    made.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("part").parquet(f"{root}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{root}/centroids")
    probes = _calibrated(given, x[:CALIBRATED], centroids, recall) if len(x) else 1
    about = {"dim": dim, "n": n, "parts": parts, "probes": probes, "id_type": id_type, "recall": recall}
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.text(f"{root}/about")
    return VectorIndex(spark, root)


def _calibrated(given: DataFrame, asked: np.ndarray, centroids: np.ndarray, recall: float) -> int:
    """The cells to probe so that ``recall`` of the best CALIBRATED_K other vectors of each of ``asked`` lie in them, by exact search over all vectors."""
    spark = given.sparkSession
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], "query_id int, embedding array<double>")
    # the query itself is among the best, and its own cell is probed anyway
    best = search.dense(given, queries, CALIBRATED_K + 1).join(given, "chunk_id").select("query_id", "embedding").toPandas()
    cell = nearest_cells(unit(np.stack(best["embedding"].to_numpy()).astype(float)), centroids, 1)[0][:, 0]
    order = nearest_cells(asked, centroids, len(centroids))[0]
    place = np.argsort(order, axis=1)
    ranks = np.sort(place[best["query_id"].to_numpy(), cell])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def _candidates(held, k: int):
    """query_id, cell, chunk_id, low, high: what the codes say of the vectors of a batch; per query those that may be among its best k."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, names, asking, centroids = held.value
        for batch in batches:
            for start in range(0, len(batch), BATCH):
                rows = batch.iloc[start : start + BATCH]
                for cell, own in rows.groupby("cell"):
                    which = asking.get(int(cell))
                    if which is None:
                        continue
                    q = queries[which]
                    codes = np.frombuffer(b"".join(own["codes"]), np.int8).reshape(len(own), -1).astype(float)
                    about = (q @ centroids[int(cell)])[:, None] + (q @ codes.T) * own["scale"].to_numpy()[None, :]
                    error = own["error"].to_numpy()[None, :] + 1e-9
                    low, high = about - error, about + error
                    bar = -np.partition(-low, k - 1, axis=1)[:, k - 1 : k] if low.shape[1] > k else np.full((len(low), 1), -np.inf)
                    i, j = np.nonzero(high >= bar)
                    yield pd.DataFrame({"query_id": names[which][i], "cell": int(cell), "chunk_id": own["chunk_id"].to_numpy()[j], "low": low[i, j], "high": high[i, j]})

    return run


def nearest(stored: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score: for each of ``queries`` (query_id, embedding) the best k vectors of the cells that it probes, as
    ``search.dense`` scores and orders them; with all cells probed its very rows.

    Queries are few beside the vectors and are answered BATCH at a time; folders that none of them probes are not read. A null vector or one
    of another length has no match; a zero vector has cosine 0 with all, and probes all cells.
    """
    spark, dim = stored.spark, stored.about["dim"]
    asked = queries.where(F.size("embedding") == dim).select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    n_blocks = -(-asked.count() // BATCH)
    blocks = [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b) for b in range(n_blocks)]
    parts = [_nearest(stored, block, k, probes or stored.probes) for block in blocks]
    if not parts:
        types = queries.schema["query_id"].dataType.simpleString(), stored.about["id_type"]
        return spark.createDataFrame([], "query_id {}, rank int, chunk_id {}, score double".format(*types))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _nearest(stored: VectorIndex, block: DataFrame, k: int, probes: int) -> DataFrame:
    spark = stored.spark
    held = block.toPandas()
    names = held["query_id"].to_numpy()
    x = unit(np.stack(held["embedding"].to_numpy()).astype(float)) if len(held) else np.zeros((0, stored.about["dim"]))
    cells = nearest_cells(x, stored.centroids, min(probes, len(stored.centroids)))[0]
    asking: dict[int, list[int]] = {}
    for i, row in enumerate(cells):
        for cell in range(len(stored.centroids)) if not x[i].any() else row.tolist():
            asking.setdefault(int(cell), []).append(i)
    which = np.array(sorted(asking), np.int64)
    rows = stored.rows().where(F.col("part").isin(np.unique(stored.part(which)).tolist()))
    sent = spark.sparkContext.broadcast((x, names, {c: np.array(q) for c, q in asking.items()}, stored.centroids))
    name = block.schema["query_id"].dataType.simpleString()
    found = rows.select("cell", "chunk_id", "codes", "scale", "error").mapInPandas(_candidates(sent, k), f"query_id {name}, cell int, chunk_id {stored.about['id_type']}, low double, high double")
    order = Window.partitionBy("query_id").orderBy(F.desc("low"))
    bar = found.withColumn("place", F.row_number().over(order)).where(F.col("place") == k).select("query_id", F.col("low").alias("bar"))
    kept = found.join(bar, "query_id", "left").where(F.col("bar").isNull() | (F.col("high") >= F.col("bar"))).select("query_id", "cell", "chunk_id")
    verified = kept.join(rows.select("cell", "chunk_id", "embedding"), ["cell", "chunk_id"]).join(F.broadcast(block.select("query_id", F.col("embedding").alias("ask"))), "query_id")
    scored = verified.select("query_id", "chunk_id", scoring.cosine_score(scoring.cosine(F.col("embedding"), F.col("ask"))).alias("score"))
    return search.ranked(scored, k).select("query_id", "rank", "chunk_id", "score")


def recall(stored: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """n_queries, n_true, n_found, recall: one row, of these queries against exact search over ``vectors``."""
    true = search.dense(vectors, queries, k).select("query_id", "chunk_id")
    found = nearest(stored, queries, k, probes).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    both = true.join(found, ["query_id", "chunk_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_true"))
