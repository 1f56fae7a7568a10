"""The inverted index: term statistics, postings and corpus statistics as tables, and stored in segments."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import scoring, text

BLOCK = 128  # postings of a term that have one bound of their scores
LEAST_BUCKETS, MOST_BUCKETS = 16, 4_096  # by term; a segment's files are sorted by term within a bucket
BUCKET_POSTINGS = 1 << 20
COUNTS = "array<struct<term:string,tf:bigint>>"


def term_stats(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", tokens: Callable[[Column], Column] = text.tokens) -> DataFrame:
    """chunk_id and its terms, one row per chunk; chunks without terms stay, so they count in the corpus. ``tokens`` cuts texts, those of
    queries alike: ``Lexicon.tokens`` where words have no spaces between them."""
    return chunks.select(F.col(id_col).alias("chunk_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("terms"))


def postings(stats: DataFrame) -> DataFrame:
    """term, chunk_id, tf, doc_length."""
    exploded = stats.select("chunk_id", F.size("terms").cast("long").alias("doc_length"), F.explode("terms").alias("term"))
    return exploded.groupBy("term", "chunk_id").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_length").alias("doc_length"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """num_docs, total_terms, avg_doc_length: one row."""
    length = F.size("terms").cast("long")
    return stats.agg(F.count(F.lit(1)).alias("num_docs"), F.coalesce(F.sum(length), F.lit(0)).alias("total_terms"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_doc_length"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_table(posted: DataFrame, corpus: DataFrame) -> DataFrame:
    """term, df, idf; the corpus statistics are one row and travel along."""
    return document_frequency(posted).join(F.broadcast(corpus.select("num_docs"))).select("term", "df", scoring.idf(F.col("num_docs"), F.col("df")).alias("idf"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``existing`` with the rows of ``incoming`` in place of those with the same key."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def top_terms(posted: DataFrame, k: int = 10) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("chunk_id").orderBy(F.desc("tf"), "term")
    return posted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("chunk_id", "rank", "term", "tf")


def rle(terms: Column) -> Column:
    """Terms of a chunk with their times, in order of the terms: one struct (term, tf) each."""
    in_order = F.sort_array(terms)
    starts = lambda ordered: F.filter(F.transform(ordered, lambda t, i: F.when((i == 0) | (t != F.get(ordered, i - 1)), i)), lambda i: i.isNotNull())
    # bound by a lambda, so that the sorted terms are made once
    counted = lambda ordered, at: F.transform(at, lambda i, n: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, n + 1), F.size(ordered)) - i).cast("long").alias("tf")))
    once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    return once(in_order, lambda ordered: once(starts(ordered), lambda at: counted(ordered, at)))


def bucket(term: Column, buckets: int = LEAST_BUCKETS) -> Column:
    """The bucket of a term's postings."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Index:
    """A version of a stored index: immutable segments and tombstones in the order in which they came.

    A segment has its chunks with their counted terms (``forward``), postings in blocks, and its terms' document frequencies. A
    tombstone names chunks that are gone from all segments before it, with the document frequencies that go with them. The
    statistics of the index are sums over both, so that adding and removing write no more than what they add and remove.
    A version is a small file that lists them; it appears as a whole or not at all, and what it lists never changes, so
    a reader keeps its version whatever is written meanwhile.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        known = versions(spark, self.root)
        if not known or version is not None and version not in known:
            raise ValueError(f"{root} has no such version of an index")
        self.version = max(known) if version is None else version
        self.manifest = json.loads(_read_text(spark, _version_file(self.root, self.version)))
        self.parts, self.buckets, self.id_type = self.manifest["parts"], self.manifest["buckets"], self.manifest["id_type"]

    def _tables(self, kind: str, name: str, schema: str) -> list[tuple[int, DataFrame]]:
        return [(at, self.spark.read.schema(schema).parquet(f"{p['path']}/{name}")) for at, p in enumerate(self.parts) if p["kind"] == kind]

    def _live(self, tables: list[tuple[int, DataFrame]]) -> DataFrame:
        """The rows of all segments (chunk_id and others) without chunks that a later tombstone names."""
        dead = self._tables("tombstone", "dead", f"chunk_id {self.id_type}, doc_length long")
        found = []
        for at, rows in tables:
            for when, gone in dead:
                rows = rows.join(gone.select("chunk_id"), "chunk_id", "left_anti") if when > at else rows
            found.append(rows)
        return reduce(DataFrame.unionByName, found)

    def forward(self) -> DataFrame:
        """chunk_id, doc_length, counts (array of term, tf) of the chunks that are there."""
        schema = f"chunk_id {self.id_type}, doc_length long, counts {COUNTS}"
        return self._live(self._tables("segment", "forward", schema))

    def blocks(self) -> DataFrame:
        """segment, bucket, term, block, n, max_tf, min_length, and the chunk_ids, tfs and lengths of the block's postings, which
        may be of chunks that have gone."""
        schema = f"term string, block long, n long, max_tf long, min_length long, chunk_ids array<{self.id_type}>, tfs array<bigint>, lengths array<bigint>, bucket int"
        found = [rows.withColumn("segment", F.lit(at)) for at, rows in self._tables("segment", "postings", schema)]
        return reduce(DataFrame.unionByName, found)

    def live_postings(self, blocks: DataFrame) -> DataFrame:
        """The postings of some of the index's ``blocks``, one row each (chunk_id, tf, doc_length beside the other columns), without chunks that
        have gone."""
        flat = blocks.select("*", F.explode(F.arrays_zip("chunk_ids", "tfs", "lengths")).alias("p")).drop("chunk_ids", "tfs", "lengths")
        flat = flat.select("*", F.col("p.chunk_ids").alias("chunk_id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("doc_length")).drop("p")
        dead = [rows.select("chunk_id", F.lit(at).alias("died")) for at, rows in self._tables("tombstone", "dead", f"chunk_id {self.id_type}, doc_length long")]
        if not dead:
            return flat
        # a chunk may have gone and come again: its last tombstone counts
        last = reduce(DataFrame.unionByName, dead).groupBy("chunk_id").agg(F.max("died").alias("died"))
        return flat.join(last, "chunk_id", "left").where("died is null or segment > died").drop("died")

    def postings(self) -> DataFrame:
        """term, chunk_id, tf, doc_length, bucket."""
        return self.live_postings(self.blocks()).select("term", "chunk_id", "tf", "doc_length", "bucket")

    def terms(self) -> DataFrame:
        """term, df, bucket."""
        schema = "term string, df long, bucket int"
        own = [rows for _, rows in self._tables("segment", "terms", schema)]
        gone = [rows.withColumn("df", -F.col("df")) for _, rows in self._tables("tombstone", "terms", schema)]
        if len(own) == 1 and not gone:
            return own[0]
        return reduce(DataFrame.unionByName, own + gone).groupBy("term", "bucket").agg(F.sum("df").alias("df")).where("df > 0").select("term", "df", "bucket")

    def lengths(self) -> DataFrame:
        """chunk_id, doc_length; chunks without terms too."""
        schema = f"chunk_id {self.id_type}, doc_length long"
        return self._live(self._tables("segment", "forward", schema))

    def corpus(self) -> DataFrame:
        """num_docs, total_terms, avg_doc_length: one row."""
        n, total = (sum(p[c] * (1 if p["kind"] == "segment" else -1) for p in self.parts) for c in ("num_docs", "total_terms"))
        row = [F.lit(n).cast("long").alias("num_docs"), F.lit(total).cast("long").alias("total_terms"), F.lit(total / n if n else 0.0).alias("avg_doc_length")]
        return self.spark.range(1).select(*row)

    def weights(self) -> DataFrame:
        """term, df, idf."""
        return self.terms().join(F.broadcast(self.corpus())).select("term", "df", scoring.idf(F.col("num_docs"), F.col("df")).alias("idf"))


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _version_file(root: str, version: int) -> str:
    return f"{root}/versions/{version:010d}.json"


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the versions of the index in ``root``."""
    folder, files = _filesystem(spark, f"{root.rstrip('/')}/versions")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))


def _commit(spark: SparkSession, root: str, manifest: dict, version: int) -> Index:
    """Make ``manifest`` the index's version: written aside, then renamed; if another writer has taken the number, that is an error and
    nothing has changed."""
    target, files = _filesystem(spark, _version_file(root, version))
    aside, _ = _filesystem(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if files.exists(target) or not files.rename(aside, target):
        files.delete(aside, False)
        raise ValueError(f"version {version} of {root} has been written by another")
    return Index(spark, root, version)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of their term, best first, as blocks of one term and BLOCK postings at most."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        terms = batch.column("term")
        new = np.concatenate([[True], pc.not_equal(terms.slice(1), terms.slice(0, n - 1)).to_numpy(zero_copy_only=False)]) if n > 1 else np.array([True])
        first = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        starts = np.flatnonzero(place % BLOCK == 0)
        offsets = pa.array(np.append(starts, n), pa.int32())
        tf, length = (batch.column(c).to_numpy() for c in ("tf", "doc_length"))
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("chunk_id", "tf", "doc_length")]
        at = pa.array(starts)
        columns = [terms.take(at), pa.array(number + np.arange(len(starts))), pa.array(np.diff(np.append(starts, n))), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length, starts)), *lists, batch.column("bucket").take(at)]
        yield pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "max_tf", "min_length", "chunk_ids", "tfs", "lengths", "bucket"])
        number += len(starts)


def _segment(spark: SparkSession, forward: DataFrame, root: str, buckets: int | None) -> tuple[dict, int]:
    """Write a segment of ``forward`` (chunk_id, doc_length, counts) below ``root``: what the manifest says of it, and its number of buckets."""
    path = f"{root}/segments/{uuid.uuid4().hex}"
    forward.write.parquet(f"{path}/forward")  # texts are tokenised once, here
    stored = spark.read.schema(forward.schema).parquet(f"{path}/forward")
    total = stored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("counts")), F.lit(0)).alias("postings")).first()
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (total["postings"] // BUCKET_POSTINGS).bit_length()))
    average = max(1.0, total["terms"] / max(1, total["n"]))
    flat = stored.select("chunk_id", "doc_length", F.explode("counts").alias("c")).select("chunk_id", "doc_length", "c.term", "c.tf")
    flat = flat.withColumn("bucket", bucket(F.col("term"), buckets)).withColumn("impact", scoring.bm25(F.lit(1.0), F.col("tf"), F.col("doc_length"), F.lit(average)))
    # by range, not by hash: a word that most chunks have goes to several files of its bucket
    order = ("bucket", "term", F.desc("impact"), "chunk_id")
    ids = forward.schema["chunk_id"].dataType.simpleString()
    placed = flat.repartitionByRange(*order).sortWithinPartitions(*order).select("term", "chunk_id", "tf", "doc_length", "bucket")
    blocks = placed.mapInArrow(_cut, f"term string, block long, n long, max_tf long, min_length long, chunk_ids array<{ids}>, tfs array<bigint>, lengths array<bigint>, bucket int")
    blocks.write.partitionBy("bucket").parquet(f"{path}/postings")
    counted = spark.read.schema("term string, n long, bucket int").parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    _by_bucket(counted, f"{path}/terms")
    return {"kind": "segment", "path": path, "num_docs": total["n"], "total_terms": total["terms"]}, buckets


def _by_bucket(terms: DataFrame, path: str) -> None:
    terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def _forward(stats: DataFrame) -> DataFrame:
    if "counts" in stats.columns:
        return stats.select("chunk_id", "doc_length", "counts")
    return stats.select("chunk_id", F.size("terms").cast("long").alias("doc_length"), rle(F.col("terms")).alias("counts"))


def _entombed(stored: Index, keys: DataFrame, root: str) -> list[dict]:
    """A tombstone below ``root`` for those of ``keys`` (chunk_id) that the index has."""
    path = f"{root}/tombstones/{uuid.uuid4().hex}"
    spark = stored.spark
    stored.forward().join(keys, "chunk_id", "left_semi").write.parquet(f"{path}/dead")
    dead = spark.read.parquet(f"{path}/dead")
    total = dead.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("terms")).first()
    if not total["n"]:
        return []
    lost = dead.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    _by_bucket(lost.withColumn("bucket", bucket(F.col("term"), stored.buckets)), f"{path}/terms")
    return [{"kind": "tombstone", "path": path, "num_docs": total["n"], "total_terms": total["terms"]}]


def store_forward(stats: DataFrame, path: str) -> None:
    """Store chunks with their counted terms alone (chunk_id, doc_length, counts), for ``search.bm25_scan`` and for a later ``build``."""
    _forward(stats).write.option("compression", "zstd").mode("overwrite").parquet(path)


def build(stats: DataFrame, root: str) -> Index:
    """Store the index of ``stats`` (one row per chunk, or a stored forward table) in the folder ``root``, as a version of one segment."""
    root, spark = root.rstrip("/"), stats.sparkSession
    part, buckets = _segment(spark, _forward(stats), root, None)
    return _commit(spark, root, {"parts": [part], "buckets": buckets, "id_type": stats.schema["chunk_id"].dataType.simpleString()}, max(versions(spark, root), default=0) + 1)


def _changed(stored: Index, parts: list[dict], root: str) -> Index:
    return _commit(stored.spark, root, stored.manifest | {"parts": stored.parts + parts}, (stored.version if root == stored.root else max(versions(stored.spark, root), default=0)) + 1)


def add(stored: Index, stats: DataFrame, root: str | None = None) -> Index:
    """A new version of an index with the chunks of ``stats``, in place of those with the same ids: a segment of its own, and a
    tombstone for what it replaces. With another ``root`` the version is kept there and refers to the old segments where they are."""
    root = (root or stored.root).rstrip("/")
    tombs = _entombed(stored, stats.select("chunk_id").distinct(), root)
    part, _ = _segment(stored.spark, _forward(stats), root, stored.buckets)
    return _changed(stored, [*tombs, part], root)


def remove(stored: Index, gone: DataFrame, root: str | None = None) -> Index:
    """A new version of an index without the chunks in ``gone`` (chunk_id): a tombstone."""
    root = (root or stored.root).rstrip("/")
    return _changed(stored, _entombed(stored, gone.select("chunk_id").distinct(), root), root)


def compact(stored: Index, root: str | None = None) -> Index:
    """A new version of an index in one segment, without what has gone. Older versions keep their files until ``vacuum``."""
    root = (root or stored.root).rstrip("/")
    part, buckets = _segment(stored.spark, stored.forward(), root, None)
    return _commit(stored.spark, root, stored.manifest | {"parts": [part], "buckets": buckets}, (stored.version if root == stored.root else max(versions(stored.spark, root), default=0)) + 1)


def vacuum(stored: Index) -> list[str]:
    """Remove the versions before ``stored`` and the segments and tombstones below its root that neither it nor a later version lists.
    Readers of these versions and writers that haven't committed have to be done."""
    spark, root = stored.spark, stored.root
    kept = {p["path"] for v in versions(spark, root) if v >= stored.version for p in Index(spark, root, v).parts}
    for v in versions(spark, root):
        if v < stored.version:
            at, files = _filesystem(spark, _version_file(root, v))
            files.delete(at, False)
    gone = []
    for kind in ("segments", "tombstones"):
        folder, files = _filesystem(spark, f"{root}/{kind}")
        for name in [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []:
            if f"{root}/{kind}/{name}" not in kept:
                files.delete(_filesystem(spark, f"{root}/{kind}/{name}")[0], True)
                gone.append(name)
    return gone


def upsert_batches(existing: DataFrame, batches: list[DataFrame], key: str = "chunk_id") -> DataFrame:
    """One upsert of several batches; of rows with one key that of the last batch counts."""
    if not batches:
        return existing
    rows = batches[0].withColumn("__batch", F.lit(0))
    for number, batch in enumerate(batches[1:], 1):
        rows = rows.unionByName(batch.withColumn("__batch", F.lit(number)))
    names = [c for c in existing.columns if c != key]
    last = rows.groupBy(key).agg(F.max(F.struct("__batch", *names)).alias("r")).select(key, *[F.col(f"r.`{c}`").alias(c) for c in names])
    return upsert(existing, last.select(*existing.columns), key)
