"""Images as rows: their index, statistics, duplicates and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import ids

# Types by suffix.
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "html": "text/html"}


def register(images: DataFrame) -> DataFrame:
    """``images`` (doc_hash, page, number, path, collection, content) with their ids; of one id the first path stays."""
    named = images.withColumn("image_id", ids.image_id(F.col("doc_hash"), F.col("page"), F.col("number")))
    first = F.min(F.struct("path", "collection", "doc_hash", "content")).alias("first")
    return named.groupBy("image_id").agg(first).select("image_id", "first.*")


def statistics(index: DataFrame) -> DataFrame:
    return index.groupBy("collection").agg(F.count(F.lit(1)).alias("n_images"), F.sum(F.octet_length("content")).alias("n_bytes"))


def without_duplicates(index: DataFrame, head: int = 64) -> DataFrame:
    """One image of those whose base64 content starts alike."""
    start = F.substring(F.base64("content"), 1, head)
    return index.groupBy(start.alias("start")).agg(F.min("image_id").alias("image_id"), F.count(F.lit(1)).alias("n_alike")).drop("start")


def mime_of(path: Column, default: str = "image/png") -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?\z", 1))
    out = F.lit(default)
    for name, mime in MIME.items():
        out = F.when(suffix == name, mime).otherwise(out)
    return out


# How files of a type begin, in hexadecimal.
MAGIC = {"89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "47494638": "image/gif", "424D": "image/bmp"}


def mime_of_content(content: Column, path: Column, default: str = "image/png") -> Column:
    """The type by suffix, else by the first bytes, else ``default``."""
    head = F.hex(F.substring(content, 1, 12))
    by_bytes = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").otherwise(default)
    for start, mime in MAGIC.items():
        by_bytes = F.when(head.startswith(start), mime).otherwise(by_bytes)
    return F.coalesce(F.nullif(mime_of(path, ""), F.lit("")), by_bytes)


def listed(index: DataFrame, collection: str | None = None, doc_hash: str | None = None) -> DataFrame:
    """Images of a collection, a document or both."""
    found = index.where(F.col("collection") == collection) if collection else index
    return found.where(F.col("doc_hash") == doc_hash) if doc_hash else found


def removed(index: DataFrame, gone: DataFrame) -> DataFrame:
    """The index without the images of the documents in ``gone`` (doc_hash)."""
    return index.join(gone.select("doc_hash").distinct(), "doc_hash", "left_anti")
