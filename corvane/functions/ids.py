"""Identity rules of documents, chunks and images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ids that a text may name.
EVIDENCE_ID = r"(?i)\b([a-f0-9]{8}_[0-9]{4}_[a-f0-9]{8})\b"
DOCUMENT_ID = r"(?i)\b(doc_[a-f0-9]+)\b"


def doc_id(content: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(content, 256), 1, 16))


def _index(position: Column) -> Column:
    return F.format_string("%04d", position)


def draft_chunk_id(document: Column, position: Column, text: Column) -> Column:
    return F.concat_ws("_", document, _index(position), F.substring(F.sha2(text, 256), 1, 8))


def stored_chunk_id(source_path: Column, position: Column, text: Column) -> Column:
    return F.concat_ws("_", F.substring(F.sha2(source_path, 256), 1, 8), _index(position), F.substring(F.sha2(text, 256), 1, 8))


def image_id(doc_hash: Column, page: Column, number: Column) -> Column:
    return F.concat_ws("_", F.substring(doc_hash, 1, 8), page.cast("string"), number.cast("string"))


def document_of_chunk(source_ref: Column, document: Column, source_path: Column, chunk_id: Column) -> Column:
    """The document of a stored record: its reference, its document, its file's stem, or the id's front part."""
    stem = F.regexp_extract(source_path, r"([^/]+?)(\.[^./]*)?$", 1)
    front = F.regexp_extract(chunk_id, r"^(.*)_[0-9]+_[^_]*$", 1)
    return F.coalesce(source_ref, document, F.concat(F.lit("doc_"), stem), F.nullif(front, F.lit("")), chunk_id)


def evidence_ids(text: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(EVIDENCE_ID), F.lit(1)), F.regexp_extract_all(text, F.lit(DOCUMENT_ID), F.lit(1))))


def normalized(ids: Column, most: int = 12) -> Column:
    """Different ids that aren't blank, in their first order, ``most`` at most."""
    kept = F.filter(F.transform(ids, lambda i: F.regexp_replace(i, r"^\s+|\s+\z", "")), lambda i: i != "")
    return F.slice(F.array_distinct(kept), 1, most)
