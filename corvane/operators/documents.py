"""Document tools over a chunk table: listings, summaries, outlines, full texts, neighbours, lookups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.session import staged


def list_collections(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("n_chunks"))


def list_documents(chunks: DataFrame) -> DataFrame:
    """A row for each document: its chunks, and the title by rule of its first chunk."""
    first = F.min(F.struct("chunk_index", "chunk_id", "text"))
    grouped = chunks.groupBy("doc_id", "source_path", "doc_type").agg(F.count(F.lit(1)).alias("chunk_count"), first.alias("first"))
    return grouped.select("doc_id", "source_path", "doc_type", "chunk_count", text.rule_title(F.col("first.text")).alias("title"))


LISTED, MOST_LISTED = 50, 500


def listed(chunks: DataFrame, collection: str | None = None, limit: int = LISTED) -> DataFrame:
    """position and the columns of ``list_documents``: the first ``limit`` documents (1 to MOST_LISTED) by path, title and id, of one
    collection if it is given. A document without a path comes first."""
    limit = max(1, min(int(limit), MOST_LISTED))
    own = chunks.where(F.col("collection") == collection) if collection else chunks
    path = F.coalesce("source_path", F.lit(""))
    # documents behind the last path that is shown are not grouped with their texts
    last = own.select("doc_id", "source_path", "doc_type").distinct().select(path.alias("path")).orderBy("path").limit(limit).agg(F.max("path")).first()[0]
    first = list_documents(own.where(path <= F.lit(last or ""))).orderBy(path, "title", F.col("doc_id").cast("string")).limit(limit)
    order = Window.orderBy(path, "title", F.col("doc_id").cast("string"))  # MOST_LISTED rows
    return first.withColumn("position", F.row_number().over(order) - 1).select("position", "doc_id", "source_path", "doc_type", "chunk_count", "title")


def located(chunks: DataFrame, requests: DataFrame, hits: DataFrame) -> DataFrame:
    """request_id, how, doc_id, n_matched: the document that each of ``requests`` (request_id, doc_id, query, source_path, title) means.

    An id says it itself (given). A query means the document of its ``hits`` (request_id, doc_id) if they are all of one (searched). Without
    both, path and title, each a part in any case, mean the one document of the listing that has them (matched). Several documents are
    ambiguous, none is missing, and a request that says nothing is empty; these have no document.
    """
    blank = lambda c: F.nullif(text.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(""))
    asked = requests.select("request_id", blank("doc_id").alias("given"), blank("query").alias("query"), blank("source_path").alias("path"), blank("title").alias("heading"))
    kind = F.when(F.col("given").isNotNull(), "given").when(F.col("query").isNotNull(), "searched").when(F.coalesce("path", "heading").isNotNull(), "matched").otherwise("empty")
    asked = asked.withColumn("kind", kind)
    found = hits.groupBy("request_id").agg(F.countDistinct("doc_id").alias("n_found"), F.min("doc_id").alias("found_id"))
    listing = listed(chunks, limit=MOST_LISTED).select("doc_id", F.lower(F.coalesce("source_path", F.lit(""))).alias("own_path"), F.lower("title").alias("own_title"))
    holds = lambda own, part: F.col(part).isNull() | F.contains(own, F.lower(F.col(part)))
    # the listing has MOST_LISTED rows at most, which bounds what is sent
    met = asked.where("kind = 'matched'").join(F.broadcast(listing), holds(F.col("own_path"), "path") & holds(F.col("own_title"), "heading"))
    met = met.groupBy("request_id").agg(F.countDistinct("doc_id").alias("n_met"), F.min("doc_id").alias("met_id"))
    out = asked.join(found, "request_id", "left").join(met, "request_id", "left")
    n = F.coalesce(F.when(F.col("kind") == "searched", F.col("n_found")).when(F.col("kind") == "matched", F.col("n_met")).when(F.col("kind") == "given", F.lit(1)), F.lit(0)).cast("long")
    one = F.when(F.col("kind") == "given", F.col("given")).when((F.col("kind") == "searched") & (n == 1), F.col("found_id").cast("string")).when((F.col("kind") == "matched") & (n == 1), F.col("met_id").cast("string"))
    how = F.when((F.col("kind") == "empty") | (F.col("kind") == "given") | (n == 1), F.col("kind")).when(n > 1, "ambiguous").otherwise("missing")
    return out.select("request_id", how.alias("how"), one.alias("doc_id"), n.alias("n_matched"))


NAMED = 5_000  # documents that are named to the scan of the chunks


def located_texts(chunks: DataFrame, requests: DataFrame, hits: DataFrame, most: int = 120_000) -> DataFrame:
    """``located`` with the full text of the document (``full_text``) and its number of chunks; an id that no document has is missing."""
    where = staged(located(chunks, requests, hits), "located")  # searched once, and few rows, to which texts need not be moved
    wanted = where.where("doc_id is not null").select("doc_id").distinct()
    own = chunks.withColumn("doc_id", F.col("doc_id").cast("string"))
    names = [r[0] for r in wanted.limit(NAMED + 1).collect()]
    # named, they filter documents before these are cut into chunks
    own = own.where(F.col("doc_id").isin(names)) if len(names) <= NAMED else own.join(wanted, "doc_id", "left_semi")
    known = own.select("doc_id").distinct().withColumn("known", F.lit(True))
    out = where.join(full_text(own, most), "doc_id", "left").join(known, "doc_id", "left")
    how = F.when((F.col("how") == "given") & F.col("known").isNull(), "missing").otherwise(F.col("how"))
    return out.select("request_id", how.alias("how"), F.when(how != "missing", F.col("doc_id")).alias("doc_id"), "n_matched", "n_chunks", "full_text")


def summary(chunks: DataFrame) -> DataFrame:
    """A document's first lines that are no headings, up to 500 characters, with its number of chunks."""
    body = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda line: (line != "") & ~line.rlike("^#{1,6}\\s"))
    first = F.min_by(F.array_join(F.slice(body, 1, 5), " "), F.when(F.size(body) > 0, F.col("chunk_index")))
    grouped = chunks.groupBy("doc_id").agg(first.alias("summary"), F.count(F.lit(1)).alias("chunk_count"))
    return grouped.select("doc_id", F.substring(F.coalesce("summary", F.lit("")), 1, 500).alias("summary"), "chunk_count")


def outline(chunks: DataFrame) -> DataFrame:
    """doc_id, section, heading, n_chunks, has_table, has_image: chunks under the last heading before or in them.

    Chunks before the first heading stand under "Front Matter".
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    heading = F.when(F.col("text").rlike(r"\A#{1,6}\s+"), text.clean_heading(text.first_line(F.col("text"))))
    marked = chunks.withColumn("own", heading)
    placed = marked.withColumn("section", F.count("own").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("heading", F.coalesce(F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit("Front Matter")))
    return placed.groupBy("doc_id", "section", "heading").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(text.has_table(F.col("text"))).alias("has_table"), F.max(text.has_image(F.col("text"))).alias("has_image"))


def full_text(chunks: DataFrame, most: int = 120_000) -> DataFrame:
    """A document's chunks outside references and appendix, joined in order and cut at ``most`` characters."""
    most = min(max(most, 1_000), 500_000)
    kept = chunks.where(~text.is_references(F.lit(""), F.col("text")) & ~text.is_appendix(F.lit(""), F.col("text")))
    joined = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", text.strip(F.col("text")).alias("text")))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n")
    cut = F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most - 20), F.lit("\n...[truncated]"))).otherwise(whole)
    return joined.select("doc_id", cut.alias("full_text"), F.size("parts").alias("n_chunks"))


def neighbours(chunks: DataFrame, targets: DataFrame, window: int = 1) -> DataFrame:
    """target_id, chunk_id, relative_position: chunks of the same document within ``window`` (0 to 5) positions.

    Positions are numbered, so the range join is an equality join on document and position.
    """
    window = min(max(window, 0), 5)
    order = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")
    placed = chunks.select("doc_id", "chunk_id", F.row_number().over(order).alias("position"))
    wanted = placed.join(targets.select("chunk_id"), "chunk_id", "left_semi")
    wanted = wanted.select("doc_id", F.col("chunk_id").alias("target_id"), F.col("position").alias("at"), F.explode(F.sequence(F.col("position") - window, F.col("position") + window)).alias("position"))
    return wanted.join(placed, ["doc_id", "position"]).select("target_id", "chunk_id", (F.col("position") - F.col("at")).alias("relative_position"))


def read_chunk(chunks: DataFrame, wanted: str) -> DataFrame:
    """The chunk with this id, or else the first whose id contains it."""
    hit = chunks.where(F.col("chunk_id").contains(wanted)).withColumn("exact", F.col("chunk_id") == wanted)
    return hit.orderBy(F.desc("exact"), "chunk_id").limit(1).drop("exact")


def statistics(chunks: DataFrame) -> DataFrame:
    images = F.size(text.image_refs(F.col("text")))
    return chunks.agg(
        F.countDistinct("doc_id").alias("n_documents"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.coalesce(F.sum(images), F.lit(0)).alias("n_images"),
        F.floor(F.avg(F.length("text"))).alias("avg_chars"),
    )


def _holds(part: str) -> Callable[[Column], Column]:
    return lambda tag: F.lower(tag).contains(part)


def structural(chunks: DataFrame, has_table: bool | None = None, has_image: bool | None = None, exclude_references: bool = False, exclude_appendix: bool = False, title: str | None = None, doc_id: str | None = None, source_path: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Chunks by what they hold; conditions that are not given don't filter. ``doc_id`` is a part of the chunk's id or of
    its source_ref; path, title and tags match in part and in any case."""
    keep: Column = F.lit(True)
    if doc_id:
        keep = keep & (F.col("source_ref").contains(doc_id) | F.col("chunk_id").cast("string").contains(doc_id))
    if source_path:
        keep = keep & F.lower("source_path").contains(source_path.lower())
    for tag in tags:
        keep = keep & F.exists("tags", _holds(tag.lower()))
    body, heading = F.col("text"), F.coalesce("heading", F.lit(""))
    if has_table is not None:
        keep = keep & (text.has_table(body) == has_table)
    if has_image is not None:
        keep = keep & (text.has_image(body) == has_image)
    if exclude_references:
        keep = keep & ~text.is_references(heading, body)
    if exclude_appendix:
        keep = keep & ~text.is_appendix(heading, body, single_hash=False)
    if title:
        keep = keep & F.lower(heading).contains(title.lower())
    return chunks.where(keep)


def resolve(docs: DataFrame, asked: DataFrame, fields: Sequence[str] = ("doc_id", "source_ref", "source_path", "doc_hash")) -> DataFrame:
    """asked_id, doc_id, how for each of ``asked`` (asked_id): the document with that source_ref (exact), else the one of
    which a field contains it (partial); several are ambiguous and none is missing, both without a document."""
    from corvane.operators import evidence

    exact = asked.select("asked_id").distinct().join(docs.groupBy(F.col("source_ref").alias("asked_id")).agg(F.min("doc_id").alias("exact_id")), "asked_id", "left")
    named = docs.select("doc_id", F.explode(F.array_distinct(F.array(*[F.col(c).cast("string") for c in fields]))).alias("chunk_id")).where("chunk_id is not null")
    met = evidence.containing(exact.where("exact_id is null").select("asked_id"), named.select("chunk_id")).join(named, "chunk_id").groupBy("asked_id")
    met = met.agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("part_id"))
    out = exact.join(met, "asked_id", "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("n") == 1, "partial").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return out.select("asked_id", F.coalesce("exact_id", F.when(F.col("n") == 1, F.col("part_id"))).alias("doc_id"), how.alias("how"))


def counts(docs: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_images for each of ``docs`` (doc_id), none counting as 0, from its ``chunks`` and ``images`` (doc_id)."""
    per_doc = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    met = docs.select("doc_id").join(per_doc(chunks, "n_chunks"), "doc_id", "left").join(per_doc(images, "n_images"), "doc_id", "left")
    return met.na.fill(0, ["n_chunks", "n_images"])


def detail(ledger: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """A row for each ledger entry with the ids of its document's chunks (file_hash, chunk_index, chunk_id) and images
    (file_hash, image_id), in order."""
    of_chunks = chunks.groupBy("file_hash").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("s")).select("file_hash", F.col("s.chunk_id").alias("chunk_ids"))
    of_images = images.groupBy("file_hash").agg(F.array_sort(F.collect_set("image_id")).alias("image_ids"))
    none = F.array().cast("array<string>")
    met = ledger.join(of_chunks, "file_hash", "left").join(of_images, "file_hash", "left")
    return met.withColumns({c: F.coalesce(c, none) for c in ("chunk_ids", "image_ids")})


def stored_summary(chunks: DataFrame) -> DataFrame:
    """A document's first stored summary that isn't blank, else that of ``summary``; all its tags, types and chunks."""
    first = F.min_by("summary", F.when(text.strip(F.coalesce("summary", F.lit(""))) != "", F.col("chunk_index")))
    stored = chunks.groupBy("doc_id").agg(first.alias("stored"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.min("doc_type").alias("doc_type"))
    made = summary(chunks.drop("summary"))
    return made.join(stored, "doc_id").select("doc_id", F.coalesce("stored", "summary").alias("summary"), "tags", "doc_type", "chunk_count")
