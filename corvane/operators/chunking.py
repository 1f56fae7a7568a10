"""Documents into chunks: by headings, and by size."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corvane.functions import ids, text

# Where a text is cut, in order.
SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_index, heading and text: documents split before their headings."""
    split = docs.select(*docs.columns, F.posexplode(text.heading_sections(F.coalesce("text", F.lit("")))).alias("section_index", "section"))
    return split.withColumn("heading", F.when(F.col("section").rlike(r"\A#{1,6}\s+"), text.first_line(F.col("section")))).drop("text").withColumnRenamed("section", "text")


def region_kept(parts: DataFrame, include_references: bool = False, include_appendix: bool = False) -> DataFrame:
    """Sections outside the regions of references and appendix.

    A region runs from the heading that opens it to the heading that opens the other. A lettered heading opens
    an appendix only once references or an appendix have been seen. The row's own document is folded by windows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("section_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("doc_id").orderBy("section_index").rowsBetween(Window.unboundedPreceding, -1)
    named = text.heading_text(text.first_line(F.col("text")))
    lowered = F.lower(named)
    out = parts.withColumn("is_ref", lowered.isin("references", "reference", "bibliography")).withColumn("is_app", (lowered == "appendix") | lowered.startswith("appendix "))
    opened = F.coalesce(F.max(F.col("is_ref") | F.col("is_app")).over(before), F.lit(False))
    out = out.withColumn("opens", F.when(F.col("is_ref"), "references").when(F.col("is_app") | (opened & named.rlike(r"^[A-Z]\s+.+")), "appendix"))
    out = out.withColumn("region", F.last("opens", ignorenulls=True).over(w))
    kept = F.col("region").isNull()
    if include_references:
        kept = kept | (F.col("region") == "references")
    if include_appendix:
        kept = kept | (F.col("region") == "appendix")
    return out.where(kept).drop("is_ref", "is_app", "opens", "region")


def with_chunk_ids(parts: DataFrame) -> DataFrame:
    """Chunks with their position in the document and both kinds of id."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("section_index")
    out = parts.withColumn("chunk_index", F.row_number().over(order) - 1)
    out = out.withColumn("draft_id", ids.draft_chunk_id(ids.doc_id(F.col("source_path")), F.col("chunk_index"), F.col("text")))
    return out.withColumn("chunk_id", ids.stored_chunk_id(F.col("source_path"), F.col("chunk_index"), F.col("text")))


def split_by_size(body: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator that helps, with at most ``overlap`` shared."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    units: list[str] = []
    todo = [(body, 0)]
    while todo:
        piece, level = todo.pop()
        if len(piece) <= size - overlap or not piece:
            units.append(piece)
        elif level == len(separators):
            step = size - overlap
            units += [piece[i : i + step] for i in range(0, len(piece), step)]
        else:
            parts = re.split(f"(?<={re.escape(separators[level])})", piece)
            todo += [(p, level + 1) for p in reversed(parts) if p]
    out: list[str] = []
    current = ""
    for unit in units:
        if current and len(current) + len(unit) > size:
            out.append(current)
            tail = current[-overlap:] if overlap else ""
            current = tail if len(tail) + len(unit) <= size else ""
        current += unit
    return [p for p in [*out, current] if p.strip()]


# What lines of figures, tables and headings look like.
IMAGE_LINE = re.compile(r"\[IMAGE:\s*[^\]]+\]\s*\Z")
PICTURE_START, PICTURE_END = "----- Start of picture text -----", "----- End of picture text -----"
FIGURE_CAPTION = re.compile(r"(?:Figure|Fig\.)\s*\d+[A-Za-z]?\s*[:.]", re.IGNORECASE)
TABLE_CAPTION = re.compile(r"Table\s*\d+[A-Za-z]?\s*[:.]", re.IGNORECASE)
HEADING = re.compile(r"#{1,6}\s+")
NUMBER = re.compile(r"(\d+(?:\.\d+)*)\b")
SHORT_HEADING = 120
LOOK_AHEAD = 4


def line_kind(line: str) -> str:
    """blank, image, heading, separator (of a table), row (of a table), figure or table (captions), or text."""
    s = line.strip()
    if not s:
        return "blank"
    if "|" in s and ("---" in s or not s.strip("|")):
        return "separator"
    for kind, pattern in (("image", IMAGE_LINE), ("heading", HEADING), ("figure", FIGURE_CAPTION), ("table", TABLE_CAPTION)):
        if pattern.match(s):
            return kind
    return "row" if s.count("|") >= 2 else "text"


def protected_blocks(body: str) -> list[tuple[str, str]]:
    """(kind, text) of a section in order; kind is normal, image or table.

    An image block is image lines, blank ones, text read from a picture, and a caption up to its blank line. A table
    starts with a row that a separator follows within LOOK_AHEAD lines, and takes a caption behind it along.
    """
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    kinds = [line_kind(line) for line in lines]
    pipes = [line.count("|") >= 2 for line in lines]

    def opens_table(at: int) -> bool:
        if at >= len(lines) or not pipes[at]:
            return False
        ahead = [k for k in range(at + 1, min(at + 1 + LOOK_AHEAD, len(lines))) if kinds[k] != "blank"]
        for k in ahead:
            if kinds[k] == "separator":
                return True
            if not pipes[k]:
                return False
        return False

    def caption_end(at: int, stops: set[str]) -> int:
        """Where a caption that starts at ``at`` is over: behind its blank line, or before what stops it."""
        at += 1
        while at < len(lines) and kinds[at] not in stops and not opens_table(at):
            at += 1
            if kinds[at - 1] == "blank":
                break
        return at

    def image_end(at: int) -> int:
        while at < len(lines):
            if PICTURE_START in lines[at]:
                at = next((k + 1 for k in range(at + 1, len(lines)) if PICTURE_END in lines[k]), len(lines))
            elif kinds[at] == "figure":
                return caption_end(at, {"heading"})
            elif kinds[at] in ("image", "blank"):
                at += 1
            else:
                break
        return at

    def table_end(at: int) -> int:
        while at < len(lines) and (pipes[at] or kinds[at] == "blank"):
            at += 1
        return caption_end(at, {"heading", "image"}) if at < len(lines) and kinds[at] == "table" else at

    out: list[tuple[str, str]] = []
    start = at = 0
    while at <= len(lines):
        end, kind = at, ""
        if at < len(lines) and kinds[at] == "image":
            end, kind = image_end(at), "image"
        elif opens_table(at):
            end, kind = table_end(at), "table"
        if kind or at == len(lines):
            if normal := "\n".join(lines[start:at]).strip():
                out.append(("normal", normal))
            if kind:
                out.append((kind, "\n".join(lines[at:end]).strip()))
            start = end
        at = max(at + 1, end)
    return out


def heading_number(line: str) -> str | None:
    """The section number of a heading, as 4.2 of ``## **4.2 Setup**``."""
    found = NUMBER.match(re.sub(r"[*_]", "", HEADING.sub("", line.strip(), count=1)).strip())
    return found[1] if found else None


class HeadingMerger:
    """Joins a short chunk of headings alone with the next: with text, or with a section below its own. Chunks go in one by one.

    A title of the whole document stays alone, and a chunk that has taken another along takes no more.
    """

    def __init__(self) -> None:
        self.waiting: str | None = None

    def take(self, chunk: str) -> list[str]:
        """The chunks that are done once ``chunk`` has come."""
        out: list[str] = []
        chunk = chunk.strip()
        if not chunk:
            return out
        first = chunk.split("\n", 1)[0]
        if self.waiting is not None:
            head = self.waiting.split("\n", 1)[0]
            above, below = heading_number(head), heading_number(first)
            waiting, self.waiting = self.waiting, None
            if not HEADING.match(first) or (above and below and below.startswith(above + ".")):
                return [f"{waiting}\n\n{chunk}"]
            out.append(waiting)
        headings = all(HEADING.match(line.strip()) for line in chunk.split("\n") if line.strip())
        if headings and len(chunk) <= SHORT_HEADING and not re.match(r"#\s", first):
            self.waiting = chunk
            return out
        return [*out, chunk]

    def end(self) -> list[str]:
        out, self.waiting = [self.waiting] if self.waiting is not None else [], None
        return out


def merged_headings(chunks: list[str]) -> list[str]:
    """Chunks as HeadingMerger joins them."""
    merger = HeadingMerger()
    return [done for chunk in chunks for done in merger.take(chunk)] + merger.end()


def pieces_of(section: str, size: int, overlap: int) -> list[str]:
    """The chunks of one section before headings are merged."""
    out: list[str] = []
    for kind, block in protected_blocks(section):
        out += split_by_size(block, size, overlap) if kind == "normal" else [block] if len(block) <= size else split_by_size(block, size, 0)
    cleaned = (re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", re.sub(r"^[\s.,;:!?，。；：！？]+", "", c.strip()))) for c in out)
    return [c for c in cleaned if c]


def section_pieces(sections: list[str], size: int = 1500, overlap: int = 200) -> list[str]:
    """The chunks of a document's sections: no chunk reaches over a heading, and figures and tables stay whole where they fit."""
    return merged_headings([piece for section in sections for piece in pieces_of(section, size, overlap)])


class SplitSections:
    """A table function over sections (doc_id, section_index, text), partitioned by document and ordered: their chunks one after the other.

    It holds one section and one waiting chunk, never a whole document.
    """

    def __init__(self) -> None:
        self.merger, self.doc, self.n = HeadingMerger(), None, 0

    def _out(self, done: list[str]) -> Iterator[tuple]:
        for chunk in done:
            yield self.doc, self.n, chunk
            self.n += 1

    def eval(self, row: Row, size: int, overlap: int) -> Iterator[tuple]:
        self.doc = row["doc_id"]
        for piece in pieces_of(row["text"], size, overlap):
            yield from self._out(self.merger.take(piece))

    def terminate(self) -> Iterator[tuple]:
        yield from self._out(self.merger.end())


def split_function(id_type: str = "bigint"):
    """The table function that splits sections, for ``spark.udtf.register`` or for calls on a table; ``id_type`` is that of doc_id."""
    return F.udtf(SplitSections, returnType=f"doc_id {id_type}, chunk_index int, text string")


def split_by_function(docs: DataFrame, size: int = 1500, overlap: int = 200, include_references: bool = False, include_appendix: bool = False) -> DataFrame:
    """The rows of ``split_documents`` by the table function: sections stream by in order, and none are gathered."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    kept = region_kept(sections(docs.select("doc_id", "text")), include_references, include_appendix).select("doc_id", "section_index", "text")
    table = kept.asTable().partitionBy("doc_id").orderBy("section_index")
    return split_function(docs.schema["doc_id"].dataType.simpleString())(table, F.lit(size), F.lit(overlap))


def split_documents(docs: DataFrame, size: int = 1500, overlap: int = 200, include_references: bool = False, include_appendix: bool = False) -> DataFrame:
    """doc_id, chunk_index, text: documents by headings, without regions that are left out, then by blocks and size.

    Sections are gathered for each document, which is what a chunk may not exceed anyway. A document without chunks has
    no rows.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    kept = region_kept(sections(docs.select("doc_id", "text")), include_references, include_appendix)
    gathered = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_index", "text"))).alias("s")).select("doc_id", F.col("s.text").alias("sections"))

    def run(found: pd.Series) -> pd.Series:
        return pd.Series([section_pieces(list(s), size, overlap) for s in found], dtype=object)

    return gathered.select("doc_id", F.posexplode(F.pandas_udf(run, "array<string>")("sections")).alias("chunk_index", "text"))


def chunk_records(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks (doc_id, chunk_index, text) as they are stored: with their document's metadata but for its images, of which they
    have those that they refer to, in the order of the references, and the page of the first."""
    met = chunks.join(docs.drop("text"), "doc_id").withColumn("image_refs", text.image_refs(F.col("text")))
    of = lambda ref: F.get(F.filter("images", lambda i: i["id"] == ref), 0)
    own = F.filter(F.transform(F.array_distinct("image_refs"), of), lambda i: i.isNotNull())
    met = met.withColumn("own", own).drop("images").withColumnRenamed("own", "images")
    return met.withColumn("page_num", F.get("images", 0)["page"]).withColumn("source_ref", F.col("doc_id").cast("string"))


_BLOCK = re.compile(r"(?:^[^\n]*\|[^\n]*\|[^\n]*(?:\n|\Z))+|(?:^\[IMAGE:[^\n]*(?:\n|\Z))+", re.MULTILINE)


def chunk_text(body: str, size: int = 1500, overlap: int = 200) -> list[str]:
    """A document's chunks; tables and images stay whole, and longer ones are cut without overlap."""
    out: list[str] = []
    at = 0
    for block in [*_BLOCK.finditer(body), None]:
        normal = body[at : block.start() if block else len(body)]
        out += split_by_size(normal, size, overlap) if normal.strip() else []
        if block:
            out += [block[0]] if len(block[0]) <= size else split_by_size(block[0], size, 0)
            at = block.end()
    cleaned = (re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", re.sub(r"^[\s.,;:!?，。；：！？]+", "", c.strip()))) for c in out)
    return [c for c in cleaned if c]


def recursive_chunks(docs: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """doc_id, chunk_index, text: documents cut by size."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([chunk_text(t or "", size, overlap) for t in texts], dtype=object)

    split = F.pandas_udf(run, "array<string>")
    return docs.select("doc_id", F.posexplode(split("text")).alias("chunk_index", "text"))


def heading_links(parts: DataFrame) -> DataFrame:
    """Sections (doc_id, section_index, text) with a heading, the next one's number, and whether that is a section below."""
    from pyspark.sql import Window

    number = F.nullif(F.regexp_extract(F.regexp_replace(F.regexp_replace(text.first_line(F.col("text")), r"^#{1,6}\s+", ""), "[*_]", ""), r"^\s*(\d+(?:\.\d+)*)\b", 1), F.lit(""))
    met = parts.withColumn("number", number).withColumn("next_number", F.lead("number").over(Window.partitionBy("doc_id").orderBy("section_index")))
    below = F.coalesce(F.startswith("next_number", F.concat("number", F.lit("."))), F.lit(False))
    return met.where(F.col("number").isNotNull()).select("doc_id", "section_index", "number", "next_number", below.alias("is_parent"))
