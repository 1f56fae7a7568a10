"""Mixing sources to target weights, by hash-random order and distributed prefix sums.

Every document gets a random key from a hash. Within its source the documents are dealt into equal ranges
of that key, small enough to sort alone; sums over the ranges give each range its offset, sums within a
range the rest, and so every document knows how many words of its source come before it. A source is cut
at its exact budget: whole epochs first, then the documents up to the cut, of which the last is taken in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import ROW, WORD, packed, text_key, word_count
from corvane.session import staged

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the mix is to hold 3/2 of all words
SEED = "mix-1"
KEY_DIGITS = 5  # hexadecimal digits of the key that name its finest range
RANGE_ROWS = 5_000
SOURCE_RANGES = 64  # ranges of sources that are ranked apart
COPIES = 10_000  # copies of a row that one array lists


def random_key(*columns: Column, seed: str = SEED) -> Column:
    """A key that looks random and depends on the columns and the seed alone."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with each source's target.

    Sources in code point order, null last, take the weights in turn. Targets share SHARE of all words by
    weight; none passes 2 times its source's size, and what is over goes to the others by weight, again
    until no target is above. Each round is one aggregate over the sources and gives the driver three numbers.
    """
    # ranks in two steps, for sources may be hosts: within ranges of the order, and before each range
    dealt = sizes.select(F.col("source").isNull().alias("nul"), "source", "source_size")
    dealt = staged(dealt.repartitionByRange(SOURCE_RANGES, "nul", "source").withColumn("range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # SOURCE_RANGES rows at most
    ahead = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("nul", "source")) - 1 + F.col("ahead")
    weight = F.get(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(place, F.lit(len(weights))).cast("int"))
    ranked = staged(dealt.join(F.broadcast(ahead), "range").select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    num, den = SHARE
    rest, share = num * total, 0  # in 1/den words, so that all stays whole until the last division
    capped: Column = F.lit(False)
    n_capped = -1
    while True:
        got = ranked.agg(
            F.sum(F.when(capped, 2 * F.col("source_size")).otherwise(0)).alias("full"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("share"),
            F.count_if(capped).alias("n"),
        ).first()
        rest, share = num * total - den * (got["full"] or 0), got["share"] or 0
        if got["n"] == n_capped:
            break
        n_capped = got["n"]
        if share:
            over = F.lit(rest).cast("decimal(38,0)") * F.col("weight") > F.lit(2 * den * share).cast("decimal(38,0)") * F.col("source_size")
            capped = capped | over if n_capped else over
    own = F.lit(float(rest) / den) * F.col("weight") / F.lit(float(share or 1))
    return ranked.select("source", "source_size", F.when(capped, (2 * F.col("source_size")).cast("double")).otherwise(own).alias("target"))


def _times(df: DataFrame, n: str, name: str) -> DataFrame:
    """``df`` with each row ``n`` times, numbered from 0 in ``name``, in arrays of COPIES at most."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES)))
    low = F.col("__part") * COPIES
    return df.withColumn("__part", part).withColumn(name, F.explode(F.sequence(low, F.least(low + COPIES, F.col(n)) - 1))).drop("__part")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], *more: Column) -> DataFrame:
    """Rows of ``docs``, equal ones as one with ``copies``: doc_id, source, size, source_size, target, n_before (words of the
    source before them), budget (words that the mix takes of the source), epochs and the columns ``more``."""
    doc, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    names = ["doc_id", "source", "size", "key", "k1", "k2", *[f"more{i}" for i in range(len(more))]]
    slim = docs.select(doc.alias("doc_id"), source.alias("source"), word_count(text).alias("size"), random_key(doc).alias("key"), *text_key(text), *[c.alias(f"more{i}") for i, c in enumerate(more)])
    # rows with equal columns are one row with a count, so that no repeated key can pile up in a range
    slim = staged(slim.groupBy(*names).agg(F.count(F.lit(1)).alias("copies")), "sizes")
    n_rows = slim.count()
    digits = next(d for d in range(KEY_DIGITS + 1) if 16**d * RANGE_ROWS >= n_rows or d == KEY_DIGITS)
    # null-safe keys: joins and windows see no null
    ranged = slim.withColumns({"nul": F.col("source").isNull(), "src": F.coalesce("source", F.lit("")), "range": F.substring("key", 1, digits)})
    words = F.col("size") * F.col("copies")
    ranges = ranged.groupBy("nul", "src", "range").agg(F.sum(words).alias("words"))
    per_source = ranges.groupBy("nul", "src").agg(F.sum("words").alias("source_size"))
    aims = targets(per_source.select(F.when(~F.col("nul"), F.col("src")).alias("source"), "source_size"), weights)
    aims = aims.select(F.col("source").isNull().alias("nul"), F.coalesce("source", F.lit("")).alias("src"), "source_size", "target")
    before = F.coalesce(F.sum("words").over(Window.partitionBy("nul", "src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.withColumn("before", before).drop("words").join(aims, ["nul", "src"])
    within = Window.partitionBy("nul", "src", "range").orderBy("key", *[n for n in names if n not in ("key", "source")])
    ahead = F.coalesce(F.sum(words).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("ahead", ahead).join(offsets, ["nul", "src", "range"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return placed.select(*names, "copies", "source_size", "target", (F.col("before") + F.col("ahead")).alias("n_before"), budget.alias("budget"), epochs.alias("epochs"))


def _part(copy: Column) -> Column:
    """The words that the last, incomplete epoch takes of a copy of a row of ``_placed``."""
    start = F.col("n_before") + copy * F.col("size")
    return F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("budget") - F.col("epochs") * F.col("source_size") - start)).cast("long")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, epochs for every row of ``docs``.

    ``taken`` counts the words that the mix takes from a row over all epochs, never more than 2 times its
    size; by source they sum to the target rounded down. Null texts have no words and take none; a null
    source is a source of its own, the last. Rows with the same id are ordered by size and a hash of their text, equal
    rows told apart by number alone. An empty table gives an empty mix; texts may have any length. Reruns agree.
    """
    placed = _times(_placed(docs, id_col, text_col, source_col, weights), "copies", "copy")
    taken = F.col("epochs") * F.col("size") + _part(F.col("copy"))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "epochs")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The mix itself: ``docs`` with every row as often as it is taken, and the last copy at a source's cut
    shortened to the words that the budget has left. Rows of which nothing is taken go. Reruns agree.

    Rows alike in all columns travel as one.
    """
    doc, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    whole_row = F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    placed = _placed(docs, id_col, text_col, source_col, weights, whole_row)
    # of equal rows first whole ones are taken, then at most one in part
    left = F.greatest(F.lit(0).cast("long"), F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("n_before"))
    full = F.when(F.col("size") > 0, F.least(F.col("copies"), F.floor(left / F.col("size")))).otherwise(F.lit(0))
    takes = placed.withColumn("full", full.cast("long")).withColumn("rest", F.when(F.col("full") < F.col("copies"), _part(F.col("full"))).otherwise(F.lit(0)).cast("long"))
    takes = takes.withColumn("n", F.when(F.col("size") > 0, F.col("epochs") * F.col("copies") + F.col("full") + (F.col("rest") > 0).cast("long")).otherwise(F.lit(0)))
    names = lambda i, s, r: [F.xxhash64(i, s, "k1", "k2", r).alias("n1"), F.xxhash64(r, "k2", s, i, "k1").alias("n2")]
    takes = takes.where("n > 0").select(*names(F.col("doc_id"), F.col("source"), F.col("more0")), "n", "rest")
    rows = packed(docs, d_id=doc, d_source=source, d_row=whole_row, **dict(zip(("k1", "k2"), text_key(text), strict=True)))
    rows = rows.select(ROW, *names(F.col("d_id"), F.col("d_source"), F.col("d_row")))
    rows = rows.groupBy("n1", "n2").agg(F.first(ROW).alias(ROW))
    copies = _times(rows.join(takes, ["n1", "n2"]), "n", "copy")
    cut = (F.col("rest") > 0) & (F.col("copy") == F.col("n") - 1)
    body = F.col(f"{ROW}.`{text_col}`")
    pieces = F.regexp_extract_all(body, F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    cut_text = F.array_join(F.slice(pieces, F.lit(1), F.col("rest").cast("int")), "")
    columns = []
    for name in docs.columns:
        if name == text_col:
            columns.append(F.when(cut, cut_text).otherwise(body).alias(name))
        elif name == chars_col:
            columns.append(F.when(cut, F.length(cut_text)).otherwise(F.col(f"{ROW}.`{name}`")).cast(docs.schema[name].dataType).alias(name))
        else:
            columns.append(F.col(f"{ROW}.`{name}`").alias(name))
    return copies.select(*columns)


ORACLE = r"""
WITH RECURSIVE slim AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][1 + ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT]::BIGINT AS weight
  FROM slim GROUP BY source),
total AS (SELECT sum(source_size)::BIGINT AS words FROM sources),
rounds AS (
  SELECT 0 AS n, (3 * words)::DOUBLE AS rest, (SELECT sum(weight) FROM sources)::DOUBLE AS share, 0::BIGINT AS n_capped FROM total
  UNION ALL
  SELECT r.n + 1,
         (3 * t.words)::DOUBLE - 2 * coalesce(sum(CASE WHEN r.rest * s.weight > 4 * r.share * s.source_size THEN 2 * s.source_size END), 0),
         coalesce(sum(CASE WHEN r.rest * s.weight > 4 * r.share * s.source_size THEN 0 ELSE s.weight END), 0)::DOUBLE,
         count_if(r.rest * s.weight > 4 * r.share * s.source_size)
  FROM rounds r, sources s, total t
  WHERE r.n < 50 AND r.share > 0
  GROUP BY r.n, r.rest, r.share, r.n_capped, t.words
  HAVING count_if(r.rest * s.weight > 4 * r.share * s.source_size) > r.n_capped),
last_round AS (SELECT rest, share FROM rounds ORDER BY n DESC LIMIT 1),
aims AS (
  SELECT source, source_size,
         CASE WHEN share = 0 OR rest * weight > 4 * share * source_size THEN (2 * source_size)::DOUBLE
              ELSE rest / 2 * weight / share END AS target
  FROM sources, last_round),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, s.source,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM slim s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source),
epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS whole FROM placed)
SELECT doc_id, size, source_size, target,
       (whole * size + least(size, greatest(0, floor(target)::BIGINT - whole * source_size - ahead)))::BIGINT AS taken, source, whole AS epochs
FROM epochs
"""
