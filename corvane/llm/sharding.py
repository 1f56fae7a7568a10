"""Sharding by sampled splitters, under the law ``bytes``: the shards' sizes are near equal.

Records are ordered by a hash of the text, so that equal texts stand together. A sample drawn by size gives
quantile boundaries, which cut the order into ranges of about equal bytes. A range that came out too large
is divided again: by the hash's value, and a single text that alone overfills a range by a hash of the
record's id. Prefix sums over the ranges and within each give every record its place, and the shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import staged

N_SHARDS = 8
N_RANGES = 64  # ranges that the sampled splitters cut
SAMPLE = 20_000  # expected records in the sample
RANGE_ROWS = 50_000  # a range with more rows than this is divided
SNAP = 100  # a text's copies stay in one shard if they hold at most 1/SNAP of a shard's bytes
HASH_BITS = 60


def _hash60(column: F.Column) -> F.Column:
    """The first 60 bits of the MD5, as a long."""
    return F.conv(F.substring(F.md5(column), 1, HASH_BITS // 4), 16, 10).cast("long")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1, null counting as empty. Sizes of two shards differ by at most
    1/SNAP of a shard and two records. ``slot`` numbers a shard's rows without gaps from 0. ``grown_shard``
    is null: this law moves records when shards are added. Copies of a text stay in one shard unless they
    overfill it. Rows with equal id and text may trade places; null ids sort first. An empty table gives no rows;
    texts of any length are records.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        _hash60(text).alias("key"),
    )
    slim = slim.withColumn("tie", _hash60(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    slim = staged(slim, "records")
    n_rows, n_bytes = slim.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n_rows:
        n_bytes = 0
    # a record is drawn with a chance in proportion to its size; the draw is a hash of what it holds
    chance = F.least(F.lit(1.0), F.col("size") * F.lit(SAMPLE / max(1, n_bytes)))
    drawn = slim.where(F.pmod(F.xxhash64("key", "tie", "size"), F.lit(1 << 30)) < chance * float(1 << 30))
    cuts = [i / N_RANGES for i in range(1, N_RANGES)]
    splitters = sorted({int(x) for x in drawn.agg(F.percentile_approx("key", cuts, 10 * N_RANGES)).first()[0] or []})
    bounds = F.array(*[F.lit(x).cast("long") for x in splitters]) if splitters else F.array().cast("array<long>")
    ranged = slim.withColumn("range", F.aggregate(bounds, F.lit(0), lambda n, b: n + (F.col("key") >= b).cast("int")))
    lows, highs = [0, *splitters], [*splitters, 1 << HASH_BITS]
    low, width = (F.array(*[F.lit(x).cast("double") for x in xs]) for xs in (lows, [max(1, b - a) for a, b in zip(lows, highs, strict=True)]))
    parts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.ceil(F.col("n") / RANGE_ROWS).alias("parts"))
    ranged = ranged.join(F.broadcast(parts), "range")  # at most N_RANGES rows
    at = (F.col("key").cast("double") - F.get(low, "range")) / F.get(width, "range")
    ranged = ranged.withColumn("part", F.least(F.col("parts") - 1, F.floor(F.greatest(F.lit(0.0), at) * F.col("parts"))).cast("long"))
    # texts that overfill a part by themselves: each has more than RANGE_ROWS rows, so there are few beside the rows
    hot = ranged.groupBy("range", "part", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where(F.col("n") > RANGE_ROWS)
    entry = F.struct("key", F.ceil(F.col("n") / RANGE_ROWS).alias("spread"), "bytes")
    sides = hot.groupBy("range", "part").agg(F.sort_array(F.collect_list(entry)).alias("hots"))
    ranged = ranged.join(sides, ["range", "part"], "left")  # one row a part
    # (range, part, lane, sub) follows the order (key, tie): a hot text has a lane of its own between its neighbours'
    lane = F.aggregate(F.coalesce("hots", F.array().cast("array<struct<key:bigint,spread:bigint,bytes:bigint>>")), F.lit(0), lambda n, h: n + F.when(F.col("key") > h["key"], 2).when(F.col("key") == h["key"], 1).otherwise(0))
    own = F.get(F.filter("hots", lambda h: h["key"] == F.col("key")), 0)
    sub = F.coalesce(F.floor(F.col("tie") / F.lit(float(1 << HASH_BITS)) * own["spread"]), F.lit(0)).cast("long")
    cell = ["range", "part", "lane", "sub"]
    ranged = ranged.select("doc_id", "size", "text_crc32", "key", "tie", "range", "part", lane.alias("lane"), sub.alias("sub"), own["bytes"].alias("h_bytes"))
    sums = ranged.groupBy(*cell).agg(F.sum("size").alias("c_bytes"), F.count(F.lit(1)).alias("c_rows"))
    # sums before each cell: those of whole ranges, of which there are N_RANGES at most, and within a range
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole_ranges, in_range = Window.orderBy("range"), Window.partitionBy("range").orderBy("part", "lane", "sub")
    totals = sums.groupBy("range").agg(F.sum("c_bytes").alias("r_bytes"), F.sum("c_rows").alias("r_rows"))
    totals = totals.select("range", before(whole_ranges, "r_bytes").alias("rb0"), before(whole_ranges, "r_rows").alias("rr0"))
    offsets = sums.select(*cell, before(in_range, "c_bytes").alias("cb0"), before(in_range, "c_rows").alias("cr0")).join(F.broadcast(totals), "range")
    offsets = offsets.select(*cell, (F.col("rb0") + F.col("cb0")).alias("b0"), (F.col("rr0") + F.col("cr0")).alias("r0"))
    offsets = offsets.withColumn("lane_b0", F.min("b0").over(Window.partitionBy("range", "part", "lane")))
    inner = Window.partitionBy(*cell).orderBy("key", "tie", "doc_id", "size")
    run = inner.rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("b1", F.coalesce(F.sum("size").over(run), F.lit(0))).withColumn("r1", F.row_number().over(inner) - 1)
    whole = Window.partitionBy(*cell, "key")
    placed = placed.withColumn("g_bytes", F.sum("size").over(whole)).withColumn("g_start", F.min("b1").over(whole))
    placed = placed.join(offsets, cell)
    group_bytes, group_start = F.coalesce("h_bytes", "g_bytes"), F.when(F.col("h_bytes").isNull(), F.col("b0") + F.col("g_start")).otherwise(F.col("lane_b0"))
    start = F.when(group_bytes * F.lit(SNAP * n_shards) <= F.lit(n_bytes), group_start).otherwise(F.col("b0") + F.col("b1"))
    number = F.least(F.lit(n_shards - 1), F.floor(start.cast("decimal(38,0)") * n_shards / F.lit(max(1, n_bytes)))).cast("int")
    placed = staged(placed.select("doc_id", "size", "text_crc32", number.alias("shard"), (F.col("r0") + F.col("r1")).alias("at")), "placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _crc_table() -> list[int]:
    """The 256 remainders of CRC-32, by its rule."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


ORACLE = r"""
WITH steps AS (SELECT [{table}]::BIGINT[] AS t),
sums AS (
  SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
                               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents), steps),
slim AS (
  SELECT doc_id, crc AS text_crc32, (strlen(coalesce(d.text, '')) + 1)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(d.text, '')), 1, 15))::BIGINT AS key,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS tie
  FROM documents d JOIN sums ON coalesce(d.text, '') = sums.text),
placed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY key, tie, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b1,
         row_number() OVER (ORDER BY key, tie, doc_id, size) - 1 AS place, sum(size) OVER () AS n_bytes
  FROM slim),
grouped AS (SELECT *, sum(size) OVER (PARTITION BY key) AS g_bytes, min(b1) OVER (PARTITION BY key) AS g_start FROM placed),
dealt AS (
  SELECT *, least(7, (CASE WHEN g_bytes * 800 <= n_bytes THEN g_start ELSE b1 END) * 8 // n_bytes)::INTEGER AS shard FROM grouped)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (place - min(place) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM dealt
""".replace("{table}", ", ".join(map(str, _crc_table())))
