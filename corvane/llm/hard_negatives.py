"""Hard negatives by zone maps over Hilbert-ordered blocks.

Vectors become integer codes. Candidates are sorted by label and by their place on a Hilbert curve through the components
that vary most, and written as Parquet blocks of BLOCK rows with one label each; beside a block stand the least and greatest code of
each dimension, its zone map. Interval arithmetic bounds the inner product of an anchor with all rows of a block from the zone map
alone. An anchor has windows: ranges of scores of which it needs the first few rows. It reads the blocks that its bounds can't rule
out, and no others:

1. Its own block gives a floor for the scores of its positives; same-label blocks whose upper bound reaches it are read.
2. With the positives the windows of the negatives are known. A few other-label blocks with the highest bounds, read along
   in the first pass, give these windows a floor. Other-label blocks whose bounds meet a window above its floor are read.

Anchors are sent to pages of zone maps, and to the shelves (blocks next to each other) that they chose, where they stream by
while the blocks are held; shelves with many anchors are dealt out to several tasks. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import frames, objects
from corvane.session import discard, staged

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
SHARE = (3, 9)  # of a positive's score, in tenths: where its negatives' scores may lie
BLOCK = 1024
SHELF = 16  # blocks
PAGE = 2048  # zone maps that are held at a time
PAGE_ANCHORS = 1 << 14  # anchors that one task compares with a page
SLICE = 512  # anchors that travel together
SHELF_SLICES = 64  # slices that one task compares with a shelf
KEY_DIMS, KEY_BITS = 15, 4  # of the Hilbert curve: 60 bits
LENGTHS = 16  # lengths of vectors, the most frequent, whose components are chosen by their spread; others take the first ones
SEED_BLOCKS, SEED_SCORES = 4, 64
LARGEST = float(1 << 59)  # below this the square sum of a row's codes has to be, so that scores fit into a long
MOST = 1 << 62
FIELDS = ("p", "lo", "lo_id", "hi", "k")
WINDOW = "struct<p:int,lo:bigint,lo_id:bigint,hi:bigint,k:int,other:boolean>"
HITS = "anchor long, anchor_id long, p int, other boolean, vec_id long, score long"


def codes_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of each component as int64, and which rows are small enough for exact scores."""
    scaled = np.floor(vectors * SCALE)
    with np.errstate(over="ignore"):
        small = (scaled * scaled).sum(1) < LARGEST
    return np.where(small[:, None], scaled, 0).astype(np.int64), small


def hilbert_keys(levels: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """The place of each row of ``levels`` (n, dims; below 2 ** bits) on the Hilbert curve, by Skilling's transform."""
    x = levels.T.astype(np.int64).copy()
    dims, top = len(x), 1 << (bits - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros(x.shape[1], np.int64), top
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0) if dims else 0
        bit >>= 1
    x ^= turn
    keys = np.zeros(x.shape[1], np.int64)
    for at in reversed(range(bits)):
        for i in range(dims):
            keys = (keys << 1) | ((x[i] >> at) & 1)
    return keys


def packed(codes: np.ndarray) -> bytes:
    """Codes as bytes, two for each where they fit and else four."""
    fits = not codes.size or int(np.abs(codes).max()) < 1 << 15
    return codes.astype("<i2" if fits else "<i4").tobytes()


def unpacked(raw: bytes, rows: int, dim: int) -> np.ndarray:
    kind = "<i2" if len(raw) == 2 * rows * dim else "<i4"
    return np.frombuffer(raw, kind).reshape(rows, dim).astype(np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, zones): the least and the greatest inner product that any row between ``low`` and ``high`` can have.

    Sums are exact below 2 ** 53; the slack covers rounding above it and is below one else.
    """
    up, down = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
    low, high = low.astype(float), high.astype(float)
    size = np.abs(anchors).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(size < 2.0**52, 0, size * 2.0**-44)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no sum can leave the exact range, else in integers."""
    most = lambda x: float(np.sqrt((x.astype(float) ** 2).sum(1).max(initial=0)))
    if most(anchors) * most(rows) < 2.0**52:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    return anchors @ rows.T


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in frames(batches):
        for dim, part in batch.groupby("dim"):
            if dim:
                codes, small = codes_of(np.stack(part["vector"].to_numpy()))
                x = codes[small].astype(float)
                yield pd.DataFrame({"dim": int(dim), "at": np.arange(int(dim)), "n": int(small.sum()), "s": x.sum(0), "ss": (x * x).sum(0)})


def _axes(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the LENGTHS most frequent lengths of vectors the KEY_DIMS components of the widest spread, their means and their deviations."""
    sums = rows.select("dim", "vector").mapInPandas(_spread, "dim int, at int, n long, s double, ss double").groupBy("dim", "at").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]).where("n > 0")
    spread = F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))
    each = sums.select("dim", "n", F.struct((-spread).alias("v"), F.col("at").alias("at"), (F.col("s") / F.col("n")).alias("mean")).alias("axis"))
    first = each.withColumn("turn", F.row_number().over(Window.partitionBy("dim").orderBy("axis"))).where(F.col("turn") <= KEY_DIMS)
    found = first.groupBy("dim").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("axis")).alias("axes")).orderBy(F.desc("n"), "dim").limit(LENGTHS)
    return {r["dim"]: (np.array([a["at"] for a in r["axes"]]), np.array([a["mean"] for a in r["axes"]]), np.sqrt([-a["v"] for a in r["axes"]])) for r in found.collect()}


def _coded(axes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames(batches):
            for dim, part in batch.groupby("dim"):
                codes, small = codes_of(np.stack(part["vector"].to_numpy()).reshape(len(part), int(dim)))
                part, codes = part[small], codes[small]
                at, mean, deviation = axes.get(int(dim), (np.arange(min(int(dim), KEY_DIMS)), 0.0, SCALE / max(1, dim) ** 0.5))
                levels = np.floor((codes[:, at] - mean) / np.maximum(deviation, 1e-9) * (1 << KEY_BITS) / 5 + (1 << KEY_BITS) / 2)
                key = hilbert_keys(np.clip(levels, 0, (1 << KEY_BITS) - 1))
                yield part[["vec_id", "label", "dim", "asks"]].assign(key=key, codes=objects([packed(x) for x in codes]).to_numpy())

    return run


def _blocks(size: int, shelf: int):
    """Rows in order, as blocks of one label and one length of vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, number, held = TaskContext.get().partitionId() << 32, 0, None

        def block(rows: pd.DataFrame) -> dict:
            nonlocal number
            label, dim = rows["label"].iloc[0], int(rows["dim"].iloc[0])
            codes = np.stack([unpacked(raw, 1, dim)[0] for raw in rows["codes"]])
            ids = rows["vec_id"].to_numpy(np.int64)
            out = {"shelf": first + number // shelf, "block": first + number, "label": label, "dim": dim, "n": len(rows), "min_id": ids.min(), "low": codes.min(0), "high": codes.max(0)}
            number += 1
            return out | {"ids": ids.tobytes(), "asks": rows["asks"].to_numpy(bool).tobytes(), "codes": packed(codes)}

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            out = []
            while len(held):
                same = ((held["label"] == held["label"].iloc[0]) & (held["dim"] == held["dim"].iloc[0])).to_numpy()
                n = min(size, len(held) if same.all() else int(np.argmin(same)))
                if n == len(held) and n < size:
                    break  # may go on in the next batch
                out.append(block(held.iloc[:n]))
                held = held.iloc[n:]
            if out:
                yield pd.DataFrame(out)
        if held is not None and len(held):
            yield pd.DataFrame([block(held)])

    return run


def _anchors(positives: int, size: int):
    """The anchors of each block, with the floor that their own block gives to their positives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames(batches, 64):
            for row in batch.itertuples():
                at = np.flatnonzero(np.frombuffer(row.asks, bool))
                if not len(at):
                    continue
                ids, codes = np.frombuffer(row.ids, np.int64), unpacked(row.codes, row.n, row.dim)
                found = scores(codes[at], codes)
                lo, lo_id = np.full(len(at), -MOST), np.full(len(at), np.iinfo(np.int64).max)
                for k, i in enumerate(at):
                    other = np.flatnonzero(ids != ids[i])
                    if len(other) >= positives:
                        best = other[np.lexsort((ids[other], -found[k, other]))[positives - 1]]
                        lo[k], lo_id[k] = found[k, best], ids[best]
                yield pd.DataFrame({"anchor": row.block * size + at, "anchor_id": ids[at], "label": row.label, "dim": row.dim, "codes": objects([packed(codes[i]) for i in at]), "lo": lo, "lo_id": lo_id})

    return run


def _windows(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """The windows of all anchors in turn: the place of their anchor, and their fields."""
    lists = [list(w) for w in rows["windows"]]
    flat = [w for own in lists for w in own]
    out = {c: np.array([w[c] for w in flat], np.int64) for c in FIELDS}
    return out | {"other": np.array([w["other"] for w in flat], bool), "at": np.repeat(np.arange(len(lists)), [len(w) for w in lists])}


def _chosen(n_pages: int):
    """For each shelf of a page and slice of anchors: the anchors, and for each block the windows that may have rows there.

    Rows come in order, zone maps before anchors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, zones = None, []
        for batch in frames(batches, SLICE):
            for (page, share), part in batch.groupby(["page", "share"], sort=False):
                if (page, share) != place:
                    place, zones = (page, share), []
                maps = part[~part["asks"]]
                zones += [maps] if len(maps) else []
                asking = part[part["asks"]]
                for dim, group in asking.groupby("dim"):
                    if zones:
                        yield from chosen(int(page), int(dim), group.reset_index(drop=True), pd.concat(zones))

    def chosen(page: int, dim: int, group: pd.DataFrame, zones: pd.DataFrame) -> Iterator[pd.DataFrame]:
        zones = zones[zones["dim"] == dim]
        if not len(zones):
            return
        codes = np.stack([unpacked(raw, 1, dim)[0] for raw in group["codes"]])
        least, most = bounds(codes, *(np.stack(zones[c].to_numpy()).reshape(len(zones), dim) for c in ("low", "high")))
        w, anchor = _windows(group), group["anchor"].to_numpy(np.int64)
        same = group["label"].to_numpy()[:, None] == zones["label"].to_numpy()[None, :]
        at, lo = w["at"], w["lo"][:, None]
        first_id = zones["min_id"].to_numpy(np.int64)[None, :]
        may = ((most[at] > lo) | ((most[at] == lo) & (first_id <= w["lo_id"][:, None]))) & (least[at] <= w["hi"][:, None])
        may &= same[at] != w["other"][:, None]
        for k in np.flatnonzero(w["p"] < 0):  # a seed: the highest bounds of one page
            top = np.flatnonzero(may[k]) if anchor[at[k]] % n_pages == page else np.zeros(0, np.int64)
            top = top[np.argsort(-most[at[k], top], kind="stable")[:SEED_BLOCKS]]
            may[k] = False
            may[k, top] = True
        shelves, blocks = zones["shelf"].to_numpy(np.int64), zones["block"].to_numpy(np.int64)
        out = []
        for shelf in np.unique(shelves[may.any(0)]):
            here = np.flatnonzero((shelves == shelf) & may.any(0))
            used = np.flatnonzero(may[:, here].any(1))
            asked = np.unique(at[used])
            row = {"shelf": shelf, "slice": int(anchor[0]), "dim": dim, "anchors": anchor[asked].tobytes(), "anchor_ids": group["anchor_id"].to_numpy(np.int64)[asked].tobytes(), "codes": packed(codes[asked])}
            row |= {c: w[c][used].tobytes() for c in (*FIELDS, "other")} | {"at": np.searchsorted(asked, at[used]).tobytes()}
            out.append(row | {"blocks": blocks[here], "picks": [np.flatnonzero(may[used, b]).astype(np.int32).tobytes() for b in here]})
        if out:
            yield pd.DataFrame(out)

    return run


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that windows find in the blocks they chose, at most k of each block. Rows come in order, blocks before slices of anchors."""
    place, held = None, {}
    for batch in frames(batches, 64):
        for row in batch.itertuples():
            if (row.shelf, row.share) != place:
                place, held = (row.shelf, row.share), {}
            if not row.asks:
                held[row.block] = np.frombuffer(row.ids, np.int64), unpacked(row.codes, row.n, row.dim)
                continue
            anchors, anchor_ids = (np.frombuffer(raw, np.int64) for raw in (row.anchors, row.anchor_ids))
            codes = unpacked(row.codes, len(anchors), row.dim)
            w = {c: np.frombuffer(getattr(row, c), np.int64) for c in (*FIELDS, "at")} | {"other": np.frombuffer(row.other, bool)}
            for block, raw in zip(row.blocks, row.picks, strict=True):
                ids, rows = held[block]
                pick = np.frombuffer(raw, np.int32)
                asked, which = np.unique(w["at"][pick], return_inverse=True)
                found = scores(codes[asked], rows)[which]
                inside = (found >= w["lo"][pick][:, None]) & (found <= w["hi"][pick][:, None]) & (ids[None, :] != anchor_ids[w["at"][pick]][:, None])
                i, j = np.nonzero(inside)
                order = np.lexsort((ids[j], -found[i, j], i))
                i, j = i[order], j[order]
                turn = np.arange(len(i)) - np.searchsorted(i, i)
                kept = turn < w["k"][pick][i]
                i, j = i[kept], j[kept]
                at = w["at"][pick][i]
                yield pd.DataFrame({"anchor": anchors[at], "anchor_id": anchor_ids[at], "p": w["p"][pick][i], "other": w["other"][pick][i], "vec_id": ids[j], "score": found[i, j]})


def _filled(rows: DataFrame, **kinds: str) -> DataFrame:
    """``rows`` with columns that say nothing there: zeros for numbers, which nulls would turn into floats, and else null."""
    return rows.withColumns({c: F.lit(0 if kind in ("long", "int") else None).cast(kind) for c, kind in kinds.items()})


class Blocks:
    """Candidates as Parquet blocks with zone maps, and the search of anchors' windows in them."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table
        self.n = table.count()
        self.pages = max(1, -(-self.n // PAGE))

    def choices(self, asking: DataFrame, n_anchors: int) -> DataFrame:
        """Slices of ``asking`` (anchor, anchor_id, label, dim, codes, windows) by shelf, with the blocks that their windows' bounds allow."""
        shares = max(1, -(-n_anchors // PAGE_ANCHORS))
        label = self.table.schema["label"].dataType
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        zones = self.table.select(F.pmod(F.xxhash64("shelf"), F.lit(self.pages)).cast("int").alias("page"), every(shares).alias("share"), F.lit(False).alias("asks"), "label", "dim", "shelf", "block", "min_id", "low", "high")
        zones = _filled(zones, anchor="long", anchor_id="long", codes="binary", windows=f"array<{WINDOW}>")
        sent = asking.select(every(self.pages).alias("page"), F.pmod(F.xxhash64("anchor"), F.lit(shares)).cast("int").alias("share"), F.lit(True).alias("asks"), F.col("label").cast(label).alias("label"), "dim", "anchor", "anchor_id", "codes", "windows")
        sent = _filled(sent, shelf="long", block="long", min_id="long", low="array<int>", high="array<int>")
        rows = zones.unionByName(sent).repartition("page", "share").sortWithinPartitions("page", "share", "asks", "anchor")
        binary = ", ".join(f"{c} binary" for c in ("anchors", "anchor_ids", "codes", *FIELDS, "other", "at"))
        return rows.mapInPandas(_chosen(self.pages), f"shelf long, slice long, dim int, {binary}, blocks array<long>, picks array<binary>")

    def search(self, asking: DataFrame, n_anchors: int) -> DataFrame:
        """anchor, anchor_id, p, other, vec_id, score: what the windows of ``asking`` find, from each block the first k."""
        choices = staged(self.choices(asking, n_anchors), "choices")
        shares = max(1, -(-n_anchors // (SLICE * SHELF_SLICES)))
        dealt = choices.withColumn("share", F.pmod(F.xxhash64("slice"), F.lit(shares)).cast("int"))
        wanted = dealt.select("share", F.explode("blocks").alias("block")).distinct()
        blocks = self.table.select("shelf", "block", "dim", "n", "ids", "codes").join(wanted, "block")
        texts = ("anchors", "anchor_ids", *FIELDS, "other", "at")
        rows = _filled(blocks.withColumn("asks", F.lit(False)), **dict.fromkeys(texts, "binary"), blocks="array<long>", picks="array<binary>")
        asked = _filled(dealt.drop("slice").withColumn("asks", F.lit(True)), block="long", n="int", ids="binary")
        rows = rows.unionByName(asked).repartition("shelf", "share").sortWithinPartitions("shelf", "share", "asks", "block")
        return rows.mapInPandas(_scored, HITS)


def blocks_of(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> Blocks:
    """The rows of ``vectors`` that take part as blocks; ``anchor`` says which of them ask."""
    raw = F.col(f"`{vector_col}`").cast("array<double>")
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), raw.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("dim", F.size("vector"))
    label = rows.schema["label"].dataType.simpleString()
    coded = rows.mapInPandas(_coded(_axes(rows)), f"vec_id long, label {label}, dim int, asks boolean, key long, codes binary")
    coded = staged(coded.dropDuplicates(), "codes")
    order = ("label", "dim", "key", "vec_id")
    schema = f"shelf long, block long, label {label}, dim int, n int, min_id long, low array<int>, high array<int>, ids binary, asks binary, codes binary"
    blocks = Blocks(staged(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_blocks(BLOCK, SHELF), schema), "blocks"))
    discard(coded)
    return blocks


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each row for which ``anchor`` holds, the positives are the first POSITIVES other rows of its label by their integer inner product with
    it, higher first, ties by smaller id; for each of them the first NEGATIVES rows of other labels come whose score is within SHARE
    of the positive's, all where there are fewer. A positive of negative score has none.

    Rows with a null id, a null label or a null vector, and those with null or non-finite components take no part, nor do those
    whose codes have a square sum of LARGEST or more, as their scores may not fit into a long. Rows repeated in id, label and
    vector are one row; rows that share their id alone are different rows, but none is another's positive or negative. Vectors are compared with
    those of their own length; empty ones score 0. An empty table gives no rows; other columns count for nothing.
    """
    blocks = blocks_of(vectors, anchor, id_col, vector_col, label_col)
    label = blocks.table.schema["label"].dataType.simpleString()
    anchors = staged(blocks.table.mapInPandas(_anchors(POSITIVES, BLOCK), f"anchor long, anchor_id long, label {label}, dim int, codes binary, lo long, lo_id long"), "anchors")
    n_anchors = anchors.count()
    window = lambda p, lo, lo_id, hi, k, other: F.struct(F.lit(p).cast("int").alias("p"), lo.cast("long").alias("lo"), lo_id.cast("long").alias("lo_id"), hi.cast("long").alias("hi"), F.lit(k).alias("k"), F.lit(other).alias("other"))
    largest = F.lit((1 << 63) - 1)
    asking = anchors.withColumn("windows", F.array(window(0, F.col("lo"), F.col("lo_id"), F.lit(MOST), POSITIVES, False), window(-1, F.lit(-MOST), largest, F.lit(MOST), SEED_SCORES, True)))
    hits = staged(blocks.search(asking, n_anchors), "positives")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    positives = hits.where("not other").withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= POSITIVES)
    # tenths of the score, rounded into the range
    exact = lambda n, up: F.expr(f"(score * {n} + {9 if up else 0} - pmod(score * {n} + {9 if up else 0}, 10)) div 10")
    positives = staged(positives.select("anchor", "turn", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), exact(SHARE[0], True).alias("lo"), exact(SHARE[1], False).alias("hi")), "positives")
    seeds = hits.where("other").groupBy("anchor").agg(F.sort_array(F.collect_list("score"), asc=False).alias("seeds"))
    open_windows = positives.where("lo <= hi").join(seeds, "anchor", "left")
    within = F.filter("seeds", lambda s: (s >= F.col("lo")) & (s <= F.col("hi")))
    floor = F.coalesce(F.try_element_at(within, F.lit(NEGATIVES)), F.col("lo"))
    windows = open_windows.groupBy("anchor").agg(F.collect_list(window(F.col("turn"), floor, largest, F.col("hi"), NEGATIVES, True)).alias("windows"))
    found = blocks.search(anchors.drop("lo", "lo_id").join(windows, "anchor"), n_anchors)
    first = Window.partitionBy("anchor", "p").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= NEGATIVES).withColumnRenamed("p", "turn")
    return ranked.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(positives, ["anchor", "turn"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS codes
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.codes, b.codes) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
