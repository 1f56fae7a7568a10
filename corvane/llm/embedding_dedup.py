"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on many random directions. A direction's list holds the vectors that have it among their
``top`` largest projections, sorted by projection: where projections are large a list is thin. Each list is cut
into ranges of BLOCK places. Around every vector lies a window of its projection plus and minus ``half_window``; two
vectors collide in a list if either lies in the other's window, and collisions are counted over all lists that both
are in. ``settings`` calibrates how many lists a vector enters and which count makes a pair a candidate, so that
pairs at exactly the threshold are found with a chance of RECALL. Candidates are verified by their cosine.

Lists hold numbers of vectors and projections alone. The vectors themselves travel to the verification only, once for
each pair of groups of near vectors in which there is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import frames, objects
from corvane.llm.components import components
from corvane.session import staged

THRESHOLD = 0.9
RECALL = 0.98  # of pairs at exactly the threshold
LEAST = 3  # collisions that a candidate needs at least: fewer say little
TOPS = (8, 12, 16, 24, 32, 48, 64)  # lists that a vector may enter, tried in turn
WINDOW = 2.0  # half width of the window, in standard deviations of the difference at the threshold
CELLS = 8  # ranges of equal width in half a window, by which lists are cut
SEED = 20240101
BLOCK = 1024  # places of a list that are compared with each other at a time
HOME_BYTES = 1 << 20  # vectors that are verified against each other at a time
PART_ROWS = 50_000  # candidates between two homes that are verified in one place
MOST_LISTS = 1 << 17
PAIRS = 1024  # simulated pairs for calibration
PLACE = ["home_a", "home_b", "part"]
CHUNK = 1 << 12  # directions that are made at a time


def n_lists(n: int) -> int:
    """The number of lists for n vectors: a power of 2, about 4 times the root of n."""
    return int(min(MOST_LISTS, 1 << max(7, int(np.ceil(np.log2(4 * max(n, 1) ** 0.5))))))


@lru_cache(maxsize=4)
def _directions(dim: int, chunk: int) -> np.ndarray:
    """CHUNK directions; no more than four chunks are held, however many lists there are."""
    return np.random.default_rng([SEED, dim, chunk]).standard_normal((dim, CHUNK)).astype(np.float32)


def half_window(threshold: float) -> float:
    return WINDOW * float(np.sqrt(2 - 2 * threshold))


def top_lists(unit: np.ndarray, lists: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, top) numbers of each vector's lists, largest projection first, and the projections."""
    rows, small = np.arange(len(unit))[:, None], unit.astype(np.float32)
    numbers, values = np.zeros((len(unit), 0), np.int32), np.zeros((len(unit), 0), np.float32)
    for chunk in range(-(-lists // CHUNK)):
        width = min(CHUNK, lists - chunk * CHUNK)
        shown = small @ _directions(unit.shape[1], chunk)[:, :width]
        part = np.argpartition(-shown, top - 1, axis=1)[:, :top] if width > top else np.broadcast_to(np.arange(width), shown.shape)
        numbers, values = np.hstack([numbers, (part + chunk * CHUNK).astype(np.int32)]), np.hstack([values, shown[rows, part]])
        order = np.argsort(-values, axis=1, kind="stable")[:, :top]
        numbers, values = numbers[rows, order], values[rows, order]
    return numbers, values


def simulated_counts(dim: int, lists: int, threshold: float, tops: tuple[int, ...] = TOPS, pairs: int = PAIRS, seed: int = SEED + 1) -> list[np.ndarray]:
    """For each of ``tops`` the collisions of random pairs whose cosine is exactly ``threshold``.

    Gaussian directions treat all rotations alike, so random pairs at this cosine stand for any such pairs.
    """
    rng = np.random.default_rng([seed, dim, lists])
    x = rng.standard_normal((pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, dim))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    (one, a), (two, b) = (top_lists(v, lists, max(tops)) for v in (x, threshold * x + np.sqrt(1 - threshold**2) * y))
    met = (one[:, :, None] == two[:, None, :]) & (np.abs(a[:, :, None] - b[:, None, :]) <= half_window(threshold))
    return [met[:, :top, :top].sum((1, 2)) for top in tops]


@cache
def settings(dim: int, lists: int, threshold: float) -> tuple[int, int]:
    """(top, least): the lists that a vector enters, and the collisions that make a candidate.

    The fewest lists are taken at which pairs at the threshold collide LEAST times with chance RECALL, and then the
    largest count that still keeps it. If no number in TOPS is enough, that is an error.
    """
    for top, counts in zip(TOPS, simulated_counts(dim, lists, threshold, TOPS), strict=True):
        if (counts >= LEAST).mean() >= RECALL:
            return top, next(least for least in range(top, 0, -1) if (counts >= least).mean() >= RECALL)
    raise ValueError(f"no number of lists finds {RECALL:.0%} of the pairs at cosine {threshold} in {dim} dimensions and {lists} lists")


def _entries(lists: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames(batches):
            for dim, group in batch.groupby("dim"):
                tops, shown = top_lists(np.stack(group["unit"].to_numpy()), lists, settings(int(dim), lists, threshold)[0])
                yield pd.DataFrame({"dim": dim, "node": group["node"].to_numpy(), "tops": objects(list(tops)), "shown": objects(list(shown))})

    return run


def _collisions(lists: int, threshold: float):
    """Pairs of a range of a list and another, or the same, that collide here first and in enough lists."""
    width = half_window(threshold)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        dim, number = int(group["dim"].iloc[0]), int(group["list"].iloc[0])
        least, same = settings(dim, lists, threshold)[1], bool(group["one"].iloc[0] == group["two"].iloc[0])
        q = group if same else group[group["block"] == group["one"]]
        r = group if same else group[group["block"] == group["two"]]
        none = pd.DataFrame({"a": [], "b": [], "home_a": [], "home_b": []}, dtype="int64")
        if not len(q) or not len(r):
            return none
        r_tops, r_shown = np.stack(r["tops"].to_numpy()), np.stack(r["shown"].to_numpy()).astype(np.float64)
        r_here, q_here = r["p"].to_numpy(np.float64), q["p"].to_numpy(np.float64)
        # all other lists of the range one behind the other, each sorted by projection
        other = (r_tops != number).ravel()
        where = np.repeat(np.arange(len(r)), r_tops.shape[1])[other]
        place = r_tops.ravel()[other] * 1e4 + r_shown.ravel()[other]
        order = np.argsort(place, kind="stable")
        place, where = place[order], where[order]
        found = []
        for at in range(0, len(q), 64):
            part = q.iloc[at : at + 64]
            tops, shown = np.stack(part["tops"].to_numpy()), np.stack(part["shown"].to_numpy()).astype(np.float64)
            asks = (tops != number).ravel()
            row = np.repeat(np.arange(len(part)), tops.shape[1])[asks]
            centre, lst = tops.ravel()[asks] * 1e4 + shown.ravel()[asks], tops.ravel()[asks]
            low, high = np.searchsorted(place, centre - width, "left"), np.searchsorted(place, centre + width, "right")
            n = high - low
            total = int(n.sum())
            hits = where[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)] if total else np.zeros(0, np.int64)
            i, earlier = np.repeat(row, n), np.repeat(lst, n) < number
            code = i * len(r) + hits
            here = np.abs(q_here[at + i] - r_here[hits]) <= width
            if same:
                here &= hits > at + i
            code, counts = np.unique(code[here & ~np.isin(code, code[earlier])], return_counts=True)
            code = code[counts + 1 >= least]
            found.append(np.stack([at + code // len(r), code % len(r)]))
        i, j = np.hstack(found) if found else np.zeros((2, 0), np.int64)
        a, b = q["node"].to_numpy()[i], r["node"].to_numpy()[j]
        home_a, home_b = q["home"].to_numpy()[i], r["home"].to_numpy()[j]
        swap = (home_a > home_b) | ((home_a == home_b) & (a > b))
        pick = lambda x, y: np.where(swap, y, x)
        return pd.DataFrame({"a": pick(a, b), "b": pick(b, a), "home_a": pick(home_a, home_b), "home_b": pick(home_b, home_a)})

    return run


def _verified(threshold: float):
    """Of rows in order of PLACE, vectors before candidates, the candidates whose cosine is high enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in frames(batches, 8192):
            if not len(batch):
                continue
            vectors, asked = batch[batch["b"].isna()], batch[batch["b"].notna()]
            held = vectors if held is None else pd.concat([held, vectors])
            if len(asked):
                at = {key: i for i, key in enumerate(zip(*(held[c] for c in PLACE), held["a"], strict=True))}
                units = held["unit"].to_numpy()
                ends = [[at[key] for key in zip(*(asked[c] for c in PLACE), asked[end].astype("int64"), strict=True)] for end in ("a", "b")]
                cosine = np.empty(len(asked))
                by_dim = np.array([len(units[i]) for i in ends[0]])
                for dim in np.unique(by_dim):
                    of = np.flatnonzero(by_dim == dim)
                    one, two = (np.stack([units[e[k]] for k in of]) for e in ends)
                    cosine[of] = np.einsum("ij,ij->i", one, two)
                near = asked[cosine >= threshold]
                a, b = near["a"].to_numpy(np.int64), near["b"].to_numpy(np.int64)
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
            last = batch.iloc[-1]
            held = held[np.logical_and.reduce([held[c] == last[c] for c in PLACE])]

    return run


def _place(before: str, n: str, node: str, size: int) -> Column:
    """The range of ``size`` places in which a row of a cell stands; rows of a cell spread evenly over its places."""
    return F.floor((F.col(before) + F.pmod(F.xxhash64(node, F.lit(3)), F.col(n))) / size)


def _before(cells: DataFrame, by: list[str], order: str) -> DataFrame:
    """``cells`` with the rows of the cells before each."""
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def links(units: DataFrame, n: int, threshold: float = THRESHOLD) -> DataFrame:
    """a, b (a < b): linked nodes of ``units`` (node long, dim int, unit array<double>), of n rows.

    A list, however many vectors it holds, is compared range by range, and only with ranges that windows reach; a
    task holds two ranges. If so many vectors are alike that a range's window covers many others, their pairs are links
    that have to be found one by one: that work grows with the square of such a group, and with nothing else.
    """
    lists = n_lists(n)
    entries = units.mapInPandas(_entries(lists, threshold), "dim int, node long, tops array<int>, shown array<float>")
    entries = staged(entries, "entries")
    # homes: groups of vectors with the same strongest list, or lists near it, of about HOME_BYTES
    home_rows = F.greatest(F.lit(64), F.floor(F.lit(HOME_BYTES) / (8 * F.col("dim"))))
    first = _before(entries.groupBy("dim", F.col("tops")[0].alias("list")).agg(F.count(F.lit(1)).alias("n")), ["dim"], "list")
    slot = F.floor((F.col("before") + F.pmod(F.xxhash64("node", F.lit(3)), F.col("n"))) / home_rows)
    homes = entries.withColumn("list", F.col("tops")[0]).join(first, ["dim", "list"]).select("dim", "node", "tops", "shown", F.shiftleft(F.col("dim").cast("long"), 40).bitwiseOR(slot).alias("home"))
    places = homes.select("*", F.explode(F.arrays_zip("tops", "shown")).alias("e"))
    cell = F.floor(F.col("e.shown") / (half_window(threshold) / CELLS)).cast("int")
    places = places.select("dim", "node", "tops", "shown", "home", F.col("e.tops").alias("list"), F.col("e.shown").alias("p"), cell.alias("cell"))
    cells = _before(places.groupBy("dim", "list", "cell").agg(F.count(F.lit(1)).alias("n")), ["dim", "list"], "cell")
    cells = staged(cells, "cells")
    reach = F.explode(F.sequence(F.floor(F.col("before") / BLOCK), F.floor((F.col("before") + F.col("n") - 1) / BLOCK)))
    blocks = cells.select("dim", "list", "cell", reach.alias("block")).groupBy("dim", "list", "block").agg(F.min("cell").alias("low"), F.max("cell").alias("high"))
    one, two = (blocks.select("dim", "list", *[F.col(c).alias(f"{c}{k}") for c in ("block", "low", "high")]) for k in (1, 2))
    near = (F.col("block1") <= F.col("block2")) & (F.col("low2") - F.col("high1") <= CELLS + 1)
    meets = one.join(two, ["dim", "list"]).where(near).select("dim", "list", F.col("block1").alias("one"), F.col("block2").alias("two"))
    meets = meets.withColumn("block", F.explode(F.array_distinct(F.array("one", "two"))))
    dealt = places.join(cells, ["dim", "list", "cell"]).withColumn("block", _place("before", "n", "node", BLOCK)).drop("before", "n", "cell")
    dealt = dealt.join(meets, ["dim", "list", "block"])
    candidates = dealt.groupBy("dim", "list", "one", "two").applyInPandas(_collisions(lists, threshold), "a long, b long, home_a long, home_b long")
    candidates = staged(candidates, "candidates")
    # two homes with very many candidates, as a large group of near vectors makes, are verified in several places
    parts = candidates.groupBy("home_a", "home_b").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts"))
    candidates = candidates.join(parts, ["home_a", "home_b"]).withColumn("part", F.pmod(F.xxhash64("a", F.lit(5)), "parts"))
    ends = [candidates.select(*PLACE, F.col(end).alias("node")) for end in ("a", "b")]
    needed = ends[0].union(ends[1]).distinct().join(units.select("node", "unit"), "node")
    rows = needed.select(*PLACE, F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "unit")
    rows = rows.union(candidates.select(*PLACE, "a", "b", F.lit(None).cast("array<double>")))
    rows = rows.repartition(*PLACE).sortWithinPartitions(*PLACE, F.col("b").asc_nulls_first())
    return rows.mapInPandas(_verified(threshold), "a long, b long")


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Null, empty and zero vectors and those with null or non-finite components link with nothing: no links, their
    own component, kept. Vectors of different lengths never link. Equal vectors, told by 128 bits of a hash, are one node
    whose copies are linked with each other, so copies make no pairs; repeated rows are copies too, and share a
    component. Null ids count for a component only where it has no other. An empty table gives no rows; vectors may
    have any length.
    """
    raw = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), raw.alias("raw"))
    finite = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    top = F.array_max(F.transform("raw", F.abs))
    scaled = F.transform("raw", lambda x: x / top)  # so that no square over- or underflows
    usable = F.coalesce((F.size("raw") > 0) & finite & (top > 0), F.lit(False))
    sized = rows.withColumn("scaled", F.when(usable, scaled))
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("scaled", lambda x: x / norm)
    name = lambda seed: F.when(F.col("scaled").isNotNull(), F.xxhash64("raw", F.lit(seed)))
    sized = staged(sized.select("vec_id", name(1).alias("k1"), name(2).alias("k2"), unit.alias("unit")), "vectors")
    groups = sized.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"))
    groups = staged(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers hold once written
    pairs = staged(links(groups.select("node", F.size("unit").alias("dim"), "unit"), groups.count(), threshold), "links")
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    weights = groups.select(F.col("node").alias("other"), "copies")
    degrees = ends.join(weights, "other").groupBy("node").agg(F.sum("copies").alias("others"))
    labels = components(pairs)
    known = groups.select("node", "k1", "k2", "low", "copies").join(degrees, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = known.groupBy("label").agg(F.min("low").alias("component_id"))
    known = known.join(lowest, "label").select("k1", "k2", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sized.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
