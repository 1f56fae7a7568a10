"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each a word of the perfect binary Golay code of length 23
(padded with zeros). A segment's keys are the indices of all codewords within distance 4: one or six of them.
Two segments that differ in at most 2 bits share a key, and one that differs in at most 1 bit has its nearest
codeword among the other's keys. If two fingerprints differ in at most 4 bits, then by the pigeonhole
either a segment agrees and another differs in at most 2 bits, or all three differ, two of them in exactly 1 bit and
the third in at most 2. The first kind meets on the segment and a key of the other (34 bits), the second on a key of each
segment (36 bits). Joins on these give candidates, and counting the differing bits verifies them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ROW, WORDS_BYTES, frames, packed, text_key
from corvane.llm.components import components
from corvane.session import staged

SHINGLE = 4
SEED = 42
MAX_DISTANCE = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and length
GOLAY_LENGTH, GOLAY_CHECK = 23, 11
GOLAY_POLYNOMIAL = 0b110001110101  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
RADIUS = 4

EXACT_FUZZY = list(permutations(range(3), 2))  # a segment that agrees, another within 2 bits
SPREAD = len(EXACT_FUZZY)  # the family of pairs that differ in all three segments
FAMILY_SHIFT = 40


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit integer; no words: zero."""
    words = WORDS_BYTES.findall((text or "").encode().lower())  # on bytes, lower() changes A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = np.array([digest(joined, SEED)], dtype="<u8")
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: len(words) - SHINGLE + 1].tolist()
        stops = (ends - 1)[SHINGLE - 1 :].tolist()
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), "<u8", len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


@cache
def _syndromes() -> np.ndarray:
    """The remainder of each single bit divided by the code's polynomial."""
    out, rest = [], 1
    for _ in range(GOLAY_LENGTH):
        out.append(rest)
        rest <<= 1
        if rest >> GOLAY_CHECK:
            rest ^= GOLAY_POLYNOMIAL
    return np.array(out, np.int64)


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = np.zeros_like(words)
    for bit, rest in enumerate(_syndromes()):
        out ^= np.where((words >> bit) & 1, rest, 0)
    return out


@cache
def _errors() -> np.ndarray:
    """By syndrome the error patterns of weight RADIUS or less, lightest first, filled up with -1."""
    found: list[list[int]] = [[] for _ in range(1 << GOLAY_CHECK)]
    for weight in range(RADIUS + 1):
        for bits in combinations(range(GOLAY_LENGTH), weight):
            pattern = sum(1 << b for b in bits)
            found[int(np.bitwise_xor.reduce(_syndromes()[list(bits)])) if bits else 0].append(pattern)
    out = np.full((len(found), max(map(len, found))), -1, np.int64)
    for syndrome, patterns in enumerate(found):
        out[syndrome, : len(patterns)] = patterns
    return out


def golay_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6): the indices of all codewords within RADIUS of each 23-bit word, nearest first, -1 for none."""
    errors = _errors()[_syndrome(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> GOLAY_CHECK)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each fingerprint its join keys. ``near`` has a bit for each segment of which the key is the nearest codeword's."""
    for batch in frames(batches):
        prints = batch["fp"].to_numpy(np.int64)
        segments = [(prints >> start) & ((1 << length) - 1) for start, length in SEGMENTS]
        fuzzy = [golay_keys(s) for s in segments]
        for family, (p, q) in enumerate(EXACT_FUZZY):
            row, col = np.nonzero(fuzzy[q] >= 0)
            key = (family << FAMILY_SHIFT) | (segments[p][row] << 12) | fuzzy[q][row, col]
            yield pd.DataFrame({"key": key, "fp": prints[row], "near": (col == 0).astype(np.int32)})
        there = (fuzzy[0][:, :, None, None] >= 0) & (fuzzy[1][:, None, :, None] >= 0) & (fuzzy[2][:, None, None, :] >= 0)
        row, *cols = np.nonzero(there)
        key = (SPREAD << FAMILY_SHIFT) | (fuzzy[0][row, cols[0]] << 24) | (fuzzy[1][row, cols[1]] << 12) | fuzzy[2][row, cols[2]]
        near = sum((col == 0).astype(np.int32) << k for k, col in enumerate(cols))
        yield pd.DataFrame({"key": key, "fp": prints[row], "near": near})


def _family(errors: list[Column]) -> tuple[Column, Column]:
    """The one family by which a pair is to be found, and the bits of ``near`` that its key has to have there: a segment
    that differs in one bit or none is found by its nearest codeword."""
    family, needed = F.lit(SPREAD), F.lit(0)
    for k, e in enumerate(errors):
        needed = needed + F.when(e <= 1, 1 << k).otherwise(0)
    for number, (p, q) in reversed(list(enumerate(EXACT_FUZZY))):
        hit = (errors[p] == 0) & (errors[q] <= 2)
        family, needed = F.when(hit, number).otherwise(family), F.when(hit, (errors[q] <= 1).cast("int")).otherwise(needed)
    return family, needed


def near_pairs(prints: DataFrame) -> DataFrame:
    """a, b (a < b): all pairs of different values of ``fp`` in ``prints`` (no repeats) that differ in MAX_DISTANCE bits or less."""
    keys = prints.select("fp").mapInPandas(_keys, "key long, fp long, near int")
    # of keys of all segments the asking side needs only those with two nearest codewords
    asks = (F.shiftright("key", FAMILY_SHIFT) < SPREAD) | (F.bit_count("near") >= 2)
    left = keys.where(asks).select("key", F.col("fp").alias("a"), "near")
    right = keys.select(F.col("key").alias("r_key"), F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    errors = [F.bit_count(differ.bitwiseAND(F.lit(((1 << n) - 1) << start if start + n < 64 else -(1 << start)).cast("long"))) for start, n in SEGMENTS]
    family, needed = _family(errors)
    # a pair shares keys in several families; only its first counts
    first = (F.shiftright("key", FAMILY_SHIFT) == family) & (F.col("near").bitwiseAND(needed) == needed)
    close = (F.col("a") < F.col("b")) & (F.bit_count(differ) <= MAX_DISTANCE)
    # each fingerprint has some 200 keys, which estimates of size don't know: no side is ever to be broadcast
    return left.hint("merge").join(right.hint("merge"), (F.col("key") == F.col("r_key")) & close & first).select("a", "b").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    printed = F.pandas_udf(_fingerprints, "long")(text)
    prints = staged(docs.select(F.col(f"`{id_col}`").alias("doc_id"), printed.alias("fp"), *text_key(text)), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    labels = components(near_pairs(nodes)).withColumnRenamed("node", "fp")
    labelled = nodes.join(labels, "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    lowest = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
    return prints.join(labelled.join(lowest, "label").select("fp", "label", "component_id"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. component_id is the
    smallest id that links lead to, its own included; null ids count only where a component has no other.
    Rows with equal fingerprints, repeated rows too, are one node, so copies make no pairs: links are between
    fingerprints. An empty table gives no rows. Texts of any length count whole.
    """
    return _grouped(docs, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, that with the smallest id, with all its columns.

    Where several rows have that id, one of them stays.
    """
    names = lambda i: [F.xxhash64(i, "k1", "k2").alias("n1"), F.xxhash64("k2", i, "k1").alias("n2")]
    grouped = _grouped(docs, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = grouped.groupBy("label").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("doc_id").alias("k_id")).select("k_id", "k.*").select(*names(F.col("k_id")))
    rows = packed(docs, d_id=F.col(f"`{id_col}`"), **dict(zip(("k1", "k2"), text_key(F.col(f"`{text_col}`")), strict=True))).select(ROW, *names(F.col("d_id")))
    # texts are dealt out once, by name, for the join and for the choice among equal rows
    kept = rows.join(keep, ["n1", "n2"], "left_semi").dropDuplicates(["n1", "n2"])
    return kept.select(*[F.col(f"{ROW}.`{c}`").alias(c) for c in docs.columns])
