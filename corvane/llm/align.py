"""Alignment of two tokenizers' tokens by whitespace-token anchors.

Each text is encoded whole by both tokenizers. Where tokens of both end at the same byte, and both next tokens begin with
a space, lies an anchor; anchors split a document into windows of token ids, mostly a word each. A window's alignment
follows from its ids alone, so a task works it out once for each pair of id tuples and looks it up from then on: the groups
between shared ends, and the links, pairs of tokens whose bytes overlap.

How often each pair of ids is linked over the whole corpus is summed up in Spark. The most frequent pairs, a bounded table,
travel to all tasks, where each document looks its own up; all other pairs are joined. The bound decides only which
way a pair takes.
"""

from __future__ import annotations

import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm.bpe import byte_pieces, vocabulary_path
from corvane.session import staged

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BATCH_ROWS = 128
KNOWN = 1 << 18  # windows that a task remembers,
KNOWN_BYTES = 64 << 20  # and bytes of their ids and groups; then it forgets them
HOT_PAIRS = 1 << 20  # pairs of ids at most that travel to all tasks, 17 bytes each
SUMMED_ROWS = 4_096  # documents whose pairs are summed up in a task before they are dealt out
LONG_WORD = 500  # characters; the first tokenizer's library has a way for long words that the faster encoder hasn't
LONG_SPACE = re.compile(rf"\s{{{LONG_WORD}}}")
LINKS = "pairs array<long>, times array<int>"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class ByteBpe:
    """Encodes as the library of the JSON vocabulary does, names of special tokens being plain text. Where the ids follow the order
    of the merges, as in vocabularies of this kind, texts without long words go through a faster encoder of the same merges."""

    def __init__(self, path: str) -> None:
        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are parallel already
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        self.pieces = byte_pieces(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["id"] for t in model["added_tokens"]}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
        in_order = all(model["model"]["vocab"].get(m.replace(" ", "")) == 256 + i for i, m in enumerate(merges))
        ranks = {piece: i for i, piece in enumerate(self.pieces) if i not in special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_order and len(ranks) == 256 + len(merges) else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            if self.fast is not None and len(max(text.split(), key=len, default="")) < LONG_WORD and not LONG_SPACE.search(text):
                out.append(self.fast.encode_ordinary(text))
            else:
                out.append(self.library.encode(text, add_special_tokens=False).ids)
        return out


class PieceBpe:
    """Encodes as the library of a sentencepiece model does."""

    def __init__(self, path: str) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n, piece = self.library.get_piece_size(), self.library.id_to_piece
        self.pieces = [bytes([int(piece(i)[3:-1], 16)]) if self.library.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(n)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@cache
def _tokenizers(path_a: str, path_b: str) -> tuple[ByteBpe, PieceBpe]:
    return ByteBpe(path_a), PieceBpe(path_b)


class Windows:
    """The alignments of the windows that a task has met, by the bytes of their ids."""

    def __init__(self, a: ByteBpe, b: PieceBpe) -> None:
        self.a, self.b, self.n_b = a, b, len(b.pieces)
        self.sizes = [np.array([len(p) for p in t.pieces], np.int64) for t in (a, b)]
        self.spaced = [np.array([p[:1] == b" " for p in t.pieces], bool) for t in (a, b)]
        # by number * 4 + what follows: the number and a comma, a bar, a semicolon or nothing
        self.shown = [f"{i}{after}" for i in range(max(len(a.pieces), len(b.pieces))) for after in (",", "|", ";", "")]
        self.id_type = np.uint16 if max(len(a.pieces), len(b.pieces)) < 0xFFFF else np.uint32
        self.mark = np.iinfo(self.id_type).max  # stands between the ids of both
        self.forget()

    def forget(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__  # a new window takes the next number
        self.groups: list[str] = []
        self.n_groups, self.starts, self.links = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def of(self, keys: list[bytes]) -> np.ndarray:
        if len(self.numbers) > KNOWN or self.held > KNOWN_BYTES:
            self.forget()
        codes = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))
        if fresh := list(islice(self.numbers, len(self.groups), None)):
            shown, n_groups, n_links, links = self.align(fresh)
            self.groups += shown
            self.held += sum(map(len, fresh)) + sum(map(len, shown))
            self.n_groups = np.concatenate([self.n_groups, n_groups])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n_links)])
            self.links = np.concatenate([self.links, links])
        return codes

    def align(self, keys: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of windows by their ids: the groups as text, the numbers of groups and of links, and all links in turn."""
        ids = np.frombuffer(b"".join(keys), self.id_type).astype(np.int64)
        length = np.array([len(k) for k in keys], np.int64) // np.dtype(self.id_type).itemsize
        middle, last = np.flatnonzero(ids == self.mark), np.cumsum(length)
        side = np.repeat(np.tile([0, 2, 1], len(keys)), np.stack([middle - (last - length), np.ones_like(middle), last - middle - 1], 1).ravel())
        flat = [ids[side == k] for k in (0, 1)]
        # a window has as many bytes of both, so bytes can be counted over all windows
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, flat, strict=True)]
        marks = np.zeros(int(ends[0][-1]) + 1, np.uint8)
        marks[ends[0]] = 1
        marks[ends[1]] += 2
        close = [marks[e] == 3 for e in ends]
        stop = [np.flatnonzero(c) for c in close]  # the last token of each group
        # between two ends, whosever they are, one token of each lies: a link
        cuts = np.flatnonzero(marks)
        at_a, at_b = (np.cumsum(marks[cuts] & bit > 0) - (marks[cuts] & bit > 0) for bit in (1, 2))
        links = flat[0][at_a] * self.n_b + flat[1][at_b]
        n_a = np.cumsum(middle - (last - length))  # tokens of the first up to each window's end
        byte = ends[0][n_a - 1]
        n_groups = np.diff(np.searchsorted(stop[0], n_a), prepend=0)
        n_links = np.diff(np.searchsorted(cuts, byte, "right"), prepend=0)
        # the tokens of each group of the first, then those of the second
        group = [np.cumsum(c) - c for c in close]
        turn = [np.arange(len(flat[0])) + np.concatenate([[0], stop[1] + 1])[group[0]], np.arange(len(flat[1])) + (stop[0] + 1)[group[1]]]
        window_end = np.zeros(len(flat[1]), bool)
        window_end[np.cumsum(last - middle - 1) - 1] = True
        code = np.zeros(len(flat[0]) + len(flat[1]), np.int64)
        code[turn[0]] = flat[0] * 4 + close[0]
        code[turn[1]] = flat[1] * 4 + np.where(window_end, 3, 2 * close[1])
        words, ends_of = [self.shown[c] for c in code.tolist()], (last - np.arange(1, len(keys) + 1)).tolist()
        return ["".join(words[i:j]) for i, j in zip([0, *ends_of[:-1]], ends_of, strict=True)], n_groups, n_links, links

    def cut(self, ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Windows per document, and the number of each window in turn, of documents whose tokens' bytes are the same."""
        lengths = [np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b)]
        flat = [np.concatenate([np.array(x, np.int64) for x in ids]) for ids in (ids_a, ids_b)]
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, flat, strict=True)]
        marks = np.zeros(int(ends[0][-1]) + 1, np.uint8)
        marks[ends[0]] = 1
        marks[ends[1]] += 2
        shared = [np.flatnonzero(marks[e] == 3) for e in ends]  # the k-th of both is the same byte
        last = np.zeros(len(flat[0]), bool)
        last[np.cumsum(lengths[0]) - 1] = True
        spaced = [s[np.append(x, 0)[at + 1]] for s, x, at in zip(self.spaced, flat, shared, strict=True)]
        anchor = last[shared[0]] | (spaced[0] & spaced[1])
        stop_a, stop_b = (at[anchor] + 1 for at in shared)
        start_a, start_b = (np.concatenate([[0], stop[:-1]]) for stop in (stop_a, stop_b))
        number = np.arange(len(stop_a))
        # the ids of each window of both tokenizers behind one another, MARK between them
        row = np.full(len(flat[0]) + len(flat[1]) + len(number), self.mark, self.id_type)
        row[np.repeat(start_b + number, stop_a - start_a) + np.arange(len(flat[0]))] = flat[0]
        row[np.repeat(stop_a + number + 1, stop_b - start_b) + np.arange(len(flat[1]))] = flat[1]
        width = row.itemsize
        raw, at = row.tobytes(), ((start_a + start_b + number) * width).tolist()
        keys = [raw[i:j] for i, j in zip(at, [*at[1:], len(raw)], strict=True)]
        per_document = np.diff(np.searchsorted(stop_a, np.concatenate([[0], np.cumsum(lengths[0])]), "right"))
        return per_document, self.of(keys)

    def aligned(self, texts: list[str | None]) -> dict[str, list]:
        """For each text n_a, n_b, n_groups, n_links, its groups, and its linked pairs with the times each is linked."""
        out: dict[str, list] = {c: [0] * len(texts) for c in COUNTS}
        out |= {"groups": [""] * len(texts), "pairs": [np.zeros(0, np.int64)] * len(texts), "times": [np.zeros(0, np.int64)] * len(texts)}
        asked = [i for i, text in enumerate(texts) if text]
        ids_a, ids_b = self.a.encode([" " + texts[i] for i in asked]), self.b.encode([texts[i] for i in asked])
        for k, i in enumerate(asked):
            raw = (" " + texts[i]).encode()
            if any(b"".join(map(t.pieces.__getitem__, ids[k])) != raw for t, ids in ((self.a, ids_a), (self.b, ids_b))):
                asked[k] = -1
        good = [k for k, i in enumerate(asked) if i >= 0]
        if not good:
            return out
        counts, codes = self.cut([ids_a[k] for k in good], [ids_b[k] for k in good])
        ends, listed = np.cumsum(counts), codes.tolist()
        sizes = self.starts[codes + 1] - self.starts[codes]
        before = np.cumsum(sizes) - sizes
        links = self.links[np.repeat(self.starts[codes] - before, sizes) + np.arange(int(sizes.sum()))]
        stride = len(self.a.pieces) * self.n_b
        pairs, times = np.unique(np.repeat(np.repeat(np.arange(len(good)), counts), sizes) * stride + links, return_counts=True)
        cuts = np.searchsorted(pairs, np.arange(len(good) + 1) * stride)
        groups = self.n_groups[codes]
        for n, k in enumerate(good):
            i, stop = asked[k], int(ends[n])
            start = stop - int(counts[n])
            out["n_a"][i], out["n_b"][i] = len(ids_a[k]), len(ids_b[k])
            out["n_groups"][i], out["n_links"][i] = int(groups[start:stop].sum()), int(sizes[start:stop].sum())
            out["groups"][i] = ";".join([self.groups[c] for c in listed[start:stop]])
            out["pairs"][i], out["times"][i] = pairs[cuts[n] : cuts[n + 1]] - n * stride, times[cuts[n] : cuts[n + 1]]
        return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _list(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), kind))


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*_tokenizers(path_a, path_b))
        for part in _slices(batches, BATCH_ROWS):
            found = windows.aligned(part.column("text").to_pylist())
            columns = [part.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in COUNTS), pa.array(found["groups"], pa.string())]
            columns += [_list(found["pairs"], pa.int64()), _list(found["times"], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "groups", "pairs", "times"])

    return run


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each document and pair of it in turn: the document's place in the batch, the pair, and its times."""
    pairs = part.column("pairs")
    place = np.repeat(np.arange(part.num_rows), _numbers(pairs.value_lengths()))
    return place, _numbers(pairs.flatten()), _numbers(part.column("times").flatten())


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches, SUMMED_ROWS):
        _, pairs, times = _flat(part)
        distinct, which = np.unique(pairs, return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, which, times)
        yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(sums)], ["pair", "n"])


def _known(hot: dict[str, np.ndarray], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in the table of frequent pairs each pair would be, and whether it is."""
    at = np.minimum(np.searchsorted(hot["pair"], pairs), max(0, len(hot["pair"]) - 1))
    return at, hot["pair"][at] == pairs if len(hot["pair"]) else np.zeros(len(pairs), bool)


def _hot_sums(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = broadcast.value
        for part in _slices(batches, SUMMED_ROWS):
            place, pairs, times = _flat(part)
            at, known = _known(hot, pairs)
            place, at, times = place[known], at[known], times[known]
            sums, best = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            np.add.at(sums, place, times * hot["n"][at])
            np.add.at(best, place, times * hot["best"][at])
            kept = [c for c in part.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(sums), pa.array(best)], [*kept, "hot_sum", "hot_best"])

    return run


def _cold_pairs(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, SUMMED_ROWS):
            place, pairs, times = _flat(part)
            rest = ~_known(broadcast.value, pairs)[1]
            rows = _numbers(part.column("row"))[place[rest]]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(pairs[rest]), pa.array(times[rest])], ["row", "pair", "times"])

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times: one row per row of ``docs``.

    ``groups`` lists the ids of both tokenizers between bytes where tokens of both end (``a1,a2|b1;a3|b2,b3``), ``pairs`` the linked
    pairs of ids, each a times the second vocabulary's size plus b, and ``times`` how often each is linked in the document. Null and
    empty texts, and those whose tokens' bytes differ from a space and the text, have no tokens: zeros and empty values. Rows
    alike are aligned alike, null ids stay, an empty table gives no rows, and other columns count for nothing. Texts may have any length
    and are encoded whole; a task holds BATCH_ROWS of them.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {counts}, groups string, {LINKS}"
    return rows.mapInArrow(_aligned(path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)), schema)


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """pair, n, best of ``links`` (pairs, times): the times that each pair is linked over all rows, and whether that is the most of its
    second id, ties included. The table of the second vocabulary's ids bounds what is broadcast."""
    counts = staged(links.mapInArrow(_summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair_sums")
    second = F.pmod("pair", F.lit(n_b))
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    found = counts.withColumn("second", second).join(F.broadcast(most), "second")
    return staged(found.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair_counts")


def hot_pairs(counts: DataFrame) -> dict[str, np.ndarray]:
    """The most frequent pairs by pair, HOT_PAIRS at most: grades of counts (a sixteenth of a power of 2) from the top, while all of a grade fits."""
    grade = F.floor(F.log2("n") * 16).cast("int")
    least, held = 10_000, 0
    for step, n in sorted(counts.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if held + n > HOT_PAIRS:
            break
        least, held = step, held + n
    hot = counts.where(grade >= least).toArrow()
    order = np.argsort(hot["pair"].to_numpy())
    return {c: hot[c].to_numpy()[order].astype(kind) for c, kind in (("pair", np.int64), ("n", np.int64), ("best", np.int8))}


def alignment_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``, as ``align`` has them.

    ``count_sum`` adds up over a document's links how often their pair of ids is linked in all documents; ``n_best`` counts the links
    whose pair is linked as often as any of its second id.
    """
    path_b = path_b or vocabulary_path(VOCABULARY_B)
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    found = align(docs, id_col, text_col, path_a, path_b)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    links = staged(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", *COUNTS, digest.alias("groups_sha256"), "pairs", "times"), "links")
    counts = pair_counts(links.select("pairs", "times"), n_b)
    broadcast = docs.sparkSession.sparkContext.broadcast(hot_pairs(counts))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.schema if f.name not in ("pairs", "times"))
    hot = links.mapInArrow(_hot_sums(broadcast), f"{kept}, hot_sum long, hot_best long")
    cold = links.select("row", "pairs", "times").mapInArrow(_cold_pairs(broadcast), "row long, pair long, times long").join(counts, "pair")
    cold = cold.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("cold_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("cold_best"))
    added = lambda what: (F.col(f"hot_{what}") + F.coalesce(f"cold_{what}", F.lit(0))).cast("long")
    return hot.join(cold, "row", "left").select("doc_id", *COUNTS, added("best").alias("n_best"), added("sum").alias("count_sum"), "groups_sha256")
