"""Byte-level BPE by tables of distinct words.

Texts are split into words (the pre-tokens of the vocabulary's pattern), and each distinct word is encoded once. The
words that are frequent in a bounded sample of documents make one table, bounded too, which travels to all tasks; a
text becomes a string of its words' numbers there, with holes for all other words. The words in the holes are
dealt out by word, so that all places of a word meet: it is encoded once, and its ids go back by a join of
places with their text. The sample decides only which way a word takes, not its ids.

Decoding is a join of ids with the table of pieces, which has a row for each id of the vocabulary, a proven bound for a
broadcast. The ids of the frequent words are joined once for each word, all others where they stand; ``decode`` joins
those of any table of ids.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm.common import frames, objects, text_key
from corvane.session import staged

VOCABULARY = "byte_bpe_50k.json"
SAMPLE_ROWS = 40_000  # documents, by a hash, whose words are counted to find the frequent ones
HOT_WORDS = 1 << 19  # so many words at most travel to all tasks,
HOT_BYTES = 4_096  # none longer than this,
HOT_TOTAL = 32 << 20  # and no more bytes of them
LONG_LANES = 64  # longer words are dealt out to so many tasks, each of which encodes them once
SHORT = 1 << 15  # taken off ids that travel, so that those of a vocabulary of twice as many fit into 16 bits
FIRST = 1 << 30  # marks the first id of a word in a hole
BATCH_ROWS = 512
ENCODE_ROWS = 4_096
KNOWN = 1 << 18  # stretches of text between spaces that a task remembers,
KNOWN_CHARS = 1 << 24  # and their characters
LOW = 0xFFFFFFFF

# The pattern of the vocabulary's words, and the same for texts whose letters are all in LETTERS.
SPACE = r"\p{White_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{SPACE}+(?!\P{{White_Space}})|{SPACE}+"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
FAST = rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
#: Other characters may be letters, digits or spaces, and take the full pattern.
PLAIN = re.compile(rf"[\n\t\r\x20-\x7E¡-©«-±´¶-¸»¿×÷{LETTERS}–—‘’“”•…€]*")

#: A word always starts at a space between two characters that are none (\s is more than White_Space).
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")

_full, _fast = regex.compile(PATTERN), re.compile(FAST)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are parallel already
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def _specials(path: str) -> tuple[tuple[str, ...], re.Pattern | None]:
    """Tokens that stand in a text as they are and are never split, and what finds them."""
    with open(path, encoding="utf-8") as file:
        names = tuple(sorted((t["content"] for t in json.load(file)["added_tokens"]), key=len, reverse=True))
    return names, re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def split_words(text: str | None, path: str) -> list[str]:
    """The words of a text in order; joined they are the text again. Null has none. Special tokens are words."""
    if not text:
        return []
    find = (_fast if PLAIN.fullmatch(text) else _full).findall
    names, special = _specials(path)
    if not any(name in text for name in names):
        return find(text)
    return [w for i, part in enumerate(special.split(text)) for w in ([part] if i % 2 else find(part))]


def _counted(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames(batches, 4 * BATCH_ROWS):
            counts: Counter[str] = Counter()
            for text in batch["text"]:
                counts.update(split_words(text, path))
            yield pd.DataFrame({"word": objects(list(counts)), "n": np.array(list(counts.values()), np.int64)})

    return run


def _word_hash(words: list[str]) -> np.ndarray:
    """(n, 2): a 128-bit hash of each word."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w.encode()) for w in words]), "<i8").reshape(-1, 2)


def _ids(words: list[str], path: str) -> list[list[int]]:
    out: list[list[int]] = []
    for at in range(0, len(words), ENCODE_ROWS):
        out += [e.ids for e in _tokenizer(path).encode_batch_fast(words[at : at + ENCODE_ROWS], add_special_tokens=False)]
    return out


def _encoded(path: str):
    """Words that are distinct already, with their ids and hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = batch["word"].tolist()
            hashes = _word_hash(words)
            yield pd.DataFrame({"h1": hashes[:, 0], "h2": hashes[:, 1], "n": batch["n"].to_numpy(), "ids": objects(_ids(words, path))})

    return run


def _encoded_places(path: str, kind: pa.DataType):
    """Places in order of their word: each word is encoded where it first comes. Ids come less SHORT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, list[int]] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            word = batch.column("word").dictionary_encode()
            words = _strings(word.dictionary)
            known = last is not None and words[0] == last[0]
            ids = ([last[1]] if known else []) + _ids(words[1:] if known else words, path)
            last = words[-1], ids[-1]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1]) - SHORT
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat).cast(kind))
            yield pa.RecordBatch.from_arrays([batch.column("n1"), batch.column("tag"), lists.take(word.indices)], ["n1", "tag", "ids"])

    return run


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _grade(n: Column) -> Column:
    """Counts in steps of a sixteenth of a power of 2: below 1,024 grades for any count."""
    return F.floor(F.log2(n) * 16).cast("int")


def hot_words(texts: DataFrame, path: str) -> dict[str, np.ndarray]:
    """The frequent words of the column text as arrays: hashes in order, ranks, and by rank the ids and the decoded bytes.
    At most HOT_WORDS words and HOT_TOTAL bytes.

    Grades of counts are taken from the top as long as all of a grade fits; only then are words encoded, and
    their ids joined with the pieces.
    """
    counted = texts.select("text").mapInPandas(_counted(path), "word string, n long").where(F.octet_length("word") <= HOT_BYTES)
    short = staged(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    grades = short.groupBy(_grade(F.col("n")).alias("grade")).agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word")).alias("bytes"))
    least, words, held = 10_000, 0, 0
    for grade, n, size in sorted(grades.collect(), reverse=True):
        if words + n > HOT_WORDS or held + size > HOT_TOTAL:
            break
        least, words, held = grade, words + n, held + size
    hot = short.where(_grade(F.col("n")) >= least).mapInPandas(_encoded(path), "h1 long, h2 long, n long, ids array<int>")
    hot = joined_pieces(hot, "ids", ["h1", "h2", "n"], path).toArrow()
    h1, h2, n = (hot[c].to_numpy() for c in ("h1", "h2", "n"))
    by_rank = np.lexsort((h2, h1, -n))  # rank 0 is the hole
    rank = np.empty(len(n), np.int32)
    rank[by_rank] = np.arange(1, len(n) + 1, dtype=np.int32)
    order = np.lexsort((h2, h1))
    starts, ids = _by_rank(*_lists(hot["ids"].combine_chunks()), by_rank)
    byte_starts, raw = _by_rank(*_binaries(hot["decoded"].combine_chunks()), by_rank)
    return {"h1": h1[order], "h2": h2[order], "rank": rank[order], "starts": starts, "ids": ids.astype(np.int32), "byte_starts": byte_starts, "bytes": raw}


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _binaries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of binaries, null counting as empty, and all their bytes in turn."""
    column = column.cast(pa.binary())
    column = column.fill_null(b"") if column.null_count else column
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    _, ends, raw = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.diff(ends), np.frombuffer(raw or b"", np.uint8)[ends[0] : ends[-1]]


def _by_rank(lengths: np.ndarray, items: np.ndarray, by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the items of each rank begin (rank 0 has none; one more for the end), and the items in order of rank."""
    starts = np.cumsum(lengths) - lengths
    sizes = np.concatenate([[0], lengths[by_rank]]).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), items[_spread(starts[by_rank], lengths[by_rank])]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... up to lengths[i] of them, for all i in turn."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


class WordRanks:
    """The stretches between spaces that a task has met, each split, hashed and looked up once with the space before it. They are
    forgotten when they are more than KNOWN or have more than KNOWN_CHARS characters."""

    def __init__(self, path: str, hot: dict[str, np.ndarray]) -> None:
        self.path, self.hot = path, hot
        self.undivided = any(" " in name for name in _specials(path)[0])  # a special token could reach over a space
        self.forget()

    def forget(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__  # a new stretch takes the next number
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)  # by number: its words in ``words``
        self.words: list[str] = []
        self.ranks = np.zeros(0, np.int32)  # of each in ``words``; 0 for words that aren't hot
        self.chars = 0

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words per text, and in turn each word's number in ``words`` and its rank."""
        if len(self.numbers) > KNOWN or self.chars > KNOWN_CHARS:
            self.forget()
        counts, stretches = self._stretches(texts)
        sizes = self.sizes[stretches]
        code = _spread(self.starts[stretches], sizes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return np.diff(ends), code, self.ranks[code]

    def _stretches(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Stretches per text, and in turn their numbers. A text with white space at the edge of one is divided by BOUNDARY."""
        parts = pc.split_pattern(texts, " ")
        counts = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        distinct, codes = coded.dictionary, coded.indices.to_numpy()
        trimmed = pc.binary_length(pc.utf8_trim_whitespace(distinct)).to_numpy()
        odd = (trimmed == 0) | (trimmed < pc.binary_length(distinct).to_numpy())
        number, ends = self.numbers.__getitem__, np.cumsum(counts)
        firsts = ends - counts
        by_hand = np.add.reduceat(odd[codes], firsts, dtype=np.int64) > 0 if len(counts) else np.zeros(0, bool)
        if self.undivided:
            by_hand[:] = True
        used = np.zeros(len(distinct), bool)
        used[codes[~np.repeat(by_hand, counts)]] = True
        numbers = np.zeros(len(distinct), np.int64)
        numbers[used] = list(map(number, _strings(pc.binary_join_element_wise("", distinct.filter(pa.array(used)), " "))))
        self._learn(joined=True)
        out = numbers[codes]
        even = np.flatnonzero(~by_hand)
        out[firsts[even]] = list(map(number, _strings(coded.take(pa.array(firsts[even])).cast(pa.string()))))
        self._learn(joined=False)
        if not by_hand.any():
            return counts, out
        found = np.split(out, ends[:-1])
        for i in np.flatnonzero(by_hand).tolist():
            text = texts[i].as_py()
            first, *others = [text] if self.undivided else BOUNDARY.split(text)
            found[i] = np.array([number(first), *(number(f" {x}") for x in others)], np.int64)
        self._learn(joined=False)
        return np.array(list(map(len, found)), np.int64), np.concatenate(found)

    def _learn(self, joined: bool) -> None:
        """The words of new stretches, and their ranks. With ``joined`` all start at a space and end before one, and are split as one text."""
        fresh = list(islice(self.numbers, len(self.sizes), None))
        if not fresh:
            return
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        if not joined:
            groups = [np.array([k]) for k in range(len(fresh))]
        else:
            plain = np.ones(len(fresh), bool)
            if not PLAIN.fullmatch("".join(fresh)):
                plain = np.array([PLAIN.fullmatch(x) is not None for x in fresh])
            groups = [np.flatnonzero(plain), np.flatnonzero(~plain)]
        sizes = np.zeros(len(fresh), np.int64)
        words: list[str] = []
        for group in groups:
            found = split_words("".join(fresh if len(group) == len(fresh) else [fresh[k] for k in group]), self.path)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            sizes[group] = np.diff(np.searchsorted(ends, np.cumsum(lengths[group]), side="right"), prepend=0)
            words += found
        order = np.concatenate(groups)
        starts = np.zeros(len(fresh), np.int64)
        starts[order] = len(self.words) + np.cumsum(sizes[order]) - sizes[order]
        ranks = np.zeros(len(words), np.int32)
        if words and len(self.hot["h1"]):
            hashes = _word_hash(words)
            at = np.minimum(np.searchsorted(self.hot["h1"], hashes[:, 0]), len(self.hot["h1"]) - 1)
            known = (self.hot["h1"][at] == hashes[:, 0]) & (self.hot["h2"][at] == hashes[:, 1])
            ranks = np.where(known, self.hot["rank"][at], 0)
        self.starts, self.sizes, self.ranks = (np.concatenate(x) for x in ((self.starts, starts), (self.sizes, sizes), (self.ranks, ranks)))
        self.words += words
        self.chars += int(lengths.sum())


def _holes(path: str, broadcast):
    """Every word that isn't hot, with 96 bits of its text's name (n1, low half of tag) and its place (high half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordRanks(path, broadcast.value)
        for part in _slices(batches):
            counts, code, ranks = known.of(part.column("text"))
            hole = np.flatnonzero(ranks == 0)
            row = np.repeat(np.arange(len(counts)), counts)[hole]
            place = hole - (np.cumsum(counts) - counts)[row]
            n1, n2 = (part.column(c).to_numpy()[row] for c in ("n1", "n2"))
            words = pa.array([known.words[c] for c in code[hole]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(n1), pa.array((place << 32) | (n2 & LOW)), words], ["n1", "tag", "word"])

    return run


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^21 in one to three bytes of seven bits, and how many bytes each takes."""
    wide, wider = ranks >= 1 << 7, ranks >= 1 << 14
    sizes = 1 + wide.astype(np.int64) + wider
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[at] = (ranks & 127) | (wide << 7)
    out[at[wide] + 1] = ((ranks[wide] >> 7) & 127) | (wider[wide] << 7)
    out[at[wider] + 2] = ranks[wider] >> 14
    return out, sizes


def unpack(packed: np.ndarray) -> np.ndarray:
    last = packed < 128
    first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(packed) else np.zeros(0, np.int64)
    low = packed & 127
    out = low[first].astype(np.int32)
    for step in (1, 2):
        more = ~last[first] if step == 1 else ~last[first] & ~last[np.minimum(first + 1, len(packed) - 1)]
        out[more] |= low[first[more] + step].astype(np.int32) << (7 * step)
    return out


def _packed(path: str, broadcast):
    """Each text as its words' packed ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, known = zstandard.ZstdCompressor(level=3).compress, WordRanks(path, broadcast.value)
        for part in _slices(batches):
            counts, _, ranks = known.of(part.column("text"))
            raw, sizes = pack(ranks)
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
            packed = pa.array([compress(raw[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n1", "n2")), packed], ["doc_id", "n1", "n2", "packed"])

    return run


def _flat(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the lists, null counting as empty, and all their items in turn."""
    return column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _merged(ranks: np.ndarray, n_hole: np.ndarray, starts: np.ndarray, hot: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many items each word has, and all items in turn: those of its rank, and for holes in turn ``n_hole`` of ``found``."""
    n, hole = starts[ranks + 1] - starts[ranks], ranks == 0
    n[hole] = n_hole
    inside = np.repeat(hole, n)
    out = np.empty(int(n.sum()), hot.dtype)
    out[~inside] = hot[_spread(starts[ranks][~hole], n[~hole])]
    out[inside] = found
    return n, out


def _filled(broadcast):
    """The ids of each text and their pieces one behind the other: of its ranks and, for the holes in turn, what came back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, expand = broadcast.value, zstandard.ZstdDecompressor().decompress
        for part in _slices(batches):
            raw = [np.frombuffer(expand(x), np.uint8) for x in part.column("packed").to_pylist()]
            ranks = unpack(np.concatenate(raw))
            words = np.array([int((r < 128).sum()) for r in raw], np.int64)
            ends = np.concatenate([[0], np.cumsum(words)])
            pieces = _flat(part.column("found"))[1]
            codes, sizes, found = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint8)
            if len(pieces):
                codes = pieces.field("code").to_numpy(zero_copy_only=False).astype(np.int32)
                sizes, found = _binaries(pieces.field("piece"))
            first = np.flatnonzero(codes & FIRST)
            n_ids = np.diff(np.append(first, len(codes)))
            n_bytes = np.add.reduceat(sizes, first) if len(first) else sizes
            n, ids = _merged(ranks, n_ids, hot["starts"], hot["ids"], codes & (FIRST - 1))
            m, text = _merged(ranks, n_bytes, hot["byte_starts"], hot["bytes"], found)
            at_ids, at_bytes = (np.concatenate([[0], np.cumsum(x)])[ends] for x in (n, m))
            whole = text.tobytes()
            decoded = pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(at_bytes[:-1].tolist(), at_bytes[1:].tolist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at_ids, pa.int32()), pa.array(ids, pa.int32())), decoded], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) for every row of ``docs``, as the vocabulary's own library encodes the whole
    text without adding special tokens; the names of special tokens in a text become these tokens. With ``decoded`` the
    text of the ids comes beside them, found by joining ids with pieces. Null and empty texts have no ids. Rows alike in id and text
    are joined alike. An empty table gives no rows. Texts may have any length; a task holds BATCH_ROWS of them.
    """
    path = path or vocabulary_path()
    text = F.col(f"`{text_col}`")
    k1, k2 = text_key(text)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"), k1, k2)
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "k1", "k2").alias("n1"), F.xxhash64("k2", "doc_id", "k1").alias("n2"))
    n_rows = docs.count()
    sample = rows.where(F.pmod("n1", F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE_ROWS / max(1, n_rows))) + 1)
    broadcast = docs.sparkSession.sparkContext.broadcast(hot_words(sample, path))
    holes = rows.select("n1", "n2", "text").mapInArrow(_holes(path, broadcast), "n1 long, tag long, word string")
    fits = _tokenizer(path).get_vocab_size(with_added_tokens=True) <= 2 * SHORT
    # a word too long to be hot may stand in most documents
    lane = F.when(F.octet_length("word") > HOT_BYTES, F.pmod("n1", F.lit(LONG_LANES))).otherwise(F.lit(0).cast("long"))
    places = holes.repartition(F.col("word"), lane).sortWithinPartitions("word").mapInArrow(_encoded_places(path, pa.int16() if fits else pa.int32()), f"n1 long, tag long, ids array<{'smallint' if fits else 'int'}>")
    back = places.groupBy("n1", F.col("tag").bitwiseAND(F.lit(LOW)).alias("low")).agg(F.sort_array(F.collect_set(F.struct("tag", "ids"))).alias("s"))
    mark = lambda s: F.transform(s["ids"], lambda x, i: (x.cast("int") + SHORT).bitwiseOR(F.when(i == 0, FIRST).otherwise(0)))
    back = back.select("n1", "low", F.flatten(F.transform("s", mark)).alias("codes"))
    # stays as it is dealt out, by text: no further exchange
    back = back.select("n1", "low", F.posexplode("codes").alias("at", "code")).withColumn("id", F.col("code").bitwiseAND(F.lit(FIRST - 1)))
    back = back.join(F.broadcast(piece_table(docs.sparkSession, path)), "id")
    found = F.transform(F.sort_array(F.collect_list(F.struct("at", "code", "piece"))), lambda x: F.struct(x["code"].alias("code"), x["piece"].alias("piece")))
    back = back.groupBy("n1", "low").agg(found.alias("found"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    packed = rows.mapInArrow(_packed(path, broadcast), f"doc_id {id_type}, n1 long, n2 long, packed binary")
    packed = packed.select("doc_id", "n1", F.col("n2").bitwiseAND(F.lit(LOW)).alias("low"), "packed")
    joined = packed.join(back, ["n1", "low"], "left").select("doc_id", "packed", "found")
    out = joined.mapInArrow(_filled(broadcast), f"doc_id {id_type}, ids array<int>, decoded string")
    return out if decoded else out.select("doc_id", "ids")


def byte_pieces(path: str) -> list[bytes]:
    """The bytes of each id of the vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    tokenizer = _tokenizer(path)
    return [bytes(byte_of[c] for c in tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """id and piece (its bytes), a row for each id of the vocabulary."""
    pieces = byte_pieces(path)
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.binary())}))


def joined_pieces(encoded: DataFrame, ids_col: str, keys: list[str], path: str) -> DataFrame:
    """``keys``, which name a row of ``encoded``, its ids and ``decoded``, their bytes in turn, by a join of ids with pieces.
    Ids that the vocabulary doesn't have, and nulls among them, count for nothing; rows that have no others go."""
    ids = encoded.select(*keys, F.posexplode(F.col(ids_col)).alias("at", "id"))
    pieces = ids.join(F.broadcast(piece_table(encoded.sparkSession, path)), "id").groupBy(*keys)
    pieces = pieces.agg(F.sort_array(F.collect_list(F.struct("at", "id", "piece"))).alias("s"))
    # hexadecimal, as arrays join strings only
    return pieces.select(*keys, F.col("s.id").alias("ids"), F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["piece"])), "")).alias("decoded"))


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of the ids, special tokens kept, by a join of ids with pieces. Ids that
    the vocabulary doesn't have, and nulls among them, count for nothing; bytes that are no UTF-8 become U+FFFD; a
    null list decodes to the empty text. A column ``decoded`` of the caller's is replaced. Equal lists are decoded once, so that neither repeated rows nor rows
    without an id need care.
    """
    path = path or vocabulary_path()
    ids = F.col(f"`{ids_col}`")
    columns = [F.col(f"`{c}`") for c in encoded.columns if c != "decoded"]
    name = [F.xxhash64(ids, F.lit(seed)).alias(f"__h{seed}") for seed in (1, 2)]
    lists = encoded.where(F.size(ids) > 0).select(ids.alias("ids"), *name).groupBy("__h1", "__h2").agg(F.first("ids").alias("ids"))
    texts = joined_pieces(lists, "ids", ["__h1", "__h2"], path).select(F.col("__h1").alias("__t1"), F.col("__h2").alias("__t2"), _replaced(F.coalesce("decoded", F.lit(b""))).alias("__text"))
    named = encoded.select(*columns, *name)
    joined = named.join(texts, (F.col("__h1") == F.col("__t1")) & (F.col("__h2") == F.col("__t2")), "left")
    return joined.select(*columns, F.coalesce("__text", F.lit("")).alias("decoded"))


def _utf8(raw: pd.Series) -> pd.Series:
    return objects([bytes(b).decode("utf-8", "replace") for b in raw])


def _replaced(raw: Column) -> Column:
    """Bytes as text, with U+FFFD for what is no UTF-8."""
    return F.pandas_udf(_utf8, "string")(raw)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row of ``docs``, encoded and decoded again."""
    done = encode(docs, id_col, text_col, path, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
