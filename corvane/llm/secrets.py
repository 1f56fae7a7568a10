"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

All of it is made of DataFrame functions on one row, so a scan neither shuffles nor leaves the JVM. The
entropy of a window follows from counts that each step updates by the character that enters and the one
that leaves; alphabets and thresholds differ by character class. An allow-list suppresses known harmless strings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns of the contract, by kind in the order in which kinds sort.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

WINDOW = 20
BITS, PACKED = 5, 12  # a count of at most WINDOW takes 5 bits, so a long holds 12 of them
STRIDE = 64
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}+"
#: By character class: kind, its alphabet, and the bits a window needs.
CLASSES = {
    "hex": ("entropy_hex", "0123456789abcdef", 3.0),
    "base64": ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.7),
}
#: A candidate that matches one of these is no secret: UUIDs, words without digits, digits alone, placeholders.
ALLOW = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^[A-Za-z/=_-]+$",
    r"^[0-9/=+_-]+$",
    r"(?i)example|placeholder|dummy|xxxx|0000000",
)
SPAN = "struct<start:int,kind:int,stop:int>"


def _placed(text: Column, pattern: str, hits: Column) -> Column:
    """start, stop and text of each match: gaps and matches alternate, so their lengths add up to places.

    Matches are placed in groups of STRIDE and the groups then put one behind the other, so that no long array is
    copied for each match.
    """
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    none = F.array().cast("array<struct<start:int,stop:int,hit:string>>")
    # bound by an array of one, so that it is made once and not for each group
    groups = F.transform(F.array(pairs), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / STRIDE).cast("int")), lambda g: F.slice(p, g * STRIDE + 1, STRIDE)))[0]

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        stop = start + F.length(pair["hit"])
        found = F.array(F.struct(start.alias("start"), stop.alias("stop"), pair["hit"].alias("hit")))
        return F.struct(stop.alias("at"), F.concat(state["found"], found).alias("found"))

    walked = F.transform(groups, lambda g: F.aggregate(g, F.struct(F.lit(0).alias("at"), none.alias("found")), step))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("offsets"))
    add = lambda s, g: F.struct((s["at"] + g["at"]).alias("at"), F.concat(s["offsets"], F.array(s["at"])).alias("offsets"))
    offsets = lambda w: F.aggregate(w, first, add, lambda s: s["offsets"])
    move = lambda g, by: F.transform(g["found"], lambda p: F.struct((p["start"] + by).alias("start"), (p["stop"] + by).alias("stop"), p["hit"].alias("hit")))
    moved = F.transform(F.array(walked), lambda w: F.flatten(F.zip_with(w, offsets(w), move)))[0]
    return F.when(F.size(hits) > 0, moved).otherwise(none)


def _spans(placed: Column, kind: str) -> Column:
    number = KINDS.index(kind)
    return F.transform(placed, lambda p: F.struct(p["start"].alias("start"), F.lit(number).alias("kind"), p["stop"].alias("stop")))


def window_entropy(candidate: Column, alphabet: str, least: float, window: int = WINDOW) -> Column:
    """lo, hi and best: from the first to the last window of ``least`` bits or more, and the most bits of any.

    ``candidate`` holds characters of ``alphabet`` only, at least ``window`` of them. State: the count of each
    character in the window, PACKED of them in a long, and the sum of c * log2(c), of which the entropy is log2(window) -
    sum / window. A step changes two counts, so it takes as long for any alphabet and window.
    """
    size, n_words = len(alphabet), -(-len(alphabet) // PACKED)
    zero = F.lit(0).cast("long")
    # by number of a character what it adds to each of the longs; number ``size`` is none
    rows = [[f"{1 << code % PACKED * BITS if code < size and code // PACKED == k else 0}L" for k in range(n_words)] for code in range(size + 1)]
    ones = F.expr("array(" + ", ".join(f"array({', '.join(row)})" for row in rows) + ")")
    shifts = F.expr("array(" + ", ".join(str(code % PACKED * BITS) for code in range(size + 1)) + ")")
    term = F.expr("array(" + ", ".join(f"{c * math.log2(c) if c > 0 else 0.0!r}D" for c in range(window + 2)) + ")")
    codes = F.transform(F.slice(F.split(candidate, ""), F.lit(1), F.length(candidate)), lambda c: F.instr(F.lit(alphabet), c) - 1)
    behind = F.slice(F.concat(F.array_repeat(F.lit(size), window), codes), F.lit(1), F.length(candidate))
    move = lambda new, old: F.struct(new.alias("new"), old.alias("old"), F.get(ones, new).alias("more"), F.get(ones, old).alias("less"))
    names = [f"c{k}" for k in range(n_words)]
    start = F.struct(*[zero.alias(n) for n in names], F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), F.lit(0.0).alias("best"))

    def count(state: Column, code: Column) -> Column:
        word = state[names[-1]]
        for k in range(n_words - 2, -1, -1):
            word = F.when(code < (k + 1) * PACKED, state[names[k]]).otherwise(word)
        return F.call_function("shiftright", word, F.get(shifts, code)).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")

    def step(state: Column, move: Column) -> Column:
        new, old = move["new"], move["old"]
        grown, shrunk = count(state, new), count(state, old)
        gain = F.get(term, grown + 1) - F.get(term, grown)
        total = F.when(new == old, state["sum"]).when(old == size, state["sum"] + gain).otherwise(state["sum"] + gain + F.get(term, shrunk - 1) - F.get(term, shrunk))
        at = state["at"] + 1
        bits = F.when(at < window, 0.0).otherwise(F.lit(math.log2(window)) - total / window)
        return F.struct(
            *[(state[n] + F.get(move["more"], k) - F.get(move["less"], k)).alias(n) for k, n in enumerate(names)],
            total.alias("sum"),
            at.alias("at"),
            F.when(state["lo"] >= 0, state["lo"]).when(bits >= least, at - window).otherwise(-1).alias("lo"),
            F.when(bits >= least, at).otherwise(state["hi"]).alias("hi"),
            F.greatest(state["best"], bits).alias("best"),
        )

    return F.aggregate(F.zip_with(codes, behind, move), start, step, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), s["best"].alias("best")))


def _entropy_spans(placed: Column) -> Column:
    """Spans of high entropy within candidates, by character class."""

    def of(p: Column) -> Column:
        is_hex = p["hit"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        (_, hex_alphabet, hex_least), (_, b64_alphabet, b64_least) = CLASSES["hex"], CLASSES["base64"]
        found = F.when(is_hex, window_entropy(F.lower(p["hit"]), hex_alphabet, hex_least)).otherwise(window_entropy(p["hit"], b64_alphabet, b64_least))
        kind = F.when(is_hex, KINDS.index("entropy_hex")).otherwise(KINDS.index("entropy_base64"))
        return F.struct(p["start"].alias("at"), kind.alias("kind"), found.alias("found"))

    allowed = lambda hit: hit.rlike("|".join(f"(?:{a})" for a in ALLOW))
    scored = F.transform(F.filter(placed, lambda p: ~allowed(p["hit"])), of)
    high = F.filter(scored, lambda s: s["found"]["lo"] >= 0)
    return F.transform(high, lambda s: F.struct((s["at"] + s["found"]["lo"]).alias("start"), s["kind"].alias("kind"), (s["at"] + s["found"]["hi"]).alias("stop")))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: the spans of each row's text, as arrays of (start, kind, stop) in order.

    Places count code points; ``stop`` is exclusive; ``kind`` is a number in KINDS. ``base`` holds what the fixed
    patterns find, ``added`` windows of high entropy that no base span covers. Null and empty texts have none.
    """
    body = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    no_hits = F.array().cast("array<string>")
    found = lambda pattern, group=0: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    lowered = F.lower("text")
    may_assign = lowered.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        may_assign = may_assign | lowered.contains(word)
    hits = body.select(
        "doc_id",
        "text",
        F.when(may_assign, found(ASSIGN)).otherwise(no_hits).alias("assign"),
        F.when(F.col("text").contains("AKIA"), found(ACCESS)).otherwise(no_hits).alias("access"),
        found(HEX).alias("hex"),
        found(CANDIDATE).alias("candidates"),
    )
    # a match of assign counts if the value behind it is long enough
    assign = F.filter(_placed(F.col("text"), ASSIGN, F.col("assign")), lambda p: F.length(F.regexp_extract(p["hit"], ASSIGN, 2)) >= ASSIGN_LEAST)
    placed = hits.select(
        "doc_id",
        F.array_sort(
            F.concat(_spans(assign, "assign"), _spans(_placed(F.col("text"), ACCESS, F.col("access")), "access"), _spans(_placed(F.col("text"), HEX, F.col("hex")), "hex"))
        ).alias("base"),
        _placed(F.col("text"), CANDIDATE, F.col("candidates")).alias("candidates"),
    )
    # a candidate that is a base span of hexadecimal digits adds nothing, whatever its entropy
    scored = placed.select("doc_id", "base", _entropy_spans(F.filter("candidates", lambda p: ~p["hit"].rlike("^[0-9a-f]{24,}$"))).alias("entropy"))
    # in order of starts, base spans first: a span is covered if it stops no later than some base span so far
    order = lambda spans, rank: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    begin = F.struct(F.lit(-1).alias("top"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(state: Column, s: Column) -> Column:
        own = F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
        base = F.struct(F.greatest(state["top"], s["stop"]).alias("top"), state["found"].alias("found"))
        return F.when(s["rank"] == 0, base).when(s["stop"] <= state["top"], state).otherwise(F.struct(state["top"].alias("top"), F.concat(state["found"], own).alias("found")))

    fresh = F.aggregate(F.array_sort(F.concat(order(F.col("base"), 0), order(F.col("entropy"), 1))), begin, step, lambda s: s["found"])
    fresh = F.when(F.size("entropy") > 0, fresh).otherwise(F.array().cast(f"array<{SPAN}>"))
    return scored.select("doc_id", "base", fresh.alias("added"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added: one row per row of ``docs``.

    Null and empty texts have no spans, an empty table gives no rows, and repeated rows are scanned alike. Texts of any
    length are scanned whole.
    """
    spans = secret_spans(docs, id_col, text_col)
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return spans.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
