"""URL filters by a bit-parallel wildcard automaton.

Glob rules are compiled into one multiword Shift-And machine: every position of every rule is a bit, one
mask for each byte value says which positions accept that byte, another which positions loop on it. A
whole batch of URLs advances one byte at a time through all rules at once.

In a glob ``?`` stands for one byte other than ``/``, ``*`` for any run without ``/``, ``**`` for any run.
It is matched against the whole canonical URL: a dot, the host in lower case, then the path.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The host and path rules of the contract; the rule that is longest wins.
HOST_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: What decides where no host rule fits: the first of these that matches, else DEFAULT.
GLOBS = [
    ("block", "**.casino-*/**"),
    ("block", "**.cheap-pills.**"),
    ("block", "**.spam-farm.**"),
    ("block", "**.free-bets.**"),
    ("block", "**.adult-?.**"),
    ("block", "**.ads-track.**"),
]
DEFAULT = "allow"
LONG = 4_096  # bytes of a URL that is walked by itself


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; null or no ``://``: empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_glob(rule: str) -> str:
    """A host and path rule as a glob: the host and all its subdomains, any path that starts with the rule's."""
    if any(c in rule for c in "*?"):
        raise ValueError(f"a host rule has no wildcards: {rule}")
    return f"*.{rule}**"


@dataclass(frozen=True)
class ShiftAnd:
    """Masks of the machine: ``accept`` and ``loop`` are (256, words) of 64-bit words; bits are states."""

    accept: np.ndarray
    loop: np.ndarray
    start: np.ndarray
    finals: np.ndarray  # the state number at which each glob has matched

    @staticmethod
    def compile(globs: list[str]) -> ShiftAnd:
        accepts: list[set[int] | None] = []  # for each state the bytes that lead into it; None: a glob's first state
        loops: list[set[int]] = []
        finals, starts = [], []
        everything, in_part = set(range(256)), set(range(256)) - {ord("/")}
        for glob in globs:
            starts.append(len(accepts))
            accepts.append(None)
            loops.append(set())
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loops[-1] = everything
                    i += 2
                    continue
                if raw[i] == ord("*"):
                    loops[-1] = loops[-1] | in_part
                elif raw[i] == ord("?"):
                    accepts.append(in_part)
                    loops.append(set())
                else:
                    accepts.append({raw[i]})
                    loops.append(set())
                i += 1
            finals.append(len(accepts) - 1)
        words = max(1, -(-len(accepts) // 64))
        accept, loop, start = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
        for state, (into, stay) in enumerate(zip(accepts, loops, strict=True)):
            word, bit = divmod(state, 64)
            one = np.uint64(1) << np.uint64(bit)
            for table, values in ((accept, into or ()), (loop, stay)):
                for value in values:
                    table[value, word] |= one
        for state in starts:
            start[state // 64] |= np.uint64(1) << np.uint64(state % 64)
        return ShiftAnd(accept, loop, start, np.array(finals, dtype=np.int64))

    @cached_property
    def _whole(self) -> tuple[list[int], list[int], int]:
        """The masks of each byte and the start, all words of them as one number."""
        number = lambda row: int.from_bytes(np.ascontiguousarray(row).astype("<u8").tobytes(), "little")
        return [number(r) for r in self.accept], [number(r) for r in self.loop], number(self.start)

    def _walked(self, subject: bytes) -> int:
        """``first_match`` of one subject, by itself."""
        accept, loop, state = self._whole
        for byte in subject:
            state = ((state << 1) & accept[byte]) | (state & loop[byte])
        return next((glob for glob, bit in enumerate(self.finals.tolist()) if state >> bit & 1), -1)

    def first_match(self, subjects: list[bytes]) -> np.ndarray:
        """For each subject the number of the first glob that matches all of it, or -1. Subjects of up to LONG bytes step together, longer ones
        are walked one by one, so that none holds up the others."""
        found = np.full(len(subjects), -1, np.int64)
        for i in [i for i, s in enumerate(subjects) if len(s) > LONG]:
            found[i] = self._walked(subjects[i])
        short = [i for i, s in enumerate(subjects) if len(s) <= LONG]
        found[short] = self._stepped([subjects[i] for i in short])
        return found

    def _stepped(self, subjects: list[bytes]) -> np.ndarray:
        found = np.full(len(subjects), -1, np.int64)
        order = np.argsort([-len(s) for s in subjects], kind="stable")
        lengths = np.array([len(subjects[i]) for i in order], dtype=np.int64)
        flat = np.frombuffer(b"".join(subjects[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
        state = np.tile(self.start, (len(subjects), 1))
        live = len(subjects)
        for at in range(int(lengths[0]) if live else 0):
            while live and lengths[live - 1] <= at:  # longest first, so those that have ended are at the back
                live -= 1
            byte, now = flat[begin[:live] + at], state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.accept[byte]) | (now & self.loop[byte])
        word, bit = np.divmod(self.finals, 64)
        for glob in range(len(self.finals) - 1, -1, -1):
            hit = (state[:, word[glob]] >> np.uint64(bit[glob])) & np.uint64(1) == 1
            found[order[hit]] = glob
        return found


def url_filter(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    host_rules: list[tuple[str, str]] = HOST_RULES,
    globs: list[tuple[str, str]] = GLOBS,
    default: str = DEFAULT,
) -> DataFrame:
    """Judge every URL: id, host, path, rule (the longest host rule that fits, else null), verdict, glob_rule.

    One row per input row, whatever repeats; an empty table gives none, and URLs may have any length. A null or malformed
    URL has empty host and path, fits no host rule and takes ``default`` unless a glob matches. ``glob_rule`` names the
    glob that decided, else null. Rows stay where they are: no shuffle, and only the rules travel with the tasks.
    """
    ranked = sorted(host_rules, key=lambda r: (-len(r[1]), r[1])) + list(globs)
    n_rules = len(host_rules)
    machine = ShiftAnd.compile([rule_glob(r) for _, r in ranked[:n_rules]] + [g for _, g in ranked[n_rules:]])

    @F.pandas_udf("long")
    def winner(subject: pd.Series) -> pd.Series:
        return pd.Series(machine.first_match([s.encode() for s in subject]))

    parts = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    won = parts.withColumn("won", winner(F.concat(F.lit("."), "host", "path")))
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("won").cast("int"))
    is_rule = F.col("won").between(0, n_rules - 1)
    return won.select(
        "page_id",
        "host",
        "path",
        F.when(is_rule, of([text for _, text in ranked])).alias("rule"),
        F.when(F.col("won") < 0, F.lit(default)).otherwise(of([verdict for verdict, _ in ranked])).alias("verdict"),
        F.when(F.col("won") >= n_rules, of([text for _, text in ranked])).alias("glob_rule"),
    )


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts),
globbed AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_full_match('.' || host || path, '(?s).*\.casino-[^/]*/.*') THEN '**.casino-*/**'
    WHEN contains('.' || host || path, '.cheap-pills.') THEN '**.cheap-pills.**'
    WHEN contains('.' || host || path, '.spam-farm.') THEN '**.spam-farm.**'
    WHEN contains('.' || host || path, '.free-bets.') THEN '**.free-bets.**'
    WHEN regexp_full_match('.' || host || path, '(?s).*\.adult-[^/]\..*') THEN '**.adult-?.**'
    WHEN contains('.' || host || path, '.ads-track.') THEN '**.ads-track.**' END AS glob_rule
  FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN glob_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       glob_rule
FROM globbed
"""
