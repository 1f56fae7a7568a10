"""What several corpus operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
WORDS_BYTES = re.compile(WORD.encode())

ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """``keys`` beside one struct with the whole row, so that no column of the caller's can clash with ours.

    ``select(ROW + ".*")`` gives the caller's columns back.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW), *[c.alias(k) for k, c in keys.items()])


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text: together a 128-bit key for joins that find a row again."""
    return [F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), F.length(text), text).alias("k2")]


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def frames(batches: Iterator[pd.DataFrame], rows: int = 2048) -> Iterator[pd.DataFrame]:
    """Batches cut to at most ``rows`` rows, which bounds what a task holds at once."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def objects(values: list) -> pd.Series:
    """A column of strings, bytes or lists, also where there are no rows (of which pandas would make floats)."""
    return pd.Series(values, dtype=object)
