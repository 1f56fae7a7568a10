"""Streams: short-term memory with state, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.memory import CAPACITY

ITEM = "session_id long, event_id long, ts timestamp, score double"


def short_term(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A stream of the newest ``capacity`` items of each session, after every batch that touches the session.

    ``events`` has the columns of ITEM. State holds a session's items only; what leaves is counted in evicted.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (session,) = key
        held, evicted = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for batch in batches:
            held += [(int(t.value // 1000), int(e)) for t, e in zip(batch["ts"], batch["event_id"], strict=True)]
            held.sort()
            evicted += max(0, len(held) - capacity)
            held = held[-capacity:]
        state.update(([list(h) for h in held], evicted))
        yield pd.DataFrame({"session_id": [session], "n_held": [len(held)], "evicted": [evicted], "oldest_event": [held[0][1]], "newest_event": [held[-1][1]]})

    return events.groupBy("session_id").applyInPandasWithState(
        update, "session_id long, n_held long, evicted long, oldest_event long, newest_event long", "held array<array<long>>, evicted long", "update", GroupStateTimeout.NoTimeout
    )


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type; events later than ``late`` behind the newest are dropped."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
