"""The short-term buffer of conversations as one stateful stream: items, lookups and promotions in, leaving items out.

A session holds its newest items. An item leaves when it is pushed out by newer ones, when it grows too old, or when a promotion finds
it worth keeping; what leaves goes on with its lookups counted. State is an ordered list of the items held and a map with the score
and lookups of each; a timer lets items of sessions expire that hear nothing more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.memory import CAPACITY, PASS

#: Rows of the stream: kind is item, lookup or promote; at is when; a promotion needs no event_id.
ROW = "session_id long, at timestamp, kind string, event_id long, score double"
LEFT = "session_id long, event_id long, score double, access_count int, reason string, left_at timestamp, total double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST_ACCESSES = 10
KINDS = {"item": 0, "lookup": 1, "promote": 2}
WEIGHTS = (0.3, 0.5, 0.2)  # of recency, importance and use, as a batch promotion has them


def micros(at: pd.Timestamp) -> int:
    return int(at.value // 1000)


def promotion_total(age_micros: int, score: float, accesses: int) -> float:
    recent = max(0.0, 1 - age_micros / 3_600_000_000 / 24)
    return WEIGHTS[0] * recent + WEIGHTS[1] * min(1.0, max(0.0, score)) + WEIGHTS[2] * (1 - math.exp(-accesses))


class Buffer:
    """What one session holds: ``order`` of (at, event_id), oldest first, and ``items`` (event_id to score and accesses)."""

    def __init__(self, order: list[tuple[int, int]], items: dict[int, tuple[float, int]], capacity: int, lives: int, threshold: float) -> None:
        self.order, self.items, self.capacity, self.lives, self.threshold = order, items, capacity, lives, threshold
        self.left: list[tuple] = []
        self.dirty: set[int] = set()

    def _leave(self, place: int, reason: str, at: int, total: float | None = None) -> None:
        event = self.order.pop(place)[1]
        self.left.append((event, *self.items.pop(event), reason, at, total))
        self.dirty.add(event)

    def expire(self, now: int) -> None:
        while self.order and self.order[0][0] + self.lives <= now:
            self._leave(0, "expired", self.order[0][0] + self.lives)

    def take(self, at: int, kind: str, event: int, score: float) -> None:
        """One row; before it all goes that is too old by then."""
        self.expire(at)
        if kind == "item" and event not in self.items:
            self.order.append((at, event))
            self.items[event] = (score, 0)
            self.dirty.add(event)
            if len(self.order) > self.capacity:
                self._leave(0, "evicted", at)
        elif kind == "lookup" and event in self.items:
            own, accesses = self.items[event]
            self.items[event] = (own, min(MOST_ACCESSES, accesses + 1))
            self.dirty.add(event)
        elif kind == "promote":
            for place in reversed(range(len(self.order))):
                then, held = self.order[place]
                total = promotion_total(at - then, *self.items[held])
                if total >= self.threshold - 1e-9:
                    self._leave(place, "promoted", at, total)


class BufferProcessor(StatefulProcessor):
    def __init__(self, capacity: int, lives: int, threshold: float) -> None:
        self.capacity, self.lives, self.threshold = capacity, lives, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.order = handle.getListState("order", "at long, event_id long")
        self.items = handle.getMapState("items", "event_id long", "score double, accesses int")

    def _held(self) -> Buffer:
        order = [tuple(r) for r in self.order.get()] if self.order.exists() else []
        items = {k[0]: tuple(v) for k, v in self.items.iterator()} if order else {}
        return Buffer(order, items, self.capacity, self.lives, self.threshold)

    def _kept(self, buffer: Buffer, session: int, was: int | None) -> Iterator[pd.DataFrame]:
        for event in buffer.dirty:
            if event in buffer.items:
                self.items.updateValue((event,), buffer.items[event])
            elif self.items.exists() and self.items.containsKey((event,)):
                self.items.removeKey((event,))
        if buffer.order:
            self.order.put(buffer.order)
        else:
            self.order.clear()
        due = (buffer.order[0][0] + self.lives) // 1000 + 1 if buffer.order else None
        if due != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if due is not None:
                self.handle.registerTimer(due)
        if buffer.left:
            out = pd.DataFrame(buffer.left, columns=["event_id", "score", "access_count", "reason", "left_at", "total"])
            out["left_at"] = pd.to_datetime(out["left_at"], unit="us")
            out["total"] = out["total"].astype(float)
            out.insert(0, "session_id", session)
            yield out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        buffer = self._held()
        was = (buffer.order[0][0] + self.lives) // 1000 + 1 if buffer.order else None
        came = pd.concat(list(rows))
        came = came.assign(at=came["at"].map(micros), turn=came["kind"].map(KINDS)).sort_values(["at", "turn", "event_id"], kind="stable")
        for row in came.itertuples():
            buffer.take(row.at, row.kind, row.event_id, row.score)
        yield from self._kept(buffer, key[0], was)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        buffer = self._held()
        buffer.expire(int(timerValues.getCurrentWatermarkInMs()) * 1000)
        yield from self._kept(buffer, key[0], None)  # the timer that has gone off is no more

    def close(self) -> None:
        pass


def leaving(rows: DataFrame, capacity: int = CAPACITY, hours: float = 24 * 7, threshold: float = PASS, late: str = "0 seconds") -> DataFrame:
    """A stream of the items that leave the buffer of their session (LEFT), from a stream of rows as in ROW.

    Rows come in order of time from batch to batch, up to ``late``; how they are split into batches changes nothing. Within a batch they
    are sorted by time, items before lookups before promotions. An item that is held already, a lookup of one that isn't, and
    rows without a session or a time count for nothing.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    known = rows.where("session_id is not null and at is not null and kind in ('item', 'lookup', 'promote')")
    known = known.select("session_id", "at", "kind", F.coalesce("event_id", F.lit(-1)).alias("event_id"), F.coalesce("score", F.lit(0.0)).alias("score"))
    processor = BufferProcessor(capacity, int(hours * 3_600_000_000), threshold)
    return known.withWatermark("at", late).groupBy("session_id").transformWithStateInPandas(processor, LEFT, "append", "eventTime")


def promote_into(stream: DataFrame, root: str, checkpoint: str, **settings: object) -> None:
    """Run ``stream`` (rows as in ROW) over all that is there: promoted items go to two stores below ``root``, ``long_term`` and ``episodic``.

    A batch writes under its number in both stores, and a repeated batch overwrites itself, so a crash between the two leaves
    no item doubled or in one store alone once the stream goes on. Items that aren't promoted stay in the state.
    """

    def write(batch: DataFrame, number: int) -> None:
        promoted = batch.where("reason = 'promoted'").drop("reason")
        promoted.persist()
        for store in ("long_term", "episodic"):
            promoted.write.mode("overwrite").parquet(f"{root}/{store}/batch={number}")
        promoted.unpersist()

    out = leaving(stream, **settings)
    out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stores(spark, root: str) -> DataFrame:
    """store and the columns of LEFT but its reason, of the stores that ``promote_into`` has written."""
    schema = LEFT.replace("reason string, ", "")
    parts = [spark.read.schema(schema).parquet(f"{root}/{s}").select(F.lit(s).alias("store"), *[c.split()[0] for c in schema.split(", ")]) for s in ("long_term", "episodic")]
    return parts[0].unionByName(parts[1])
