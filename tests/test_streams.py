"""Streams with state: the buffer, promotion into two stores, ingestion through the ledger, traces."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.streaming import buffer, ingest, traces

BASE = dt.datetime(2024, 1, 1)


def moment(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def rows_of(seed, n=160):
    """Items, lookups and promotions of three sessions in order of time."""
    rng = random.Random(seed)
    rows, held, clock = [], {}, 0.0
    for i in range(n):
        clock += rng.choice([0.5, 1, 3, 20])
        session = rng.randint(1, 3)
        kind = rng.choice(["item"] * 5 + ["lookup"] * 4 + (["promote"] if i % 9 == 0 else []))
        event = i if kind == "item" else rng.choice(held.get(session, [0]) + [999]) if kind == "lookup" else None
        held.setdefault(session, []).append(i) if kind == "item" else None
        rows.append((session, moment(clock), kind, event, rng.random() if kind == "item" else None))
    return rows


def plainly(rows, capacity, hours, threshold):
    """The same by one list a session."""
    left, held, lives = set(), {}, hours * 3_600_000_000
    for session, at, kind, event, score in rows:
        now = int((at - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
        mine = held.setdefault(session, [])
        for item in [i for i in mine if i[0] + lives <= now]:
            left.add((session, item[1], item[3], "expired"))
            mine.remove(item)
        if kind == "item":
            mine.append([now, event, score, 0])
            if len(mine) > capacity:
                left.add((session, mine[0][1], mine.pop(0)[3], "evicted"))
        elif kind == "lookup":
            for item in mine:
                if item[1] == event:
                    item[3] = min(10, item[3] + 1)
        else:
            for item in [i for i in mine if buffer.promotion_total(now - i[0], i[2], i[3]) >= threshold]:
                left.add((session, item[1], item[3], "promoted"))
                mine.remove(item)
    return left, held


def files(spark, rows, cuts, path):
    """Each slice of rows as files of its own, one after the other."""
    for start, stop in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[start:stop], buffer.ROW).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(buffer.ROW).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("cuts", [[], [40, 41, 100], [10, 20, 30, 120]])
def test_buffer_does_not_depend_on_batches(spark, tmp_path, cuts):
    rows = [(k, at, kind, None if event is None else event, score) for k, at, kind, event, score in rows_of(4)]
    files(spark, rows, cuts, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    gone = buffer.leaving(stream(spark, str(tmp_path / "in")), 5, 2, 0.55)
    gone.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["session_id"], r["event_id"], r["access_count"], r["reason"]) for r in spark.read.parquet(out).collect()}
    want, held = plainly(rows, 5, 2, 0.55)
    overdue = {i[1] for mine in held.values() for i in mine}  # held still, or let go by a timer
    assert {g for g in got if g[1] not in overdue} == want and {w[3] for w in want} == {"expired", "evicted", "promoted"}
    assert all(reason == "expired" for _, event, _, reason in got if event in overdue)


def test_a_timer_lets_items_of_quiet_sessions_go(spark, tmp_path):
    rows = [(1, moment(0), "item", 1, 0.1), (1, moment(1), "lookup", 1, None), (2, moment(300), "item", 2, 0.1)]
    files(spark, rows, [2], str(tmp_path / "in"))
    out = str(tmp_path / "out")
    gone = buffer.leaving(stream(spark, str(tmp_path / "in")), 5, 2)
    gone.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["session_id"], r["event_id"], r["access_count"], r["reason"], r["left_at"]) for r in spark.read.parquet(out).collect()] == [(1, 1, 1, "expired", moment(120))]


def test_promotion_survives_a_crash_between_its_stores(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    rows = rows_of(8)
    files(spark, rows, [30, 60, 90, 120], str(tmp_path / "in"))
    root, state, plain, crashes = str(tmp_path / "stores"), str(tmp_path / "state"), DataFrameWriter.parquet, []

    def failing(self, path, *more, **named):
        if "/episodic/batch=" in path and len(crashes) < 2 and not path.endswith("=0"):
            crashes.append(path)
            raise OSError("the second store is away")
        return plain(self, path, *more, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    run = lambda: buffer.promote_into(stream(spark, str(tmp_path / "in")), root, state, capacity=6, hours=48, threshold=0.55)
    for _ in range(2):
        with pytest.raises(Exception, match="away"):
            run()
    run()
    run()  # nothing more to do
    want = sorted((s, e, n) for s, e, n, reason in plainly(rows, 6, 48, 0.55)[0] if reason == "promoted")
    found = buffer.stores(spark, root)
    for store in ("long_term", "episodic"):
        assert sorted(tuple(r) for r in found.where(F.col("store") == store).select("session_id", "event_id", "access_count").collect()) == want != []


DOC = "doc_id long, text string"


def come(spark, path, rows):
    spark.createDataFrame(rows, DOC).coalesce(1).write.mode("append").parquet(path)


def entries(spark, root):
    return {r["file_path"]: (r["status"], r["error_msg"], r["n_chunks"], r["attempts"]) for r in ingest.ledger(spark, root).collect()}


def test_ingestion_goes_by_the_ledger(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    come(spark, source, [(1, "# a\nx\n# b\ny"), (2, "plain"), (3, None), (4, "plain")])
    run = lambda **how: ingest.ingest_by_ledger(spark, DOC, source, root, files_per_batch=1, **how)
    busy = lambda number: F.when((F.col("doc_id") == 2) & F.lit(number < 2), "busy")
    run(problem=busy)
    assert entries(spark, root) == {"doc/1": ("success", None, 2, 1), "doc/2": ("failed", "busy", 0, 1), "doc/3": ("failed", "no text", 0, 1)}
    come(spark, source, [(7, "# a\nx\n# b\ny"), (8, "# new\nz")])  # a text that is there already, and another
    run(problem=busy)
    assert entries(spark, root)["doc/2"] == ("failed", "busy", 0, 2) and "doc/7" not in entries(spark, root)
    come(spark, source, [(9, "last")])
    run(problem=busy)  # now the failed one succeeds
    assert entries(spark, root) == {"doc/1": ("success", None, 2, 1), "doc/2": ("success", None, 1, 3), "doc/3": ("failed", "no text", 0, 3), "doc/8": ("success", None, 1, 1), "doc/9": ("success", None, 1, 1)}
    assert sorted(r["doc_id"] for r in ingest.chunks_of(spark, root).collect()) == [1, 1, 2, 8, 9]


def test_ingestion_after_a_crash_between_chunks_and_ledger(spark, tmp_path):
    source, root, crashes = str(tmp_path / "in"), str(tmp_path / "out"), []

    def crash(number):
        if number == 1 and not crashes:
            crashes.append(number)
            raise OSError("gone")

    for batch in ([(1, "one"), (2, "")], [(3, "three"), (4, "one")], [(5, "five")]):
        come(spark, source, batch)
    run = lambda: ingest.ingest_by_ledger(spark, DOC, source, root, before_entry=crash, files_per_batch=1)
    with pytest.raises(Exception, match="gone"):
        run()
    assert sorted(r["doc_id"] for r in ingest.chunks_of(spark, root).collect()) == [1]  # what has no entry isn't shown
    for _ in range(2):
        run()
        assert sorted(r["doc_id"] for r in ingest.chunks_of(spark, root).collect()) == [1, 3, 5]
        assert {k: v[0] for k, v in entries(spark, root).items()} == {"doc/1": "success", "doc/2": "failed", "doc/3": "success", "doc/5": "success"}


def test_traces_late_doubled_and_broken(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    line = lambda trace, stage, minute, ms: '{"trace_id":"%s","stage":"%s","at":"%s","elapsed_ms":%s}' % (trace, stage, moment(minute).isoformat(), ms)  # noqa: E731, UP031
    lots = [
        [line("a", "load", 0, 5), line("a", "split", 1, 7), line("a", "load", 0, 5), "no json {", '{"stage":"x"}'],  # one doubled, two broken
        [line("a", "split", 1, 7), line("b", "load", 3, 1), line("a", "store", 4, 2)],  # one doubled over files
        [line("a", "load", 30, 9), line("c", "load", 60, 4)],  # the trace goes on after a pause
        [line("b", "late", 5, 100), line("c", "end", 61, 6), line("d", "load", 200, 1)],  # one too late
    ]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for i, lot in enumerate(lots):
        (source / f"{i}.log").write_text("\n".join(lot) + "\n")
        traces.collect_traces(spark, str(source), out, state)
    got = {(r["trace_id"], r["start"]): (r["n_stages"], r["elapsed_ms"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", moment(0)): (3, 14.0), ("b", moment(3)): (1, 1.0), ("a", moment(30)): (1, 9.0), ("c", moment(60)): (2, 10.0)}
    broken = traces.stages(spark, str(source)).where("broken is not null").select("broken")
    broken.writeStream.format("parquet").option("path", str(tmp_path / "bad")).option("checkpointLocation", str(tmp_path / "bad-state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == sorted(["no json {", '{"stage":"x"}'])
