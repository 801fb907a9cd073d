"""Keyed state, stream-stream joins and progress against batch results."""

import datetime as dt
import time

import pytest
from pyspark.sql import Row, functions as F

from corpusloom.operators import dedup, splits
from corpusloom.queries import catalog
from corpusloom.session import scratch_path
from corpusloom.streaming import events as streams, keyed

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{folder}/events.parquet")


def rows_of(n, nulls=True):
    rows = [(i, BASE + dt.timedelta(minutes=7 * i), i % 4 if i % 9 else None, ("view", "purchase", None)[(i // 3) % 3], 1.0, "{}") for i in range(n)]
    return rows + [(1000 + i, None, i % 3, ("view", "view", "click")[i % 3], 1.0, "{}") for i in range(9 if nulls else 0)]


@pytest.mark.parametrize("rows", [rows_of(60), rows_of(0), []])
def test_queries_keep_null_times_and_empty_tables(spark, tmp_path, rows):
    put(spark, tmp_path, rows)
    events = spark.read.parquet(f"{tmp_path}/events.parquet")
    kept = dedup.drop_consecutive(events, "user_id", "event_type", "ts", "event_id").select("event_id", "user_id", "ts", "event_type")
    want = sorted(r.event_id for r in kept.collect())
    last = sorted(r.event_id for r in splits.last_n_per_key(kept, "user_id", ["ts", "event_id"]).collect())
    for whole, history in ((catalog.r2_stream_consecutive, catalog.r2_stream_history), (catalog.r2_state, catalog.r2_state_history)):
        assert sorted(r.event_id for r in whole(spark, str(tmp_path)).collect()) == want
        if rows:
            assert sorted(r.event_id for r in history(spark, str(tmp_path)).collect()) == last


def test_a_batch_reads_only_the_state_of_its_keys(spark, tmp_path):
    target = scratch_path(spark, "t-keyed")
    for part in (rows_of(40, nulls=False), [(500, BASE + dt.timedelta(days=9), 1, "view", 1.0, "{}")]):
        put(spark, tmp_path, part)
        stream = streams.read_events(spark, f"{tmp_path}/events.parquet", spark.createDataFrame([], SCHEMA).schema)
        before = keyed.keyed_history(spark, target).count() if part[0][0] else 0
        table = keyed.run_into(keyed.keyed_consecutive(stream, "user_id", "ts", "event_id", "event_type"), target)
    assert table.filter("event_id = 500").count() <= 1
    assert keyed.keyed_history(spark, target).count() in (before, before + 1)


def test_idle_state_expires(spark, tmp_path):
    target = scratch_path(spark, "t-idle")
    for i, (day, user) in enumerate([(0, 1), (5, 2), (9, 1), (9, 2)]):
        put(spark, tmp_path, [(i, BASE + dt.timedelta(days=day), user, "view", 1.0, "{}")])
        stream = streams.read_events(spark, f"{tmp_path}/events.parquet", spark.createDataFrame([], SCHEMA).schema)
        day_ms = 24 * 3600 * 1000
        table = keyed.run_into(keyed.keyed_consecutive(stream, "user_id", "ts", "event_id", "event_type", idle_ms=3 * day_ms), target)
    # User 1's text of day 0 is gone by day 9, user 2's of day 5 as well: equal texts count as new.
    assert sorted(r.event_id for r in table.collect()) == [0, 1, 2, 3]


def test_stream_join_equals_batch(spark, tmp_path):
    rows = rows_of(120)
    put(spark, tmp_path, rows)
    got = sorted((r.user_id, r.event_id, r.answer_id) for r in catalog.r4_stream_join(spark, str(tmp_path)).collect())
    want = []
    for i, ts, user, kind, *_ in rows:
        if kind == "view" and ts is not None and user is not None:
            found = [j for j, t, u, k, *_ in rows if k == "purchase" and u == user and t is not None and ts <= t <= ts + dt.timedelta(hours=6)]
            want += [(user, i, j) for j in found] or [(user, i, None)]
    assert got == sorted(want, key=lambda r: (r[0], r[1], r[2] or -1))


def test_progress_adds_up(spark, tmp_path):
    for k in range(4):
        put(spark, tmp_path, rows_of(10 * (k + 1), nulls=False))
    stream = streams.read_events(spark, f"{tmp_path}/events.parquet", spark.createDataFrame([], SCHEMA).schema, max_files=1)
    table, progress = keyed.run_with_progress(stream, "t-progress")
    waits = keyed.backlog(progress, table.count()).orderBy("batch_id").collect()
    assert sum(r.rows for r in waits) == 100 and waits[-1].backlog == 0 and len(waits) > 3
    assert [r.backlog for r in waits] == sorted((r.backlog for r in waits), reverse=True)
    counts = keyed.stage_counts(table, table.filter(F.col("event_id") < 5), table.limit(0)).first()
    assert (counts.captured, counts.processed, counts.generated, counts.waiting, counts.unanswered) == (100, 20, 0, 80, 20)


def test_a_key_reads_and_writes_one_state_in_a_batch(spark):
    """The text before is that of the last row kept, so no state of its own is read for it."""
    class Handle:
        calls, rows = [], []

        def getListState(self, name, schema):  # noqa: N802
            self.calls.append(name)
            return self

        def get(self):
            self.calls.append("get")
            return iter(self.rows)

        def put(self, rows):
            self.calls.append("put")
            self.rows[:] = rows

    schema = spark.createDataFrame([], "user bigint, id bigint, ts timestamp_ntz, text string").schema
    processor, handle = keyed._Consecutive("ts", "id", "text", schema, 2, None), Handle()
    processor.init(handle)
    row = Row("id", "ts", "user", "text")
    noon = dt.datetime(2026, 1, 1, 12)
    first = [row(3, noon, 1, "b"), row(2, noon, 1, "a"), row(9, None, 1, "a"), row(1, noon, 1, "a")]
    assert [tuple(r) for r in processor.handleInputRows(("k",), iter(first), None)] == [(1, 9, None, "a", 1), (1, 3, noon, "b", 2)]
    second = [row(5, noon, 1, "c"), row(4, noon, 1, "b")]
    assert [tuple(r) for r in processor.handleInputRows(("k",), iter(second), None)] == [(1, 5, noon, "c", 2)]
    assert handle.calls == ["history", "get", "put", "get", "put"] and [r[1] for r in handle.rows] == [3, 5]
