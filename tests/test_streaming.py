"""Streams over all available input against the same operators on the batch table."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, splits
from corpusloom.queries import catalog
from corpusloom.queries.catalog import length_scorer
from corpusloom.streaming import events as streams

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    rows, n = [], 0
    for minute in range(60):
        for user in (1, 2, 3):
            n += 1
            text = None if n % 17 == 0 else "" if n % 13 == 0 else f"Write a function number {(n // 5) % 4}" + "!" * (n % 2)
            rows.append((n, user if n % 3 else 1, BASE + dt.timedelta(minutes=minute, seconds=user), text, float(n % 100)))
    df = spark.createDataFrame(rows, "event_id bigint, user_id int, ts timestamp, text string, confidence double")
    for first in (0, 20, 40):  # one file after the other, in the order of time
        inside = (F.minute("ts") >= first) & (F.minute("ts") < first + 20)
        df.filter(inside).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path, df.schema


@pytest.mark.parametrize("max_files", [1, 64])
def test_consecutive_equals_batch(spark, source, max_files):
    path, schema = source
    stream = streams.read_events(spark, path, schema, max_files=max_files)
    table, state = streams.run_consecutive(stream, "user_id", "ts", "event_id", "text", "t-consecutive")
    batch = dedup.drop_consecutive(spark.read.parquet(path), "user_id", "text", "ts", "event_id")
    assert table.select("event_id").exceptAll(batch.select("event_id")).isEmpty()
    assert table.count() == batch.count()
    sizes = {}
    for r in table.orderBy("ts", "event_id").collect():
        sizes.setdefault(r.user_id, []).append(r.history_size)
    assert all(s == [min(10, k + 1) for k in range(len(s))] for s in sizes.values())
    kept = table.drop("history_size")
    last = streams.read_history(spark, state, kept.schema)
    assert last.exceptAll(splits.last_n_per_key(kept, "user_id", ["ts", "event_id"])).isEmpty()
    assert last.count() == splits.last_n_per_key(kept, "user_id", ["ts", "event_id"]).count() > 0
    streams.clear_history(spark, state, kept.schema)
    assert streams.read_history(spark, state, kept.schema).isEmpty()


def test_empty_streams(spark, tmp_path):
    schema = "event_id bigint, user_id int, ts timestamp, text string"
    rows = spark.createDataFrame([], schema)
    stream = lambda: streams.read_events(spark, str(tmp_path), rows.schema)
    assert streams.run_consecutive(stream(), "user_id", "ts", "event_id", "text", "t-empty")[0].count() == 0
    assert streams.run_rolling_counts(streams.rolling_counts(stream(), "ts"), "t-empty").count() == 0
    good, failed = streams.run_responses(stream(), length_scorer, "t-empty")
    assert good.count() == failed.count() == 0
    assert streams.run_to_table(stream(), "t-empty").count() == 0


def test_polling_ends(spark, source):
    path, schema = source
    stream = streams.read_events(spark, path, schema).select("event_id")
    with pytest.raises(ValueError):
        streams.run_to_table(stream, "t-poll", {"processingTime": "1 second"})
    assert streams.run_to_table(stream, "t-poll", {"processingTime": "1 second"}, wait=15).count() == \
        spark.read.parquet(path).count()


def test_bounded_query_waits_for_all_events(spark, tmp_path, monkeypatch):
    rows = spark.range(12).selectExpr("id AS event_id", "CAST(id AS STRING) AS event_type")
    rows.repartition(12).write.parquet(str(tmp_path / "events"))
    slow = F.udf(lambda x: time.sleep(3) or x, "bigint")
    one = streams.read_events(spark, str(tmp_path / "events"), rows.schema, max_files=1)
    monkeypatch.setattr(catalog, "_stream", lambda *_: one.withColumn("event_id", slow("event_id")))
    assert catalog.r6_stream_bounded(spark, str(tmp_path)).count() == 12


def test_time_limit_keeps_what_is_committed(spark, source):
    path, schema = source
    slow = F.udf(lambda x: time.sleep(0.5) or x, "bigint")
    stream = streams.read_events(spark, path, schema, max_files=1).select(slow("event_id").alias("event_id"))
    began = time.time()
    table = streams.run_to_table(stream, "t-limit", {"processingTime": "1 second"}, wait=5)
    assert table.count() < spark.read.parquet(path).count() and time.time() - began < 40


def test_classify_and_gate_equal_batch(spark, source):
    path, schema = source
    make = lambda df: streams.gate(streams.emit_questions(df)).select("event_id")
    table = streams.run_to_table(make(streams.read_events(spark, path, schema)), "t-gate")
    batch = make(spark.read.parquet(path))
    assert table.exceptAll(batch).isEmpty() and table.count() == batch.count() > 0


def test_rolling_counts_equal_batch(spark, source):
    path, schema = source
    stream = streams.rolling_counts(streams.read_events(spark, path, schema, max_files=1), "ts", "1 minute")
    table = streams.run_rolling_counts(stream, "t-rates")
    batch = streams.rolling_counts(spark.read.parquet(path), "ts", "1 minute")
    assert table.exceptAll(batch).isEmpty() and batch.exceptAll(table).isEmpty()


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    schema = "event_id int, ts timestamp"
    for i, minutes in enumerate((120, 121, 0)):
        row = [(i, BASE + dt.timedelta(minutes=minutes))]
        spark.createDataFrame(row, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
        time.sleep(1.1)
    stream = streams.read_events(spark, str(tmp_path), spark.read.parquet(str(tmp_path)).schema, max_files=1)
    table = streams.run_rolling_counts(streams.rolling_counts(stream, "ts", "1 minute"), "t-late")
    assert sorted(r.window_start.hour for r in table.collect()) == [2, 2]


def test_responses_survive_failures(spark, source):
    path, schema = source
    questions = streams.read_events(spark, path, schema).filter("text IS NOT NULL").select("event_id", "text")
    good, failed = streams.run_responses(questions, length_scorer, "t-responses")
    assert good.count() > 0 and failed.count() > 0
    assert good.count() + failed.count() == spark.read.parquet(path).filter("text IS NOT NULL").count()


def test_consecutive_across_spans(spark):
    rows = [(i, "k", BASE + dt.timedelta(hours=h), t) for i, (h, t) in enumerate(
        [(0, "a"), (0, "a"), (5, "a"), (9, "b"), (9, ""), (20, "b"), (30, "a")])]
    df = spark.createDataFrame(rows, "event_id int, key string, ts timestamp, text string")
    kept = dedup.drop_consecutive(df, "key", "text", "ts", "event_id")
    assert sorted(r.event_id for r in kept.collect()) == [0, 3, 6]
