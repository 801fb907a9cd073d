"""Streams with state of their own per key, joins of two streams, and the progress of a stream as a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import scratch_path
from .events import HISTORY, WATERMARK, drain

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROGRESS = "spark.sql.streaming.numRecentProgressUpdates"
PROGRESS = ("batch_id bigint, rows bigint, rows_per_second double, processed_per_second double, "
            "duration_ms bigint, state_rows bigint, late_rows bigint")
# Progress reports that are kept for a table, one for each micro-batch.
MOST_REPORTS = 100_000


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for the time of a block (``__`` in a name stands for a dot)."""
    names = {name.replace("__", "."): value for name, value in conf.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class _Consecutive(StatefulProcessor):
    """Keeps the rows of a key whose text differs from the one before; state: the last rows kept, of which the
    last has the text that the next row is compared with. It is read once and written once for a micro-batch."""

    def __init__(self, time: str, id_col: str, text: str, row: T.StructType, history: int, idle_ms: int | None):
        self.names = row.fieldNames()
        self.time, self.id, self.text = (self.names.index(c) for c in (time, id_col, text))
        self.is_plain = isinstance(row[time].dataType, T.TimestampNTZType)
        self.row, self.history_size, self.idle_ms = row, history, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("history", self.row)
        self.out = Row(*self.names, "history_size")

    def _order(self, row: tuple) -> tuple:
        return tuple((row[k] is not None, row[k]) if row[k] is not None else (False,) for k in (self.time, self.id))

    def _epoch_ms(self, time: datetime) -> int:
        return int((time.replace(tzinfo=timezone.utc) if self.is_plain else time).timestamp() * 1000)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = [tuple(r) for r in self.kept.get()]
        known, fresh, latest = held[-1][self.text] if held else None, [], None
        for row in sorted((tuple(r[c] for c in self.names) for r in rows), key=self._order):
            if row[self.text] != known:
                known = row[self.text]
                fresh.append(row)
            latest = row[self.time]
        if self.idle_ms is not None and latest is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(self._epoch_ms(latest) + self.idle_ms)
        if fresh:
            self.kept.put((held + fresh)[-self.history_size:])
        for i, row in enumerate(fresh):
            yield self.out(*row, min(self.history_size, len(held) + 1 + i))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_consecutive(events: DataFrame, key: str, time: str, id_col: str, text: str, history: int = HISTORY,
                      idle_ms: int | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Per key, events of a stream whose text differs from the one before, with ``history_size``.

    The state of a key is its last ``history`` kept rows (one at least), in a state store: a micro-batch
    reads and writes the state of its own keys only. With ``idle_ms``, a timer drops the state of a key once
    the watermark is so far behind its last event; rows that are later than the watermark are then dropped. The rows of a key in one micro-batch are sorted together, so the size of
    a micro-batch bounds what a task holds; rows of later batches come after those of earlier ones. A null
    time comes first within its batch. Null and empty texts are no texts and are left out.
    """
    narrow = events.select(key, id_col, time, text).filter(F.coalesce(F.col(text), F.lit("")) != "")
    out = T.StructType([*narrow.schema.fields, T.StructField("history_size", T.LongType())])
    processor = _Consecutive(time, id_col, text, T.StructType(narrow.schema.fields), history, idle_ms)
    if idle_ms is not None:
        narrow = narrow.withWatermark(time, watermark)
    # The state store takes no null key, so a null one is told apart by a column of its own.
    whole = narrow.withColumns({"_none": F.col(key).isNull(), "_key": F.coalesce(F.col(key).cast("string"), F.lit(""))})
    return whole.groupBy("_none", "_key").transformWithState(
        processor, out, "Append", "None" if idle_ms is None else "EventTime")


def run_into(stream: DataFrame, target: str) -> DataFrame:
    """Run what is available of an append stream into ``target``; called again, it goes on where it was.

    State is kept in RocksDB, on disk beside the executors and in the checkpoint.
    """
    spark = stream.sparkSession
    with settings(spark, **{_STORE.replace(".", "__"): _ROCKS}):
        stream.writeStream.format("parquet").outputMode("append").option("path", target) \
            .option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start().awaitTermination()
    return drain(spark, target, stream.schema)


def keyed_history(spark: SparkSession, target: str) -> DataFrame:
    """The rows that the keys' histories hold, read from the state that ``run_into`` left."""
    with settings(spark, **{_STORE.replace(".", "__"): _ROCKS}):
        state = spark.read.format("statestore").option("stateVarName", "history").load(f"{target}-state")
        return state.select("list_element.*")


def join_responses(questions: DataFrame, answers: DataFrame, key: str, time: str, within: str,
                   watermark: str = WATERMARK) -> DataFrame:
    """Each question of one stream with the answers of another that follow it within ``within``.

    Columns: ``key``, the question's ``event_id`` and ``asked``, the answer's ``answer_id`` and
    ``answered``. A question without an answer comes out, with nulls, once both watermarks have passed the
    time in which it could come. The watermarks and the bound on times let the state of old rows be dropped.
    Rows with a null key or time take no part.
    """
    span = F.expr(f"INTERVAL {within}")
    asked = questions.select(F.col(key).alias("key"), "event_id", F.col(time).cast("timestamp").alias("asked")) \
        .withWatermark("asked", watermark).filter("key IS NOT NULL AND asked IS NOT NULL")
    answered = answers.select(F.col(key).alias("answer_key"), F.col("event_id").alias("answer_id"),
                              F.col(time).cast("timestamp").alias("answered")) \
        .withWatermark("answered", watermark).filter("answer_key IS NOT NULL AND answered IS NOT NULL")
    joined = asked.join(answered, (F.col("key") == F.col("answer_key")) & (F.col("answered") >= F.col("asked"))
                        & (F.col("answered") <= F.col("asked") + span), "leftOuter")
    return joined.select("key", "event_id", "asked", "answer_id", "answered")


def progress_table(query: StreamingQuery) -> DataFrame:
    """What a query has reported per micro-batch: rows, rates, duration, rows of state, rows dropped as late.

    Batches without rows, which only move a watermark, are left out unless they have state.
    """
    rows = []
    for report in query.recentProgress:
        state = report["stateOperators"]
        rows.append((report["batchId"], report["numInputRows"], report["inputRowsPerSecond"], report["processedRowsPerSecond"],
                     report["durationMs"].get("triggerExecution"), sum(s["numRowsTotal"] for s in state),
                     sum(s.get("numRowsDroppedByWatermark", 0) for s in state)))
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.getActiveSession()
    table = spark.createDataFrame([(b, n, float(i or 0), float(p or 0), d, s, late) for b, n, i, p, d, s, late in rows], PROGRESS)
    return table.filter("rows > 0 OR state_rows > 0")


def run_with_progress(stream: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Run an append stream over all that is available; its table, and its ``progress_table``."""
    spark = stream.sparkSession
    target = scratch_path(spark, label)
    with settings(spark, **{_PROGRESS.replace(".", "__"): str(MOST_REPORTS)}):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", target) \
            .option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start()
        query.awaitTermination()
    return drain(spark, target, stream.schema), progress_table(query)


def backlog(progress: DataFrame, total: int) -> DataFrame:
    """Add ``backlog``, the rows that wait after each batch, of ``total`` in all. One row per batch."""
    so_far = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return progress.withColumn("backlog", F.lit(total) - F.sum("rows").over(so_far))


def stage_counts(captured: DataFrame, processed: DataFrame, generated: DataFrame) -> DataFrame:
    """One row: events captured, processed and answered, and what waits between the stages."""
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in
              ((captured, "captured"), (processed, "processed"), (generated, "generated"))]
    both = counts[0].unionByName(counts[1], allowMissingColumns=True).unionByName(counts[2], allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns)).withColumns({
        "waiting": F.col("captured") - F.col("processed"), "unanswered": F.col("processed") - F.col("generated")})
