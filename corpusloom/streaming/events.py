"""Operators on streams of text events, which also run on batch tables.

An event has a key, a time, an id, a text and a confidence. The watermark is our addition.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.classify import detect_question
from ..operators.dedup import drop_consecutive
from ..operators.filters import is_emitted, passes_gate
from ..operators.scoring import responses, score_batches
from ..operators.splits import last_n_per_key
from ..session import scratch_path

HISTORY = 10
WATERMARK = "10 minutes"


def read_events(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet",
                max_files: int = 64) -> DataFrame:
    """A stream of Parquet files; ``max_files`` bounds a micro-batch, and so the work per key in it."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob) \
        .option("maxFilesPerTrigger", max_files).parquet(path)


def run_to_table(stream: DataFrame, label: str, trigger: dict[str, Any] | None = None,
                 wait: float | None = None, whole: bool = False) -> DataFrame:
    """Run an append stream into a Parquet table and return that table.

    All available input by default. A polling ``trigger`` needs ``wait``, the seconds after which the
    stream is stopped with what is committed by then, or ``whole``: it is stopped once all input is.
    """
    if trigger and "processingTime" in trigger and wait is None and not whole:
        raise ValueError("a polling stream does not end by itself: pass wait or whole")
    spark = stream.sparkSession
    target = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", f"{target}-state")
        .trigger(**(trigger or {"availableNow": True})).start())
    try:
        if whole:
            query.processAllAvailable()
        else:
            query.awaitTermination() if wait is None else query.awaitTermination(wait)
    finally:
        query.stop()
    return drain(spark, target, stream.schema)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def drain(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Everything a stream has written so far; an empty table if that is nothing."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


def event_id(*parts: str) -> Column:
    """An id that depends on the event alone."""
    return F.xxhash64(*[F.col(p) for p in parts])


def classify(events: DataFrame, text: str = "text") -> DataFrame:
    """Add the question decision and its confidence."""
    found = events.withColumn("_found", detect_question(F.col(text)))
    return found.withColumns({
        "is_question": F.col("_found.is_question"),
        "question_confidence": F.col("_found.confidence")}).drop("_found")


def emit_questions(events: DataFrame, text: str = "text") -> DataFrame:
    """Classified events that are questions."""
    return classify(events, text).filter(is_emitted(F.col(text), F.col("is_question")))


def gate(events: DataFrame, text: str = "text", confidence: str = "confidence",
         is_question: str = "is_question", min_confidence: float = 70.0) -> DataFrame:
    return events.filter(passes_gate(F.col(text), F.col(confidence), F.col(is_question), min_confidence))


def _ranked(kept: DataFrame, key: str, time: str, id_col: str, span_seconds: int) -> DataFrame:
    """Add ``_nth``, the place of a row among those of its key, from 1.

    Rows are sorted within spans of time only; the counts of the spans before are added.
    """
    cut = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(span_seconds * 1_000_000))
    spans = kept.withColumn("_span", F.coalesce(cut, F.lit(-(1 << 62))))
    before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.groupBy(F.col(key).alias("_k"), F.col("_span").alias("_s")).agg(F.count(F.lit(1)).alias("_rows")) \
        .select("_k", "_s", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    placed = spans.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_span").orderBy(time, id_col)))
    joined = placed.join(starts, placed[key].eqNullSafe(starts["_k"]) & (placed["_span"] == starts["_s"]))
    return joined.select(*kept.columns, (F.col("_before") + F.col("_place")).alias("_nth"))


def run_consecutive(events: DataFrame, key: str, time: str, id_col: str, text: str, label: str,
                    history: int = HISTORY, span_seconds: int = 3600, watermark: str = WATERMARK,
                    trigger: dict[str, Any] | None = None, target: str | None = None) -> tuple[DataFrame, str]:
    """Per key, events whose text differs from the one before; the table, and the folder of the histories.

    Each micro-batch runs ``drop_consecutive`` over its rows and the last kept text of each key, so no
    key is gathered in one task. ``history_size`` is the number of texts that the key's history holds
    then, ``history`` at most. The state is a table of the last ``history`` kept rows of each key, written
    per batch. An event that is older than its key's last kept row by more than ``watermark`` is late and
    dropped. A batch that is run again overwrites what it wrote. With the ``target`` of an earlier run, the
    stream goes on where that one ended.
    """
    spark = events.sparkSession
    target = target or scratch_path(spark, label)
    narrow = events.select(key, id_col, time, text)
    state = f"{target}-history"

    def write(batch: DataFrame, batch_id: int) -> None:
        old = read_history(spark, state, narrow.schema, before=batch_id)
        last = old.groupBy(F.col(key).alias("_k")).agg(
            F.max(time).alias("_last"), F.count(F.lit(1)).alias("_old"))
        known = batch.join(last, batch[key].eqNullSafe(last["_k"]), "left")
        timely = known.filter(F.col("_last").isNull() | F.col(time).isNull() | (
            F.col(time).cast("timestamp") >= F.col("_last").cast("timestamp") - F.expr(f"INTERVAL {watermark}")))
        fresh = timely.select(*batch.columns, F.lit(True).alias("_new"))
        newest = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(id_col).desc())
        ends = old.withColumn("_n", F.row_number().over(newest)).filter("_n = 1") \
            .select(*batch.columns, F.lit(False).alias("_new"))
        kept = drop_consecutive(fresh.unionByName(ends), key, text, time, id_col, span_seconds) \
            .filter("_new").drop("_new")
        ranked = _ranked(kept, key, time, id_col, span_seconds)
        sized = ranked.join(last, ranked[key].eqNullSafe(last["_k"]), "left").select(
            *batch.columns, F.least(F.lit(history), F.coalesce("_old", F.lit(0)) + F.col("_nth"))
            .cast("bigint").alias("history_size"))
        sized.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        written = spark.read.schema(sized.schema).parquet(f"{target}/batch={batch_id}").select(*batch.columns)
        last_n_per_key(old.unionByName(written), key, [time, id_col], history) \
            .write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    query = narrow.writeStream.option("checkpointLocation", f"{target}-state") \
        .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
    query.awaitTermination()
    schema = T.StructType([*narrow.schema.fields, T.StructField("history_size", T.LongType())])
    return drain(spark, target, schema), state


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches below a folder: names alone, one for each micro-batch."""
    if not _exists(spark, folder):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))


def read_history(spark: SparkSession, folder: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The last kept rows of each key, after the newest batch (or the newest one below ``before``)."""
    numbers = [n for n in _batches(spark, folder) if before is None or n < before]
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/batch={numbers[-1]}")


def clear_history(spark: SparkSession, folder: str, schema: T.StructType) -> None:
    """Empty the histories: the next batch starts without texts."""
    for number in _batches(spark, folder)[-1:]:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def rolling_counts(events: DataFrame, time: str, width: str = "1 minute",
                   by: list[str] | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Events per window; state of windows behind the watermark is dropped."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark(time, watermark)
    return timed.groupBy(F.window(time, width), *(by or [])).agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("window.start").alias("window_start"), *(by or []), F.col("n").cast("bigint"))


def run_rolling_counts(counts: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Run ``rolling_counts`` in update mode; the table keeps the latest count of each window."""
    spark = counts.sparkSession
    target = scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the folder of this batch makes a retry harmless.
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    counts.writeStream.outputMode("update").option("checkpointLocation", f"{target}-state") \
        .trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    schema = T.StructType(counts.schema.fields + [T.StructField("batch", T.LongType())])
    return drain(spark, target, schema).groupBy("window_start", *(by or [])) \
        .agg(F.max_by("n", "batch").alias("n"))


def run_responses(questions: DataFrame, scorer: Callable[[list[str]], list[str]], label: str,
                  question: str = "text") -> tuple[DataFrame, DataFrame]:
    """Answer each question of the stream: the table of responses and that of failed questions."""
    spark = questions.sparkSession
    target = scratch_path(spark, label)

    def write(batch: DataFrame, batch_id: int) -> None:
        done = responses(score_batches(batch, scorer, question), question)
        done.write.mode("overwrite").partitionBy("failed").parquet(f"{target}/batch={batch_id}")

    questions.writeStream.option("checkpointLocation", f"{target}-state") \
        .trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    schema = responses(score_batches(spark.createDataFrame([], questions.schema), scorer, question),
                       question).schema
    table = drain(spark, target, schema)
    return table.filter(~F.col("failed")), table.filter("failed")
