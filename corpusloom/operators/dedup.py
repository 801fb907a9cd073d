"""Exact duplicates, consecutive duplicates and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import dedup_key


def exact_dedup(df: DataFrame, text_col: str = "question_text",
                order: list[str] | None = None) -> DataFrame:
    """First row, in the given order, of each group with the same key text.

    ``row_number() = 1`` is also applied inside every map task before the shuffle, so a group of
    copies sends at most one row per task, however large it is.
    """
    order = order or ["rec_id"]
    first = Window.partitionBy("_dedup_key").orderBy(*order)
    return (
        df.withColumn("_dedup_key", dedup_key(F.col(text_col)))
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") == 1)
        .drop("_dedup_key", "_n")
    )


def drop_consecutive(df: DataFrame, key: str, text_col: str, time_col: str, id_col: str,
                     span_seconds: int = 3600) -> DataFrame:
    """Rows whose text differs from the text before it of the same key.

    A key is cut into spans of time. Inside a span the text before is a plain ``lag``; the first row
    of a span looks at the last text of the key's span before it, which comes from a table with one
    row per key and span. So a key with a third of all rows is sorted in many small pieces.
    """
    filled = df.filter(F.coalesce(F.col(text_col), F.lit("")) != "") \
        .withColumn("_span", F.floor(F.unix_micros(F.col(time_col).cast("timestamp")) / F.lit(span_seconds * 1_000_000)))
    within = Window.partitionBy(key, "_span").orderBy(time_col, id_col)
    ends = filled.groupBy(key, "_span").agg(
        F.max_by(text_col, F.struct(time_col, id_col)).alias("_end"))
    starts = ends.select(
        F.col(key).alias("_k"), F.col("_span").alias("_s"),
        F.lag("_end").over(Window.partitionBy(key).orderBy("_span")).alias("_before_span"))
    marked = filled.withColumn("_lag", F.lag(text_col).over(within)) \
        .withColumn("_first", F.row_number().over(within) == 1)
    joined = marked.join(
        starts, marked[key].eqNullSafe(starts["_k"]) & marked["_span"].eqNullSafe(starts["_s"]), "inner")
    before = F.when(F.col("_first"), F.col("_before_span")).otherwise(F.col("_lag"))
    return joined.filter(~F.col(text_col).eqNullSafe(before)).select(*[marked[c] for c in df.columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; a column a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
