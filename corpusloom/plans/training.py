"""Training items from a written corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.corpus import load_training_items


def prepare_training(spark: SparkSession, corpus: str, output: str | None = None) -> DataFrame:
    items = load_training_items(spark, corpus)
    if output:
        items.write.mode("overwrite").json(output)
    return items
