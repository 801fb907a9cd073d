"""Reconciling a written corpus with its inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import stats
from ..session import stage
from ..sinks.writers import write_report
from ..sources import inventory
from ..sources.corpus import read_splits


def input_files(spark: SparkSession, root: str, exclude: str | None = None) -> DataFrame:
    """Files with their dataset and number of entries."""
    files = inventory.route_to_datasets(inventory.list_files(spark, root, exclude))
    return inventory.exact_entries(spark, root, files)


def verify(spark: SparkSession, root: str, corpus: str, report: str | None = None) -> dict[str, DataFrame]:
    """Input profile, split profile, coverage, quality and summary, as tables."""
    files = stage(input_files(spark, root, corpus).select("dataset", "path", "length", "entries"),
                  "input-files")
    outputs = stage(read_splits(spark, corpus)
                    .select("split", "source_site", "difficulty", "language"), "outputs")
    per_dataset = files.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("files"), F.sum("entries").alias("entries"))
    tables = {
        "inputs": stats.input_profile(files),
        "splits": stats.split_profile(outputs),
        "coverage": stats.coverage(files, outputs),
        "quality": stats.quality_report(outputs),
        "summary": stats.summary(per_dataset, outputs),
    }
    if report:
        tables = {name: write_report(table, f"{report}/{name}") for name, table in tables.items()}
    return tables


def is_accepted(summary: DataFrame) -> bool:
    """Whether the job should succeed: some output, and a coverage above the limit."""
    return bool(summary.first()["accepted"])
