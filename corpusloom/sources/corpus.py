"""Reading a written corpus back: its splits, its manifest and its training items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import SPACE
from ..operators.mapping import training_items
from ..schema import UNIFIED
from .inventory import plain_path

# Lists are JSON texts in the written files, so every field is read as text first.
_TEXT_FIELDS = T.StructType([T.StructField(f.name, T.StringType()) for f in UNIFIED]
                            + [T.StructField("rec_id", T.StringType())])


def _typed(record, field: T.StructField):
    value = record[field.name]
    if isinstance(field.dataType, T.ArrayType):
        return F.from_json(value, "array<string>").alias(field.name)
    return value.try_cast(field.dataType).alias(field.name)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Records of all splits with a ``split`` column; bad lines are skipped, a missing split is empty.

    The split comes from the folder (``split=train/``) or the file name (``train.jsonl``,
    ``train_003.jsonl``). A field absent from a record is null.
    """
    lines = spark.read.option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "*.{json,jsonl}").text(path)
    file = plain_path(F.col("_metadata.file_path"))
    split = F.regexp_extract(file, r"(?:/split=|/)(train|validation|test)(?:/|_[0-9]+\.|\.)", 1)
    rows = lines.select("value", split.alias("split")) \
        .filter((F.col("split") != "") & F.rlike("value", F.lit(f"[^{SPACE}]")))
    parsed = rows.withColumn("_ok", F.try_parse_json("value").isNotNull()).filter("_ok") \
        .select("split", F.from_json("value", _TEXT_FIELDS).alias("record")).filter("record IS NOT NULL")
    record = F.col("record")
    return parsed.select("split", record["rec_id"].alias("rec_id"), *[_typed(record, f) for f in UNIFIED])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as (metric, key, n)."""
    return spark.read.schema("metric string, `key` string, n bigint").json(f"{path.rstrip('/')}/manifest")


def load_training_items(spark: SparkSession, path: str) -> DataFrame:
    """Training items of a written corpus; a path that does not exist is an error."""
    return training_items(read_splits(spark, path))
