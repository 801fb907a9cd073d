"""Writing splits, shards, manifests and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import stats
from ..operators.mapping import nested_as_json
from ..operators.splits import bucket_starts, with_shuffle_key

JSON_OPTIONS = {"ignoreNullFields": "false"}
# Formats a corpus can be written in.
OUTPUT_FORMATS = ("jsonl", "parquet")


def write_splits(df: DataFrame, path: str) -> None:
    """One folder of JSON lines per split: ``split=train`` and so on. Lists are JSON arrays."""
    df.write.mode("overwrite").options(**JSON_OPTIONS).partitionBy("split").json(path)


def in_shuffled_order(df: DataFrame, id_col: str, seed: str) -> DataFrame:
    """Rows range-partitioned by split and hash: neighbours in the shuffled order share a task."""
    keyed = with_shuffle_key(df, seed, id_col)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(tasks, "split", "_bucket")


def with_shards(df: DataFrame, shard_size: int, id_col: str = "rec_id", seed: str = "43") -> DataFrame:
    """Add ``shard`` (three digits at least) to rows in shuffled order, with one shuffle of the rows.

    The starts of the hash buckets are three splits times 65,536 buckets at most, so they are
    broadcast; the rank inside a bucket needs no further shuffle after the range partitioning.
    """
    starts = bucket_starts(with_shuffle_key(df.select("split", id_col), seed, id_col), ["split"])
    local = Window.partitionBy("split", "_bucket").orderBy("_shuffle_key", id_col)
    placed = in_shuffled_order(df, id_col, seed).withColumn("_local", F.row_number().over(local))
    joined = placed.join(F.broadcast(starts), ["split", "_bucket"])
    index = F.floor((F.col("_before") + F.col("_local") - 1) / F.lit(shard_size))
    whole = F.col("_total") <= shard_size
    digits = F.greatest(F.lit(3), F.length(index.cast("string")))
    return joined.withColumn("shard", F.when(whole, F.lit("all")).otherwise(
        F.lpad(index.cast("string"), digits, F.lit("0")))).select(*df.columns, "shard")


def write_shards(df: DataFrame, path: str, shard_size: int = 0, formats: tuple[str, ...] = ("jsonl",),
                 id_col: str = "rec_id", seed: str = "43") -> None:
    """Shuffled splits under ``<path>/<format>/split=…[/shard=…]``; lists are JSON texts."""
    unknown = set(formats) - set(OUTPUT_FORMATS)
    if unknown:
        raise ValueError(f"unknown output formats: {sorted(unknown)}")
    flat = nested_as_json(df)
    if shard_size > 0:
        rows, folders = with_shards(flat, shard_size, id_col, seed), ["split", "shard"]
    else:
        rows = in_shuffled_order(flat, id_col, seed) \
            .sortWithinPartitions("split", "_shuffle_key").drop("_shuffle_key", "_bucket")
        folders = ["split"]
    for fmt in formats:
        writer = rows.write.mode("overwrite").partitionBy(*folders)
        if fmt == "jsonl":
            writer.options(**JSON_OPTIONS).json(f"{path}/jsonl")
        else:
            writer.parquet(f"{path}/parquet")


def shard_counts(df: DataFrame, shard_size: int) -> DataFrame:
    """Manifest rows: ``shards`` (number per split) and ``shard`` (rows of ``split/shard``)."""
    sizes = df.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("rows"))
    whole = F.lit(shard_size <= 0) | (F.col("rows") <= shard_size)
    size = F.lit(max(shard_size, 1))
    numbered = sizes.withColumn("count", F.when(whole, F.lit(1)).otherwise(F.ceil(F.col("rows") / size)).cast("bigint"))
    counts = numbered.select(F.lit("shards").alias("metric"), F.col("split").alias("key"), F.col("count").alias("n"))
    each = numbered.select("split", "rows", whole.alias("whole"), F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"))
    digits = F.greatest(F.lit(3), F.length(F.col("i").cast("string")))
    name = F.when(F.col("whole"), F.lit("all")).otherwise(F.lpad(F.col("i").cast("string"), digits, F.lit("0")))
    rows = F.when(F.col("whole"), F.col("rows")).otherwise(F.least(size, F.col("rows") - F.col("i") * size))
    return counts.unionAll(each.select(F.lit("shard"), F.concat_ws("/", "split", name), rows.cast("bigint")))


def write_rejected(rejected: DataFrame, path: str) -> DataFrame:
    """Write what was rejected, with reasons, under ``<path>/rejected``; counts by format and reason."""
    target = f"{path}/rejected"
    rejected.write.mode("overwrite").parquet(target)
    return rejected.sparkSession.read.schema(rejected.schema).parquet(target) \
        .groupBy("format", "reason").agg(F.count(F.lit(1)).alias("n"))


def write_manifest(df: DataFrame, path: str, shard_size: int = 0, formats: tuple[str, ...] = ("jsonl",),
                   rejected: DataFrame | None = None) -> DataFrame:
    """Write the manifest as a few JSON lines and return it.

    Besides the counts of ``stats.manifest``: shards and their rows, output formats, and rejected
    records by ``format/reason``. Datasets are the keys of ``source_site``.
    """
    rows = stats.manifest(df).unionByName(shard_counts(df, shard_size))
    spark = df.sparkSession
    rows = rows.unionByName(spark.createDataFrame([("output_format", f, 1) for f in formats], "metric string, key string, n bigint"))
    if rejected is not None:
        rows = rows.unionByName(rejected.select(
            F.lit("rejected").alias("metric"), F.concat_ws("/", "format", "reason").alias("key"), "n"))
    return write_report(rows, f"{path}/manifest")


def write_report(df: DataFrame, path: str) -> DataFrame:
    """Write a small report as one JSON file and read it back."""
    df.coalesce(1).write.mode("overwrite").options(**JSON_OPTIONS).json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_inventory(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").parquet(path)
