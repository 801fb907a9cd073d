"""Exact seeded splits, ranks and shards without one task per group.

A row's place in its group is its place in the order of ``md5(seed:id)``. The hash is uniform, so
its first four hex digits cut every group into 65,536 equal buckets. Counting buckets gives the rank
at which each bucket starts; only ranks inside a bucket need sorting. A group that holds a third of
all rows is thus spread over 65,536 sort groups, and the running sum over buckets has a fixed bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

TRAIN, VALIDATION = 0.9, 0.05
_KEY, _BUCKET = "_shuffle_key", "_bucket"


def shuffle_key(seed: str, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def with_shuffle_key(df: DataFrame, seed: str, id_col: str) -> DataFrame:
    keyed = df.withColumn(_KEY, shuffle_key(seed, id_col))
    return keyed.withColumn(_BUCKET, F.conv(F.substring(_KEY, 1, 4), 16, 10).cast("int"))


def _group_names(keys: list[str]) -> list[str]:
    return [f"_group_{i}" for i in range(max(1, len(keys)))]


def _with_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """The group columns as text that is never null, so that plain equality joins them."""
    if not keys:
        return df.withColumn("_group_0", F.lit("all"))
    return df.withColumns({
        name: F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
        for name, key in zip(_group_names(keys), keys)})


def _join_groups(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Equi-join on ``names``; the right side's copies carry a suffix."""
    renamed = right.withColumnsRenamed({n: f"{n}_r" for n in names})
    condition = F.col(names[0]) == F.col(f"{names[0]}_r")
    for name in names[1:]:
        condition = condition & (F.col(name) == F.col(f"{name}_r"))
    return left.join(renamed, condition, how)


def bucket_starts(keyed: DataFrame, groups: list[str]) -> DataFrame:
    """Per group and bucket: rows, rows in earlier buckets, and rows of the whole group."""
    counts = keyed.groupBy(*groups, _BUCKET).agg(F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*groups)
    earlier = whole.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *groups, _BUCKET, "_rows",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(whole).alias("_total"))


def exact_rank(df: DataFrame, keys: list[str], id_col: str, seed: str) -> DataFrame:
    """Add ``rank`` (from 1, in hash order within the group) and ``group_rows``."""
    groups = _group_names(keys)
    keyed = with_shuffle_key(_with_groups(df, keys), seed, id_col)
    starts = bucket_starts(keyed, groups)
    local = Window.partitionBy(*groups, _BUCKET).orderBy(_KEY, id_col)
    placed = keyed.withColumn("_local", F.row_number().over(local))
    joined = _join_groups(placed, starts, groups + [_BUCKET], "inner")
    return joined.select(
        *df.columns,
        (F.col("_before") + F.col("_local")).cast("bigint").alias("rank"),
        F.col("_total").cast("bigint").alias("group_rows"))


def split_limits(total: Column, train: float, validation: float) -> tuple[Column, Column]:
    """Last rank of train, and last rank of validation."""
    n = total.cast("double")
    last_train = F.floor(n * F.lit(train)).cast("bigint")
    return last_train, last_train + F.floor(n * F.lit(validation)).cast("bigint")


def split_cuts(df: DataFrame, keys: list[str], id_col: str, seed: str,
               train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """One row per group: the hash of its last train row and of its last validation row.

    Only the few buckets that hold a cut are ranked; all other rows are just counted.
    """
    groups = _group_names(keys)
    narrow = with_shuffle_key(_with_groups(df.select(id_col, *[k for k in keys if k != id_col]), keys),
                              seed, id_col)
    starts = bucket_starts(narrow, groups)
    last_train, last_validation = split_limits(F.col("_total"), train, validation)
    wanted = (
        starts.withColumn("_cut", F.explode(F.array(
            F.struct(F.lit(1).alias("side"), last_train.alias("rank")),
            F.struct(F.lit(2).alias("side"), last_validation.alias("rank")))))
        .filter((F.col("_cut.rank") > F.col("_before"))
                & (F.col("_cut.rank") <= F.col("_before") + F.col("_rows")))
        .select(*groups, _BUCKET, F.col("_cut.side").alias("_side"),
                (F.col("_cut.rank") - F.col("_before")).alias("_local_rank"))
    )
    near = _join_groups(narrow, wanted, groups + [_BUCKET], "inner") \
        .select(*groups, _BUCKET, "_side", "_local_rank", _KEY)
    local = Window.partitionBy(*groups, _BUCKET, "_side").orderBy(_KEY)
    found = near.withColumn("_local", F.row_number().over(local)) \
        .filter(F.col("_local") == F.col("_local_rank"))
    return found.groupBy(*groups).agg(
        F.max(F.when(F.col("_side") == 1, F.col(_KEY))).alias("_train_cut"),
        F.max(F.when(F.col("_side") == 2, F.col(_KEY))).alias("_validation_cut"))


def assign_splits(df: DataFrame, keys: list[str], id_col: str = "rec_id", seed: str = "42",
                  train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    """Add ``split``: per group, floor(n·train) train, floor(n·validation) validation, rest test.

    The rows themselves are not shuffled: each compares its hash with the two cuts of its group.
    The table of cuts is staged, so the planner knows its size and broadcasts it only when small.
    """
    groups = _group_names(keys)
    cuts = stage(split_cuts(df, keys, id_col, seed, train, validation), "split-cuts")
    grouped = _with_groups(df, keys).withColumn(_KEY, shuffle_key(seed, id_col))
    joined = _join_groups(grouped, cuts, groups, "left")
    split = F.when(F.col(_KEY) <= F.coalesce(F.col("_train_cut"), F.lit("")), F.lit("train")) \
        .when(F.col(_KEY) <= F.coalesce(F.col("_validation_cut"), F.lit("")), F.lit("validation")) \
        .otherwise(F.lit("test"))
    return joined.select(*df.columns, split.alias("split"))


def stratified_split(df: DataFrame, id_col: str = "rec_id", seed: str = "42",
                     train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    return assign_splits(df, ["source_site", "difficulty"], id_col, seed, train, validation)


def global_split(df: DataFrame, id_col: str = "rec_id", seed: str = "42",
                 train: float = TRAIN, validation: float = VALIDATION) -> DataFrame:
    return assign_splits(df, [], id_col, seed, train, validation)


def assign_shards(df: DataFrame, shard_size: int, id_col: str = "rec_id", seed: str = "43",
                  split_col: str = "split") -> DataFrame:
    """Add ``rank`` within the split and ``shard``: ``(rank - 1) // shard_size``.

    A split of at most ``shard_size`` rows stays whole: its shard is null.
    """
    ranked = exact_rank(df, [split_col], id_col, seed)
    shard = F.floor((F.col("rank") - 1) / F.lit(shard_size)).cast("bigint")
    return ranked.withColumn("shard", F.when(F.col("group_rows") > shard_size, shard)) \
        .drop("group_rows")


def last_n_per_key(df: DataFrame, key: str, order: list[str], n: int = 10) -> DataFrame:
    """The last ``n`` rows per key. The limit is also applied before the shuffle, per map task."""
    latest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= n).drop("_n")
