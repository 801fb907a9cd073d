"""Reconciling two large tables by digests: only where they differ are rows shuffled and joined.

A digest of a bucket is its number of rows and two sums of hashes, so it does not depend on order, counts
repeated rows, and is summed in the map tasks. Buckets that differ are cut into finer ones, which are
compared in the same way; then the rows of the fine buckets that still differ are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage

# Coarse buckets, and fine ones in each of them. At most BUCKETS * FINE small rows are compared.
BUCKETS, FINE = 4096, 1024


def _bucket(id_col: str, salt: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(parts)).cast("int")


def bucket_digests(rows: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """Count and sums of hashes of the ids in each bucket."""
    sums = [F.sum(F.xxhash64(F.lit(salt), F.col(id_col)).cast("decimal(38,0)")).alias(f"sum_{salt}") for salt in (1, 2)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def differing(left: DataFrame, right: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """The buckets of ``left`` whose digest ``right`` does not have."""
    facts = ["n", "sum_1", "sum_2"]
    return bucket_digests(left, id_col, by).join(bucket_digests(right, id_col, by), [*by, *facts], "left_anti").select(*by)


def candidates(inputs: DataFrame, outputs: DataFrame, id_col: str = "rec_id", buckets: int = BUCKETS,
               fine: int = FINE) -> tuple[DataFrame, DataFrame]:
    """The rows of either side with an id that lie in fine buckets that differ; outputs are ids alone."""
    cut = [_bucket(id_col, 3, buckets).alias("_bucket"), _bucket(id_col, 4, fine).alias("_fine")]
    left = inputs.filter(F.col(id_col).isNotNull()).select("*", *cut)
    right = outputs.filter(F.col(id_col).isNotNull()).select(id_col, *cut)
    coarse = stage(differing(left, right, id_col, ["_bucket"]), "differing-buckets")  # at most ``buckets`` numbers
    left, right = (side.join(F.broadcast(coarse), "_bucket", "left_semi") for side in (left, right))
    finer = stage(differing(left, right, id_col, ["_bucket", "_fine"]), "differing-buckets")
    return tuple(side.join(finer, ["_bucket", "_fine"], "left_semi").drop("_bucket", "_fine") for side in (left, right))


def missing_by_digest(inputs: DataFrame, outputs: DataFrame, id_col: str = "rec_id", buckets: int = BUCKETS,
                      fine: int = FINE) -> DataFrame:
    """Input rows with no output row of the same id, as ``stats.missing_records``.

    Where nearly all rows agree, nearly none is shuffled. A row without an id has no counterpart.
    """
    left, right = candidates(inputs, outputs, id_col, buckets, fine)
    return left.join(right.select(id_col), id_col, "left_anti").select(*inputs.columns) \
        .unionByName(inputs.filter(F.col(id_col).isNull()))
