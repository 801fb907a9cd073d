"""Connected components of an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage

ROUNDS = 60
PART_ROWS = 1 << 18  # edges in a file of a round, about; with few edges there are LEAST_PARTS files
LEAST_PARTS = 8


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node with an edge.

    Each round points neighbours at smaller ones, until every node points at the smallest of its
    component. Rounds are staged, so lineage stays short; only a count and a checksum reach the driver.
    """
    links = stage(edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).distinct(), "edges")
    # A round never has more than two rows for an edge, so many shuffle partitions need not be as many files.
    parts = max(LEAST_PARTS, -(-2 * links.count() // PART_ROWS))
    before = None
    for _ in range(ROUNDS):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours larger than u point at the smallest around u.
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter("u != v")
        # Small star: u and its smaller neighbours point at the smallest of them.
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        links = stage(small.coalesce(parts), "edges")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(tops).coalesce(parts)
