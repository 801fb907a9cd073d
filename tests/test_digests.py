"""Reconciliation by digests against the anti join."""

import pytest

from corpusloom.operators import digests, stats


@pytest.mark.parametrize(("buckets", "fine"), [(4096, 1024), (7, 3), (1, 1)])
def test_equals_anti_join(spark, buckets, fine):
    inputs = spark.createDataFrame([(i, f"r{i % 7}") for i in range(3000)] + [(None, "none"), (5, "again"), (5, "again")], "rec_id bigint, n string")
    lost = {3, 4, 999, 2500}
    outputs = spark.createDataFrame([(i, "x") for i in range(3000) if i not in lost] + [(None, "x"), (7000, "more")], "rec_id bigint, other string")
    got, want = (f(inputs, outputs).collect() for f in (
        lambda a, b: digests.missing_by_digest(a, b, buckets=buckets, fine=fine), stats.missing_records))
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert {r.rec_id for r in got} == lost | {None}


def test_equal_buckets_are_not_joined(spark):
    inputs = spark.range(100_000).selectExpr("id AS rec_id")
    left, right = digests.candidates(inputs, inputs.filter("rec_id NOT IN (17, 42)"))
    assert left.count() <= 10 and right.count() <= 8 and {17, 42} <= {r.rec_id for r in left.collect()}
    left, right = digests.candidates(inputs, inputs)
    assert left.isEmpty() and right.isEmpty()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "rec_id bigint")
    some = spark.range(3).selectExpr("id AS rec_id")
    assert digests.missing_by_digest(none, some).isEmpty() and digests.missing_by_digest(some, none).count() == 3
