"""Top-k search against brute force."""

import math
import random

import pytest

from corpusloom.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, uid string, codes string, id string"


def brute(rows, k=5, every=50):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in kept:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j) for j, v in kept if j != i]
        out += [(i, n + 1, j, -s) for n, (s, _, j) in enumerate(sorted(scored, key=lambda t: t[:2] + (t[2] or 0,))[:k])]
    return sorted(out, key=str)


def data(seed, n=400, dimensions=9):
    rng = random.Random(seed)
    vector = lambda: [rng.choice([0.0, 1.0, -2.0]) * rng.randint(0, 512) / 256 for _ in range(dimensions)]
    rows = [(i, vector()) for i in range(-100, n)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(50, rows[150][1]), (7, [1.0] * 3), (8, []), (100, vector())]
    return rows + [(150, None), (200, [1.0, None]), (250, [float("nan")] * dimensions), (9, [float("inf")] * 3),
                   (None, [2.0] * dimensions), (None, [-2.0] * dimensions)]


@pytest.mark.parametrize("blocks", [{}, {"rows": 37, "queries": 3}])
@pytest.mark.parametrize("k", [1, 5])
def test_equals_brute_force(spark, blocks, k):
    rows = data(k)
    frame = spark.createDataFrame([(*r, 1, "u", "c", "i") for r in rows], SCHEMA)
    got = topk.top_k(frame, k=k, **blocks).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k)


def test_fewer_rows_than_k_and_empty_table(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    few = [(0, [1.0]), (1, [-1.0]), (2, [0.0])]
    assert sorted(map(tuple, topk.top_k(frame(few)).collect())) == brute(few)
    assert topk.top_k(frame([(0, [1.0])])).count() == 0 and topk.top_k(frame([])).count() == 0
