"""Periodic runs against brute force over words."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import queries, runs


def brute(x, min_length=12):
    found, n = {}, len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i + q - start >= max(min_length, 2 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def found_runs(x, min_length=12):
    return list(zip(*(a.tolist() for a in runs.find_runs(np.array(x, np.int64), min_length)), strict=True))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("x", [[], [1], [7] * 11, [7] * 12, [7] * 40, fibonacci(150), [0, 1] * 9 + [0] + [0, 1] * 9,
                               [1, 0] * 12 + [0, 1] * 12, list(range(6)) * 2, list(range(5)) * 2, list(range(50)) * 2,
                               [0] * 20 + [1] + [0] * 20 + [1] + [0] * 20])
def test_known_words(x):
    assert found_runs(x) == brute(x)


def test_all_short_binary_words():
    for n in (16, 17):
        for word in itertools.islice(itertools.product((0, 1), repeat=n), 0, None, 61):
            assert found_runs(word) == brute(word), word


@pytest.mark.parametrize("min_length", [1, 3, 12, 30])
def test_random_words(min_length):
    rng = random.Random(min_length)
    for _ in range(250):
        x = []
        while len(x) < rng.randint(1, 220):
            piece = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 12))]
            x += (piece * rng.randint(1, 9))[:rng.randint(1, 90)]
        assert found_runs(x, min_length) == brute(x, min_length), x


def rows():
    rng = random.Random(5)
    out = [(0, None), (1, ""), (2, " \n"), (3, "the " * 30), (4, "\x1f\x1c a"), (None, "a b " * 10), (3, "the " * 30)]
    for i in range(5, 90):
        vocabulary = [f"w{k}é" for k in range(rng.choice([2, 3, 60]))]
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        out.append((i, rng.choice([" ", "\t\n", "  "]).join(words)))
    return out + [(100, " ".join(f"u{i % 4111}" for i in range(30_000)))]


def test_operator_equals_brute_force(spark, docs):
    frame = docs(rows()).selectExpr("*", "lang AS runs", "source AS collapsed", "lang AS n_words").drop("n_chars")
    for row in runs.periodic_runs(frame, keep=["doc_id", "text"]).collect():
        tokens = (row.text or "").encode().split()
        expected = brute(tokens) if len(tokens) < 1000 else [(0, 30_000, 4111)]
        assert (row.n_words, [tuple(r) for r in row.runs]) == (len(tokens), expected)
        dropped = {i for s, n, q in expected for i in range(s + q, s + n)}
        assert row.collapsed.encode() == b" ".join(w for i, w in enumerate(tokens) if i not in dropped)


def test_query_equals_brute_force(spark, docs, tmp_path):
    docs(rows()).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op13_basic_factor_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text in rows():
        tokens = (text or "").encode().split()
        n, h = len(tokens), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            tokens = [tokens[k] if k < a else tokens[a + (k - a) % p] for k in range(n)]
        expected = brute(tokens) if n < 1000 else [(0, 30_000, 4111)]
        dropped = {k for s, length, q in expected for k in range(s + q, s + length)}
        best = min(expected, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = [hashlib.sha256(v).hexdigest() for v in (
            "".join(f"{s},{length},{q}\n" for s, length, q in expected).encode(),
            b" ".join(w for k, w in enumerate(tokens) if k not in dropped))]
        want.append((i, len(expected), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), *sha))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and len((t or "").split()) > 20 for i, t in rows())
    assert got == sorted(want, key=str)


def test_empty_table(spark, docs):
    assert runs.periodic_runs(docs([])).count() == 0
