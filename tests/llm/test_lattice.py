"""Lattice scores against sums over all segmentations, and counts against plain counting."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from corpusloom.llm import lattice

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WEIGHTS = {**{bytes([b]): 0.001 for b in range(256)}, b" a": 2.0, b" ab": 1.0, b"b": 0.5, b"ab": 0.7, b"ba": 0.3,
           b" ": 0.1, "é".encode(): 0.2}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def all_segmentations(word, prob):
    """Probability of a word over every way to cut it."""
    marked, total = b" " + word, 0.0
    for cuts in itertools.product([False, True], repeat=len(marked) - 1):
        parts, start = [], 0
        for place, cut in enumerate([*cuts, True], 1):
            if cut:
                parts.append(marked[start:place])
                start = place
        total += math.prod(prob.get(p, 0.0) for p in parts)
    return total


def test_marginal_over_all_segmentations():
    pieces = lattice.make_pieces(WEIGHTS, 3.0)
    prob = {name: math.exp(log) for name, log in zip(pieces.names, pieces.logs, strict=True)}
    assert sum(prob.values()) + math.exp(pieces.end) == pytest.approx(1)
    names = [b"a", b"ab", b"abab", b"bba", "éa".encode(), b"\xff", b"zabba", b"a" * 9]
    got = lattice.word_logs(pa.array(names, pa.binary()), pieces)
    assert got == pytest.approx([math.log(all_segmentations(n, prob)) for n in names])


def test_long_words_agree_with_short_ones(monkeypatch):
    pieces = lattice.make_pieces(WEIGHTS, 3.0)
    names = pa.array([b"ab" * 15, b"abba" * 9, b"q" * 38], pa.binary())
    counts = np.array([1, 2, 3])
    short = lattice.word_logs(names, pieces), lattice.expected_counts(names, counts, pieces)
    monkeypatch.setattr(lattice, "ACROSS", 10)
    assert lattice.word_logs(names, pieces) == pytest.approx(short[0])
    assert lattice.expected_counts(names, counts, pieces) == pytest.approx(short[1])


def test_learning_raises_the_likelihood(spark):
    counts = spark.createDataFrame([(b"abab", 50), (b"ba", 30), (b"xyz", 5)], "word binary, n bigint")
    names, n = pa.array([b"abab", b"ba", b"xyz"], pa.binary()), np.array([50, 30, 5])
    def value(rounds):
        pieces = lattice.learn_pieces(counts, 10, WEIGHTS, rounds)
        return (lattice.word_logs(names, pieces) * n).sum() + 10 * pieces.end
    values = [value(k) for k in range(4)]
    assert values == sorted(values)


@pytest.mark.parametrize("frequent", [1 << 17, 3, 0])
def test_scores_equal_brute_force(docs, frequent):
    rows = [(i, f"The cat{i % 5} sat  on\tThe MAT{i % 7} é{i}") for i in range(60)] + \
        [(60, None), (61, ""), (62, "x" * 300), (None, "The end"), (7, "another text under seven"), (8, rows8 := "dup dup row"),
         (8, rows8)]
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in WORD.findall(lower(t)))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    counts[None] = len(train)
    weights = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    frame = docs(rows)
    clash = frame.selectExpr("*", "lang AS key", "text AS word", "n_chars AS n", "source AS score")
    got = lattice.score_documents(clash, weights, frequent=frequent).collect()
    assert len(got) == len(rows)

    def want(text):
        tokens = [*WORD.findall(lower(text)), None]
        return (len(tokens), sum(counts[t] > 0 for t in tokens), n,
                round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), 6))

    expected = Counter((i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, *want(t)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))
                   for r in got) == expected
    assert all(r.score < 0 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.n_tokens), set()).add(round(r.score, 9))
    assert all(len(s) == 1 for s in by_text.values())


def test_empty_table(docs):
    weights = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert lattice.score_documents(docs([]), weights).count() == 0
    only_held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lattice.score_documents(docs([(only_held, "some text")]), weights).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert row.score < 0
