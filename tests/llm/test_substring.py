"""Substring dedup against a brute-force count of windows."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import fmindex, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Removed flags per distinct (id, text), in the operator's order of ids (one text per id)."""
    order = sorted({(float("inf") if i is None else i, t) for i, t in rows if t is not None})
    seen, out = set(), {}
    for i, t in order:
        words = WORD.findall(t)
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            if w in seen:
                gone[s:s + window] = [True] * window
            seen.add(w)
        out[i, t] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def compare(spark_docs, rows, window, **sizes):
    want = brute(rows, window)
    got = substring.without_repeats(spark_docs, window, **sizes).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    for r in got:
        key = (float("inf") if r.doc_id is None else r.doc_id, texts[r.doc_id])
        assert (r.n_words, r.n_removed, r.kept_words) == want.get(key, (0, 0, "")), r.doc_id


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "é", "naïve"] + [f"w{i}" for i in range(300)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 60))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.5 else \
                [rng.choice(vocabulary) for _ in range(rng.randint(1, 40))]
        sep = rng.choice([" ", "\n", "  \t"])
        rows.append((i * 3 % n if n % 3 else i, sep.join(words)))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"index_words": 64}, {"hot_bytes": 600, "index_words": 200}])
def test_equals_brute_force(docs, sizes):
    rows = corpus(5, 200)
    compare(docs(rows), rows, 20, **sizes)


def test_short_windows_and_repetitive_texts(docs):
    rows = [(1, "a b " * 40), (2, "a " * 100), (3, "b a " * 30 + "c"), (0, "x " * 21), (9, "x " * 20)]
    compare(docs(rows), rows, 20)
    compare(docs(rows), rows, 20, hot_bytes=50)


def test_edges(docs):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, "  \n"), (4, long), (4, long), (None, long), (5, long + " tail"), (6, "one")]
    frame = docs(rows)
    compare(frame, rows, 20)
    clash = frame.selectExpr("*", "text AS key", "doc_id AS oid", "lang AS ranges", "lang AS anchors")
    assert substring.without_repeats(clash).count() == len(rows)
    assert substring.without_repeats(docs([])).count() == 0


def test_two_texts_of_one_id_are_ordered_by_key(docs):
    long = " ".join(f"w{i}" for i in range(30))
    got = substring.without_repeats(docs([(1, long + " x"), (1, long + " y")])).collect()
    assert sorted(r.n_removed for r in got) == [0, 30]


def test_kept_text_keeps_the_layout(docs):
    long = " ".join(f"w{i}" for i in range(25))
    got = {r.doc_id: r for r in substring.without_repeats(
        docs([(1, f"Head\n\n{long}\nend"), (2, f" Top\t\n{long} \n\nRest  é\n"), (3, "clean  text\n")])).collect()}
    assert got[1].kept_text == f"Head\n\n{long}\nend"
    assert got[2].kept_text == " Top\t\nRest  é\n"
    assert got[3].kept_text == "clean  text\n"


def test_index_ranks_and_ranges():
    rng = np.random.default_rng(3)
    sequence = np.append(rng.integers(1, 5, 700), 0)
    index = fmindex.FMIndex(sequence)
    assert index.order.tolist() == sorted(range(701), key=lambda i: sequence[i:].tolist())
    symbol, place = rng.integers(0, 5, 200), rng.integers(0, 702, 200)
    transform = sequence[index.order - 1]
    assert index.matrix.rank(symbol, place).tolist() == [int((transform[:p] == s).sum())
                                                         for s, p in zip(symbol, place)]


def test_index_runs_take_little_memory():
    """What a worker holds for a run of the default size, besides the run's own rows."""
    half = substring.INDEX_WORDS // 80
    segments = 2 * half
    text = np.random.default_rng(11).integers(0, 50_000, (segments, 40))
    text[half:] = text[:half]
    rows = pa.RecordBatch.from_pydict({
        "route": np.arange(segments), "oid": np.arange(segments), "key": np.arange(segments),
        "start": np.zeros(segments, np.int32), "n": np.full(segments, 40, np.int32),
        "seg": pa.array([b" ".join(b"w%d" % w for w in row) for row in text.tolist()], pa.binary())})
    tracemalloc.start()
    try:
        found = list(substring._search_shards(20, substring.INDEX_WORDS)(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(f.num_rows for f in found) == half
    assert peak < 64 << 20
