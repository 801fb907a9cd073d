"""Benchmark windows against brute force over words."""

import random
import re

import pytest

from corpusloom.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, items, window=10):
    windows = []
    for i, t in items:
        w = WORD.findall(low(t))
        size = min(window, len(w))
        windows += [("" if i is None else str(i), tuple(w[s:s + size])) for s in range(len(w) - size + 1) if size]
    out = []
    for i, t in rows:
        w, hit, found = WORD.findall(low(t)), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def data(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "é", "x1", "9", "日本"]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(passage(rng.choice([12, 14, 20, 30])))) for i in range(12)]
    items += [(100, "unique words"), (101, "Rare"), (102, None), (103, "!!"), (None, "nobody's item"), (100, "unique words")]
    rows = []
    for i in range(60):
        words = passage(rng.randint(0, 30))
        if rng.random() < 0.5:
            words += rng.choice(items[:12])[1].split() + passage(3)
        if rng.random() < 0.2:
            words += ["UNIQUE,", "words!", "rare?", "nobody's", "item"]
        rows.append((i, rng.choice([" ", ", ", "\n- "]).join(words)))
    return rows + [(70, None), (71, ""), (72, "?!"), (None, "rare"), (3, rows[3][1])], items


@pytest.mark.parametrize("block_bytes", [1 << 25, 150])
def test_equals_brute_force(spark, docs, block_bytes):
    rows, items = data(6)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    frame = docs(rows).selectExpr("*", "lang AS n_words", "lang AS items", "text AS spans")
    got = decontam.contamination(frame, benchmark, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in got), key=str) == brute(rows, items)


def test_spans_point_into_the_original(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    benchmark = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    text = "Ünïcödé — start. ONE, two\nthree four five six seven eight nine TEN! end"
    row = decontam.contamination(docs([(1, text)]), benchmark).first()
    assert row.n_hit == 10 and [text[s.start:s.stop] for s in row.spans] == \
        ["ONE, two\nthree four five six seven eight nine TEN"]


def test_empty_tables(spark, docs):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contamination(docs([(1, "x")]), nothing).first().n_hit == 0
    assert decontam.contamination(docs([]), nothing).count() == 0


def test_blocks_hold_each_item_once(spark):
    items = [(i, f"item {i} " + "w " * i) for i in range(40)] + [(3, "item 3 w w w "), (None, "item"), (7, None)]
    benchmark = spark.createDataFrame(items * 2, "item_id bigint, text string")
    folder, n = decontam.write_items(benchmark, "item_id", "text", limit=200)
    blocks = [decontam.read_block(folder, k) for k in range(n)]
    held = [item for block in blocks for item in block]
    assert n > 5 and len(held) == len(set(held)) and max(map(len, blocks)) < len(held)
    assert set(held) == {("" if i is None else str(i), t) for i, t in items if t is not None}
    assert decontam.read_block(folder, n) == []
