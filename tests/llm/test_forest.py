"""Near duplicates against all pairs of sets, and the component joins against union-find."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import components, forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    ids = sorted(sets)
    pairs = []
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
    top = union(pairs, ids)
    return {i: (len(sets[i]), top[i], top[i] == i) for i in ids}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 20 + [f"w{i}" for i in range(400)]
    rows, i = [], 0
    while i < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 40, 120, 300]))]
        for _ in range(rng.choice([1, 1, 1, 2, 3, 12, 60])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 20, len(base) // 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = " ".join(copy)
            rows.append((i * 7919 % 100_003, text.upper() if rng.random() < 0.1 else text))
            i += 1
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_all_pairs(docs, size):
    rows = corpus(size, 500)
    want = brute(rows, size)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
           for r in forest.component_table(docs(rows), size).collect()}
    assert len(got) == len(rows)
    wrong = {i for i in want if got[i] != want[i]}
    assert {i for i in want if got[i][0] != want[i][0]} == set()
    assert len(wrong) <= 0.01 * len(rows), len(wrong)  # candidates are found with high probability, not surely


@pytest.mark.parametrize("common", [3, 256])
def test_large_regions_equal_all_pairs(docs, monkeypatch, common):
    monkeypatch.setattr(forest, "BLOCK_ROWS", 4)
    monkeypatch.setattr(forest, "COMMON", common)
    rows = corpus(7, 400)
    want = brute(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in forest.component_table(docs(rows), 2).collect()}
    assert sum(got[i] != want[i] for i in want) <= 0.01 * len(rows)


@pytest.mark.parametrize("common", [2, 1000])
def test_prefixes_leave_no_link_out(docs, spark, monkeypatch, common):
    monkeypatch.setattr(forest, "COMMON", common)
    rows = corpus(11, 300)
    sets = {i: shingles(t, 2) for i, t in rows}
    frame = docs(rows).selectExpr("doc_id AS oid", "hash(text) + 0L AS key", "text")
    own = frame.selectExpr("oid AS node", "oid AS component")
    pairs, held = forest._by_prefix(own, frame, 2, 80)
    pairs, held = {(r.a, r.b) for r in pairs.collect()}, {r.node for r in held.collect()}
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(links) > 500
    assert all(link in pairs or set(link) <= held for link in links)
    if common == 1000:
        assert not held and links <= pairs and len(pairs) < 2 * len(links)


def test_many_texts_of_one_template_are_not_compared_in_blocks(docs, monkeypatch):
    def refused(*_):
        raise AssertionError("compared in blocks")

    monkeypatch.setattr(forest, "_compared", refused)
    shared = " ".join(f"t{i}" for i in range(82))
    rows = [(i, shared + " " + " ".join(f"x{i - i % 2 if i < 100 else i}_{k}" for k in range(18)) + " end" * (i % 2))
            for i in range(20_000)]
    got = {r.doc_id: r.component_id for r in forest.component_table(docs(rows).repartition(8), 2).collect()}
    assert got == {i: i - i % 2 if i < 100 else i for i in range(20_000)}


def test_star_of_copies_that_do_not_link_with_each_other(docs):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(300):
        copy = list(base)
        for place in rng.sample(range(200), 9):
            copy[place] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(copy)))
    got = forest.component_table(docs(rows), 2).collect()
    assert {r.component_id for r in got} == {0}


def test_large_family_near_the_threshold(docs):
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(401)], []
    for i in range(2000):
        copy = list(base)
        for place in rng.sample(range(401), rng.choice([13, 14, 15, 16])):
            copy[place] = f"x{i}_{place}"
        rows.append((i, " ".join(copy)))
    sets = [shingles(t, 2) for _, t in rows]
    number = {s: k for k, s in enumerate(sorted(shingles(" ".join(base), 2)))}
    inside = np.zeros((len(rows), len(number)), np.float32)
    for i, s in enumerate(sets):  # copies share nothing but what is left of the first text
        inside[i, [number[x] for x in s if x in number]] = 1
    both, size = (inside @ inside.T).astype(int), np.array([len(s) for s in sets])
    linked = 100 * both >= 80 * (size[:, None] + size - both)
    want = union([(a, b) for a, b in np.argwhere(linked).tolist() if a < b], range(len(rows)))
    assert 100 < sum(want[i] == i for i in want) < 1900
    got = {r.doc_id: r.component_id for r in forest.component_table(docs(rows), 2).collect()}
    assert got == want


def test_edges(docs):
    text = "one two three four five six seven"
    frame = docs([(3, text), (3, text), (5, text.upper()), (None, text), (None, "alone x y"), (8, None), (9, ""),
                  (9, " \n"), (10, "word"), (11, "word"), (12, "Word other"), (20, "word"), (20, "q r s")])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in
                  forest.component_table(frame, 2).collect()), key=str)
    want = [(3, 6, 3, True), (3, 6, 3, True), (5, 6, 3, False), (None, 6, 3, False), (None, 2, None, True),
            (8, 0, 8, True), (9, 0, 9, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False),
            (12, 1, 12, True), (20, 1, 10, False), (20, 2, 10, False)]
    assert got == sorted(want, key=str)
    clash = frame.selectExpr("*", "text AS digest", "doc_id AS node", "lang AS key", "lang AS a", "lang AS n")
    assert forest.component_table(clash, 2).count() == 13
    assert forest.component_table(docs([]), 2).count() == 0


def test_component_joins(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)]
    got = {r.node: r.component for r in
           components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = union(pairs, {x for p in pairs for x in p})
    assert got == {n: c for n, c in want.items() if n in got}
    assert set(got) == {x for a, b in pairs if a != b for x in (a, b)}


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    """Few edges are not spread over a file for each shuffle partition in every round."""
    written, stage = [], components.stage

    def counted(df, label):
        out = stage(df, label)
        written.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(components, "stage", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        edges = spark.range(200).selectExpr("id - id % 20 AS a", "id AS b")
        found = {r.node: r.component for r in components.components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {i: i - i % 20 for i in range(200)}
    assert len(written) > 2 and max(written[1:]) <= components.LEAST_PARTS


def test_shingles_of_open_regions_grow_with_the_rows(docs, monkeypatch):
    """Regions of hundreds of rows and of thousands take the same steps, so shingles that are given one by one do not jump."""
    made, compact = {}, forest.stage_compact

    def counted(df, label):
        out = compact(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(forest, "stage_compact", counted)
    shared = " ".join(f"t{i}" for i in range(82))
    counts = []
    for n in (200, 1000):
        rows = [(i, shared + " " + " ".join(f"x{i}_{k}" for k in range(18))) for i in range(n)]
        made.clear()
        got = {r.doc_id: r.component_id for r in forest.component_table(docs(rows).repartition(8), 2).collect()}
        assert got == {i: i for i in range(n)}
        counts.append(made.get("forest-tokens", 0))
    assert counts[0] > 0 and counts[1] <= 6 * counts[0]


def test_rows_of_a_batch_come_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([None if i % 7 == 0 else f"t{i}" for i in range(300)])],
                                       names=["node", "text"])
    assert list(forest._text_rows(batch)) == [(i, None if i % 7 == 0 else f"t{i}") for i in range(300)]
    assert list(forest._text_rows(batch.slice(0, 0))) == []
