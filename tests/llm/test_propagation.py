"""Balanced label propagation: the law of even counts, whole groups, slots, groups beyond a quota."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from corpusloom.llm import propagation


def check(rows, got, shards=8):
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(shards))
    assert max(counts.get(k, 0) for k in range(shards)) - min(counts.get(k, 0) for k in range(shards)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    facts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == facts
    spread = defaultdict(set)
    for r in got:
        spread[r.grp].add(r.shard)
    return spread


def test_groups_stay_whole(docs):
    rng = random.Random(3)
    rows = [(i, f"text {i if rng.random() < 0.7 else rng.randrange(12)}") for i in range(403)]
    rows += [(900, None), (901, None), (902, ""), (None, "no id"), (5, rows[5][1])]
    frame = docs(rows).selectExpr("*", "lang AS shard", "lang AS grp", "lang AS rank", "text AS size", "lang AS tag")
    spread = check(rows, propagation.assign_shards(frame).collect())
    assert max(map(len, spread.values())) == 1


@pytest.mark.parametrize("hot", [0.4, 0.95, 1.0])
def test_group_larger_than_a_shard(docs, hot, monkeypatch):
    monkeypatch.setattr(propagation, "HOT_ROWS", 50)
    rows = [(i, "hot" if i < 300 * hot else f"t{i // 2}" if i % 4 < 2 else f"alone {i}") for i in range(300)]
    spread = check(rows, propagation.assign_shards(docs(rows)).collect())
    sizes = sorted(map(len, spread.values()))
    assert sizes[-1] <= -(-int(300 * hot) // 37) + 1
    assert sum(n > 1 for n in sizes[:-1]) <= 2


def test_quotas_keep_the_law():
    wishes = {(0, 1): 9, (1, 0): 4, (2, 1): 5, (1, 2): 1, (0, 2): 3}
    quota = propagation.move_quotas(wishes, [0, 2, 1])
    for j, free in enumerate([0, 2, 1]):
        assert sum(quota[i][j] for i in range(3)) - sum(quota[j]) <= free
    assert all(quota[i][j] <= wishes.get((i, j), 0) for i in range(3) for j in range(3))


def test_many_groups_compete(docs):
    rows = [(i, f"group {i // 30}") for i in range(300)]
    spread = check(rows, propagation.assign_shards(docs(rows)).collect())
    assert sum(len(s) - 1 for s in spread.values()) <= 25  # of 70 at the start; they cannot all fit into 37 or 38


def test_small_tables(docs):
    assert propagation.assign_shards(docs([])).count() == 0
    for n in (1, 5):
        check([(i, "same") for i in range(n)], propagation.assign_shards(docs([(i, "same") for i in range(n)])).collect())
