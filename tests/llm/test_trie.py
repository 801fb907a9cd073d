"""The prefix trie against brute force, and the radix tree by itself."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from corpusloom.llm import radix, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, first string, key string, n int"


def brute(rows, family=5, heads=9):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            r = role.encode()
            tid = hashlib.sha256(str(len(r)).encode() + b":" + r + text.encode()).digest()[:16]
            turns[c].append(((t is not None, t or 0), tid, (role, text)))
    turns = {c: [x[2] for x in sorted(v)] for c, v in turns.items()}
    members, ended = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (c % family if c >= 0 else -(-c % family))
        rebuilt = turns.get(base, [])[:h] + own[h:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append(c)
        ended[tuple(rebuilt)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, who in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1].encode()) if path else 0
    out = [(min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children[path], leaves[path],
            saved[path], hashlib.sha256(",".join(map(str, sorted(ended[path]))).encode()).hexdigest())
           for path, who in members.items()]
    return sorted(out, key=str)


def data(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * conversations), conversations):
        for t in range(rng.choice([1, 2, 3, 5, 12])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "é", "long text", "x", None])))
    rows += [(900 + i % 70, t, "system", "same " * t) for i in range(70) for t in range(4)]  # copies
    rows += [(c, t, "user", str(t % 3)) for c in (1000, 1001, 1005) for t in range(40)]  # over several segments
    rows += [(None, 1, "user", "nobody"), (2000, None, "user", "first"), (2000, 0, "user", "b"), (2000, 0, "user", "a"),
             (2000, 0, "user", "a")]
    return [(*r, "f", "k", 7) for r in rows]


@pytest.mark.parametrize(("segment", "limit"), [(256, 4096), (8, 5), (3, 2)])
def test_equals_brute_force(spark, segment, limit):
    rows = data(segment)
    got = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), segment=segment, limit=limit).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table_and_one_turn(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert trie.prefix_trie(frame([])).count() == 0
    one = [(5, 0, None, None, "f", "k", 1)]
    assert sorted(map(tuple, trie.prefix_trie(frame(one)).collect()), key=str) == brute(one)


def test_digests_of_hot_nodes_in_pieces(spark):
    ends = spark.range(-50, 3000).selectExpr("CASE WHEN id % 3 = 0 THEN X'01' ELSE X'02' END AS key", "id AS conv_id")
    got = {bytes(r.key): r.sha for r in trie.end_digests(ends, piece=64).collect()}
    for key, of in ((b"\1", lambda i: i % 3 == 0), (b"\2", lambda i: i % 3)):
        assert got[key] == hashlib.sha256(",".join(str(i) for i in range(-50, 3000) if of(i)).encode()).hexdigest()


@pytest.mark.parametrize("fanout", [2, 4, 5, 16, 17, 48, 49, 256])
def test_radix_tree_layouts(fanout):
    rng = random.Random(fanout)
    tree, keys = radix.RadixTree(2), {b"", b"ab", b"abcd", b"abce"}
    keys |= {b"zz" + bytes([b, rng.randrange(256)]) for b in rng.sample(range(256), fanout)}
    for key in rng.sample(sorted(keys), len(keys)):
        tree.insert(key, key)
    seen = [n.value for n, _, up in tree.walk() if not up and n.value is not None]
    assert seen == sorted(keys)
    widest = max((n.layout() for n, _, up in tree.walk() if not up))
    assert widest == next(size for size in (4, 16, 48, 256) if fanout <= size)
    depths = sorted(d for n, b, up in tree.walk() if not up for d in tree.borders(n, b))
    assert len(depths) == len({k[:d] for k in keys for d in range(0, len(k) + 1, 2)})
