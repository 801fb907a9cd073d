"""Near duplicates by an LSH forest over MinHash signatures.

1. Each text becomes a set of word shingles, its digest, and 128 MinHash values. Equal sets are one node,
   named by the smallest document id that has the set.
2. Sixteen trees each order the nodes by eight of the values. A range-partitioned sort gives each order;
   the nearest rows by longest common prefix are candidates, so that the depth adapts to how dense a
   region is. Other values estimate the similarity on the spot and drop chance neighbours.
3. In a dense region most rows stand next to a few others only, so each region also has a hub: the row
   that is on the region's densest path in most trees. All rows of the region are candidates with it.
4. Candidates are confirmed on the full sets: first the best few of each node; then those that would
   still join two components. A link inside a component changes nothing and is not fetched.
5. Regions that a window does not cover whole, or that a partition border cuts, and that still hold
   several components are settled on the full sets, so that every pair that shares LEAST_DEPTH values in
   some tree is decided exactly. Regions that overlap are settled as one. Regions of a few rows are compared
   pair by pair. In others a prefix filter comes first: two linked sets share one of the rarest shingles of either.
   Rows that share a rare one are candidates; only rows that share nothing rarer than what very many sets hold
   are compared in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .common import LOWER, mix, row_key, span_hashes, stage_compact, text_chunks, words
from .components import components

SHINGLE = 5
PERCENT = 80            # links have 100 * intersection >= PERCENT * union
TREES, DEPTH = 16, 8
LEAST_DEPTH = 3         # neighbours share at least this much of a tree's prefix
BESIDE = 4              # rows looked at on each side
SAMPLE = 32             # other values compared on the spot
SLACK, FINE_SLACK = 0.22, 0.13  # an estimate may fall this far below the threshold (3 standard errors)
DENSE = 16              # rows from which a region has a hub
FILTER_WORDS = 1 << 17  # 64-bit words of the bit map of ids whose texts are needed: 1 MB
BEST = 2                # candidates of a node confirmed first
BLOCK_ROWS, BLOCK_SHINGLES = 512, 1 << 19  # sizes of a block of an open region, on average
PAIR_ROWS = 64          # rows up to which a region is compared pair by pair at once
TEXT_ROWS = 128         # rows whose texts are Python strings at once
COLUMNS = 2048          # shingles of two blocks multiplied at once
COMMON = 256            # sets that hold a shingle, from which its holders are compared in blocks, not joined

_NULL_ID = 1 << 62      # nodes of rows without an id are numbered from here
_RNG = np.random.default_rng(99)
_A = _RNG.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)

TOKENS = "node bigint, component bigint, n bigint, token bigint"
SETS = "oid bigint, key bigint, n bigint, digest binary, values binary"
TREE_ROWS = "tree int, prefix binary, sample binary, node bigint"
FOUND = "kind int, a bigint, b bigint, weight int"


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted hashes of its distinct shingles; a row of fewer words has one for all of them."""
    data = LOWER[data]
    starts, ends, firsts = words(data, bounds)
    word = span_hashes(data, starts, ends)
    factor = [np.uint64(2 * k * k + 10 * k + 7) for k in range(size)]
    joined = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for k in range(size):
        joined += word[k:len(word) - size + 1 + k] * factor[k] if len(joined) else joined
    joined = mix(joined)
    for first, last in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if last - first >= size:
            found = np.sort(joined[first:last - size + 1])
            yield found[np.concatenate([[True], found[1:] != found[:-1]])]
        elif last > first:
            yield mix((word[first:last] * np.array(factor[:last - first])).sum(keepdims=True) + np.uint64(last - first))
        else:
            yield joined[:0]


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 16 bits each."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 2048):
        part = hashes[start:start + 2048, None] * _A
        part += _B
        np.minimum(least, part.min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype(">u2")


def _make_sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in text_chunks(batch.column(2)):
                n, digest, values = [], [], []
                for hashes in shingle_sets(data, bounds, size):
                    n.append(len(hashes))
                    digest.append(hashlib.md5(hashes.tobytes()).digest() if len(hashes) else None)
                    values.append(signature(hashes).tobytes() if len(hashes) else None)
                part = [batch.column(i).slice(first, len(n)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*part, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(values, pa.binary())],
                    names=["oid", "key", "n", "digest", "values"])
    return run


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node once per tree: the tree's values in order, and one byte each of other values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, TREES * DEPTH)
        for tree in range(TREES):
            own = np.ascontiguousarray(values[:, tree * DEPTH:(tree + 1) * DEPTH])
            other = np.roll(values, -(tree + 1) * DEPTH, axis=1)[:, :TREES * DEPTH - DEPTH]
            sample = np.ascontiguousarray(other[:, ::(TREES * DEPTH - DEPTH) // SAMPLE][:, :SAMPLE]).view(np.uint8)[:, ::2]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, tree, np.int32)), _binary(own.view(np.uint8)),
                 _binary(np.ascontiguousarray(sample)), batch.column(0)],
                names=["tree", "prefix", "sample", "node"])


def _binary(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def _neighbours(threshold: float) -> Callable:
    """Candidates of one sorted partition (kind 0), its dense regions (1), and those seen in part (2).

    Kind 0: ``a`` < ``b`` and how many sampled values agree. Kind 1: ``a`` a member, ``b`` the region,
    ``weight`` 1 on the densest path. Kind 2: ``a`` a member, ``b`` the region by its prefix.
    """
    least = int(np.ceil(max(0.0, threshold - SLACK) * SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        tree = np.concatenate([np.asarray(b.column(0)) for b in held])
        node = np.concatenate([np.asarray(b.column(3)) for b in held])
        prefix = np.frombuffer(b"".join(x for b in held for x in b.column(1).to_pylist()), np.uint16) \
            .reshape(-1, DEPTH)
        sample = np.frombuffer(b"".join(x for b in held for x in b.column(2).to_pylist()), np.uint8) \
            .reshape(-1, SAMPLE)
        same = prefix[1:] == prefix[:-1]
        shared = np.where(tree[1:] == tree[:-1], np.cumprod(same, axis=1).sum(axis=1), 0)
        reach = shared
        for gap in range(1, BESIDE + 1):
            if gap > 1:
                reach = np.minimum(reach[:-1], shared[gap - 1:]) if len(reach) > 1 else reach[:0]
            if not len(reach):
                break
            at = np.flatnonzero(reach >= LEAST_DEPTH)
            agree = (sample[at] == sample[at + gap]).sum(axis=1)
            at, agree = at[agree >= least], agree[agree >= least]
            one, two = node[at], node[at + gap]
            differ = one != two
            yield _found(0, np.minimum(one, two)[differ], np.maximum(one, two)[differ], agree[differ])
        region = np.concatenate([[0], np.cumsum(shared < LEAST_DEPTH)])
        sizes = np.bincount(region)
        leaf = np.concatenate([[0], np.cumsum(shared < DEPTH)])
        leaf_sizes = np.bincount(leaf)
        leaf_region = region[np.unique(leaf, return_index=True)[1]]
        largest = np.zeros(len(sizes), np.int64)
        np.maximum.at(largest, leaf_region, leaf_sizes)
        dense = np.flatnonzero(sizes[region] >= DENSE)
        # A region has no name of its own across partitions; its first row and tree give one.
        first = np.unique(region, return_index=True)[1]
        name = mix(node[first].astype(np.uint64) * np.uint64(64) + tree[first].astype(np.uint64)).view(np.int64)
        path = (leaf_sizes[leaf] == largest[region]) & (leaf_sizes[leaf] > 1)
        yield _found(1, node[dense], name[region[dense]], path[dense].astype(np.int64))
        part = sizes > BESIDE + 1
        part[[0, -1]] = True  # may go on in another partition
        part = np.flatnonzero(part[region])
        whole = tree[part].astype(np.uint64)
        for k in range(LEAST_DEPTH):
            whole = mix(whole * np.uint64(1 << 16) + prefix[part, k].astype(np.uint64))
        yield _found(2, node[part], whole.view(np.int64), np.zeros(len(part), np.int64))
    return run


def _found(kind: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(weight.astype(np.int32))],
        names=["kind", "a", "b", "weight"])


def _estimate(threshold: float) -> Callable:
    """Pairs whose signatures agree in enough of all values, and how many agree."""
    least = (threshold - FINE_SLACK) * TREES * DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                        for i in (2, 3))
            agree = (one == two).sum(axis=1)
            kept = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(agree.astype(np.int32)).filter(kept)],
                names=["a", "b", "agree"])
    return run


def _confirm(size: int, percent: int) -> Callable:
    """The pairs whose full sets are linked. Rows come sorted by pair, side and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, sides = None, {}

        def linked() -> bool:
            one, two = (sides.get(node) for node in pair)
            if one is None or two is None:
                return False
            both = len(np.intersect1d(one, two, assume_unique=True))
            return both > 0 and 100 * both >= percent * (len(one) + len(two) - both)

        for batch in batches:
            found = []
            for a, b, node, text in _text_rows(batch):
                if (a, b) != pair:
                    if pair and linked():
                        found.append(pair)
                    pair, sides = (a, b), {}
                if node not in sides:  # of several texts under one id the first counts
                    sides[node] = _set_of(text, size)
            yield _pair_rows(found)
        if pair and linked():
            yield _pair_rows([pair])
    return run


def _text_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch; only those of a short piece are Python values at a time."""
    for first in range(0, batch.num_rows, TEXT_ROWS):
        part = batch.slice(first, TEXT_ROWS)
        yield from zip(*[column.to_pylist() for column in part.columns], strict=True)


def _pair_rows(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _set_of(text: str, size: int) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return next(shingle_sets(data, np.array([0, len(data)]), size))


def _links_of_blocks(size: int, percent: int) -> Callable:
    """Links between components from pairs of blocks, as many as join them. Rows come sorted by pair of
    blocks, node and text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, rows = None, {}
        for batch in batches:
            found = []
            for region, one, two, side, node, component, text in _text_rows(batch):
                if (region, one, two) != pair:
                    found += _linked_rows(rows, percent)
                    pair, rows = (region, one, two), {}
                if node not in rows:  # of several texts under one id the first counts
                    rows[node] = (side, component, _set_of(text, size))
            yield _pair_rows(found)
        yield _pair_rows(_linked_rows(rows, percent))
    return run


def _linked_rows(rows: dict[int, tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that join components, among the rows of one block or between those of two (side 0 and 1)."""
    sides = [[(node, component, hashes) for node, (side, component, hashes) in rows.items() if side == k] for k in (0, 1)]
    inside = not sides[1]
    left, right = sides[0], sides[0] if inside else sides[1]
    if not left or not right:
        return []
    both = _overlaps([r[2] for r in left], [r[2] for r in right])
    total = np.array([len(r[2]) for r in left])[:, None] + np.array([len(r[2]) for r in right])
    apart = np.unique([r[1] for r in left + right], return_inverse=True)[1]
    apart = apart[:len(left), None] != apart[len(left):]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere((both > 0) & (100 * both >= percent * (total - both)) & apart).tolist():
        one, two = top(left[i][1]), top(right[j][1])
        if one != two:
            root[max(one, two)] = min(one, two)
            out.append((min(left[i][0], right[j][0]), max(left[i][0], right[j][0])))
    return out


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set on the left shares with each on the right."""
    def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], row[order]

    (one, row_one), (two, row_two) = flat(left), flat(right)
    shared = np.intersect1d(one, two)
    out = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, len(shared), COLUMNS):
        part, dense = shared[first:first + COLUMNS], []
        for hashes, row, n in ((one, row_one, len(left)), (two, row_two, len(right))):
            at = slice(np.searchsorted(hashes, part[0]), np.searchsorted(hashes, part[-1], side="right"))
            column = np.searchsorted(part, hashes[at])
            known = part[column] == hashes[at]
            matrix = np.zeros((n, len(part)), np.float32)
            matrix[row[at][known], column[known]] = 1
            dense.append(matrix)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _open_regions(members: DataFrame, found: DataFrame) -> DataFrame:
    """``region``, ``node``, ``component`` of the regions that hold several components.

    ``members``: ``node``, ``region``. Regions of which one has half its rows in the other become one, as
    the trees cut a family of copies in much the same way; the rest of their pairs is compared once.
    """
    placed = members.join(found, "node", "left").select("region", "node", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                           F.count(F.lit(1)).alias("size")).filter("low < high")
    rows = stage(placed.join(several.select("region", "size"), "region"), "forest-open")
    one, two = (rows.select("node", F.col("region").alias(c), F.col("size").alias(f"size_{c}")) for c in ("a", "b"))
    overlaps = one.join(two, "node").filter("a < b") \
        .groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first(F.least("size_a", "size_b")).alias("least")) \
        .filter("2 * n >= least").select("a", "b")
    merged = components(overlaps).toDF("region", "whole")
    return rows.join(merged, "region", "left") \
        .select(F.coalesce("whole", "region").alias("region"), "node", "component").distinct()


def _large_regions(held: DataFrame, nodes: DataFrame) -> DataFrame:
    """``region`` of open regions that are not compared pair by pair at once."""
    return held.join(nodes.select("node", "n"), "node").groupBy("region") \
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")) \
        .filter((F.col("rows") > PAIR_ROWS) | (F.col("n") > BLOCK_SHINGLES)).select("region")


def _token_rows(size: int) -> Callable:
    """The shingles of each text, one per row, with the number of them; and a row without a shingle for each text
    that has some. Columns: node, component, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in text_chunks(batch.column(2)):
                sets = list(shingle_sets(data, bounds, size))
                n = np.array([len(s) for s in sets])
                row = pa.array(np.concatenate([np.repeat(np.arange(len(n)), n), np.flatnonzero(n)]) + first)
                tokens = np.concatenate([*sets, np.zeros(np.count_nonzero(n), np.uint64)]).view(np.int64)
                none = np.arange(len(tokens)) >= n.sum()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row),
                                                  pa.array(np.concatenate([np.repeat(n, n), n[n > 0]])),
                                                  pa.array(tokens, mask=none)],
                                                 names=["node", "component", "n", "token"])
    return run


def _rare_shingles(rows: DataFrame, keyed: DataFrame, size: int) -> DataFrame:
    """Per set ``node``, ``component``, ``n``, how many of its shingles are of no use as links (``before``), and the
    rare ones after those in order (``shared``: ``holders``, ``token``). ``rows``: ``node``, ``component``.

    All shingles have one order: those that only one component holds, which link nothing new; rare ones by
    holders; common ones. The common ones, and those of one set, are counted without a join, so that no join
    key is hot. Of several texts under one id the first counts.
    """
    likely = _hit(keyed, rows.select(F.col("node").alias("oid"))).filter("hit AND text IS NOT NULL")
    texts = likely.join(rows.withColumnRenamed("node", "oid"), "oid").groupBy("oid", "component").agg(F.min("text").alias("text"))
    tokens = stage_compact(texts.mapInArrow(_token_rows(size), TOKENS), "forest-tokens")
    held = stage_compact(tokens.filter("token IS NOT NULL").groupBy("token").agg(
        F.count(F.lit(1)).alias("holders"), F.min("node").alias("node"), F.min("component").alias("low"),
        F.max("component").alias("high"), F.min("n").alias("n")).filter(F.col("holders") <= COMMON), "forest-rare")
    none = F.lit(None).cast("struct<holders: bigint, token: bigint>").alias("shared")
    alone = held.filter("holders = 1").select("node", F.col("low").alias("component"), "n", F.lit(1).alias("before"), none)
    several = held.filter("holders > 1").select("token", "holders", (F.col("low") < F.col("high")).alias("links"))
    rare = tokens.join(several, "token").select(
        "node", "component", "n", F.when(F.col("links"), 0).otherwise(1).alias("before"),
        F.when(F.col("links"), F.struct("holders", "token")).alias("shared"))
    every = tokens.filter("token IS NULL").select("node", "component", "n", F.lit(0).alias("before"), none)
    return every.unionAll(alone).unionAll(rare).groupBy("node", "component", "n").agg(
        F.sum("before").alias("before"), F.array_sort(F.collect_list("shared")).alias("shared"))


def _by_prefix(rows: DataFrame, keyed: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidates ``a`` < ``b`` between components, with ``agree`` (shared rare shingles); and ``node`` and ``index`` of
    rows that may also have links by a common shingle alone. ``rows``: ``node``, ``component``.

    Of two linked sets the smaller (``index``) shares one of its first n (100 - percent) / (100 + percent) + 1
    shingles with the first n (100 - percent) / 100 + 1 of the larger. No shingle joins more than COMMON rows, so
    the work is linear in the shingles. The shared rare shingles and what comes after the last of them bound
    what two sets can share.
    """
    sets = stage_compact(_rare_shingles(rows, keyed, size), "forest-prefixes")
    spare = F.col("n") * F.lit(100 - percent)
    reach = F.greatest(F.floor(spare / 100) + 1 - F.col("before"), F.lit(0)).cast("int")
    place = F.col("before") + F.col("nth")
    first = sets.select("node", "component", "n", "before", F.posexplode(F.slice("shared", F.lit(1), reach)).alias("nth", "s")) \
        .select(F.col("s.token").alias("token"), "node", "component", "n", place.alias("place"),
                (place * F.lit(100 + percent) <= spare).alias("index"))
    one = first.filter("index").select("token", *(F.col(c).alias(f"one_{c}") for c in ("node", "component", "n", "place")))
    two = first.select("token", *(F.col(c).alias(f"two_{c}") for c in ("node", "component", "n", "place")))
    smaller = F.struct("one_n", "one_node") < F.struct("two_n", "two_node")
    met = one.join(two, "token").filter(smaller & (F.col("one_component") != F.col("two_component"))
                                        & (100 * F.col("one_n") >= percent * F.col("two_n")))
    shared = met.groupBy("one_node", "two_node", "one_n", "two_n").agg(
        F.count(F.lit(1)).alias("agree"), F.max("one_place").alias("one_place"), F.max("two_place").alias("two_place"))
    most = F.col("agree") + F.least(F.col("one_n") - F.col("one_place"), F.col("two_n") - F.col("two_place")) - 1
    pairs = shared.filter(most * (100 + percent) >= percent * (F.col("one_n") + F.col("two_n"))).select(
        F.least("one_node", "two_node").alias("a"), F.greatest("one_node", "two_node").alias("b"), "agree")
    rest = F.col("before") + F.size("shared")
    common = sets.filter((rest < F.col("n")) & (100 * rest <= spare)) \
        .select("node", ((100 + percent) * rest <= spare).alias("index"))
    return pairs, common


def _compared(rows: DataFrame, keyed: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that join components of an open region, from all pairs of its rows.

    A large component has blocks of its own, which are not compared with each other; the small ones of a
    region share blocks. Each text goes to its block once for each other block, never to single pairs.
    """
    sized = rows.join(nodes.select("node", "n"), "node")
    large = sized.groupBy("region", "component").agg(F.count(F.lit(1)).alias("rows")) \
        .filter(F.col("rows") >= BLOCK_ROWS // 2).select("region", "component", F.lit(True).alias("large"))
    split = stage(sized.join(large, ["region", "component"], "left")
                  .withColumn("part", F.when(F.col("large"), F.col("component"))).drop("large"), "forest-split")
    blocks = split.groupBy("region", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).select(
        "region", "part", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("n") / BLOCK_SHINGLES)).alias("blocks"))
    names = blocks.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))) \
        .select("region", "part", F.struct("part", "nth").alias("block"))
    one, two = names.toDF("region", "part_one", "one"), names.toDF("region", "part_two", "two")
    pairs = stage(one.join(two, "region").filter("one <= two AND (part_one IS NULL OR part_two IS NULL OR part_one != part_two)")
                  .select("region", F.xxhash64("one").alias("one"), F.xxhash64("two").alias("two")), "forest-blocks")
    sides = pairs.select("region", F.col("one").alias("block"), "one", "two", F.lit(0).alias("side")).unionAll(
        pairs.filter("one != two").select("region", F.col("two").alias("block"), "one", "two", F.lit(1).alias("side")))
    nth = F.pmod(F.xxhash64("node"), F.col("blocks"))
    counted = blocks.toDF("in_region", "in_part", "blocks")
    dealt = split.join(counted, (F.col("region") == F.col("in_region")) & F.col("part").eqNullSafe(F.col("in_part"))) \
        .select("region", "node", "component", F.xxhash64(F.struct("part", nth.alias("nth"))).alias("block"))
    needed = dealt.join(sides, ["region", "block"]).select("region", "one", "two", "side", F.col("node").alias("oid"), "component")
    likely = _hit(keyed, dealt.select(F.col("node").alias("oid")).distinct()).filter("hit AND text IS NOT NULL")
    columns = ["region", "one", "two", "side", "oid", "component", "text"]
    return likely.join(needed, "oid").select(*columns).repartition("region", "one", "two") \
        .sortWithinPartitions("region", "one", "two", "oid", "text") \
        .mapInArrow(_links_of_blocks(size, percent), "a bigint, b bigint")


def candidates(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs ``a`` < ``b`` with the number of agreeing values, and the rows (``node``, ``region``)
    of regions in which not all pairs were looked at. ``nodes``: ``node``, ``values``."""
    rows = stage_compact(nodes.select("node", "values").mapInArrow(_tree_rows, TREE_ROWS), "forest")
    found = stage(rows.repartitionByRange("tree", "prefix", "node").sortWithinPartitions("tree", "prefix", "node")
                  .mapInArrow(_neighbours(threshold), FOUND), "forest-found")
    members = found.filter("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("region"), "weight")
    score = members.filter("weight = 1").groupBy("node").agg(F.count(F.lit(1)).alias("score"))
    hubs = members.filter("weight = 1").join(score, "node").groupBy("region") \
        .agg(F.max(F.struct("score", "node")).alias("hub")).select("region", F.col("hub.node").alias("hub"))
    spokes = members.join(hubs, "region").filter("node != hub") \
        .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    pairs = found.filter("kind = 0").select("a", "b").unionAll(spokes).distinct()
    values = nodes.select("node", "values")
    both = pairs.join(values.toDF("a", "one"), "a").join(values.toDF("b", "two"), "b").select("a", "b", "one", "two")
    members = found.filter("kind = 2").select(F.col("a").alias("node"), F.col("b").alias("region"))
    return both.mapInArrow(_estimate(threshold), "a bigint, b bigint, agree int"), members


def _confirmed(pairs: DataFrame, keyed: DataFrame, size: int, percent: int) -> DataFrame:
    """The linked pairs. Each needed text is shuffled to its pairs once, and from there to each pair."""
    sides = pairs.select(F.col("a").alias("oid"), "a", "b").unionAll(pairs.select(F.col("b").alias("oid"), "a", "b"))
    likely = _hit(keyed, sides.select("oid").distinct()).filter("hit")
    rows = likely.join(sides, "oid").select("a", "b", "oid", "text")
    return rows.filter("text IS NOT NULL").repartition("a", "b").sortWithinPartitions("a", "b", "oid", "text") \
        .mapInArrow(_confirm(size, percent), "a bigint, b bigint")


def _best(pairs: DataFrame) -> DataFrame:
    """The BEST candidates of each node, by ``agree``."""
    sides = pairs.select(F.col("a").alias("node"), "a", "b", "agree") \
        .unionAll(pairs.select(F.col("b").alias("node"), "a", "b", "agree"))
    best = Window.partitionBy("node").orderBy(F.col("agree").desc(), "a", "b")
    return stage(sides.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= BEST)
                 .select("a", "b").distinct(), "forest-chosen")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    return pairs.join(found.toDF("a", "ca"), "a", "left").join(found.toDF("b", "cb"), "b", "left") \
        .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links."""
    more = stage(links, "forest-links")
    if more.isEmpty():
        return found
    return stage(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)),
                 "forest-components")


def _hit(keyed: DataFrame, ends: DataFrame) -> DataFrame:
    """``keyed`` with ``hit``: whether a row may have its ``oid`` in ``ends``; false only if it has not.

    A bit map of hashed ids, at most FILTER_WORDS rows whatever the input, so that most other rows need no
    join, and their texts no shuffle.
    """
    place = F.pmod(F.xxhash64("oid"), F.lit(64 * FILTER_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright(place, 6).alias("word")
    bits = ends.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    marked = keyed.withColumn("word", word).join(F.broadcast(bits), "word", "left")
    return marked.select(*keyed.columns, (F.coalesce("bits", F.lit(0)).bitwiseAND(bit) != 0).alias("hit"))


def without(keyed: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose (``oid``, ``key``) is not in ``dropped``; only likely ones are joined."""
    marked = _hit(keyed, dropped.select("oid").distinct())
    likely = marked.filter("hit").join(dropped, ["oid", "key"], "left_anti")
    return marked.filter("NOT hit").select(*keyed.columns).unionByName(likely.select(*keyed.columns))


def one_of_each(keyed: DataFrame, text_col: str) -> DataFrame:
    """``keyed`` (``oid``, ``key`` and other columns) with one row of those that agree in both and have words.

    Of rows that differ in other columns the first by their JSON text stays. Only rows that may be repeated
    are shuffled, and each task sends at most one of a group.
    """
    worded = keyed.filter(F.rlike(text_col, F.lit(r"[^\x20\x09-\x0D]")))
    again = worded.groupBy("oid", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("oid", "key")
    again = stage_compact(again, "repeated-rows")
    marked = _hit(keyed, again.select("oid"))
    others = [c for c in keyed.columns if c != text_col]
    order = Window.partitionBy("oid", "key").orderBy(F.to_json(F.struct(*others)))
    likely = marked.filter("hit").join(again.withColumn("again", F.lit(True)), ["oid", "key"], "left")
    single = likely.filter("again IS NULL").select(*keyed.columns)
    first = likely.filter("again").withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(*keyed.columns)
    return marked.filter("NOT hit").select(*keyed.columns).unionAll(single).unionAll(first)


def node_id(id_col: str, text_col: str) -> Column:
    """The id, or for a row without one a number above all ids that its text gives."""
    without = F.lit(_NULL_ID) + F.shiftrightunsigned(F.xxhash64(F.lit("no id"), F.col(text_col)), 2)
    return F.coalesce(F.col(id_col).cast("bigint"), without)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The component of every document: ``oid``, ``key``, ``n_shingles``, ``component``.

    ``oid`` is the id (an integer), or a number above all ids for a row without one; ``key`` the row key.
    One row per input row. Rows that share an id are one document, so linked; where their texts differ,
    its other links are confirmed on the first text in text order. A document without words or text is
    linked with nothing.
    """
    threshold = percent / 100
    keyed = docs.select(node_id(id_col, text_col).alias("oid"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    sets = stage_compact(keyed.mapInArrow(_make_sets(shingle), SETS), "shingle-sets")
    nodes = stage_compact(sets.filter("n > 0").groupBy("digest").agg(
        F.min("oid").alias("node"), F.first("values").alias("values"), F.count(F.lit(1)).alias("rows"),
        F.first("n").alias("n")), "forest-nodes")
    pairs, members = candidates(nodes, threshold)
    pairs = stage(pairs, "forest-pairs")
    chosen = _best(pairs)
    # Copies under other ids hang on their node already; rows of one id with several sets join here.
    several = sets.filter("n > 0").groupBy("oid").agg(F.min("digest").alias("low"), F.max("digest").alias("high")) \
        .filter("low != high").select("oid")
    owned = sets.join(several, "oid", "left_semi").join(nodes.select("digest", "node"), "digest") \
        .select(F.col("oid").alias("a"), F.col("node").alias("b"))
    links = stage(_confirmed(chosen, keyed, shingle, percent).unionAll(owned), "forest-links")
    found = stage(components(links), "forest-components")

    def settle(found: DataFrame, rest: DataFrame) -> DataFrame:
        apart = stage(_apart(rest, found), "forest-apart")
        return found if apart.isEmpty() else _extended(found, _confirmed(apart, keyed, shingle, percent))

    found = settle(found, pairs.join(chosen, ["a", "b"], "left_anti"))
    held = stage(_open_regions(members, found), "forest-open")
    large = stage(_large_regions(held, nodes), "forest-large")
    if not large.isEmpty():
        rows = held.join(large, "region").select("node", "component").distinct()
        rare, common = _by_prefix(rows, keyed, shingle, percent)
        rare, common = stage(rare, "forest-rare"), stage(common, "forest-common")
        chosen = _best(rare)
        found = settle(found, chosen)
        found = settle(found, rare.join(chosen, ["a", "b"], "left_anti"))
        small = held.join(large, "region", "left_anti")
        left = stage(held.join(large, "region", "left_semi").join(common, "node"), "forest-common")
        indexed = left.groupBy("region").agg(F.max("index").alias("index")).filter("index").select("region")
        held = small.unionByName(left.join(indexed, "region", "left_semi").drop("index"))
        held = stage(_open_regions(held.select("node", "region"), found), "forest-open")
    if not held.isEmpty():
        found = _extended(found, _compared(held, keyed, nodes, shingle, percent))
    copied = nodes.filter("rows > 1").select("digest", "node")
    placed = sets.select("oid", "key", "n", "digest").join(copied, "digest", "left") \
        .select("oid", "key", "n", F.coalesce("node", "oid").alias("node"))
    joined = placed.join(found, "node", "left").select(
        "oid", "key", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component"))
    return joined


def component_table(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id`` and ``kept``.

    ``component_id`` is the smallest id reachable over links, ``kept`` whether it is the row's own. Rows
    without an id come last: such a row has the component id of the documents with an id that it reaches,
    else none, and is then kept if it is the first of its component.
    """
    found = near_duplicates(docs, shingle, percent, id_col, text_col)
    named = F.col("oid") < _NULL_ID
    return found.select(
        F.when(named, F.col("oid")).alias(id_col), "n_shingles",
        F.when(F.col("component") < _NULL_ID, F.col("component")).alias("component_id"),
        (F.col("oid") == F.col("component")).alias("kept"))
