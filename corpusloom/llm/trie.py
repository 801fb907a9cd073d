"""Prefix trie of conversations, by adaptive radix trees over fixed-width turn ids.

A turn's id is 16 bytes of the SHA-256 of its role and text, so a conversation is a key of whole ids and a
trie node is a key's beginning of whole ids. Keys are cut into segments of ``SEGMENT`` turns, so that no
conversation is ever one value: the trie of a later segment hangs under the node at which the one before
it ended. Equal segments are counted first; then they are sorted by range, and each task builds radix trees
of bounded numbers of them. Only nodes on the first or last key of a tree, or on a key that goes on in
another segment, can have members elsewhere. The others are finished where they are; these few are merged,
and what lies below them is summed over ancestors at distances 1, 2, 4, ...
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import stage_compact
from .radix import RadixTree

WIDTH = 16
SEGMENT = 256
KEYS = 4096  # of one radix tree
PIECE = 1 << 16  # characters of joined ids in one row
ROOT = bytes(WIDTH)
NODE = ("key binary, parent binary, depth bigint, bytes bigint, first bigint, n bigint, open boolean, "
        "kids bigint, leaves bigint, saved bigint, parent_first bigint")
_NODE_TYPES = pa.schema([
    ("key", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "bytes", "first", "n")),
    ("open", pa.bool_()), *((c, pa.int64()) for c in ("kids", "leaves", "saved", "parent_first"))])


def _digest(data: Column) -> Column:
    return F.substring(F.unhex(F.sha2(data, 256)), 1, WIDTH)


def node_key(tree: bytes, path: bytes) -> bytes:
    """The key of the node that a path leads to from the root of a segment's tree."""
    return hashlib.sha256(tree + path).digest()[:WIDTH] if path else tree


def numbered_turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id``, ``pos`` (from 0), ``tid`` and ``bytes`` of each turn.

    The turns are sorted by range, so a conversation may span tasks; places within a task are shifted by
    what the tasks before it hold.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    slim = turns.select(
        turns[conv_col].cast("bigint").alias("conv_id"), turns[turn_col].alias("turn"),
        _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("tid"),
        F.octet_length(text).cast("bigint").alias("bytes")).filter("conv_id IS NOT NULL")
    order = ["conv_id", F.asc_nulls_first("turn"), "tid"]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id())
    local = stage_compact(ranged.select("conv_id", "task", "tid", "bytes").mapInArrow(
        _places, "conv_id bigint, task int, tid binary, bytes bigint, place bigint"), "turns")
    held = local.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.withColumn("shift", F.sum("k").over(before)).filter("shift > 0").drop("k")
    return local.join(shifts, ["conv_id", "task"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("pos"), "tid", "bytes")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, count = None, 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        new = np.append(True, ids[1:] != ids[:-1])
        begin = np.flatnonzero(new)
        place = np.arange(len(ids)) - np.repeat(begin, np.diff(np.append(begin, len(ids))))
        if len(ids):
            if ids[0] == last:
                place[ids == last] += count
            last, count = ids[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def rebuilt_turns(numbered: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns, and (``conv_id``, ``total``) of each conversation.

    Conversation c takes the first h turns of conversation c - c % ``family`` and then its own after its
    first h, with h = crc32(c) % ``heads``.
    """
    sizes = stage_compact(numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "conversations")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    known = sizes.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family}).join(bases, "base", "left") \
        .withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0)))) \
        .withColumn("total", F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    known = stage_compact(known.select("conv_id", "base", "h", "head", "total"), "conversations")
    own = numbered.join(known, "conv_id").filter("pos >= h") \
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "tid", "bytes", "total")
    lent = numbered.filter((F.col("pos") < heads - 1) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base") \
        .join(known, "base").filter("pos < head").select("conv_id", "pos", "tid", "bytes", "total")
    return own.unionAll(lent), known.select("conv_id", "total")


def segments(turns: DataFrame, sizes: DataFrame, segment: int) -> DataFrame:
    """``conv_id``, ``seg``, ``path``, ``lens``, ``last`` and ``tree`` (the node a segment starts from)."""
    listed = turns.withColumn("seg", F.floor(F.col("pos") / segment)).groupBy("conv_id", "seg").agg(
        F.sort_array(F.collect_list(F.struct("pos", "tid", "bytes"))).alias("t"),
        F.max(F.col("pos") == F.col("total") - 1).alias("last"))
    cut = listed.select(
        "conv_id", "seg", F.unhex(F.array_join(F.transform("t.tid", F.hex), "")).alias("path"),
        F.col("t.bytes").alias("lens"), "last")
    none = sizes.filter("total = 0").select(
        "conv_id", F.lit(0).cast("bigint"), F.lit(b""), F.array().cast("array<bigint>"), F.lit(True))
    cut = stage_compact(cut.unionAll(none), "segments")
    longer = cut.filter("seg = 1").select("conv_id")
    chained = cut.join(longer, "conv_id", "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "seg") \
        .mapInArrow(_chained, T.StructType([*cut.schema.fields, T.StructField("tree", T.BinaryType())]))
    return cut.join(longer, "conv_id", "left_anti").withColumn("tree", F.lit(ROOT)).unionAll(chained)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, tree = None, ROOT
    for batch in batches:
        trees = []
        for conversation, path in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            tree = tree if conversation == last else ROOT
            trees.append(tree)
            last, tree = conversation, node_key(tree, path)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees, pa.binary())], names=[*batch.schema.names, "tree"])


def tree_nodes(tree: bytes, depth: int, keys: list[tuple], segment: int) -> list[list]:
    """The trie nodes of sorted keys (path, lens, n, first) of one tree whose root has the depth given.

    Rows have the columns of ``NODE``. A node that is not open is complete. An open one counts here only
    children, leaves and savings below children that are not open.
    """
    radix = RadixTree(WIDTH)
    for place, (path, lens, n, first) in enumerate(keys):
        edge = place in (0, len(keys) - 1) or len(path) == segment * WIDTH
        radix.insert(path, (path, lens, n, first, edge))
    rows: list[list] = []
    below: list[list] = [[]]  # per node on the way: what its children have gathered
    for node, begin, up in radix.walk():
        if not up:
            below.append([])
            continue
        parts = below.pop()
        if node.value is not None:
            path, lens, n, first, edge = node.value
            parts.append((path, lens, n, first, edge, 0, 0, 0, []))
        path, lens = parts[0][:2]
        n, first, edge = sum(p[2] for p in parts), min(p[3] for p in parts), any(p[4] for p in parts)
        kids, leaves, saved = (sum(p[i] for p in parts) for i in (5, 6, 7))
        tops = [row for p in parts for row in p[8]]
        for end in reversed(radix.borders(node, begin)):
            key = node_key(tree, path[:end])
            for row in tops:
                row[1], row[10] = key, None if edge else first
            if end == 0 and tree != ROOT:  # counted where the segment before ended
                rows.append([key, None, None, None, None, 0, True, kids, leaves, saved, None])
                break
            size = lens[end // WIDTH - 1] if end else 0
            row = [key, None, depth + end // WIDTH, size, first, n, edge, kids, leaves, saved, None]
            if not edge:
                row[8], row[9] = leaves or 1, saved + (n - 1) * size
            rows.append(row)
            tops, (kids, leaves, saved) = [row], (0, 0, 0) if edge else (1, row[8], row[9])
        below[-1].append((path, lens, n, first, edge, kids, leaves, saved, tops))
    return rows


def _grower(segment: int, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at: tuple = ()

        def grown() -> pa.RecordBatch:
            rows = tree_nodes(at[0], at[1] * segment, held, segment)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NODE_TYPES.types, strict=True)],
                                              schema=_NODE_TYPES)

        for batch in batches:
            for tree, seg, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((tree, seg) != at or len(held) == limit):
                    yield grown()
                    held = []
                at = tree, seg
                held.append(tuple(key))
        if held:
            yield grown()
    return run


def _summed(edges: DataFrame) -> DataFrame:
    """``leaves`` and ``saved`` of open nodes with all that is below them, by doubling distances."""
    kids = edges.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    total = F.col("kids") + F.coalesce("more", F.lit(0))
    own = edges.join(kids, "key", "left").withColumns({
        "kids": total, "leaves": F.col("leaves") + F.when(total == 0, 1).otherwise(0),
        "saved": F.col("saved") + (F.col("n") - 1) * F.col("bytes"), "above": F.col("parent")}).drop("more")
    own = stage_compact(own, "open-nodes")
    while own.filter("above IS NOT NULL").limit(1).count():
        lifted = own.filter("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        higher = own.select(F.col("key").alias("above"), F.col("above").alias("next"))
        own = own.join(lifted, "key", "left").join(higher, "above", "left").withColumns({
            "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)),
            "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)), "above": F.col("next")})
        own = stage_compact(own.select(*edges.columns, "above"), "open-nodes")
    return own.drop("above")


def end_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """``key`` and ``sha``: the SHA-256 of the ids of the conversations that end at a node, rising and joined
    by commas. Ids are joined in pieces where they lie after a sort by range, then hashed piece by piece."""
    ranged = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ranged.select("key", "conv_id").mapInArrow(_joiner(piece), "key binary, first bigint, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key binary, sha string")


def _joiner(piece: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, group in itertools.groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), lambda r: r[0]):
                ids: list[str] = []
                size = 0
                for _, conversation in group:
                    ids.append(str(conversation))
                    size += len(ids[-1]) + 1
                    if size >= piece:
                        rows.append((key, int(ids[0]), ",".join(ids)))
                        ids, size = [], 0
                if ids:
                    rows.append((key, int(ids[0]), ",".join(ids)))
            keys, firsts, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())],
                                             names=["key", "first", "ids"])
    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                                          names=["key", "sha"])
    last, digest = None, None
    for batch in batches:
        rows = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != last:
                if digest is not None:
                    rows.append((last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield out(rows)
    if digest is not None:
        yield out([(last, digest.hexdigest())])


def prefix_trie(conversations: DataFrame, family: int = 5, heads: int = 9, conv_col: str = "conv_id",
                turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                segment: int = SEGMENT, limit: int = KEYS) -> DataFrame:
    """The nodes of the prefix trie of rebuilt conversations (see ``rebuilt_turns``).

    One row per distinct sequence of first turns, the root included: ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id`` (the parent's ``conv_id``; null at the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (UTF-8 bytes of last texts that members after the first need not repeat,
    summed over the subtree) and ``ends_sha256``. A null role or text is empty; a null turn comes first;
    turns of equal number stand in the order of their ids, repeated rows are turns of their own. Rows
    without conversation id take no part. An empty table has no nodes, not even a root.
    """
    turns, sizes = rebuilt_turns(numbered_turns(conversations, conv_col, turn_col, role_col, text_col), family, heads)
    cut = stage_compact(segments(turns, sizes, segment), "segments")
    counted = stage_compact(cut.groupBy("tree", "seg", "path").agg(
        F.first("lens").alias("lens"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")), "paths")
    grown = stage_compact(counted.repartitionByRange("tree", "seg", "path").sortWithinPartitions("tree", "seg", "path")
                          .mapInArrow(_grower(segment, limit), NODE), "nodes")
    edges = grown.filter("open").groupBy("key").agg(
        *(F.max(c).alias(c) for c in ("parent", "depth", "bytes")), F.min("first").alias("first"),
        *(F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved")))
    edges = _summed(stage_compact(edges, "open-nodes"))
    columns = ["key", "parent", "depth", "first", "n", "kids", "leaves", "saved"]
    nodes = grown.filter("NOT open").select(*columns, "parent_first") \
        .unionAll(edges.select(*columns, F.lit(None).cast("bigint").alias("parent_first")))
    tops = edges.select(F.col("key").alias("parent"), F.col("first").alias("open_first"))
    path = F.col("path")
    ends = cut.filter("last").select(
        F.when(F.length(path) > 0, _digest(F.concat(F.col("tree"), path))).otherwise(F.col("tree")).alias("key"), "conv_id")
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(tops, "parent", "left").join(end_digests(ends), "key", "left").select(
        F.col("first").alias("conv_id"), "depth", F.coalesce("parent_first", "open_first").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"))
