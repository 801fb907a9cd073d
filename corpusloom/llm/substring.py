"""Substring dedup: removes every word inside a window of words that also starts earlier in the corpus.

The corpus is cut so that equal windows always meet. The least hash of the word groups inside a window
is its anchor, and consecutive windows with the same anchor in the same place form a segment.

1. Anchors are counted; those that occur once in the whole corpus are dropped. Map tasks settle anchors
   that they see twice themselves, so a hot anchor sends one row per batch to its counting task.
2. Documents with remaining anchors give their segments. Copies of a segment within a batch are settled
   at once. Segments of an anchor with too much text for one index are cut into single windows.
3. Segments are dealt to shards by anchor. A shard numbers its words, builds a compressed FM-index
   (Burrows-Wheeler transform in a wavelet matrix) over its distinct segments in corpus order, streams
   every window through backward search, and reports windows of full length whose range in the suffix
   order holds an earlier position.
4. The reported word ranges go back to their documents.

All comparisons that decide are on the words themselves; hashes only bring candidates together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

from pyspark.sql import DataFrame, functions as F

from .common import WORD_BYTES, carried, mix, per_row, restored, row_key, span_hashes, stage_compact, text_chunks, words
from .fmindex import FMIndex

WINDOW = 20
GROUP = 6               # words of the groups that anchors are chosen from
INDEX_WORDS = 1 << 18   # a shard is indexed in runs of whole anchors of about this many words, which take some 30 MB
HOT_BYTES = 16 << 20    # an anchor with more text than this is cut into single windows

_PLACE = np.uint64((1 << 24) - 1)
_LAST = (1 << 63) - 1   # order of a null id

ANCHORS = "route bigint, anchor bigint, key bigint, kind tinyint"
HITS = "key bigint, anchor bigint"
SEGMENTS = "route bigint, oid bigint, key bigint, start int, n int, seg binary"
RANGES = "oid bigint, key bigint, lo int, hi int"


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, window: int,
            group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with their anchor at one place: row, first window, windows, anchor.

    Windows are numbered by their first word. The place is that of the leftmost least hash, so equal
    windows have equal anchors at equal distances, and no run is longer than a window's groups.
    """
    none = np.zeros(0, np.int64)
    n = len(starts) - window + 1
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    word = span_hashes(data, starts, ends)
    grouped = np.zeros(len(word) - group + 1, np.uint64)
    for step in range(group):
        grouped += word[step:len(word) - group + 1 + step] * np.uint64(2 * step * step + 12 * step + 3)
    grouped = mix(grouped)
    number = np.arange(len(grouped), dtype=np.uint64)
    least, width, wanted = (grouped & ~_PLACE) | (number & _PLACE), 1, window - group + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[:n], least[wanted - width:wanted - width + n])
    place = (number[:n] + ((least - number[:n]) & _PLACE)).astype(np.int64)
    row = per_row(firsts)
    inside = np.arange(n) + window <= firsts[1:][row[:n]]
    first = np.ones(n, bool)
    first[1:] = (place[1:] != place[:-1]) | (row[1:n] != row[:n - 1])
    begin = np.flatnonzero(first & inside)
    closed = np.flatnonzero(np.append(first[1:] | ~inside[1:], True) & inside)
    return row[begin], begin, closed - begin + 1, grouped[place[begin]]


def _emit_anchors(window: int, group: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            key = np.asarray(batch.column(0))
            for first, data, bounds in text_chunks(batch.column(1)):
                starts, ends, firsts = words(data, bounds)
                row, _, _, anchor = anchors(data, starts, ends, firsts, window, group)
                keys.append(key[first + row])
                found.append(anchor)
            if not found:
                continue
            owner, anchor = np.concatenate(keys), np.concatenate(found)
            values, place, count = np.unique(anchor, return_inverse=True, return_counts=True)
            known = (count > 1)[place]
            lone, often = np.flatnonzero(~known), np.flatnonzero(known)
            settled = values[count > 1]
            yield _anchor_rows(anchor[lone], anchor[lone], owner[lone], 0)
            yield _anchor_rows(settled, settled, np.zeros(len(settled), np.int64), 1)
            yield _anchor_rows(mix(owner[often].view(np.uint64)), anchor[often], owner[often], 2)
    return run


def _anchor_rows(route: np.ndarray, anchor: np.ndarray, key: np.ndarray, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(route.view(np.int64)), pa.array(anchor.view(np.int64)), pa.array(key),
         pa.array(np.full(len(key), kind, np.int8))], names=["route", "anchor", "key", "kind"])


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of anchors that occur again. Holds the anchors and keys of one shuffle partition."""
    anchor, key, lone = [], [], []
    for batch in batches:
        kind = np.asarray(batch.column(3))
        a, k = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        settled, counted = kind == 2, kind < 2
        if settled.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[settled]), pa.array(a[settled])], names=["key", "anchor"])
        anchor.append(a[counted])
        key.append(k[counted])
        lone.append(kind[counted] == 0)
    if anchor:
        a, k, alone = np.concatenate(anchor), np.concatenate(key), np.concatenate(lone)
        _, place, count = np.unique(a, return_inverse=True, return_counts=True)
        again = (count > 1)[place] & alone
        yield pa.RecordBatch.from_arrays([pa.array(k[again]), pa.array(a[again])], names=["key", "anchor"])


class _Copies:
    """Segments of one batch: each content once, at its first place; the other places are settled."""

    def __init__(self):
        self.first: dict[bytes, tuple] = {}
        self.settled: list[tuple] = []

    def add(self, route: int, oid: int, key: int, start: int, n: int, segment: bytes) -> None:
        new = (oid, key, start, n, route)
        old = self.first.setdefault(segment, new)
        if old == new:
            return
        if new < old:
            self.first[segment], new = new, old
        self.settled.append(new)

    def rows(self) -> pa.RecordBatch:
        rows = [*self.first.values(), *self.settled]
        oid, key, start, n, route = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(route, pa.int64()), pa.array(oid, pa.int64()), pa.array(key, pa.int64()),
             pa.array(start, pa.int32()), pa.array(n, pa.int32()),
             pa.array([*self.first, *[None] * len(self.settled)], pa.binary())],
            names=["route", "oid", "key", "start", "n", "seg"])


def _emit_segments(window: int, group: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies = _Copies()
            oid, key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            hits = batch.column(3)
            hit_bounds = np.asarray(hits.offsets)
            hit_values = np.asarray(hits.values).view(np.uint64)
            for first, data, bounds in text_chunks(batch.column(2)):
                starts, ends, firsts = words(data, bounds)
                row, begin, count, anchor = anchors(data, starts, ends, firsts, window, group)
                last = first + len(bounds) - 1
                wanted = hit_values[hit_bounds[first]:hit_bounds[last]] * np.uint64(2) \
                    + np.repeat(mix(np.arange(first, last, dtype=np.uint64)), np.diff(hit_bounds[first:last + 1]))
                mine = anchor * np.uint64(2) + mix((row + first).astype(np.uint64))
                chosen = np.flatnonzero(np.isin(mine, wanted))
                if not len(chosen):
                    continue
                kept = np.zeros(len(data) + 1, bool)
                kept[:-1] = WORD_BYTES[data]
                text = np.where(kept[:-1], data, np.uint8(32))
                kept[ends] = True
                text = text[kept[:-1]].tobytes()
                place = np.concatenate([[0], np.cumsum(kept[:-1])])
                row, begin, count = row[chosen], begin[chosen], count[chosen]
                n = count + window - 1
                columns = (anchor[chosen].view(np.int64), oid[first + row], key[first + row], begin - firsts[row], n,
                           place[starts[begin]], place[ends[begin + n - 1]])
                for a, o, k, s, m, lo, hi in zip(*[c.tolist() for c in columns], strict=True):
                    copies.add(a, o, k, s, m, text[lo:hi])
            yield copies.rows()
    return run


def _cut_windows(window: int) -> Callable:
    """Segments of hot anchors as single windows, each routed by its own words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = np.asarray(batch.column(6).is_valid()) & np.asarray(batch.column(5).is_valid())
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(~hot)).columns[:6], names=batch.schema.names[:6])
            copies = _Copies()
            for r in batch.filter(pa.array(hot)).to_pylist():
                parts = r["seg"].split(b" ")
                for i in range(r["n"] - window + 1):
                    piece = b" ".join(parts[i:i + window])
                    route = xxhash.xxh64_intdigest(piece) - (1 << 63)
                    copies.add(route, r["oid"], r["key"], r["start"] + i, window, piece)
            yield copies.rows()
    return run


def shard_repeats(oid: np.ndarray, key: np.ndarray, start: np.ndarray, n: np.ndarray, segments: pa.Array,
                  window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges of one shard that are repeated: segment number, first word, end, by the FM-index.

    A segment whose words equal an earlier one's is repeated whole and is left out of the index.
    """
    order = np.lexsort((start, key, oid))
    content = np.asarray(pa.array(segments).dictionary_encode().indices)[order]
    _, first, place = np.unique(content, return_index=True, return_inverse=True)
    own = first[place] == np.arange(len(order))
    same = np.zeros(len(order), bool)  # a row given twice is no repeat of itself
    lead = order[first[place]]
    same[:] = (oid[order] == oid[lead]) & (key[order] == key[lead]) & (start[order] == start[lead])
    copies = order[~own & ~same]
    found = [(copies, start[copies].astype(np.int64), start[copies].astype(np.int64) + n[copies])]
    distinct = order[own]
    text = b" ".join(segments.take(pa.array(distinct)).to_pylist())
    data = np.frombuffer(text, np.uint8)
    blank = np.flatnonzero(data == 32)
    begins, stops = np.append(0, blank + 1), np.append(blank, len(data))
    spread = pa.Array.from_buffers(pa.large_binary(), len(begins), [
        None, pa.py_buffer(np.append(begins, len(data) + 1).astype(np.int64)), pa.py_buffer(text + b" ")])
    number = np.asarray(spread.dictionary_encode().indices).astype(np.int64) + 2
    sizes = n[distinct].astype(np.int64)
    assert sizes.sum() == len(number) == len(stops)
    base = np.cumsum(sizes + 1) - sizes - 1
    sequence = np.ones(len(number) + len(distinct) + 1, np.int64)
    sequence[np.arange(len(number)) + np.repeat(np.arange(len(distinct)), sizes)] = number
    sequence[-1] = 0
    windows = sizes - window + 1
    which = np.repeat(np.arange(len(distinct)), windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = base[which] + offset
    index = FMIndex(sequence)
    reached, low, high = index.repeats(sequence, begin + window - 1, window)
    earlier = reached[index.first_occurrence(low, high) < begin[reached]]
    earlier.sort()
    at = distinct[which[earlier]]
    found.append((at, start[at] + offset[earlier], start[at] + offset[earlier] + window))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _search_shards(window: int, index_words: int) -> Callable:
    def settle(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        oid, key, start, n = (np.asarray(rows.column(c).combine_chunks()) for c in ("oid", "key", "start", "n"))
        at, lo, hi = shard_repeats(oid, key, start, n, rows.column("seg").combine_chunks(), window)
        # Windows in a row make one range: sorted by document and start, joined while they overlap.
        order = np.lexsort((lo, key[at], oid[at]))
        at, lo, hi = at[order], lo[order], hi[order]
        new = np.ones(len(at), bool)
        new[1:] = (key[at[1:]] != key[at[:-1]]) | (oid[at[1:]] != oid[at[:-1]]) \
            | (lo[1:] > hi[:-1]) | (hi[1:] < hi[:-1])
        heads = np.flatnonzero(new)
        tops = np.append(heads[1:], len(at)) - 1 if len(heads) else heads
        return _ranges(oid[at[heads]], key[at[heads]], lo[heads], hi[tops])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            known = np.asarray(batch.column("seg").is_null())
            if known.any():
                rest = batch.filter(pa.array(known))
                start = np.asarray(rest.column("start"))
                yield _ranges(np.asarray(rest.column("oid")), np.asarray(rest.column("key")), start,
                              start + np.asarray(rest.column("n")))
            batch = batch.filter(pa.array(~known))
            while batch.num_rows:  # cut where the route changes, once enough words are held
                route = np.asarray(batch.column("route"))
                words_so_far = total + np.cumsum(np.asarray(batch.column("n")))
                change = np.flatnonzero(np.append(held[-1].column("route")[-1].as_py() != route[0] if held else False,
                                                  route[1:] != route[:-1]))
                full = change[words_so_far[change] - np.asarray(batch.column("n"))[change] >= index_words]
                if not len(full):
                    held.append(batch)
                    total = int(words_so_far[-1])
                    break
                if full[0]:
                    held.append(batch.slice(0, int(full[0])))
                yield settle(pa.Table.from_batches(held))
                held, total, batch = [], 0, batch.slice(int(full[0]))
        if held:
            yield settle(pa.Table.from_batches(held))
    return run


def _ranges(oid: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(oid), pa.array(key), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
        names=["oid", "key", "lo", "hi"])


def repeated_ranges(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                    group: int = GROUP, index_words: int = INDEX_WORDS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Word ranges that windows with an earlier twin cover: ``oid``, ``key``, ``lo``, ``hi``.

    ``oid`` is the id (null as the largest), ``key`` the row key; ranges may overlap.
    """
    keyed = docs.select(_order_id(id_col), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    seen = keyed.select("key", "text").mapInArrow(_emit_anchors(window, group), ANCHORS)
    hits = seen.repartition("route").mapInArrow(_repeated_anchors, HITS)
    wanted = hits.groupBy("key").agg(F.collect_list("anchor").alias("anchors"))
    segments = stage_compact(
        keyed.join(wanted, "key").select("oid", "key", "text", "anchors")
        .mapInArrow(_emit_segments(window, group), SEGMENTS), "segments")
    hot = stage_compact(
        segments.filter("seg IS NOT NULL").groupBy("route").agg(F.sum(F.octet_length("seg")).alias("bytes"))
        .filter(F.col("bytes") > hot_bytes).select("route", F.lit(True).alias("hot")), "hot-anchors")
    if not hot.isEmpty():
        segments = segments.join(hot, "route", "left").select("route", "oid", "key", "start", "n", "seg", "hot") \
            .mapInArrow(_cut_windows(window), SEGMENTS)
    # A settled row has nothing to meet, so it is dealt by its document.
    deal = F.when(F.col("seg").isNull(), F.xxhash64("key", "start")).otherwise(F.col("route"))
    return segments.withColumn("route", deal).repartition("route").sortWithinPartitions("route") \
        .mapInArrow(_search_shards(window, index_words), RANGES)


def _order_id(id_col: str):
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("oid")


def _apply_ranges(outputs: tuple[str, ...], kept: int, place: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in text_chunks(batch.column(place)):
                rows = len(bounds) - 1
                found = _cut(data, bounds, batch.column(kept).slice(first, rows), outputs)
                others = [c.slice(first, rows) for c in batch.columns[:kept]]
                yield pa.RecordBatch.from_arrays([*others, *found.values()],
                                                 names=[*batch.schema.names[:kept], *found])
    return run


def _cut(data: np.ndarray, bounds: np.ndarray, ranges: pa.Array, outputs: tuple[str, ...]) -> dict[str, pa.Array]:
    """Counts and kept texts of a run of rows, from the word ranges to remove."""
    starts, ends, firsts = words(data, bounds)
    rows = len(bounds) - 1
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ranges), 0)).astype(np.int64)
    flat = pa.compute.list_flatten(ranges)
    base = np.repeat(firsts[:-1], sizes)
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, base + np.asarray(flat.field("lo")), 1)
    np.add.at(change, base + np.asarray(flat.field("hi")), -1)
    gone = np.cumsum(change[:-1]) > 0
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[firsts])
    out = {"n_words": pa.array(np.diff(firsts)), "n_removed": pa.array(removed)}
    if "kept_words" in outputs:
        stay = ~gone
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[stay]] = 1
        inside[ends[stay]] -= 1
        length = (ends - starts)[stay]
        joined = np.full(int(length.sum()) + len(length), 32, np.uint8)
        letters = np.ones(len(joined), bool)
        letters[np.cumsum(length + 1) - 1] = False
        joined[letters] = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        sums = np.bincount(per_row(firsts)[stay], weights=length + 1, minlength=rows).astype(np.int64)
        edge, text = np.concatenate([[0], np.cumsum(sums)]), joined.tobytes()
        out["kept_words"] = pa.array([text[edge[i]:max(edge[i], edge[i + 1] - 1)].decode("utf-8", "replace")
                                      for i in range(rows)], pa.string())
    if "kept_text" in outputs:
        # The text without the removed words and the white space after each.
        row = per_row(firsts)
        last = np.append(row[1:] != row[:-1], True) if len(starts) else np.zeros(0, bool)
        follow = np.where(last, bounds[1:][row], np.append(starts[1:], len(data))) if len(starts) else starts
        cut = np.zeros(len(data) + 1, np.int32)
        np.add.at(cut, starts[gone], 1)
        np.add.at(cut, follow[gone], -1)
        left = np.cumsum(cut[:-1]) == 0
        place, rest = np.concatenate([[0], np.cumsum(left)])[bounds], data[left].tobytes()
        out["kept_text"] = pa.array([rest[place[i]:place[i + 1]].decode("utf-8", "replace")
                                     for i in range(rows)], pa.string())
    return out


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                    keep: list[str] | None = None, outputs: tuple[str, ...] = ("kept_words", "kept_text"),
                    **sizes: int) -> DataFrame:
    """Each document without the words that repeated windows cover.

    Columns: the id (or the columns in ``keep``), ``n_words``, ``n_removed``, ``kept_words`` (kept words
    joined by one space), ``kept_text`` (the text less each removed word and the white space after it;
    unchanged where nothing is removed); ``outputs`` names those of the last two to make. One row per
    input row.

    Windows are compared in the order of the id (an integer), then of the row key for different texts
    under one id, then of the place in the text; null ids come last. Rows that agree in id and text are
    one document given twice: they are no repeats of each other and share one result. A null text, an
    empty one and one of fewer than ``window`` words lose nothing.
    """
    columns = keep or [id_col]
    ranges = repeated_ranges(docs, window, id_col, text_col, **sizes) \
        .groupBy("oid", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    narrow, place = carried(docs, text_col, columns, _order_id(id_col), row_key(id_col, text_col).alias("key"))
    names = [f"__{i}" for i in range(len(columns))]
    extra = [] if text_col in columns else ["__text"]
    joined = narrow.join(ranges, ["oid", "key"], "left").select(*names, "ranges", *extra)
    schema = narrow.select(names).schema.add("n_words", "long").add("n_removed", "long")
    for name in outputs:
        schema = schema.add(name, "string")
    place = place if text_col in columns else len(names) + 1
    return restored(joined.mapInArrow(_apply_ranges(outputs, len(names), place), schema), columns)
