"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with smallest period q that no neighbouring word extends and that is at
least ``max(min_length, 2 * q)`` words long. The dictionary names the factors of 1, 2, 4, ... words; a
factor of twice the length is a pair of names. At length m the successive occurrences of a factor that
are at most m / 2 words apart form arithmetic progressions. The step of a progression, and the distances
between members of progressions up to 2 m apart, are the periods proposed there; each is extended to both
sides, and of proposals for one stretch the smallest stays.

No run is missed: with m <= q < 2 m the factor at the run's start occurs again q words later. Were both in
one progression, its step would be a smaller period; so they lie in two, at most three progressions
apart, as others are more than m / 2 words away. Factors that do not recur in their text are dropped before
the next length, so the names of prose are few beyond the first lengths.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, types as T

from .common import carried, restored, text_chunks

MIN_LENGTH = 12
JUMPS = 3  # progressions of one factor that start within 2 m words of each other
_STRIDE = 64
RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))


def find_runs(x: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs of the numbers ``x``, by start and period."""
    found: dict[tuple[int, int], int] = {}
    first = 1 << (max(1, min_length // 2).bit_length() - 1)  # shorter periods are proposed at this length too
    size, positions, codes = 1, np.arange(len(x)), x.astype(np.int64)
    names, named = np.full(len(x), -1, np.int64), positions
    while len(positions):
        order = np.argsort(codes, kind="stable")
        at, codes = positions[order], codes[order]
        new = np.append(True, codes[1:] != codes[:-1])
        gaps = np.where(new[1:], np.iinfo(np.int64).max, np.diff(at))
        if size >= first:
            _extend(x, size, min_length, found, *_proposals(at, new, gaps, size, 1 if size == first else size))
        again = ~(new & np.append(new[1:], True))
        rank = np.cumsum(new)[again]
        names[named] = -1
        named = np.sort(at[again])
        names[at[again]] = rank
        positions = named[named + size < len(x)]
        second = names[positions + size]
        positions, second = positions[second >= 0], second[second >= 0]
        codes = names[positions] * (len(at) + 1) + second
        size *= 2
    runs = np.array(sorted((s, e - s, q) for (s, e), q in found.items()), np.int64).reshape(-1, 3)
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _proposals(at: np.ndarray, new: np.ndarray, gaps: np.ndarray, size: int, least: int) \
        -> tuple[np.ndarray, np.ndarray]:
    """Periods from ``least`` to below ``2 * size``, and a place of each, from the occurrences ``at`` of the
    factors of ``size`` words, which stand by factor and place."""
    head = np.append(True, gaps > size // 2)
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], len(at)) - 1
    factor = np.cumsum(new)[begin]
    members = end - begin
    step = np.where(members > 0, at[np.minimum(begin + 1, len(at) - 1)] - at[begin], 0)
    periods, places = [], []
    if least == 1:
        periods.append(step[members > 0])
        places.append(at[begin[members > 0]])
    for jump in range(1, JUMPS + 1):
        one = np.flatnonzero(factor[jump:] == factor[:-jump])
        between = at[begin[one + jump]] - at[end[one]]
        one, between = one[between < 2 * size], between[between < 2 * size]
        by = np.maximum(step[one], step[one + jump])
        wide = np.maximum(by, 1)
        low = np.maximum(0, -((between - least) // wide))
        high = np.minimum(members[one] + members[one + jump], (2 * size - 1 - between) // wide)
        count = np.maximum(0, high - low + 1)
        each = np.repeat(np.arange(len(one)), count)
        t = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + low[each]
        periods.append(between[each] + t * by[each])
        places.append(at[end[one[each]]] - np.minimum(t, members[one[each]]) * by[each])
    return np.concatenate(periods), np.concatenate(places)


def _extend(x: np.ndarray, size: int, min_length: int, found: dict, periods: np.ndarray, places: np.ndarray) -> None:
    """Add the runs around the places to ``found``: (start, end) -> the smallest period."""
    order = np.lexsort((places, periods))
    last, reached = 0, -1
    for q, i in zip(periods[order].tolist(), places[order].tolist(), strict=True):
        if q == last and i < reached:
            continue
        start, stop = _agrees_back(x, i, q), _agrees(x, i + size, q)
        last, reached = q, stop
        if stop + q - start >= max(min_length, 2 * q):
            found[start, stop + q] = min(q, found.get((start, stop + q), q))


def _agrees(x: np.ndarray, i: int, q: int) -> int:
    """The first place from ``i`` on that differs from the one ``q`` later."""
    stride, stop = _STRIDE, len(x) - q
    while i < stop:
        there = min(stop, i + stride)
        differ = x[i:there] != x[i + q:there + q]
        if differ.any():
            return i + int(differ.argmax())
        i, stride = there, 2 * stride
    return max(i, stop)


def _agrees_back(x: np.ndarray, i: int, q: int) -> int:
    """The smallest place from which all up to ``i`` agree with those ``q`` later."""
    stride = _STRIDE
    while i > 0:
        there = max(0, i - stride)
        differ = x[there:i] != x[there + q:i + q]
        if differ.any():
            return i - int(differ[::-1].argmax())
        i, stride = there, 2 * stride
    return 0


def _numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers that no two documents share, and the documents' boundaries."""
    out, base = [], 0
    for tokens in documents:
        seen: dict[bytes, int] = {}
        out.append(np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.int64, len(tokens)) + base)
        base += len(seen)
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), np.cumsum([0, *map(len, documents)])


def collapse(tokens: list[bytes], starts: list[int], lengths: list[int], periods: list[int]) -> bytes:
    """The words joined by a space, without those after a run's first period."""
    if not starts:
        return b" ".join(tokens)
    edges = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(edges, np.add(starts, periods), 1)
    np.add.at(edges, np.add(starts, lengths), -1)
    return b" ".join(itertools.compress(tokens, (np.cumsum(edges[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_length: int = MIN_LENGTH, keep: list[str] | None = None) -> DataFrame:
    """The periodic runs of each text, and the text without the repetitions.

    Columns: the id (or the columns named in ``keep``), ``n_words``, ``runs`` (start, length, period; by
    start and period; start and length in words) and ``collapsed`` (the words joined by one space, without
    those that a run holds after its first period). A null or empty text has no words, no runs and an empty
    ``collapsed``. Rows are judged one by one, so repeated rows give repeated results; a null id is kept.
    Words are compared, not hashes of them. Texts are read whole; no row is shuffled.
    """
    columns = keep or [id_col]
    narrow, place = carried(docs, text_col, columns)
    names = [f"__{i}" for i in range(len(columns))]
    schema = narrow.select(names).schema.add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    return restored(narrow.mapInArrow(_finder(min_length, len(names), place), schema), columns)


_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _finder(min_length: int, kept: int, place: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in text_chunks(batch.column(place)):
                body = data.tobytes()
                documents = [body[a:b].split() for a, b in itertools.pairwise(bounds.tolist())]
                x, edges = _numbered(documents)
                starts, lengths, periods = find_runs(x, min_length)
                cuts = np.searchsorted(starts, edges)
                starts -= np.repeat(edges[:-1], np.diff(cuts))
                columns = [a.tolist() for a in (starts, lengths, periods)]
                texts = [collapse(tokens, *(c[a:b] for c in columns))
                         for tokens, (a, b) in zip(documents, itertools.pairwise(cuts.tolist()), strict=True)]
                runs = pa.ListArray.from_arrays(
                    pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
                        [pa.array(a, pa.int64()) for a in (starts, lengths, periods)], fields=list(_RUN_TYPE.value_type)))
                part = batch.slice(first, len(documents))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:kept], pa.array(np.diff(edges), pa.int64()), runs,
                     pa.array(texts, pa.binary()).view(pa.string())],
                    names=[*part.schema.names[:kept], "n_words", "runs", "collapsed"])
    return run
