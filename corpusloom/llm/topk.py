"""Exact top-k search: term-at-a-time accumulation over postings, blocks of rows against blocks of queries.

Vectors become whole numbers, query rows sparse lists of (term, weight). Rows and queries are dealt into
blocks of bounded size; each block of rows meets each block of queries in one task, which turns the rows
into postings per term, adds a query's weighted postings to a dense array of scores term after term, and
picks the best by partition selection. The best of each pair of blocks are merged per query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stage_compact

SCALE = 256
# Rows and queries of a block, on average. A block pair is one group of one task.
ROWS = 8192
QUERIES = 8192


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null for a vector that is null or holds a null or non-finite one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Postings:
    """Per term the slots of the rows that have it, rising, and their weights."""

    def __init__(self, offsets: np.ndarray, weights: np.ndarray):
        slots = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        terms = np.arange(len(weights)) - offsets[:-1][slots]
        kept = weights != 0
        order = np.argsort(terms[kept], kind="stable")
        self.rows = len(offsets) - 1
        self.slots, self.weights = slots[kept][order], weights[kept][order]
        self.bounds = np.searchsorted(terms[kept][order], np.arange(terms.max(initial=-1) + 2))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """The inner product of the query with every row."""
        out = np.zeros(self.rows, np.int64)
        for term in np.flatnonzero(query[:len(self.bounds) - 1]):
            a, b = self.bounds[term], self.bounds[term + 1]
            if b - a == self.rows:  # every row has the term: no slots to look up
                out += query[term] * self.weights[a:b]
            else:
                out[self.slots[a:b]] += query[term] * self.weights[a:b]
        return out


def best_slots(scores: np.ndarray, k: int) -> np.ndarray:
    """Slots of the k highest scores, of equal ones the smallest slots; all, if there are fewer."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]])


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    array = column.combine_chunks()
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    offsets = array.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return offsets - offsets[:1], array.flatten().to_numpy(zero_copy_only=False)


_NONE = np.iinfo(np.int64).min
_FOUND = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _searcher(k: int) -> Callable[[pa.Table], pa.Table]:
    def search(block: pa.Table) -> pa.Table:
        rows, queries = block.filter(pc.invert(block["asks"])), block.filter(block["asks"])
        if not rows.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        rows = rows.sort_by("id")  # nulls last; slots then break ties
        ids = rows["id"].to_numpy()
        postings = Postings(*_lists(rows["codes"]))
        offsets, weights = _lists(queries["codes"])
        uids, query_ids, scores, slots = [], [], [], []
        for n, (uid, own) in enumerate(zip(queries["uid"].to_pylist(), queries["id"].to_pylist(), strict=True)):
            found = postings.scores(weights[offsets[n]:offsets[n + 1]])
            first, last = np.searchsorted(ids, [own, own + 1]) if rows["id"].null_count == 0 else \
                np.searchsorted(ids[:rows.num_rows - rows["id"].null_count], [own, own + 1])
            rest = np.delete(np.arange(rows.num_rows), np.s_[first:last]) if last > first else None
            best = best_slots(found, k) if rest is None else rest[best_slots(found[rest], k)]
            uids.append(np.full(len(best), uid))
            query_ids.append(np.full(len(best), own))
            scores.append(found[best])
            slots.append(best)
        return pa.table([pa.array(np.concatenate(uids)), pa.array(np.concatenate(query_ids)),
                         pa.array(np.concatenate(scores)), rows["id"].take(pa.array(np.concatenate(slots)))],
                        schema=_FOUND)
    return search


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = SCALE, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """The ``k`` rows with the highest scores for each row whose id is divisible by ``every``.

    Columns: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``. A score is the inner product of
    floor(scale * x) over the components that both have, in 64 bits (it wraps around beyond). All rows
    are searched but those with the query's own id. Ties go to the smaller id, a null id last. Vectors that
    are null or hold a null or non-finite component take no part; an empty one scores 0. A row with a
    null id is found but asks nothing. A repeated row is a row of its own: it is found as often as it
    is there, and its query is answered as often. An empty table gives no rows.
    """
    coded = vectors.select(vectors[id_col].cast("bigint").alias("id"), whole_numbers(vectors[vector_col], scale).alias("codes"))
    coded = stage_compact(coded.filter("codes IS NOT NULL").withColumn("uid", F.monotonically_increasing_id()), "vectors")
    asked = coded.filter(F.col("id") % every == 0)
    down, across = (df.count() // size + 1 for df, size in ((coded, rows), (asked, queries)))

    def dealt(df: DataFrame, asks: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("uid"), F.lit(across if asks else down)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit((down if asks else across) - 1)))
        return df.select("uid", "id", "codes", F.lit(asks).alias("asks"),
                         (each if asks else own).alias("down"), (own if asks else each).alias("across"))

    found = dealt(coded, asks=False).unionAll(dealt(asked, asks=True)).groupBy("down", "across").applyInArrow(
        _searcher(k), "uid bigint, query_id bigint, score bigint, vec_id bigint")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
