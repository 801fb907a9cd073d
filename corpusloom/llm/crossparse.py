"""Language identification by cross-parsing entropy over suffix automata.

Each language has the suffix automaton of some labelled text. A text is parsed greedily into the
longest phrases that the labelled text contains; the language that needs the fewest phrases, each
counted at the cost of naming a place in its labelled text, wins.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import carried, remainder, restored, text_chunks

# Bounds of the labelled sample: rows per label value, and characters taken of each, so 49,152 per label.
# A longer text gives as many windows of equal size, each from its own stretch of the whole text.
SAMPLE_ROWS = 96
SAMPLE_CHARS = 512
WINDOWS = 8

# Texts are parsed in stretches of this many symbols, side by side; every stretch starts a phrase.
STRETCH = 256

_SPACE, _PAD = 32, 0
# Lower case for A-Z; digits, marks and white space are one separator; other bytes stay.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else _SPACE
                  for c in range(256)], np.uint8)


def fold(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, runs of separators as one, and the new row boundaries."""
    symbols = _FOLD[data]
    blank = symbols == _SPACE
    extra = np.zeros(len(symbols), bool)
    extra[1:] = blank[1:] & blank[:-1]
    extra[bounds[:-1][bounds[:-1] < len(symbols)]] = False
    kept = np.concatenate([[0], np.cumsum(~extra)])
    return symbols[~extra], kept[bounds]


def suffix_automaton(symbols: bytes) -> list[dict[int, int]]:
    """Transitions per state of the automaton that accepts every substring; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for symbol in symbols:
        state, at = len(moves), last
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at != -1 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = link[at]
        if at != -1:
            target = moves[at][symbol]
            if length[at] + 1 == length[target]:
                link[state] = target
            else:
                clone = len(moves)
                moves.append(dict(moves[target]))
                link.append(link[target])
                length.append(length[at] + 1)
                while at != -1 and moves[at].get(symbol) == target:
                    moves[at][symbol] = clone
                    at = link[at]
                link[target] = link[state] = clone
        last = state
    return moves


@functools.lru_cache(maxsize=1)
def tables(labelled: tuple[tuple[str, bytes], ...]) -> tuple[np.ndarray, list[tuple[str, np.ndarray, float]]]:
    """The symbol numbers, and per language its flat transition table and the cost of a phrase.

    A move that does not exist ends the phrase and starts the next with the same symbol; it is stored
    as the complement of the state after that symbol. The last state is the one before any phrase, and
    after a symbol that the language lacks. Number 0 is padding, 1 a symbol no language has.
    """
    seen = sorted(set().union(*[set(text) for _, text in labelled]))
    number = np.ones(256, np.uint8)
    for place, symbol in enumerate(seen, 2):
        number[symbol] = place
    width, found = len(seen) + 2, []
    for language, text in labelled:
        moves = suffix_automaton(text)
        start = np.full(width, len(moves), np.int32)
        for symbol, state in moves[0].items():
            start[number[symbol]] = state
        table = np.tile(~start, (len(moves) + 1, 1))
        table[:, 0] = np.arange(len(moves) + 1)
        for state, out in enumerate(moves):
            for symbol, target in out.items():
                table[state, number[symbol]] = target
        found.append((language, table.ravel(), float(np.log2(max(2, len(text))))))
    return number, found


def phrases(symbols: np.ndarray, bounds: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Phrases per row; ``symbols`` are symbol numbers."""
    sizes = np.diff(bounds)
    lanes = -(-sizes // STRETCH)
    row = np.repeat(np.arange(len(sizes)), lanes)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = bounds[:-1][row] + nth * STRETCH
    left = np.minimum(STRETCH, bounds[1:][row] - begin)
    padded = np.concatenate([symbols, np.zeros(STRETCH, np.uint8)])
    order = np.argsort(-left, kind="stable")
    begin, left = begin[order], left[order]
    alive = np.searchsorted(-left, -np.arange(STRETCH), side="left")  # lanes longer than each step
    state = np.full(len(row), len(table) // width - 1, np.int32)
    count = np.zeros(len(row), np.int32)
    for step in range(STRETCH):
        n = alive[step]
        if not n:
            break
        moved = table.take(state[:n] * width + padded[begin[:n] + step])
        ended = moved >> 31
        count[:n] -= ended
        state[:n] = moved ^ ended
    return np.bincount(row[order], weights=count, minlength=len(sizes))


def judge(column: pa.Array, labelled: tuple[tuple[str, bytes], ...]) -> tuple[list[str], np.ndarray]:
    """The best language of each text and how clearly it wins, 0 to 1."""
    number, models = tables(labelled)
    names = [language for language, _, _ in models]
    width = int(number.max()) + 1
    best, score = [], []
    for _, data, bounds in text_chunks(column):
        symbols, cuts = fold(data, bounds)
        symbols = number[symbols]
        cost = np.array([phrases(symbols, cuts, table, width) * bits for _, table, bits in models])
        order = np.argsort(cost, axis=0, kind="stable")
        least = np.take_along_axis(cost, order[:1], 0)[0]
        second = np.take_along_axis(cost, order[1:2], 0)[0] if len(models) > 1 else np.full(len(least), np.inf)
        best += [names[k] for k in order[0]]
        score.append(np.where(second > 0, 1 - least / np.where(second > 0, second, 1), 0.0))
    return best, np.concatenate(score) if score else np.zeros(0)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def spread(text: Column, chars: int) -> Column:
    """The whole text up to ``chars`` characters, else ``WINDOWS`` windows at places that its hash gives,
    one in each equal stretch of the text, with a space between them."""
    size, total = chars // WINDOWS, F.length(text).cast("bigint")
    parts = []
    for k in range(WINDOWS):
        low, high = F.floor(total * k / WINDOWS), F.floor(total * (k + 1) / WINDOWS)
        place = low + F.pmod(F.xxhash64(text, F.lit(k)), F.greatest(high - low - size + 1, F.lit(1)))
        parts.append(F.substring(text, (place + 1).cast("int"), F.lit(size)))
    return F.when(total <= chars, text).otherwise(F.concat_ws(" ", *parts))


def learn(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) \
        -> tuple[tuple[str, bytes], ...]:
    """Labelled text per language, from a bounded sample of the rows that ``trainable`` admits.

    Per label value the ``rows`` rows with a letter and the smallest hash of the id, ``chars`` characters of
    each, from all over the text (``spread``). A row given several times counts once. The rows are chosen
    from narrow columns alone; then only windows of the chosen texts reach the driver.
    """
    labelled = docs.filter(trainable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & has_letter(F.col(text_col))) \
        .select(F.col(id_col).alias("i"), F.col(label_col).cast("string").alias("l"),
                F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    by_hash = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i", "h")
    chosen = labelled.select("i", "l", "h").distinct().withColumn("n", F.row_number().over(by_hash)) \
        .filter(F.col("n") <= rows).select("i", "l", "h").collect()
    wanted = {(r["i"], r["l"], r["h"]) for r in chosen}
    found = labelled.filter(F.col("i").isin(sorted({r["i"] for r in chosen})) & F.col("h").isin([r["h"] for r in chosen])) \
        .select("i", "l", "h", spread(F.col("t"), chars).alias("t")) \
        .groupBy("i", "l", "h").agg(F.min("t").alias("t")).collect() if chosen else []
    by_label: dict[str, list[bytes]] = {}
    for r in sorted(found, key=lambda r: (r["l"], r["i"], r["t"])):
        if (r["i"], r["l"], r["h"]) in wanted:
            raw = np.frombuffer(r["t"].encode("utf-8", "surrogatepass"), np.uint8)
            by_label.setdefault(r["l"], []).append(fold(raw, np.array([0, len(raw)]))[0].tobytes())
    return tuple((label, b" ".join(parts)) for label, parts in sorted(by_label.items()))


def identify(docs: DataFrame, labelled: tuple[tuple[str, bytes], ...], id_col: str = "doc_id",
             text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The language of each whole text: the id (or the columns in ``keep``), ``lang_pred``, ``score``.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned. The
    score is the share of the best language's cost saved against the second best; ties go to the first
    language in name order with score 0. Rows are judged one by one, nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(labelled)
    columns = keep or [id_col]
    narrow, place = carried(docs, text_col, columns, has_letter(docs[text_col]).alias("__letter"))
    names = [f"__{i}" for i in range(len(columns))]
    schema = narrow.select(names).schema.add("lang_pred", "string").add("score", "double")
    return restored(narrow.mapInArrow(_judge_batches(shared, len(names), place), schema), columns)


def _judge_batches(shared, kept: int, place: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelled = shared.value
        for batch in batches:
            known = np.array(batch.column(kept)) & bool(labelled)
            if labelled and batch.num_rows:
                best, score = judge(batch.column(place), labelled)
                best = [b if k else "und" for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(score, 0, 1), 0.0)
            else:
                best, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:kept], pa.array(best, pa.string()), pa.array(score, pa.float64())],
                names=[*batch.schema.names[:kept], "lang_pred", "score"])
    return run


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(remainder(F.col(id_col), 4) == 2, F.lit(False))
