"""Language-model score by subword lattices: the marginal probability of a text over all segmentations.

The pieces are those of an existing vocabulary, and its scores are the first weights. A word with a mark
in front is a lattice with an arc for every substring that is a piece and for every single byte; no piece
crosses into the next word, so a text's probability is the product of its words' and of the end.
Expectation-maximisation over the distinct words of the training documents re-estimates the weights.
A word of the training documents has one more arc, the word as a whole: its count less a discount, over
all tokens. What the discounts leave is the weight of the arcs of pieces, which are learned from distinct
words, as it is new and rare words that need them.

Word counts are exact. The most frequent words, a bounded table, are broadcast with their counts; each
document's other words meet their counts in a join.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, remainder, row_key, stage_compact, text_chunks, words

MARK = b" "
FREQUENT = 1 << 17      # bound of the broadcast table of frequent words
EM_ROUNDS = 2
DISCOUNT = 0.75         # taken from the count of every training word
SMOOTH = 0.1            # added to the expected count of every piece
ACROSS = 40             # words of up to this many bytes are handled side by side, longer ones singly
HELD_WORDS = 1 << 20    # distinct words that a counting task holds before it passes them on

COUNTS = "word binary, n bigint"
SCORED = ("kind int, key bigint, word binary, n bigint, held_out boolean, n_known bigint, base double, "
          "score double, id {}")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(remainder(F.col(id_col), 7) == 2, F.lit(False))


def vocabulary(model_file: str) -> dict[bytes, float]:
    """Pieces as bytes, word starts marked, with first weights from the vocabulary's scores.

    Scores that are log probabilities are used as such; scores that are ranks (0, -1, -2, ...) become
    Zipf weights. Pieces with A-Z, or with a mark behind their start, never occur in marked lower-case
    words and are left out. Every byte is a piece.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = {}
    for number in range(model.vocab_size()):
        if not (model.is_control(number) or model.is_unknown(number) or model.is_byte(number)):
            piece = model.id_to_piece(number).replace("▁", " ").encode()
            if piece and MARK not in piece[1:] and not any(65 <= byte <= 90 for byte in piece):
                found[piece] = model.get_score(number)
    ranks = found and all(float(score).is_integer() for score in found.values())
    weights = {piece: 1 / (10 - score) if ranks else float(np.exp(score)) for piece, score in found.items()}
    least = min(weights.values(), default=1.0)
    return {**{bytes([byte]): least for byte in range(256)}, **weights}


@dataclass(frozen=True)
class Pieces:
    """Pieces in hash order and the natural log of their probabilities; ``end`` is that of the end."""
    names: tuple[bytes, ...]
    hashes: np.ndarray
    logs: np.ndarray
    end: float
    longest: int

    @functools.cached_property
    def table(self) -> dict[bytes, int]:
        return {name: place for place, name in enumerate(self.names)}


_FACTOR = np.uint64(0x100000001B3)


def _hash(piece: bytes) -> int:
    value = 0xCBF29CE484222325
    for byte in piece:
        value = (value * 0x100000001B3 + byte + 1) & (1 << 64) - 1
    return value


def make_pieces(weights: dict[bytes, float], end: float) -> Pieces:
    order = sorted(weights, key=_hash)
    hashes = np.array([_hash(piece) for piece in order], np.uint64)
    assert len(np.unique(hashes)) == len(hashes)
    values = np.array([weights[piece] for piece in order])
    total = values.sum() + end
    return Pieces(tuple(order), hashes, np.log(values / total), float(np.log(end / total)), max(map(len, order)))


def _by_length(names: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length: their numbers, and their bytes with the mark in front as a matrix."""
    sizes = pc.binary_length(names).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(names.buffers()[1], np.int32)[names.offset:names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2], np.uint8)
    order = np.argsort(sizes, kind="stable")
    for size in np.unique(sizes):
        chosen = order[np.searchsorted(sizes[order], size):np.searchsorted(sizes[order], size, side="right")]
        if size > ACROSS:
            for number in chosen:
                yield np.array([number]), np.concatenate(
                    [[np.uint8(32)], data[offsets[number]:offsets[number] + size]])[None, :]
        else:
            for start in range(0, len(chosen), 1 << 15):
                part = chosen[start:start + (1 << 15)]
                matrix = np.full((len(part), size + 1), 32, np.uint8)
                matrix[:, 1:] = data[offsets[part][:, None] + np.arange(size)]
                yield part, matrix


def _arcs(matrix: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Start, end, rows and pieces of all arcs, by start."""
    n, size = matrix.shape
    last = len(pieces.hashes) - 1
    for start in range(size):
        value = np.full(n, np.uint64(0xCBF29CE484222325))
        for stop in range(start + 1, min(size, start + pieces.longest) + 1):
            value = value * _FACTOR + matrix[:, stop - 1] + np.uint64(1)
            place = np.minimum(np.searchsorted(pieces.hashes, value), last)
            rows = np.flatnonzero(pieces.hashes[place] == value)
            if len(rows):
                yield start, stop, rows, place[rows]


def _forward(matrix: np.ndarray, pieces: Pieces, arcs) -> np.ndarray:
    alpha = np.full((matrix.shape[1] + 1, len(matrix)), -np.inf)
    alpha[0] = 0
    for start, stop, rows, place in arcs:
        alpha[stop, rows] = np.logaddexp(alpha[stop, rows], alpha[start, rows] + pieces.logs[place])
    return alpha


def _single(word: bytes, pieces: Pieces) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Forward logs and arcs of one long word."""
    alpha, arcs = np.full(len(word) + 1, -np.inf), []
    alpha[0] = 0
    logs = pieces.logs
    for stop in range(1, len(word) + 1):
        terms = []
        for start in range(max(0, stop - pieces.longest), stop):
            place = pieces.table.get(word[start:stop])
            if place is not None:
                arcs.append((start, stop, place))
                terms.append(alpha[start] + logs[place])
        top = max(terms)
        alpha[stop] = top + np.log(np.exp(np.array(terms) - top).sum())
    return alpha, arcs


def word_logs(names: pa.Array, pieces: Pieces) -> np.ndarray:
    """Natural log of each word's marginal probability."""
    out = np.zeros(len(names))
    for numbers, matrix in _by_length(names) if len(names) else ():
        if matrix.shape[1] > ACROSS + 1:
            out[numbers] = _single(matrix.tobytes(), pieces)[0][-1]
        else:
            out[numbers] = _forward(matrix, pieces, _arcs(matrix, pieces))[-1]
    return out


def expected_counts(names: pa.Array, counts: np.ndarray, pieces: Pieces) -> np.ndarray:
    """How often each piece is used in the words, over all segmentations by their probability."""
    total = np.zeros(len(pieces.hashes))
    for numbers, matrix in _by_length(names) if len(names) else ():
        weight = counts[numbers].astype(float)
        if matrix.shape[1] > ACROSS + 1:
            alpha, arcs = _single(matrix.tobytes(), pieces)
            beta = np.full(len(alpha), -np.inf)
            beta[-1] = 0
            for start, stop, place in reversed(arcs):
                beta[start] = np.logaddexp(beta[start], beta[stop] + pieces.logs[place])
            for start, stop, place in arcs:
                total[place] += weight[0] * np.exp(alpha[start] + pieces.logs[place] + beta[stop] - alpha[-1])
            continue
        arcs = list(_arcs(matrix, pieces))
        alpha = _forward(matrix, pieces, arcs)
        beta = np.full_like(alpha, -np.inf)
        beta[-1] = 0
        for start, stop, rows, place in reversed(arcs):
            beta[start, rows] = np.logaddexp(beta[start, rows], beta[stop, rows] + pieces.logs[place])
        for start, stop, rows, place in arcs:
            use = np.exp(alpha[start, rows] + pieces.logs[place] + beta[stop, rows] - alpha[-1, rows])
            total += np.bincount(place, weights=weight[rows] * use, minlength=len(total))
    return total


def _distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words of a run of texts, the word number of each token, and the first token per row."""
    data = LOWER[data]
    starts, ends, firsts = words(data, bounds)
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    text = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    tokens = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text.tobytes())])
    coded = tokens.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), firsts


def _merged(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]) \
        .rename_columns(["word", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for _, data, bounds in text_chunks(batch.column(0)):
            names, codes, _ = _distinct(data, bounds)
            held.append(pa.table({"word": names, "n": np.bincount(codes, minlength=len(names))}))
            size += len(names)
            if size > HELD_WORDS:
                held = [_merged(held)]
                if held[0].num_rows > HELD_WORDS // 2:
                    yield from held.pop().combine_chunks().to_batches()
                size = sum(part.num_rows for part in held)
    if held:
        yield from _merged(held).combine_chunks().to_batches()


def count_words(training: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (UTF-8) and its count ``n``. Tasks count their own words before the shuffle."""
    return training.select(text_col).mapInArrow(_count_words, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


def learn_pieces(counts: DataFrame, n_ends: int, weights: dict[bytes, float], rounds: int = EM_ROUNDS) -> Pieces:
    """Re-estimate the pieces on words with weights ``n``. Only one number per piece comes to the driver."""
    scale = sum(weights.values())
    pieces = make_pieces(weights, scale / 1000)
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(pieces)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value.hashes))
            for batch in batches:
                total += expected_counts(batch.column(0), np.asarray(batch.column(1)), shared.value)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "used"])

        used = counts.mapInArrow(expect, "piece bigint, used double").groupBy("piece").agg(F.sum("used").alias("used"))
        expected = np.full(len(pieces.names), SMOOTH)
        for row in used.collect():
            expected[row["piece"]] += row["used"]
        pieces = make_pieces(dict(zip(pieces.names, expected.tolist(), strict=True)), n_ends + SMOOTH)
    return pieces


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> pa.Table:
    """All words from a count on, so chosen from the counts' histogram that there are at most ``most``."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 4).cast("int")
    levels = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()),
                    reverse=True)
    total, cut = 0, None
    for at, n in levels:
        total += n
        if total > most:
            break
        cut = at
    chosen = counts.filter(level >= cut) if cut is not None else counts.filter("false")
    return chosen.select("word", "n").toArrow()


def _scorer(shared) -> Callable:
    """Kind 0: a document with what its frequent words give. Kind 1: another word with its
    count there and, as ``score``, the natural log of its arcs of pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, names, logs, base, end_log, end_base, end_known = shared.value
        for batch in batches:
            for first, data, bounds in text_chunks(batch.column(2)):
                found, codes, firsts = _distinct(data, bounds)
                rows = len(bounds) - 1
                place = pc.index_in(found, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
                rare = place < 0
                log = np.zeros(len(found))
                log[~rare] = logs[place[~rare]]
                arc = np.zeros(len(found))
                arc[rare] = word_logs(found.filter(pa.array(rare)), pieces)
                term = np.zeros(len(found))
                term[~rare] = base[place[~rare]]
                row = np.repeat(np.arange(rows), np.diff(firsts))
                sums = [np.bincount(row, weights=w[codes], minlength=rows) for w in (log, term, ~rare)]
                key, held = (batch.column(i).slice(first, rows) for i in (0, 1))
                ones = np.ones(rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ones * 0, pa.int32()), key, pa.nulls(rows, pa.binary()), pa.array(np.diff(firsts) + 1), held,
                     pa.array(sums[2].astype(np.int64) + end_known), pa.array(sums[1] + end_base),
                     pa.array(sums[0] + end_log), batch.column(3).slice(first, rows)],
                    names=_NAMES)
                open_ = rare[codes]
                pair, n = np.unique(row[open_] * len(found) + codes[open_], return_counts=True)
                owner, word = pair // max(1, len(found)), pair % max(1, len(found))
                size = len(pair)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(size), pa.int32()), key.take(pa.array(owner)), found.take(pa.array(word)),
                     pa.array(n.astype(np.int64)), pa.nulls(size, pa.bool_()), pa.nulls(size, pa.int64()),
                     pa.nulls(size, pa.float64()), pa.array(arc[word]), pa.nulls(size, batch.column(3).type)],
                    names=_NAMES)
    return run


_NAMES = ["kind", "key", "word", "n", "held_out", "n_known", "base", "score", "id"]


def score_documents(docs: DataFrame, weights: dict[bytes, float], id_col: str = "doc_id", text_col: str = "text",
                    frequent: int = FREQUENT, rounds: int = EM_ROUNDS) -> DataFrame:
    """Lattice score and unigram base of every whole text; one row per input row.

    Columns: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``
    (both log10). Rows whose id's checksum leaves remainder 2 modulo 7 are held out; a row without an id
    is learned from. A null or empty text is the end alone. Without training rows the pieces keep their
    first weights. Rows that agree in id and text are scored once and share the result.
    """
    keyed = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held"), F.col(text_col).alias("text"),
                        row_key(id_col, text_col).alias("key"))
    training = keyed.filter("NOT held")
    counts = stage_compact(count_words(training), "word-counts")
    n_ends = training.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total = n_words + n_ends
    denominator = float(total + distinct + int(n_ends > 0) + 1)
    distinct += int(n_ends > 0)
    pieces = learn_pieces(counts.select("word", F.lit(1).cast("bigint").alias("n")), 1, weights, rounds)
    left = DISCOUNT * distinct / total if total else 1.0

    def log_probability(count: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        return np.log10(np.maximum(count - DISCOUNT, 0) / max(1, total) + left * np.exp(arcs))

    table = frequent_words(counts, frequent)
    names, n = table.column("word").combine_chunks(), table.column("n").to_numpy().astype(float)
    shared = docs.sparkSession.sparkContext.broadcast((
        pieces, names, log_probability(n, word_logs(names, pieces)), np.log10((n + 1) / denominator),
        float(log_probability(np.array(float(n_ends)), np.array(pieces.end))),
        float(np.log10((n_ends + 1) / denominator)), int(n_ends > 0)))
    id_type = keyed.schema["id"].dataType.simpleString()
    parts = stage_compact(keyed.select("key", "held", "text", "id").mapInArrow(_scorer(shared), SCORED.format(id_type)),
                          "word-scores")
    term = F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(denominator))
    known = F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)
    arcs = F.col("score") * F.lit(float(np.log10(np.e)))
    log = F.when(F.col("c").isNull(), F.lit(float(np.log10(left))) + arcs).otherwise(F.log10(
        (F.col("c") - DISCOUNT) / F.lit(float(max(1, total))) + F.lit(left) * F.exp("score")))
    sums = parts.filter("kind = 1").select("key", "word", "n", "score") \
        .join(counts.select("word", F.col("n").alias("c")), "word", "left") \
        .groupBy("key").agg(F.sum(term).alias("more"), F.sum(known).alias("more_known"), F.sum(F.col("n") * log).alias("more_score"))
    rows = parts.filter("kind = 0").drop("kind", "word")
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    once = F.coalesce("copies", F.lit(1))
    return rows.join(sums, "key", "left").join(copies, "key", "left").select(
        F.col("id").alias(id_col), "held_out", F.col("n").alias("n_tokens"),
        (F.col("n_known") + F.coalesce(F.col("more_known") / once, F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more") / once, F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("more_score") / once, F.lit(0.0))).alias("score"))
