"""Benchmark decontamination: one Aho-Corasick automaton over the test items, one scan of the text.

Both sides are lower-cased (A-Z) and reduced to words of digits, letters and non-ASCII characters,
joined by one space. The automaton holds every window of consecutive item words; matches in the
normalised text are mapped back to words and to characters of the original.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs

from pyspark.sql import DataFrame, functions as F, types as T

from ..session import scratch_path, stage
from ..sources.inventory import absolute
from .common import byte_table, carried, restored, words

WINDOW = 10

# Text bytes of test items in one automaton. Larger sets are cut into several blocks, files in the shared
# folder, which each task reads and builds one after the other: it holds one of them at a time, the driver none.
BLOCK_BYTES = 32 << 20

_WORD = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)),
                   inside=True)
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if _WORD[c] else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[ahocorasick.Automaton, list]:
    """The automaton, and per pattern its number of words and the items that hold it."""
    automaton, patterns, index = ahocorasick.Automaton(), [], {}
    for item, text in items:
        found = normal_words(text)
        size = min(window, len(found))
        for start in range(len(found) - size + 1 if size else 0):
            pattern = b" ".join([b"", *found[start:start + size], b""]).decode("latin-1")
            if pattern not in index:
                index[pattern] = len(patterns)
                patterns.append((size, set()))
                automaton.add_word(pattern, index[pattern])
            patterns[index[pattern]][1].add(item)
    automaton.make_automaton()
    return automaton, patterns


def scan(texts: list[str | None], automata: Iterator[tuple[ahocorasick.Automaton, list]]) \
        -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """Per text: number of words, the hit words as a boolean array (empty if none), and the items."""
    normal = [normal_words(text) for text in texts]
    marks: list[np.ndarray | None] = [None] * len(texts)
    found: list[set[str]] = [set() for _ in texts]
    for automaton, patterns in automata:
        if not len(automaton):
            continue
        for row, row_words in enumerate(normal):
            if not row_words:
                continue
            joined = b" ".join([b"", *row_words, b""]).decode("latin-1")
            hits = list(automaton.iter(joined))
            if not hits:
                continue
            if marks[row] is None:
                marks[row] = np.zeros(len(row_words) + 1, np.int64)
            blanks = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
            stops = np.searchsorted(blanks, [end for end, _ in hits])
            sizes = np.array([patterns[pattern][0] for _, pattern in hits])
            np.add.at(marks[row], stops - sizes, 1)
            np.add.at(marks[row], stops, -1)
            for pattern in {pattern for _, pattern in hits}:
                found[row] |= patterns[pattern][1]
    for row, row_words in enumerate(normal):
        hit = np.zeros(0, bool) if marks[row] is None else np.cumsum(marks[row][:-1]) > 0
        yield len(row_words), hit, found[row]


_CACHE: dict = {}


def read_block(folder: str, block: int) -> list[tuple[str, str]]:
    """The items of one block, none if it has no folder."""
    store, base = fs.FileSystem.from_uri(f"{folder}/block={block}")
    if store.get_file_info(base).type == fs.FileType.NotFound:
        return []
    table = dataset.dataset(base, filesystem=store, format="parquet").to_table(columns=["i", "t"])
    return list(zip(table["i"].to_pylist(), table["t"].to_pylist(), strict=True))


def _automata(folder: str, n: int, window: int) -> Iterator[tuple[ahocorasick.Automaton, list]]:
    """One automaton after the other. An only one stays in the worker for its next batches and tasks."""
    if n > 1:
        for block in range(n):
            yield build(read_block(folder, block), window)
        return
    if (folder, window) not in _CACHE:
        _CACHE.clear()
        _CACHE[folder, window] = build(read_block(folder, 0), window)
    yield _CACHE[folder, window]


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as character offsets in the original text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), _WORD)
    character = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"start": int(character[starts[a]]), "stop": int(character[ends[b - 1]])}
            for a, b in zip(edges[::2], edges[1::2], strict=True)]


def write_items(benchmark: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_BYTES) -> tuple[str, int]:
    """Write the distinct test items as (id as text, text) to the shared folder, in blocks of about ``limit`` bytes.

    Returns the folder, as executors open it, and the number of blocks, which follows from the measured size.
    """
    spark = benchmark.sparkSession
    items = stage(benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"),
                                   F.col(text_col).alias("t")).filter("t IS NOT NULL").distinct(), "benchmark-items")
    n = int((items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // limit) + 1
    path = scratch_path(spark, "benchmark-blocks")
    items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition(min(n, _WRITERS), "block") \
        .write.partitionBy("block").parquet(path)
    return absolute(spark, path), n


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                  keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What test items each document holds.

    Columns: the id (or the columns named in ``keep``), ``n_words``, ``n_hit`` (words inside an
    occurrence of a window), ``items`` (their ids as text, sorted), ``spans`` (runs of hit words as
    character offsets in the original text). A window is ``window`` consecutive item words; a shorter
    item is one window; one without words none. Null texts have no words. A null item id counts as an
    empty id; repeated items count once; rows are judged one by one, so repeated rows give repeated
    results. No row is shuffled. The texts are read whole.
    """
    folder, n = write_items(benchmark, item_id_col, item_text_col, block_bytes)
    columns = keep or [id_col]
    narrow, place = carried(docs, text_col, columns)
    names = [f"__{i}" for i in range(len(columns))]
    fields = narrow.select(names).schema
    span = T.StructType().add("start", "long").add("stop", "long")
    schema = fields.add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())) \
        .add("spans", T.ArrayType(span))
    return restored(narrow.mapInArrow(_scanner(folder, n, window, len(names), place), schema), columns)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_ROWS = 512
_WRITERS = 1000


def _scanner(folder: str, n: int, window: int, kept: int, place: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _ROWS if n == 1 else max(1, batch.num_rows)
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                texts = part.column(place).to_pylist()
                n_words, n_hit, ids, spans = [], [], [], []
                for text, (count, hit, found) in zip(texts, scan(texts, _automata(folder, n, window)), strict=True):
                    n_words.append(count)
                    n_hit.append(int(hit.sum()))
                    ids.append(sorted(found))
                    spans.append(original_spans(text, hit) if found else [])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:kept], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                     pa.array(ids, pa.list_(pa.string())), pa.array(spans, SPANS)],
                    names=[*part.schema.names[:kept], "n_words", "n_hit", "items", "spans"])
    return run

