"""What the operators share: reading tables, row keys, and words of Arrow text batches as arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

# Bytes of text handled at once inside a batch; temporary arrays are a small multiple of this.
CHUNK_BYTES = 1 << 20

SPACES = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row by content: rows that agree in id and text share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def byte_table(members: bytes, inside: bool) -> np.ndarray:
    """256 booleans: whether a byte is (``inside``) or is not one of ``members``."""
    table = np.full(256, not inside)
    table[np.frombuffer(members, np.uint8)] = inside
    return table


WORD_BYTES = byte_table(SPACES, inside=False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes.

    Yields the first row, the bytes of the run, and the row boundaries in them. Null is empty text.
    A row longer than the limit is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last
    pa.default_memory_pool().release_unused()  # workers live on; what a batch needed goes back


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray = WORD_BYTES) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and the number of the first word of each row.

    A word is a maximal run of bytes that ``table`` marks; it never crosses a row boundary.
    """
    inside = table[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_SALT = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def series(base: int) -> np.ndarray:
        out = np.full(size, np.uint64(base))
        out[:1] = 1
        return np.multiply.accumulate(out)
    return series(_BASE), series(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, the same for the same bytes anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(16, (len(data) - 1).bit_length())
    power, inverse = _powers(size)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_SALT[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def per_row(firsts: np.ndarray) -> np.ndarray:
    """The row of each word, from the number of the first word of each row."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def carried(docs: DataFrame, text_col: str, keep: list[str], *extra: Column) -> tuple[DataFrame, int]:
    """The columns ``keep`` under private names, the ``extra`` ones, and the text, which is not sent twice
    if it is kept; and the place of the text. Kept columns come first."""
    columns = [docs[c].alias(f"__{i}") for i, c in enumerate(keep)]
    if text_col in keep:
        return docs.select(*columns, *extra), keep.index(text_col)
    return docs.select(*columns, *extra, docs[text_col].alias("__text")), len(keep) + len(extra)


def restored(out: DataFrame, keep: list[str]) -> DataFrame:
    """Undo the private names."""
    return out.withColumnsRenamed({f"__{i}": c for i, c in enumerate(keep)})


def stage_compact(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder with Zstandard and read it back; see ``session.stage``."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
