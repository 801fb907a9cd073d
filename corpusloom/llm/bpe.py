"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import tiktoken

from pyspark.sql import DataFrame

# A text above this many characters is cut at safe boundaries before it is encoded.
PIECE_CHARS = 1 << 16
# Bytes of text that are encoded and decoded before the results go on.
RUN_BYTES = 1 << 20

# A text can be cut before white space that follows something else: every match of the pattern either
# ends there or starts there, as white space stands only at the start of a match or makes up all of it.
# White space is what the library takes for it (Unicode's White_Space); Python's class has U+001C to U+001F too.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{_BLANK}])(?=[{_BLANK}])")


def load_ranks(path: str) -> bytes:
    """The rank file's content. The driver reads it, so executors need no copy of the file."""
    with open(path, "rb") as file:
        return file.read()


@functools.lru_cache(maxsize=1)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary after each ``limit`` characters."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(encoder: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of one text, special tokens taken as plain text."""
    ids = [np.array(encoder.encode_ordinary(piece), "<u4") for piece in pieces(text)]
    return ids[0] if len(ids) == 1 else np.concatenate(ids)


def round_trip(docs: DataFrame, ranks: bytes, pattern: str,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode the ids again.

    Columns: the id, ``token_ids`` (little-endian unsigned 32-bit, binary), ``n_tokens``, and
    ``decoded`` (the bytes of the ids). One row per input row; a null text is empty text with no ids;
    repeated rows give repeated results; other columns are not read. Nothing is shuffled, so a lost
    executor costs its tasks alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    narrow = docs.select(docs[id_col], docs[text_col])
    fields = [narrow.schema[id_col].simpleString().replace(":", " ", 1),
              "token_ids binary", "n_tokens bigint", "decoded binary"]
    return narrow.mapInArrow(_coder(shared, pattern), ", ".join(fields))


def _coder(shared, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(shared.value, pattern)
        for batch in batches:
            for start, stop in _row_runs(batch.column(1)):
                ids, counts, decoded = [], [], []
                for text in batch.column(1).slice(start, stop - start):
                    coded = encode(encoder, text.as_py() or "")
                    ids.append(coded.tobytes())
                    counts.append(len(coded))
                    decoded.append(encoder.decode_bytes(coded.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array(ids, pa.binary()),
                     pa.array(counts, pa.int64()), pa.array(decoded, pa.binary())],
                    names=[batch.schema.names[0], "token_ids", "n_tokens", "decoded"])
                del ids, decoded
            pa.default_memory_pool().release_unused()  # workers live on; what a batch needed goes back
    return run


def _row_runs(column: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes, so that outputs stay small."""
    sizes = np.array(pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    run = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(run, prepend=-1)) if len(run) else np.zeros(0, np.int64)
    for start, stop in zip(cuts, np.append(cuts[1:], len(run)), strict=True):
        yield int(start), int(stop)


def decode(coded: DataFrame, ranks: bytes, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """Replace ``ids_col`` (binary ids) by the bytes they stand for; null stays null."""
    shared = coded.sparkSession.sparkContext.broadcast(ranks)
    place = coded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(shared.value, pattern)
        for batch in batches:
            raw = [None if x is None else encoder.decode_bytes(np.frombuffer(x, "<u4").tolist())
                   for x in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(raw, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return coded.mapInArrow(run, coded.schema)


