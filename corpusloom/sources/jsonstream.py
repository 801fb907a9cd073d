"""JSON documents that are too long for one value: the elements of their array, read as a stream."""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs

from pyspark.sql import DataFrame, functions as F

_BLANK = " \t\n\r"
_READ = 4 << 20
_ROWS, _CHARS = 4096, 16 << 20
# Characters of the longest element that is read, well below the 2 GB of a Spark value.
ELEMENT_CHARS = 1 << 28
_TASKS = 10_000
# Bytes of a damaged file that are kept.
_HEAD = 4096
ITEMS = "src_path string, pos bigint, raw string, damaged boolean"


def elements(stream: BinaryIO, read: int = _READ, limit: int = ELEMENT_CHARS,
             faults: list[str] | None = None) -> Iterator[str | None]:
    """Texts of the elements of a top-level array; of anything else, the whole text.

    Only the element at hand is held. Where the array is damaged, the rest of it is the last element. An
    element (or such a rest) above ``limit`` characters is None, and the last. ``faults`` takes what was wrong.
    """
    faults = [] if faults is None else faults
    decode = codecs.getincrementaldecoder("utf-8")("replace").decode
    scan = json.JSONDecoder(strict=False).raw_decode
    text, at, ended, size = "", 0, False, read

    def more() -> None:
        nonlocal text, at, ended
        raw = stream.read(size)
        ended = not raw
        text, at = text[at:] + decode(raw, ended), 0

    def skip(blank: str) -> bool:
        """Move to the next other character; false at the end."""
        nonlocal at
        while True:
            while at < len(text) and text[at] in blank:
                at += 1
            if at < len(text) or ended:
                return at < len(text)
            more()

    if not skip(_BLANK + "\ufeff"):
        return
    if text[at] != "[":
        while not ended and len(text) - at <= limit:
            more()
        ended = ended and len(text) - at <= limit
        if not ended:
            faults.append("too long")
        yield text[at:] if ended else None
        return
    at += 1
    while skip(_BLANK + ","):
        if text[at] == "]":
            return
        size = read
        while True:
            try:
                _, end = scan(text, at)
                # A number may go on in the next part, so something must follow it.
                if end < len(text) or ended:
                    break
            except ValueError:
                if ended or len(text) - at > limit:
                    faults.append("damaged")
                    yield text[at:] if len(text) - at <= limit else None
                    return
            size *= 2
            more()
        yield text[at:end]
        at = end
    faults.append("not closed")


def _as_read(text: str | None) -> str | None:
    """An element as the reader of whole documents has it: a string is the text it holds, null is none."""
    if text is None or text == "null":
        return None
    try:
        return json.loads(text, strict=False) if text.startswith('"') else text
    except ValueError:
        return text


def _rows(path: str, first: int, held: list[str | None], damaged: bool) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.string()),
         pa.array([damaged] * n, pa.bool_())], names=["src_path", "pos", "raw", "damaged"])


def _items(path: str) -> Iterator[pa.RecordBatch]:
    """The elements of a file. It is read through once before, as a damaged file has no elements but is one
    bad record, of which the beginning is kept."""
    store, name = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    faults: list[str] = []
    with store.open_input_stream(name) as stream:
        for _ in elements(stream, faults=faults):
            pass
    with store.open_input_stream(name) as stream:
        if faults:
            yield _rows(path, 0, [stream.read(_HEAD).decode("utf-8", "replace")], damaged=True)
            return
        held, size, first = [], 0, 0
        for text in elements(stream):
            held.append(_as_read(text))
            size += len(text)
            if len(held) >= _ROWS or size >= _CHARS:
                yield _rows(path, first, held, damaged=False)
                held, size, first = [], 0, first + len(held)
        yield _rows(path, first, held, damaged=False)


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            yield from _items(path)


def json_items(files: DataFrame) -> DataFrame:
    """``src_path``, ``pos`` and ``raw`` of the elements of each file; a ``damaged`` file is one row. One file is one task's work, so there
    are as many tasks as files, which the planner must not merge."""
    tasks = max(1, min(_TASKS, files.count()))
    return files.select("src_path").repartition(tasks).mapInArrow(_read_files, ITEMS)
