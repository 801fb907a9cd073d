"""Members of zip and tar archives, one level deep, as files in the shared folder for the readers of their formats."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import shutil
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import IO

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path, stage
from .inventory import LISTED_SCHEMES, absolute, file_glob, guessed_formats, plain_path

ARCHIVE_SUFFIXES = ("zip", "tar", "tgz", "tar.gz")
MEMBER_SCHEMA = "path string, src_path string, format string"
_MEMBER_TYPES = pa.schema([("path", pa.string()), ("src_path", pa.string()), ("format", pa.string())])
# What unpacking raises for damaged or encrypted data, as opposed to a store that fails.
DAMAGED = (zipfile.BadZipFile, tarfile.TarError, gzip.BadGzipFile, zlib.error, EOFError, RuntimeError,
           NotImplementedError)
_CHUNK = 1 << 20
_MOST_TASKS = 10_000


def open_members(name: str, archive: IO[bytes]) -> Iterator[tuple[str, Callable[[], IO[bytes]]]]:
    """Name of each file in the archive, and how to open it before the next one is asked for."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(archive) as opened:
            for info in opened.infolist():
                if not info.is_dir():
                    yield info.filename, lambda info=info: opened.open(info)
    else:
        with tarfile.open(fileobj=archive, mode="r:*") as opened:
            for info in opened:
                if info.isfile():
                    yield info.name, lambda info=info: opened.extractfile(info)


def _subfolder(fmt: str, member: IO[bytes]) -> str:
    """Where a member goes. Parquet files of one schema share a folder, so that one scan reads them all."""
    if fmt != "parquet":
        return fmt
    try:
        schema = pq.ParquetFile(member).schema_arrow.remove_metadata()
    except (pa.ArrowInvalid, OSError) as bad:
        raise zipfile.BadZipFile(f"no Parquet file: {bad}") from bad
    member.seek(0)
    return "parquet/" + hashlib.sha256(str(schema).encode()).hexdigest()[:32]


def _copied(folder: str, formats: dict[str, str]) -> Callable:
    """Unpacks archives given by path, or by content where only Spark can open the path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = fs.FileSystem.from_uri(folder)

        def write(fmt: str, open_member: Callable[[], IO[bytes]]) -> str:
            with open_member() as member:
                place = f"{_subfolder(fmt, member)}/{uuid.uuid4().hex}.{fmt}"
                target.create_dir(f"{base}/{place.rpartition('/')[0]}", recursive=True)
                with target.open_output_stream(f"{base}/{place}", compression=None) as out:
                    shutil.copyfileobj(member, out, _CHUNK)
            return f"{folder}/{place}"

        def unpack(path: str, archive: IO[bytes]) -> Iterator[tuple[str | None, str, str]]:
            try:
                for name, open_member in open_members(path, archive):
                    fmt = formats.get(name.rsplit("/", 1)[-1].rpartition(".")[2].lower())
                    if fmt is None:
                        continue
                    try:
                        yield write(fmt, open_member), f"{path}!{name}", fmt
                    except DAMAGED:  # costs only the member, whose half-written file is in no manifest
                        yield None, f"{path}!{name}", fmt
            except DAMAGED:
                yield None, path, "archive"

        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content is None:
                    source, place = fs.FileSystem.from_uri(path)
                    opened = source.open_input_file(place)
                else:
                    opened = io.BytesIO(content)
                with opened as archive:
                    found = list(unpack(path, archive))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, pa.string()) for column in zip(*found, strict=True)], schema=_MEMBER_TYPES)
    return run


def extract_members(spark: SparkSession, root: str, formats: Iterable[str]) -> tuple[str, DataFrame]:
    """Unpack the members of the given formats, by suffix, into files of a fresh folder, an archive per task at a time.

    Returns the folder and its manifest: ``path`` of the file, ``src_path`` (``archive!member``) and
    ``format``. What cannot be unpacked has a null path; an archive that breaks off has one row of format
    ``archive`` besides its members before that. Files that are in no manifest (of attempts that failed) do
    not count. Archives and members are streamed, so they may be of any size.
    """
    glob = "{" + ",".join(file_glob(s) for s in ARCHIVE_SUFFIXES) + "}"
    scheme = re.match(r"([a-z0-9]+):", absolute(spark, root))
    by_path = scheme is None or scheme[1] in LISTED_SCHEMES
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    listed = files.select(plain_path(F.col("path")).alias("path"),
                          F.lit(None).cast("binary").alias("content") if by_path else F.col("content"))
    tasks = files.select("path").count() if by_path else 0
    if tasks:
        listed = listed.repartition(min(_MOST_TASKS, tasks))
    wanted = {f: f for f in formats}
    wanted |= {suffix: f for suffix, f in guessed_formats().items() if f in wanted}
    folder = absolute(spark, scratch_path(spark, "members"))
    return folder, stage(listed.mapInArrow(_copied(folder, wanted), MEMBER_SCHEMA), "members")
