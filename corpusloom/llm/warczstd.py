"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .common import stage_compact

# Fixed values of the formats.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ARCHIVE_BYTES = 64 << 20   # record bytes after which a task begins its next archive
# Tasks that read archives back, each one archive after the other.
MOST_TASKS = 10_000
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 8192, 16 << 10  # bounds of the dictionary's training

MANIFEST = "path string, records bigint, bytes bigint"
RECORDS = ("page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, "
           "refers_to bigint, payload binary, problem string")


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _record_id(page: int | None, payload_digest: str) -> str:
    return f"<urn:x-page:{page}>" if page is not None else f"<urn:x-payload:{payload_digest}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, whose block has the HTTP header alone."""
    name = digest(payload)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page, name)),
              ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()
                       if any(c in url for c in "\r\n") or url != url.strip() or not url else url))
        if fields[-1][1] != url:
            fields.append(("X-Target-URI-Encoding", "base64"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", _record_id(refers_to, name)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{name}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
               ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "\r\n".join([VERSION, *[f"{k}: {v}" for k, v in fields], "", ""])
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The record in ``raw``; ``problem`` says what is wrong with a damaged one."""
    out = dict.fromkeys(("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to",
                         "payload", "problem"))
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
    try:
        if not found or lines[0] != VERSION:
            raise ValueError("no WARC header")
        size = int(fields["Content-Length"])
        if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
            raise ValueError("record length differs from Content-Length")
        block = rest[:size]
        if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError("block digest differs")
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise ValueError("no HTTP header")
        http_fields = dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])
        length = int(http_fields[b"Content-Length"])
        kind, name = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != length or digest(payload) != name):
            raise ValueError("payload differs from its length or digest")
        url = fields.get("WARC-Target-URI")
        if fields.get("X-Target-URI-Encoding") == "base64":
            url = base64.b64decode(url).decode("utf-8", "surrogatepass")
        page, refers = (fields.get(k, "").removeprefix("<urn:x-page:").removesuffix(">")
                        for k in ("WARC-Record-ID", "WARC-Refers-To"))
        out |= {"page_id": int(page) if page.lstrip("-").isdigit() else None, "url": url, "record_type": kind,
                "payload_bytes": length, "payload_digest": name,
                "refers_to": int(refers) if refers.lstrip("-").isdigit() else None,
                "payload": payload if kind == "response" else None}
    except (KeyError, ValueError) as error:
        out["problem"] = str(error)
    return out


def frames(raw: bytes) -> Iterator[bytes | None]:
    """The frames of an archive, found by their block headers; None for a damaged rest."""
    at = 0
    while at < len(raw):
        start = at
        try:
            magic, = struct.unpack_from("<I", raw, at)
            if magic & 0xFFFFFFF0 == 0x184D2A50:
                at += 8 + struct.unpack_from("<I", raw, at + 4)[0]
            elif magic == FRAME:
                at += zstandard.frame_header_size(raw[at:at + 18])
                last = 0
                while not last:
                    block = int.from_bytes(raw[at:at + 3], "little")
                    last, kind, size = block & 1, block >> 1 & 3, block >> 3
                    at += 3 + (1 if kind == 1 else size)
                    if kind == 3 or at > len(raw):
                        raise ValueError("damaged block")
                at += 4 * zstandard.get_frame_parameters(raw[start:start + 18]).has_checksum
            else:
                raise ValueError("no frame")
            if at > len(raw):
                raise ValueError("cut off")
        except (ValueError, struct.error, zstandard.ZstdError):
            yield None
            return
        yield raw[start:at]


def read_archive(raw: bytes) -> Iterator[dict]:
    """The records of one archive."""
    decoder = zstandard.ZstdDecompressor()
    for number, frame in enumerate(frames(raw)):
        if frame is not None and frame[3] == 0x18 and frame[0] & 0xF0 == 0x50:
            if number == 0 and struct.unpack_from("<I", frame)[0] == SKIPPABLE and len(frame) > 8:
                content = frame[8:]
                if content[:4] == struct.pack("<I", FRAME):
                    content = zstandard.ZstdDecompressor().decompress(content)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            continue
        try:
            if frame is None:
                raise ValueError("damaged frame")
            yield parse(decoder.decompressobj().decompress(frame))
        except (ValueError, zstandard.ZstdError) as error:
            yield parse(b"") | {"problem": str(error)}


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for records like ``samples``; empty where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def open_archive(stream, dictionary: bytes) -> zstandard.ZstdCompressor:
    """Begin an archive: write its dictionary frame, and return the records' compressor."""
    if not dictionary:
        return zstandard.ZstdCompressor(level=3, write_checksum=True)
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    stream.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    return zstandard.ZstdCompressor(level=3, write_checksum=True,
                                    dict_data=zstandard.ZstdCompressionDict(dictionary))


def _writer(folder: str, dictionary: bytes, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        done, stream = [], None
        for batch in batches:
            for page, url, html, first in zip(*[batch.column(i) for i in range(4)], strict=True):
                if stream is None:
                    # Every attempt has names of its own; the manifest holds those of the one that counts.
                    path, records, size = f"{base}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    stream = store.open_output_stream(path, compression=None)  # the suffix would add one
                    packer = open_archive(stream, dictionary)
                raw = record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"),
                             first.as_py())
                stream.write(packer.compress(raw))
                records, size = records + 1, size + len(raw)
                if size >= limit:
                    stream.close()
                    done.append((path, records, size))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((path, records, size))
        paths, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            names=["path", "records", "bytes"])
    return run


def with_first_page(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                    html_col: str = "html") -> DataFrame:
    """The four columns of a record: id, URL, HTML, and the page that a revisit refers to (else null)."""
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    narrow = pages.select(pages[id_col].cast("bigint").alias("page"), pages[url_col].alias("url"),
                          pages[html_col].alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).alias("size"))
    firsts = narrow.filter(F.col("size") >= min_bytes).groupBy("sha") \
        .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha", "first")
    return narrow.join(firsts, "sha", "left").select(
        "page", "url", "html",
        F.when(~F.col("first").eqNullSafe(F.col("page")), F.col("first")).alias("refers_to"))


def _sample(pages: DataFrame, id_col: str, html_col: str) -> list:
    """Id and start of the payload of a few pages, by hash of the id.

    The ids are chosen first, so no task sends more than as many ids to the driver.
    """
    some = pages.filter(pages[id_col].isNotNull() & pages[html_col].isNotNull()).select(pages[id_col].alias("i"))
    ids = [r["i"] for r in some.orderBy(F.xxhash64("i"), "i").limit(SAMPLE_PAGES).collect()]
    chosen = pages.filter(pages[id_col].isin(ids)).select(
        pages[id_col].alias("i"), F.substring(pages[html_col], 1, SAMPLE_CHARS).alias("h"))
    return sorted(chosen.filter("h IS NOT NULL").limit(2 * SAMPLE_PAGES).collect()) if ids else []


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one WARC record per page to archives in ``folder`` and return their manifest.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the one with the smallest id is a
    response, the others are revisits of it. Rows that share that id are responses all; a null id comes
    after all others, and is a response where no page with an id has its payload. A null payload is
    empty. The dictionary is trained on a bounded sample; an empty table gives no archive. ``folder``
    must be a URI that all executors reach.
    """
    rows = with_first_page(pages, min_bytes, id_col, url_col, html_col)
    sample = _sample(pages, id_col, html_col)
    dictionary = train_dictionary([record(r["i"], "http://", r["h"].encode("utf-8", "surrogatepass"), None)
                                   for r in sample])
    return stage_compact(rows.mapInArrow(_writer(folder, dictionary, archive_bytes), MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in the manifest, in no order; one archive is read at a time.

    A record whose header, length or digest is wrong has its fields null and ``problem`` set.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("refers_to", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    raw = stream.read()
                held, size = [], 0
                for found in read_archive(raw):
                    size += len(found["payload"] or b"")
                    held.append(found if payloads else found | {"payload": None})
                    if len(held) == 1000 or payloads and size > (8 << 20):
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)
    tasks = max(1, min(MOST_TASKS, manifest.count()))  # an explicit number, which the planner does not merge
    return manifest.select("path").repartition(tasks).mapInArrow(run, RECORDS)


def new_folder(spark: SparkSession) -> str:
    """A fresh archive folder in the shared folder, as a URI of the file system that folder is on."""
    place = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "warc"))
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folder = re.sub(r"^file:/+", "file:///", system.makeQualified(place).toString())
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return folder
