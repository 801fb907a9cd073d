"""WARC archives: round trips, revisits, dictionary frames and damage."""

import struct

import pytest
import zstandard

from corpusloom.llm import warczstd

SCHEMA = "page_id bigint, url string, html string"
PAGES = [(i, f"http://x/{i}", f"<p>page {i} of many similar pages</p>" * (i % 5 + 1)) for i in range(60)] + [
    (100, None, None), (99, "http://e/", ""), (101, "http://e/ü\r\nX: y", "é" * 1000), (102, "", "é" * 1000),
    (7, "http://x/7", f"<p>page 7 of many similar pages</p>" * 3), (None, "http://n/", "é" * 1000),
    (None, "http://m/", "only here"), (103, "http://big/", "ab\r\n\r\n" * 200_000)]


def run(spark, rows, tmp_path, **sizes):
    folder = tmp_path.as_uri()
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "url AS sha", "page_id AS first", "html AS payload", "url AS page")
    manifest = warczstd.write_archives(frame, folder, **sizes)
    return warczstd.read_archives(manifest, folder).collect(), manifest


@pytest.mark.parametrize("sizes", [{}, {"archive_bytes": 3000}, {"min_bytes": 5}])
def test_round_trip_with_revisits(spark, tmp_path, sizes):
    got, manifest = run(spark, PAGES, tmp_path, **sizes)
    least = sizes.get("min_bytes", 0)
    first = {}
    for page, _, html in PAGES:
        raw = (html or "").encode()
        if page is not None and len(raw) >= least:
            first[raw] = min(first.get(raw, page), page)
    want = []
    for page, url, html in PAGES:
        raw = (html or "").encode()
        top = first.get(raw, page)
        revisit = top != page
        want.append((page, url, "revisit" if revisit else "response", len(raw), warczstd.digest(raw),
                     top if revisit else None, None if revisit else raw, None))
    assert sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got), key=str) == \
        sorted(want, key=str)
    assert sum(r.records for r in manifest.collect()) == len(PAGES)


def test_archive_layout(spark, tmp_path):
    _, manifest = run(spark, PAGES, tmp_path)
    for path in [r.path for r in manifest.collect()]:
        raw = open(path, "rb").read()
        parts = list(warczstd.frames(raw))
        magic, size = struct.unpack_from("<II", parts[0])
        assert magic == 0x184D2A5D and size == len(parts[0]) - 8
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(parts[0][8:]))
        for frame in parts[1:]:  # one frame, one record
            assert zstandard.ZstdDecompressor(dict_data=dictionary).decompress(frame).startswith(b"WARC/1.1\r\n")


def test_damage_is_reported():
    good = warczstd.record(1, "http://x/", b"payload", None)
    assert warczstd.parse(good)["problem"] is None
    for bad in (b"", good[:-1], good.replace(b"payload", b"pay1oad"), good.replace(b"WARC/1.1", b"WARC/9"),
                good.replace(b"Content-Length: 7\r\n\r\npay", b"Content-Length: 8\r\n\r\npay")):
        assert warczstd.parse(bad)["problem"] and warczstd.parse(bad)["page_id"] is None
    frame = zstandard.ZstdCompressor().compress(good)
    found = list(warczstd.read_archive(frame + frame[:-3]))
    assert [f["problem"] is None for f in found] == [True, False]
    assert [f["problem"] is None for f in warczstd.read_archive(b"junk" + frame)] == [False]


def test_empty_table(spark, tmp_path):
    got, manifest = run(spark, [], tmp_path)
    assert got == [] and manifest.count() == 0
