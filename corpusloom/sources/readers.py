"""Readers per format, all returning raw records.

Columns: ``src_path``, ``format``, ``src_block`` and ``src_row`` (which order the records of a file as
they stand in it), ``rec_id``, ``raw`` (JSON text) and ``record`` (VARIANT; null for a bad record). No
schema is inferred and no file list is built on the driver: each format is one scan of the tree.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.html import html_to_text
from ..functions.text import SPACE, utf8_text
from ..operators.dedup import union_all
from ..operators.mapping import once
from ..schema import DATASET_KEYS, FIELD_CANDIDATES
from ..session import stage
from .archives import extract_members
from .inventory import (
    JSON_BYTES, absolute, file_glob, format_glob, outside, parquet_files, parquet_folders, parquet_footers,
    parquet_groups, scanned_path, whole_files)
from .jsonstream import json_items

RAW_SCHEMA = ("src_path string, format string, src_block bigint, src_row bigint, rec_id string, "
              "raw string, record variant")
_ROW_BITS = (1 << 33) - 1


# Files read as one value: the longest that are, well below the 2 GB of a Spark value.
WHOLE_BYTES = 1 << 30
# Cells of a table's first record that are read at first.
HEAD_WIDTH = 64
# A VARIANT parser built on the defaults refuses longer strings.
LONG_STRING = 20_000_000


def _scan(spark: SparkSession, root: str, suffix: str, **options: str):
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file_glob(suffix))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader


def _origin() -> list[Column]:
    """Where a record stands: file, start of its split, and a row number rising within the split."""
    return [
        scanned_path().alias("src_path"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)).alias("src_row"),
    ]


def _whole(spark: SparkSession, root: str, fmt: str) -> DataFrame:
    """Files of a format as one value each; a file above ``WHOLE_BYTES`` has none and is rejected."""
    return whole_files(spark, root, format_glob(fmt), WHOLE_BYTES).select(
        "value", "src_path", F.lit(0).cast("bigint").alias("src_block"), F.lit(0).cast("bigint").alias("src_row"))


def _numbered(lines: DataFrame) -> DataFrame:
    """``src_row`` as the line's number in its file, ``src_block`` 0: the same however the scan is cut.

    The starts of the splits, a row each, are counted first and staged.
    """
    blocks = lines.groupBy("src_path", "src_block").agg(
        F.min("src_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    before = Window.partitionBy("src_path").orderBy("src_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(blocks.select("src_path", "src_block", (
        F.coalesce(F.sum("_lines").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), "split-starts")
    placed = lines.join(starts, ["src_path", "src_block"])
    return placed.withColumns({"src_row": F.col("src_row") + F.col("_shift"),
                               "src_block": F.lit(0).cast("bigint")}).drop("_shift")


def _variant(raw: Column) -> Column:
    """JSON text as VARIANT, null for bad JSON; of equal keys the last counts, strings may be long."""
    long = F.from_json(raw, "variant", {"maxStringLen": str((1 << 31) - 1)})
    return F.coalesce(F.try_parse_json(raw), F.when(F.length(raw) > LONG_STRING, long))


def _finish(df: DataFrame, fmt: str, rec_id: Column | None = None) -> DataFrame:
    """The common columns. ``inline`` keeps later filters from repeating the parsing.

    The id is the path and the place in the file, so equal records have different ids; a caller that
    wants to know equal content compares ``raw``.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rec_id = rec_id if rec_id is not None else F.concat_ws("#", "src_path", F.col("src_row").cast("string"))
    parsed = F.inline(F.array(F.struct(_variant(F.col("raw")).alias("record"))))
    return df.select("src_path", F.lit(fmt).alias("format"), "src_block", "src_row",
                     rec_id.alias("rec_id"), "raw", parsed)


def read_jsonl(spark: SparkSession, root: str, suffix: str = "jsonl") -> DataFrame:
    """One record per non-blank line; a bad line has a null record."""
    lines = _numbered(_scan(spark, root, suffix).text(root).select(F.col("value").alias("raw"), *_origin()))
    return _finish(lines.filter(F.rlike("raw", F.lit(f"[^{SPACE}]"))), "jsonl")


def read_json(spark: SparkSession, root: str, json_bytes: int = JSON_BYTES) -> DataFrame:
    """Elements of a top-level array, or the document itself.

    A document above ``json_bytes`` is read as a stream, so its elements may be any number. A damaged document
    is one bad record, whatever its size.
    """
    docs = whole_files(spark, root, format_glob("json"), json_bytes)
    is_array = F.startswith(F.ltrim("value", F.lit(" \t\n\r\ufeff")), F.lit("["))
    text = F.regexp_replace("value", "^\\x{feff}", "")
    items = F.when(is_array, F.from_json(text, "array<string>", {"maxStringLen": str((1 << 31) - 1)}))
    short = docs.filter("NOT too_long").select(
        "src_path", F.posexplode(F.coalesce(items, F.array(text))).alias("pos", "raw"))
    rows = short.unionByName(json_items(docs.filter("too_long")).drop("damaged")).select(
        "src_path", F.lit(0).cast("bigint").alias("src_block"), F.col("pos").cast("bigint").alias("src_row"), "raw")
    return _finish(rows, "json")


def read_text(spark: SparkSession, root: str, suffix: str = "txt") -> DataFrame:
    """A whole file per record with field ``content``; bytes that are not UTF-8 are dropped."""
    docs = _whole(spark, root, suffix).withColumn("content", utf8_text(F.col("value")))
    content = html_to_text(F.col("content")) if suffix == "html" else F.col("content")
    rows = docs.withColumn("raw", F.when(F.col("value").isNotNull(), F.to_json(F.struct(
        content.alias("content"), F.col("src_path").alias("file_path")))))
    return _finish(rows, suffix, F.col("src_path"))


def read_html(spark: SparkSession, root: str) -> DataFrame:
    return read_text(spark, root, "html")


def xml_record(text: str) -> str | None:
    """JSON of the root's children: text, or nested the same way; the last of equal tags wins."""
    def members(element: ElementTree.Element) -> dict:
        return {child.tag: members(child) if len(child) else child.text for child in element}

    try:
        return json.dumps(members(ElementTree.fromstring(text)), ensure_ascii=False)
    except ElementTree.ParseError:
        return None


@F.pandas_udf(T.StringType())
def _xml_records(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(xml_record)


def read_xml(spark: SparkSession, root: str) -> DataFrame:
    """One record per file."""
    docs = _whole(spark, root, "xml")
    return _finish(docs.withColumn("raw", _xml_records("value")), "xml", F.col("src_path"))


def _table_files(spark: SparkSession, root: str, suffix: str, sep: str) -> DataFrame:
    """Per file: whether all its lines are UTF-8, and how many separators the fullest line has (a bound
    for the parser, not the width of the table)."""
    lines = _scan(spark, root, suffix).text(root).select("value", scanned_path().alias("src_path"))
    seps = F.octet_length("value") - F.octet_length(F.replace("value", F.lit(sep), F.lit("")))
    return lines.groupBy("src_path").agg(F.bool_and(F.is_valid_utf8("value")).alias("is_utf8"), F.max(seps).alias("seps"))


def _table_rows(spark: SparkSession, root: str, suffix: str, sep: str, encoding: str, width: int, most: int) -> DataFrame:
    """The records of all tables, cut or filled up to ``width`` cells.

    One column more is declared than is read. So the parser prunes, and takes records of any length
    without raising an error for each cell that is not there.
    """
    schema = ", ".join(f"`{i}` string" for i in range(width + 1))
    rows = _scan(spark, root, suffix, sep=sep, header="false", multiLine="true", escape='"', encoding=encoding,
                 columnPruning="true", maxColumns=str(max(20_480, 2 * most, 2 * width))).schema(schema).csv(root)
    return rows.select(F.array(*[F.col(f"`{i}`") for i in range(width)]).alias("cells"), *_origin())


def _table_heads(spark: SparkSession, root: str, suffix: str, sep: str, encoding: str, most: int) -> DataFrame:
    """The first record of each table. One scan, unless the last of ``width`` cells is named: then twice as
    many are read."""
    width = HEAD_WIDTH
    while True:
        heads = stage(_table_rows(spark, root, suffix, sep, encoding, width, most).groupBy("src_path").agg(
            F.min("src_row").alias("head_row"), F.min_by("cells", "src_row").alias("head")), "table-heads")
        if heads.filter(F.size(F.array_compact(F.slice("head", width // 2 + 1, width))) > 0).isEmpty():
            return heads
        width *= 2


def _redecoded(cell: Column) -> Column:
    """A cell read as Latin-1 whose bytes are UTF-8. (Behind a byte order mark the parser has decoded it.)"""
    return F.when(F.rlike(cell, F.lit(r"[^\x00-\xFF]")), cell).otherwise(F.decode(F.encode(cell, "ISO-8859-1"), "UTF-8"))


def read_csv(spark: SparkSession, root: str, suffix: str = "csv", sep: str = ",") -> DataFrame:
    """Rows of tables with a header line, each file with its own columns and its own encoding.

    Files are read without a header, so that one scan serves files of any columns; the first record
    of a file then names the cells of the others, and only as many cells are read as the widest first
    record has names: a long text with many separators does not count. A file with lines that are not
    UTF-8 is read as Latin-1, which accepts any byte; where there are files of both kinds all are, and
    the cells of the others are decoded again. Empty cells are absent.
    """
    files = stage(_table_files(spark, root, suffix, sep), "table-files")
    seen = files.agg(F.bool_and("is_utf8").alias("all_utf8"), F.bool_or("is_utf8").alias("any_utf8"),
                     F.max("seps").alias("seps")).first()
    if seen["all_utf8"] is None:
        return spark.createDataFrame([], RAW_SCHEMA)
    encoding, mixed = "UTF-8" if seen["all_utf8"] else "ISO-8859-1", seen["any_utf8"] and not seen["all_utf8"]
    found = _table_heads(spark, root, suffix, sep, encoding, seen["seps"]).join(files.select("src_path", "is_utf8"), "src_path")
    if mixed:
        found = found.withColumn("head", F.when(F.col("is_utf8"), F.transform("head", _redecoded)).otherwise(F.col("head")))
    names = F.transform("head", lambda c: F.regexp_replace(c, "^\\x{feff}", ""))
    wide = F.array_max(F.transform(names, lambda c, i: F.when(c.isNotNull(), i + 1)))
    found = found.select("src_path", "is_utf8", "head_row", F.slice(names, F.lit(1), F.coalesce(wide, F.lit(0))).alias("head"))
    # Staged: the planner broadcasts the headers when they are small, and else shuffles.
    heads = stage(found.withColumn("unlike", F.size(F.array_distinct(F.array_compact("head"))) == F.size(F.array_compact("head"))),
                  "table-heads")
    width = heads.agg(F.max(F.size("head"))).first()[0] or 1
    body = _table_rows(spark, root, suffix, sep, encoding, width, seen["seps"]).join(heads, "src_path") \
        .filter(F.col("src_row") > F.col("head_row"))
    cells = F.slice("cells", F.lit(1), F.size("head"))
    if mixed:
        cells = F.when(F.col("is_utf8"), F.transform(cells, _redecoded)).otherwise(cells)
    named = F.filter(F.arrays_zip(F.col("head").alias("k"), cells.alias("v")),
                     lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    first = F.transform(F.array_distinct(F.transform(named, lambda p: p["k"])),
                        lambda key: F.struct(key.alias("k"), F.filter(named, lambda p: p["k"] == key)[0]["v"].alias("v")))
    fields = F.map_from_entries(F.when(F.col("unlike"), named).otherwise(first))
    table = body.select(
        "src_path", "src_block", (F.col("src_row") - F.col("head_row") - 1).alias("src_row"),
        F.to_json(fields).alias("raw"))
    return _finish(table, suffix)


def read_tsv(spark: SparkSession, root: str) -> DataFrame:
    return read_csv(spark, root, "tsv", "\t")


def candidate_columns(tables: Mapping[str, Mapping[str, Sequence[str]]] = FIELD_CANDIDATES) -> set[str]:
    """Every field name any mapping looks at; other Parquet columns are not read."""
    names = {"solutions"}
    for table in (*tables.values(), *DATASET_KEYS.values()):
        for candidates in table.values():
            names.update(candidates)
    return names | {"java", "python", "c++", "javascript", "title", "name", "test_list"}


def read_parquet(spark: SparkSession, root: str, columns: set[str] | None = None) -> DataFrame:
    """Rows of Parquet files, only the columns a mapping can use. One scan for all folders of the same schemas.

    Executors read the footers; files without one are passed over (``parquet_footers`` names them). Folders
    named ``key=value`` are folders like others. On a store that only Spark can open it is one scan per folder.
    """
    wanted = columns or candidate_columns()
    footers = parquet_footers(spark, root)
    groups = [[folder] for folder in parquet_folders(spark, root)] if footers is None else parquet_groups(footers)
    frames = []
    for folders in groups:
        reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
        try:
            table = reader.option("mergeSchema", "true").parquet(parquet_files(folders[0]))
        except AnalysisException:  # nothing readable in this folder
            continue
        if len(folders) > 1:
            table = reader.option("mergeSchema", "false").schema(table.schema).parquet(*[parquet_files(f) for f in folders])
        used = [F.col(f"`{c}`") for c in table.columns if c in wanted]
        row = F.to_json(F.struct(*used), {"ignoreNullFields": "false"}) if used else F.lit("{}")
        frames.append(_finish(
            table.select(row.alias("raw"), scanned_path().alias("src_path"),
                         F.lit(0).cast("bigint").alias("src_block"),
                         F.col("_metadata.row_index").alias("src_row")), "parquet"))
    return union_all(frames) if frames else spark.createDataFrame([], RAW_SCHEMA)


def _read(spark: SparkSession, root: str, fmt: str, columns: set[str] | None) -> DataFrame:
    return READERS[fmt](spark, root, columns) if fmt in ("parquet", "archive") else READERS[fmt](spark, root)


def read_archives(spark: SparkSession, root: str, columns: set[str] | None = None) -> DataFrame:
    """Records of all members of archives, as the readers of their formats give them.

    The members are files of the shared folder, read like others; paths name archive and member. ``columns``
    are those to read of Parquet members.
    """
    folder, manifest = extract_members(spark, root, [f for f in READERS if f != "archive"])
    present = [r["format"] for r in manifest.filter("path IS NOT NULL").select("format").distinct().collect()]
    lost = manifest.filter("path IS NULL").select(
        "src_path", "format", F.lit(0).cast("bigint").alias("src_block"), F.lit(-1).cast("bigint").alias("src_row"),
        F.concat_ws("#", "src_path", F.lit("-1")).alias("rec_id"), F.lit(None).cast("string").alias("raw"),
        F.try_parse_json(F.lit(None).cast("string")).alias("record"))
    if not present:
        return lost
    found = union_all([_read(spark, f"{folder}/{fmt}", fmt, columns) for fmt in sorted(present)])
    names = manifest.select(F.col("path").alias("_path"), F.col("src_path").alias("_name"))
    named = found.join(names, found["src_path"] == F.col("_path"))
    # A text names its file inside the record too.
    whole = F.col("format").isin("txt", "html") & F.col("record").isNotNull()
    renamed = F.to_json(F.struct(F.try_variant_get("record", "$.content", "string").alias("content"),
                                 F.col("_name").alias("file_path")))
    placed = named.select(
        F.col("_name").alias("src_path"), "format", "src_block", "src_row",
        F.concat_ws("#", "_name", F.col("src_row").cast("string")).alias("rec_id"),
        F.when(whole, renamed).otherwise(F.col("raw")).alias("raw"),
        F.when(whole, _variant(renamed)).otherwise(F.col("record")).alias("record"))
    return placed.unionByName(lost)


READERS = {
    "csv": read_csv, "tsv": read_tsv, "json": read_json, "jsonl": read_jsonl, "txt": read_text,
    "html": read_html, "xml": read_xml, "parquet": read_parquet, "archive": read_archives,
}


def read_records(spark: SparkSession, root: str, formats: tuple[str, ...] = tuple(READERS),
                 exclude: str | None = None, columns: set[str] | None = None) -> DataFrame:
    """Raw records of all files below ``root`` in the given formats, good and bad.

    ``columns`` are the Parquet columns to read, by default those of the built-in mappings.
    """
    records = union_all([_read(spark, root, f, columns) for f in formats])
    return records.filter(outside(F.col("src_path"), absolute(spark, exclude))) if exclude else records


def is_good() -> Column:
    """Whether a record is a JSON object."""
    is_object = F.rlike("raw", F.lit(r"^\s*\{"))
    return F.coalesce(F.col("record").isNotNull() & is_object, F.lit(False))


def with_reason(records: DataFrame) -> DataFrame:
    """Add ``reason``, why a record is rejected (null for a good one), and ``rejected``, its text if it is."""
    why = F.when(~is_good(), F.when(F.col("raw").isNull(), "unreadable").when(F.col("record").isNull(), "bad JSON")
                 .otherwise("no object"))
    return once(records, {"reason": why}).withColumn("rejected", F.when(F.col("reason").isNotNull(), F.col("raw")))


def good_records(records: DataFrame) -> DataFrame:
    """Records that are JSON objects."""
    return records.filter(is_good())


def rejected_records(records: DataFrame) -> DataFrame:
    """What was read but is no record: a file that is unreadable or too long, bad JSON, arrays and scalars."""
    return rejects(with_reason(records))


def rejects(marked: DataFrame) -> DataFrame:
    """The rejected ones of records that have reasons."""
    return marked.filter("reason IS NOT NULL").select(
        "src_path", "format", "src_block", "src_row", "reason", F.col("rejected").alias("raw"))
