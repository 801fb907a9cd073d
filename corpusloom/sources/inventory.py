"""Inventory of a folder tree: formats, sizes, row counts and routing to datasets."""

from __future__ import annotations

import hashlib
import mimetypes
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import SPACE, path_suffix, relative_path
from ..schema import DATASET_GLOBS, SUPPORTED_FORMATS
from ..session import stage
from .jsonstream import json_items

# JSON documents above this are read as a stream, element by element.
JSON_BYTES = 64 << 20
LINE_FORMATS = ("csv", "jsonl")


def file_glob(suffix: str) -> str:
    """Glob for a suffix in any letter case."""
    return "*." + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)


def guessed_formats() -> dict[str, str]:
    """Formats of suffixes without a reader, from the standard table of media types."""
    guesses = {}
    for suffix, media in mimetypes.types_map.items():
        name = suffix.lstrip(".").lower()
        if name in SUPPORTED_FORMATS:
            continue
        for part, fmt in (("json", "json"), ("xml", "xml"), ("text", "txt")):
            if part in media:
                guesses[name] = fmt
                break
    return guesses


def format_glob(fmt: str) -> str:
    """Glob for a format's own suffix and for those that are guessed to be it."""
    suffixes = [fmt, *sorted(name for name, guess in guessed_formats().items() if guess == fmt)]
    return "{" + ",".join(file_glob(s) for s in suffixes) + "}"


def detect_format(path: Column) -> Column:
    """Known suffix, else a guess from the media type, else ``unknown``."""
    suffix = path_suffix(path)
    result = F.when(suffix.isin(*SUPPORTED_FORMATS), suffix)
    guesses = guessed_formats()
    for fmt in ("json", "xml", "txt"):
        result = result.when(suffix.isin(*sorted(n for n, f in guesses.items() if f == fmt)), F.lit(fmt))
    return result.otherwise(F.lit("unknown"))


def plain_path(path: Column) -> Column:
    """A local path without its scheme; other paths as they are."""
    return F.regexp_replace(path, r"^file:/+", "/")


def scanned_path() -> Column:
    """The file a row was read from. ``_metadata`` holds its path percent-encoded, other columns do not."""
    encoded = F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")
    return plain_path(F.coalesce(F.try_url_decode(encoded), F.col("_metadata.file_path")))


def absolute(spark: SparkSession, path: str) -> str:
    """The path as the file system it is on names it, so that it compares with the paths of files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(r"^file:/+", "/", system.makeQualified(place).toString())


def outside(path: Column, folder: str) -> Column:
    """Whether a file is not below ``folder``, an absolute path."""
    return ~F.startswith(path, F.lit(folder.rstrip("/") + "/"))


_LISTED = "path string, is_folder boolean, length bigint, modificationTime timestamp"
_LISTED_TYPES = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64()),
                           ("modificationTime", pa.timestamp("us", "UTC"))])
# File systems that executors list themselves; others are listed by the session.
LISTED_SCHEMES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")
_LISTING_TASKS = 10_000


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, base = (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)
            prefix = folder.removesuffix(base.lstrip("/")).rstrip("/") if not folder.startswith("/") else ""
            found = [i for i in store.get_file_info(fs.FileSelector(base)) if not i.base_name.startswith(("_", "."))]
            paths = [f"{prefix}/{i.path.lstrip('/')}" for i in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(paths, pa.string()), pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_()),
                pa.array([i.size or 0 for i in found], pa.int64()),
                pa.array([i.mtime for i in found], pa.timestamp("us", "UTC"))], schema=_LISTED_TYPES)


def walk_files(spark: SparkSession, root: str) -> DataFrame:
    """Files below an absolute path, empty ones too, folder by folder.

    The folders found in one round are listed by the executors in the next, so the driver holds no file
    names. Names that begin with ``_`` or ``.`` are hidden, as for Spark's readers.
    """
    folders = spark.createDataFrame([(root,)], "path string")
    rounds = []
    while True:
        tasks = max(1, min(_LISTING_TASKS, folders.count()))
        found = stage(folders.repartition(tasks).mapInArrow(_listed, _LISTED), "listing")
        rounds.append(found.filter("NOT is_folder").drop("is_folder"))
        folders = found.filter("is_folder").select("path")
        if folders.isEmpty():
            return reduce(DataFrame.unionAll, rounds)


def listable(path: str) -> bool:
    """Whether executors can open an absolute path themselves."""
    scheme = re.match(r"([a-z0-9]+):", path)
    return scheme is None or scheme[1] in LISTED_SCHEMES


def list_files(spark: SparkSession, root: str, exclude: str | None = None) -> DataFrame:
    """Every file below ``root``: path, format, bytes, relative path. File contents are not read.

    Files without bytes are listed, except on a store that only Spark can open.
    """
    top = absolute(spark, root)
    if listable(top):
        files = walk_files(spark, top)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root) \
            .select(plain_path(F.col("path")).alias("path"), "length", "modificationTime")
    if exclude:
        files = files.filter(outside(F.col("path"), absolute(spark, exclude)))
    return files.select(
        "path", detect_format(F.col("path")).alias("format"), "length", "modificationTime",
        relative_path(F.col("path"), top).alias("relative_path"))


def supported_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("format").isin(*SUPPORTED_FORMATS))


def totals(files: DataFrame) -> DataFrame:
    """File count and bytes."""
    return files.agg(F.count(F.lit(1)).alias("files"),
                     F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _read(spark: SparkSession, root: str, suffix: str, **options: str):
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", file_glob(suffix))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader


def _by_file(df: DataFrame, count: Column) -> DataFrame:
    return df.groupBy(scanned_path().alias("path")).agg(count.cast("bigint").alias("n"))


def _line_counts(spark: SparkSession, root: str, suffix: str, blank: bool) -> DataFrame:
    lines = _read(spark, root, suffix).text(root)
    filled = F.rlike("value", F.lit(f"[^{SPACE}]"))
    return _by_file(lines, F.count(F.lit(1)) if blank else F.count_if(filled))


def _json_counts(spark: SparkSession, root: str, scalar: int, invalid: int) -> DataFrame:
    """Length of an array; 1 for an object; the given numbers for a scalar and for bad JSON.

    A damaged array is bad JSON, whatever its size.
    """
    docs = whole_files(spark, root, file_glob("json"), JSON_BYTES)
    start = F.substring(F.ltrim("value"), 1, 1)
    n = F.when(F.json_array_length("value").isNotNull(), F.json_array_length("value")) \
        .when(~F.is_variant_null(F.try_parse_json("value")) & (start == "{"), F.lit(1)) \
        .when(F.try_parse_json("value").isNull(), F.lit(invalid)).otherwise(F.lit(scalar))
    small = docs.filter("NOT too_long").select(F.col("src_path").alias("path"), n.cast("bigint").alias("n"))
    items = json_items(docs.filter("too_long").select("src_path")).groupBy(F.col("src_path").alias("path")) \
        .agg(F.when(F.bool_or("damaged"), F.lit(invalid)).otherwise(F.count(F.lit(1))).cast("bigint").alias("n"))
    return small.unionAll(items)


def whole_files(spark: SparkSession, root: str, glob: str, limit: int) -> DataFrame:
    """``src_path``, ``value`` and ``too_long`` of each file; the text of a file above ``limit`` bytes is
    not read but null, so one such file cannot fail the scan of the others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", glob).load(root)
    path = plain_path(F.col("path")).alias("src_path")
    short = files.filter(F.col("length") <= limit).select(path, F.col("content").cast("string").alias("value"),
                                                          F.lit(False).alias("too_long"))
    long = files.filter(F.col("length") > limit).select(path, F.lit(None).cast("string").alias("value"),
                                                        F.lit(True).alias("too_long"))
    return short.unionAll(long)


def parquet_folders(spark: SparkSession, root: str) -> list[str]:
    """Folders that hold Parquet files: one reader each, since schemas differ between sources.

    Only folder names reach the driver, which is fewer than the file index it holds anyway.
    """
    paths = list_files(spark, root).filter("format = 'parquet'")
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return sorted(r[0] for r in paths.select(folder).distinct().collect())


_FOOTERS = "path string, n bigint, schema string"
_FOOTERS_A_TASK = 64


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths, counts, schemas = batch.column(0).to_pylist(), [], []
        for path in paths:
            store, base = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
            with store.open_input_file(base) as file:
                try:
                    meta = pq.read_metadata(file)
                    leaves = [meta.schema.column(i) for i in range(meta.num_columns)]
                    shape = [(c.path, c.physical_type, str(c.logical_type), c.max_definition_level, c.max_repetition_level) for c in leaves]
                except (pa.ArrowInvalid, OSError):  # no footer: a damaged file
                    counts.append(None)
                    schemas.append(None)
                    continue
            # Spark's own schema, if there is one, is what it reads the file with.
            own = (meta.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata", b"")
            counts.append(meta.num_rows)
            schemas.append(hashlib.sha256(repr(shape).encode() + own).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(schemas, pa.string())],
                                         names=["path", "n", "schema"])


def parquet_footers(spark: SparkSession, root: str) -> DataFrame | None:
    """Rows (``n``) and fingerprint of the schema of each Parquet file, both null for a damaged one.

    Executors read the footers. None on a store that only Spark can open.
    """
    if not listable(absolute(spark, root)):
        return None
    files = list_files(spark, root).filter("format = 'parquet'").select("path")
    tasks = max(1, min(_LISTING_TASKS, -(-files.count() // _FOOTERS_A_TASK)))
    return stage(files.repartition(tasks).mapInArrow(_footers, _FOOTERS), "footers")


def parquet_groups(footers: DataFrame) -> list[list[str]]:
    """Folders with readable Parquet files; those whose files have the same schemas are one group, for one reader."""
    folders = footers.filter("schema IS NOT NULL").groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")) \
        .agg(F.array_join(F.array_sort(F.collect_set("schema")), "").alias("schemas"))
    groups = folders.groupBy("schemas").agg(F.array_sort(F.collect_list("folder")).alias("folders"))
    return sorted(r["folders"] for r in groups.collect())


def parquet_files(folder: str) -> str:
    """A glob for the Parquet files right in a folder, whatever characters its name has."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", folder) + "/" + file_glob("parquet")


def _parquet_counts(spark: SparkSession, root: str) -> DataFrame:
    footers = parquet_footers(spark, root)
    if footers is not None:
        return footers.filter("n IS NOT NULL").select("path", "n")
    counts = None
    for folder in parquet_folders(spark, root):
        rows = spark.read.option("recursiveFileLookup", "true") \
            .option("ignoreCorruptFiles", "true").schema("`_none` string").parquet(parquet_files(folder))
        one = _by_file(rows, F.count(F.lit(1)))
        counts = one if counts is None else counts.unionByName(one)
    return counts if counts is not None else spark.createDataFrame([], "path string, n bigint")


def _csv_records(spark: SparkSession, root: str) -> DataFrame:
    rows = _read(spark, root, "csv", header="true", multiLine="true", escape='"') \
        .schema("`_first` string").csv(root)
    return _by_file(rows, F.count(F.lit(1)))


def estimated_rows(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Add ``estimated_rows``: lines of csv and jsonl (all of them), rows of parquet, items of json."""
    counts = _json_counts(spark, root, scalar=1, invalid=1).withColumn("format", F.lit("json"))
    for suffix in LINE_FORMATS:
        counts = counts.unionByName(
            _line_counts(spark, root, suffix, blank=True).withColumn("format", F.lit(suffix)))
    counts = counts.unionByName(_parquet_counts(spark, root).withColumn("format", F.lit("parquet")))
    counted = F.when(F.col("format").isin("csv", "jsonl"), F.coalesce("n", F.lit(0))) \
        .otherwise(F.coalesce("n", F.lit(1)))
    return files.join(counts, ["path", "format"], "left") \
        .withColumn("estimated_rows", counted.cast("bigint")).drop("n")


def exact_entries(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Add ``entries``: csv records, non-blank lines of jsonl and of any text, json items, parquet rows.

    An unreadable file counts 0.
    """
    counts = _json_counts(spark, root, scalar=0, invalid=0).withColumn("kind", F.lit("json"))
    for kind, frame in (
        ("jsonl", _line_counts(spark, root, "jsonl", blank=False)),
        ("csv", _csv_records(spark, root)),
        ("parquet", _parquet_counts(spark, root)),
        ("other", _other_line_counts(spark, root)),
    ):
        counts = counts.unionByName(frame.withColumn("kind", F.lit(kind)))
    suffix = path_suffix(F.col("path"))
    kind = F.when(suffix.isin("json", "jsonl", "csv", "parquet"), suffix).otherwise(F.lit("other"))
    return files.withColumn("kind", kind).join(counts, ["path", "kind"], "left") \
        .withColumn("entries", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n", "kind")


def _other_line_counts(spark: SparkSession, root: str) -> DataFrame:
    """Non-blank lines of every file that is read as text; 0 for one that is not UTF-8."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root)
    path = scanned_path()
    plain = lines.filter(~path_suffix(path).isin("json", "jsonl", "csv", "parquet"))
    filled = F.count_if(F.rlike("value", F.lit(f"[^{SPACE}]")))
    return _by_file(plain, F.when(F.bool_and(F.is_valid_utf8("value")), filled).otherwise(F.lit(0)))


def _glob_pattern(glob: str) -> str:
    """A glob on relative paths as a regular expression: ``**/`` is any depth, ``*`` one name."""
    text = "".join({"*": "[^/]*", ".": r"\.", "\0": "(?:[^/]+/)*"}.get(c, c)
                   for c in glob.replace("**/", "\0"))
    return f"^{text}$"


def route_to_datasets(files: DataFrame, globs: dict[str, tuple[str, ...]] = DATASET_GLOBS) -> DataFrame:
    """One row per file and dataset with a matching pattern. Row-local: no join, no duplicates."""
    names = []
    for dataset, patterns in globs.items():
        pattern = "|".join(_glob_pattern(p) for p in patterns)
        names.append(F.when(F.rlike("relative_path", F.lit(pattern)), F.lit(dataset)))
    return files.withColumn("dataset", F.explode(F.array_compact(F.array(*names))))
