"""From a folder tree, or from records, to a split corpus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import path_stem, relative_path
from ..operators import dedup, filters, fuzzy, mapping, splits, variants
from ..schema import ENGINE, FIELD_CANDIDATES, UNIFIED
from ..session import stage
from ..sinks import writers
from ..sources import inventory, readers

RECORD_ORDER = ["src_path", "src_block", "src_row"]


def refine(records: DataFrame, order: Sequence[str] = ("rec_id",), fuzzy_threshold: float = 1.0,
           create_variants: bool = True, rewrite: bool = True) -> DataFrame:
    """Exact (or near) duplicates out, quality filter, language variants."""
    if fuzzy_threshold < 1.0:
        # Zero-padded, so that the text order of the key is the order of the records.
        kinds = dict(records.dtypes)
        parts = [F.lpad(F.col(c).cast("string"), 19, "0") if kinds[c] in ("bigint", "int") else F.col(c) for c in order]
        placed = records.withColumn("_order", F.concat_ws("\0", *parts))
        unique = fuzzy.fuzzy_dedup(placed, fuzzy_threshold, id_col="_order").drop("_order")
    else:
        unique = dedup.exact_dedup(records, order=list(order))
    good = filters.quality_filter(unique)
    return variants.language_variants(good, rewrite) if create_variants else good


def read_normalised(spark: SparkSession, root: str, formats: tuple[str, ...] = tuple(readers.READERS),
                    exclude: str | None = None, clean_code: bool = False, valid: Column | None = None,
                    tables: Mapping[str, Mapping[str, Sequence[str]]] = FIELD_CANDIDATES) -> DataFrame:
    """Unified, cleaned and valid records of all files below ``root``."""
    return unified_only(read_unified(spark, root, formats, exclude, clean_code, valid, tables))


def read_unified(spark: SparkSession, root: str, formats: tuple[str, ...] = tuple(readers.READERS),
                 exclude: str | None = None, clean_code: bool = False, valid: Column | None = None,
                 tables: Mapping[str, Mapping[str, Sequence[str]]] = FIELD_CANDIDATES) -> DataFrame:
    """As ``read_normalised``, and besides what is no record, with ``reason`` and text: both from one pass."""
    records = readers.with_reason(
        readers.read_records(spark, root, formats, exclude, readers.candidate_columns(tables)))
    rule = valid if valid is not None else filters.is_valid(
        F.col("question_text"), F.col("answer_text"), F.col("solution_code"))
    return mapping.normalise(records, clean_code=clean_code, valid=F.col("reason").isNotNull() | rule, tables=tables)


def unified_only(read: DataFrame) -> DataFrame:
    return read.filter("reason IS NULL").select(*[f.name for f in ENGINE], *[f.name for f in UNIFIED])


def consolidate(spark: SparkSession, root: str, output: str | None = None,
                formats: tuple[str, ...] = tuple(readers.READERS), create_variants: bool = True,
                shard_size: int = 0, output_formats: tuple[str, ...] = ("jsonl",), seed: str = "42",
                fuzzy_threshold: float = 1.0, clean_code: bool = False) -> DataFrame:
    """Read, map, clean, deduplicate, filter, fan out, split and (with ``output``) write.

    The files are read once. With ``output``, what is read is staged, as both the corpus and the rejected
    records come from it. The refined corpus is staged once: the passes that follow (bucket counts, cuts,
    manifest, write) then read only the columns they need instead of repeating the parsing and cleaning.
    """
    read = read_unified(spark, root, formats, exclude=output, clean_code=clean_code)
    # Staged before the output is replaced, which may be among the files that were listed.
    read = stage(read, "read") if output else read
    refined = stage(refine(unified_only(read), RECORD_ORDER, fuzzy_threshold, create_variants), "refined")
    split = splits.stratified_split(refined, seed=seed)
    if output:
        writers.write_shards(split, output, shard_size, output_formats)
        writers.write_manifest(split, output, shard_size, output_formats, writers.write_rejected(readers.rejects(read), output))
    return split


def consolidate_by_dataset(spark: SparkSession, root: str, output: str | None = None,
                           seed: str = "42") -> DataFrame:
    """The glob-routed profile: per-dataset keys, no cleaning, no duplicates removed, global split."""
    formats = ("csv", "json", "jsonl", "txt", "parquet")
    records = readers.read_records(spark, root, formats, exclude=output)
    located = records.withColumn(
        "relative_path", relative_path(F.col("src_path"), inventory.absolute(spark, root)))
    routed = inventory.route_to_datasets(located).drop("relative_path")
    is_text = F.col("format") == "txt"
    names = [f.name for f in ENGINE] + [f.name for f in UNIFIED]
    objects = mapping.normalise_by_dataset(readers.good_records(routed.filter(~is_text)))
    content = F.try_variant_get("record", "$.content", "string")
    texts = mapping.text_problem(
        routed.filter(is_text).withColumn("content", content), "content",
        path_stem(F.col("src_path")), F.col("dataset"))
    corpus = stage(dedup.union_all([objects.select(*names), texts.select(*names)]), "by-dataset")
    split = splits.global_split(corpus, seed=seed)
    if output:
        rejected = stage(readers.rejected_records(records), "rejected")
        writers.write_splits(split, f"{output}/jsonl")
        writers.write_manifest(split, output, rejected=writers.write_rejected(rejected, output))
    return split
