"""Manifest, profiles, coverage and quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import percentage

MANIFEST_FIELDS = ("split", "source_site", "difficulty", "question_type")
PROFILE_FIELDS = ("source_site", "difficulty", "language")
SOURCES_GOAL, ENTRIES_GOAL = 10, 5000
SUCCESS_COVERAGE = 50.0


def _counts_by(df: DataFrame, sets: list[list[str]], fields: tuple[str, ...]) -> DataFrame:
    """Counts for several groupings in one pass, with a bit set that tells them apart."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in fields]) \
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))


def manifest(df: DataFrame) -> DataFrame:
    """Total, and counts by split, source, difficulty and question type: (metric, key, n)."""
    fields = MANIFEST_FIELDS
    grouped = _counts_by(df, [[]] + [[f] for f in fields], fields)
    all_bits = (1 << len(fields)) - 1
    metric = F.when(F.col("_gid") == all_bits, F.lit("total"))
    key: Column = F.when(F.col("_gid") == all_bits, F.lit(""))
    for i, field in enumerate(fields):
        bits = all_bits ^ (1 << (len(fields) - 1 - i))
        metric = metric.when(F.col("_gid") == bits, F.lit(field))
        key = key.when(F.col("_gid") == bits, F.coalesce(F.col(field), F.lit("")))
    return grouped.select(metric.alias("metric"), key.alias("key"), F.col("n").cast("bigint").alias("n"))


def split_sizes(df: DataFrame) -> DataFrame:
    """Total and size of each split."""
    sizes = df.groupingSets([[], [F.col("split")]], F.col("split")) \
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    return sizes.select(
        F.when(F.col("_gid") == 1, F.lit("total")).otherwise(F.col("split")).alias("split"),
        F.col("n").cast("bigint").alias("n"))


def split_profile(df: DataFrame) -> DataFrame:
    """Counts of source, difficulty and language within each split: (split, field, value, n).

    An absent (null) value counts as ``unknown``; an empty one stays empty.
    """
    known = df.select("split", *[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in PROFILE_FIELDS])
    fields = ("split",) + PROFILE_FIELDS
    grouped = _counts_by(known, [["split", f] for f in PROFILE_FIELDS], fields)
    all_bits = (1 << len(PROFILE_FIELDS)) - 1
    field, value = None, None
    for i, name in enumerate(PROFILE_FIELDS):
        hit = F.col("_gid") == all_bits ^ (1 << (len(PROFILE_FIELDS) - 1 - i))
        field = F.when(hit, F.lit(name)) if field is None else field.when(hit, F.lit(name))
        value = F.when(hit, F.col(name)) if value is None else value.when(hit, F.col(name))
    return grouped.select("split", field.alias("field"), value.alias("value"),
                          F.col("n").cast("bigint").alias("n"))


def quality_report(df: DataFrame) -> DataFrame:
    """Share of each split, number of sources, and merged difficulty and language counts."""
    profile = split_profile(df)
    all_splits = df.sparkSession.createDataFrame(
        [("train",), ("validation",), ("test",)], "split string")
    sizes = profile.filter("field = 'source_site'").groupBy("split").agg(F.sum("n").alias("n"))
    three_rows = Window.partitionBy(F.lit(0))
    known = all_splits.join(sizes, "split", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shares = known.select(
        F.lit("split").alias("metric"), F.col("split").alias("key"), F.col("n").cast("bigint").alias("n"),
        percentage(F.col("n"), F.sum("n").over(three_rows)).alias("pct"))
    merged = profile.groupBy("field", "value").agg(F.sum("n").alias("n"))
    values = merged.filter("field <> 'source_site'").select(
        F.col("field").alias("metric"), F.col("value").alias("key"),
        F.col("n").cast("bigint").alias("n"), F.lit(None).cast("double").alias("pct"))
    sources = merged.filter("field = 'source_site'").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("unique_sources").alias("metric"), F.lit("").alias("key"),
        F.col("n").cast("bigint").alias("n"), F.lit(None).cast("double").alias("pct"))
    return shares.unionByName(values).unionByName(sources)


def distinct_sources(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("source_site", F.lit("unknown")).alias("source_site")).distinct()


def quality_score(df: DataFrame) -> DataFrame:
    """One row: non-empty splits, sources, entries and the score out of 100."""
    cells = df.groupBy("split", F.coalesce("source_site", F.lit("unknown")).alias("source_site")) \
        .agg(F.count(F.lit(1)).alias("n"))
    facts = cells.agg(
        F.countDistinct("split").alias("splits"),
        F.countDistinct("source_site").alias("sources"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"))
    score = F.least(F.lit(100.0), (
        F.col("splits") / F.lit(3.0) * 30.0
        + F.least(F.col("sources") / F.lit(float(SOURCES_GOAL)), F.lit(1.0)) * 30.0
        + F.least(F.col("entries") / F.lit(float(ENTRIES_GOAL)), F.lit(1.0)) * 40.0))
    return facts.select(
        F.col("splits").cast("bigint"), F.col("sources").cast("bigint"),
        F.col("entries").cast("bigint"), score.alias("score"))


def input_profile(files: DataFrame) -> DataFrame:
    """Files, entries and MiB per dataset, with a total row: needs (dataset, entries, length)."""
    rolled = files.rollup("dataset").agg(
        F.count(F.lit(1)).alias("files"), F.sum("entries").alias("entries"),
        (F.sum("length") / F.lit(1048576.0)).alias("size_mib"), F.grouping_id().alias("_gid"))
    return rolled.select(
        F.when(F.col("_gid") == 1, F.lit("total")).otherwise(F.col("dataset")).alias("dataset"),
        F.col("files").cast("bigint"), F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"),
        F.coalesce("size_mib", F.lit(0.0)).alias("size_mib"))


def coverage(inputs: DataFrame, outputs: DataFrame, dataset: str = "dataset",
             source: str = "source_site") -> DataFrame:
    """Input and output counts per dataset, with a total row.

    Both sides are first reduced to one row per dataset; the planner picks the join by their size.
    The total counts every output row, also of sources that are no input dataset.
    """
    wanted = inputs.groupBy(F.col(dataset).alias("dataset")).agg(F.sum("entries").alias("original"))
    got = outputs.groupBy(F.col(source).alias("dataset")).agg(F.count(F.lit(1)).alias("consolidated"))
    joined = wanted.join(got, "dataset", "full")
    is_input = F.col("original").isNotNull()
    counted = joined.select(
        F.when(is_input, F.col("dataset")).alias("dataset"), is_input.alias("_input"),
        F.coalesce("original", F.lit(0)).alias("original"),
        F.coalesce("consolidated", F.lit(0)).alias("consolidated"))
    rolled = counted.rollup("_input", "dataset").agg(
        F.sum("original").alias("original"), F.sum("consolidated").alias("consolidated"),
        F.grouping_id().alias("_gid"))
    shown = rolled.filter((F.col("_gid") == 3) | ((F.col("_gid") == 0) & F.col("_input")))
    return shown.select(
        F.when(F.col("_gid") == 3, F.lit("total")).otherwise(F.col("dataset")).alias("dataset"),
        F.coalesce("original", F.lit(0)).cast("bigint").alias("original"),
        F.coalesce("consolidated", F.lit(0)).cast("bigint").alias("consolidated"),
        percentage(F.coalesce("consolidated", F.lit(0)), F.coalesce("original", F.lit(0)))
        .alias("coverage_pct"),
        F.coalesce(F.col("original") - F.col("consolidated"), F.lit(0)).cast("bigint").alias("missing"))


def missing_records(inputs: DataFrame, outputs: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """Input rows with no output row of the same id."""
    return inputs.join(outputs.select(id_col), id_col, "left_anti")


def summary(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row: totals, coverage, datasets, files, success and score; needs (dataset, files, entries)."""
    original = inputs.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).cast("bigint").alias("original_entries"),
        F.count(F.lit(1)).alias("datasets"),
        F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("files"))
    # Two single rows side by side: each column has a value in one of them.
    both = original.unionByName(quality_score(outputs), allowMissingColumns=True)
    facts = both.agg(*[F.max(c).alias(c) for c in both.columns])
    pct = percentage(F.col("entries"), F.col("original_entries"))
    return facts.select(
        "original_entries", F.col("entries").alias("consolidated_entries"),
        pct.alias("coverage_pct"), F.col("datasets").cast("bigint"), "files",
        (F.col("entries") > 0).alias("success"), F.col("score").alias("quality_score"),
        ((F.col("entries") > 0) & (pct > SUCCESS_COVERAGE)).alias("accepted"))


def assemble_tokens(tokens: Column, confidences: Column, threshold: float) -> Column:
    """Struct of the joined text of confident tokens, and their mean confidence (0 if none).

    Tokens and confidences are parallel arrays of one row, so nothing is shuffled.
    """
    pairs = F.arrays_zip(tokens.alias("t"), confidences.alias("c"))
    kept = F.filter(pairs, lambda p: p["c"] > threshold)

    def build(k: Column) -> Column:
        total = F.aggregate(k, F.lit(0.0), lambda acc, p: acc + p["c"].cast("double"))
        n = F.size(k)
        return F.struct(
            F.array_join(F.transform(k, lambda p: p["t"]), " ").alias("text"),
            F.when(n > 0, total / F.nullif(n, F.lit(0)).cast("double")).otherwise(F.lit(0.0))
            .alias("confidence"),
            n.cast("bigint").alias("n_tokens"))

    return F.transform(F.array(kept), build)[0]


def rate_statistics(events: DataFrame, time_col: str, is_error: Column) -> DataFrame:
    """One row: processed, errors, uptime in seconds, and processed per minute."""
    facts = events.agg(
        F.count(F.lit(1)).alias("processed"),
        F.coalesce(F.sum(is_error.cast("bigint")), F.lit(0)).alias("errors"),
        (F.unix_micros(F.max(time_col).cast("timestamp"))
         - F.unix_micros(F.min(time_col).cast("timestamp"))).alias("_micros"))
    uptime = F.coalesce(F.col("_micros"), F.lit(0)) / F.lit(1_000_000.0)
    return facts.select(
        F.col("processed").cast("bigint"), F.col("errors").cast("bigint"), uptime.alias("uptime_s"),
        F.when(uptime > 0, F.col("processed") / F.nullif(uptime, F.lit(0.0)) * 60.0)
        .otherwise(F.lit(0.0)).alias("per_minute"))


# log2 of the values a quantile sketch keeps at its base: a rank error of about 0.7 % of the rows.
SKETCH_K = 400
RANK_ERROR = 0.02


def quantile_sketches(df: DataFrame, value: Column, *keys: str | Column) -> DataFrame:
    """A mergeable quantile sketch (``sketch``) of an integer column per window or group, a few KB each; null
    values do not count. Kept as a table, the sketches of any set of windows can be merged later."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_bigint(value.cast("bigint"), F.lit(SKETCH_K)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, ranks: Sequence[float], *keys: str | Column) -> DataFrame:
    """``n`` and ``quantiles`` (an array, one per rank) over all sketches of a group; of nothing, null."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_K)).alias("merged"))
    n = F.kll_sketch_get_n_bigint("merged")
    found = F.array(*[F.kll_sketch_get_quantile_bigint("merged", F.lit(float(r))) for r in ranks])
    return merged.select(*keys, n.alias("n"), F.when(n > 0, found).alias("quantiles"))


def latency_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1_000_000.0)
