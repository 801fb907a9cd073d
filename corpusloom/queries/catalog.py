"""The queries, one per operator. Each takes a session and the folder of the tables."""

from __future__ import annotations

import csv
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import classify, code, html, text
from ..operators import dedup, digests, filters, fuzzy, mapping, scoring, setjoin, splits, stats, variants
from ..plans import consolidate as jobs, training
from ..schema import UNIFIED
from ..session import scratch_path, stage
from ..sinks import writers
from ..sources import corpus, inventory, readers
from ..streaming import events as streams, keyed
from . import bindings as b

SHARD_SIZE = 100
FUZZY_THRESHOLD = 0.9
TOKEN_CONFIDENCE = 60.0


def _joined(name: str) -> Column:
    return F.array_join(F.col(name), "|").alias(name)


# Text functions ---------------------------------------------------------------------------------

def c1_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return b.snippets(spark, sf).select("rec_id", text.clean_text(F.col("snippet")).alias("clean"))


def c2_html_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = b.table(spark, sf, "pages")
    return pages.select("page_id", html.html_to_text(F.col("html")).alias("text"))


def c2_html_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with marks inside attributes, comments, scripts, titles and text areas, and a style that is not closed."""
    page = F.concat(
        F.lit("""<p title="a > b" lang=x data-y='<i>'>"""), F.col("page_id").cast("string"),
        F.lit("""</p><a title="<!--">kept</a><!-- <b title="--><title>x <b> y</title><textarea rows=1>1 < 2 </i></textarea>"""),
        F.lit("""<script type="a>b">if (a > b) "<p>";</script x>"""), F.col("html"), F.lit("<style>p > b {"))
    return b.table(spark, sf, "pages").select("page_id", html.html_to_text(page).alias("text"))


def c3_dedup_key(spark: SparkSession, sf: str) -> DataFrame:
    return b.docs(spark, sf).select(
        "rec_id", text.dedup_text(F.col("question_text")).alias("norm"),
        text.dedup_key(F.col("question_text")).alias("dedup_key"))


def c5_artefact_clean(spark: SparkSession, sf: str) -> DataFrame:
    return b.docs(spark, sf).select("rec_id", text.clean_artefacts(F.col("question_text")).alias("clean"))


def q1_question_type(spark: SparkSession, sf: str) -> DataFrame:
    return b.phrased(spark, sf).select("rec_id", classify.question_type(F.col("phrase")).alias("question_type"))


def q2_question_type(spark: SparkSession, sf: str) -> DataFrame:
    return b.phrased(spark, sf).select(
        "rec_id", classify.question_type_by_parts(F.col("phrase")).alias("question_type"))


def x1_fenced_code(spark: SparkSession, sf: str) -> DataFrame:
    return b.snippets(spark, sf).select("rec_id", code.extract_code(F.col("snippet")).alias("code"))


def x2_primary_solution(spark: SparkSession, sf: str) -> DataFrame:
    return b.snippets(spark, sf).select("rec_id", code.primary_solution(F.col("snippet")).alias("solution"))


def x3_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return b.snippets(spark, sf).select("rec_id", code.complexity_note(F.col("snippet")).alias("note"))


def x5_question_detect(spark: SparkSession, sf: str) -> DataFrame:
    found = b.phrased(spark, sf).withColumn("d", classify.detect_question(F.col("phrase")))
    return found.select("rec_id", "d.question_hits", "d.code_hits",
                        F.round("d.confidence", 6).alias("confidence"), "d.is_question")


def x7_path_parts(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.expr(b.SITE_PATH), F.lit(".tar.GZ"))
    return b.documents(spark, sf).select(
        F.col("doc_id").alias("rec_id"), text.path_stem(path).alias("stem"),
        text.path_suffix(path).alias("suffix"), text.relative_path(path, "/data").alias("relative_path"))


def w6_longest_part(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.split("question_text", "[.,]")
    return b.docs(spark, sf).select("rec_id", code.longest(parts).alias("longest"))


def w7_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """Truncation to a fixed length is the operator here."""
    return b.docs(spark, sf).select("rec_id", F.substring("question_text", 1, 2000).alias("head"))


# Mapping ----------------------------------------------------------------------------------------

def _records(spark: SparkSession, sf: str, *fields: Column, path: str = b.SITE_PATH) -> DataFrame:
    """Raw records: JSON of the given fields, with their VARIANT and a path."""
    raw = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    located = b.documents(spark, sf).withColumns({"rec_id": F.col("doc_id"), "src_path": F.expr(path)})
    texts = mapping.once(located, {"raw": raw}).select("rec_id", "src_path", "raw")
    return mapping.once(texts, {"record": F.try_parse_json("raw")})


def _unify_fields() -> list[Column]:
    e = F.expr
    return [
        e("CASE WHEN n_chars % 3 = 0 THEN '' ELSE text END").alias("question"),
        e("text").alias("text"), e("text").alias("content"),
        e("CASE WHEN n_chars % 2 = 0 THEN text END").alias("description"),
        e("n_chars % 2 = 0").alias("answer"), e("lang").alias("explanation"),
        e("CASE WHEN n_chars % 4 = 0 THEN '' ELSE source END").alias("code"),
        e("source").alias("solution"), e("lang").alias("lang"),
        e("n_chars % 5").alias("difficulty"), e("upper(lang)").alias("level"),
        e("lang || ', ' || source || ',, x '").alias("tags"), e("doc_id").alias("id"),
        e("source").alias("title"), e("doc_id").alias("task_id"), e("lang").alias("name"),
        e("CAST(n_chars AS STRING)").alias("time_limit"), e("array(lang, source)").alias("test_list"),
    ]


def m1_source_site(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat("url", F.expr("CASE length(url) % 5 WHEN 0 THEN '/LeetCode/mbpp' WHEN 1 THEN '/apps' "
                                  "WHEN 2 THEN '/x/Code_Contests' WHEN 3 THEN '/ds1000' ELSE '' END"))
    return b.table(spark, sf, "pages").select("page_id", mapping.source_site(path).alias("source_site"))


def _own_mapping(records: DataFrame, **candidates: list[str]) -> DataFrame:
    """The mapping job with a table of one's own for records of no known source."""
    return mapping.map_fields(records.withColumn("src_path", F.lit("/data/misc")), tables={"unknown": candidates})


def m2_coalesce_fields(spark: SparkSession, sf: str) -> DataFrame:
    mapped = _own_mapping(
        _records(spark, sf, *_unify_fields()), question_text=["missing", "question", "text"],
        answer_text=["answer", "explanation"], solution_code=["code", "solution"], difficulty=["difficulty", "level"])
    return mapped.select("rec_id", "question_text", "answer_text", "solution_code", "difficulty")


def m2_mapping_table(spark: SparkSession, sf: str) -> DataFrame:
    """A mapping of each source of the documents, as rows; sources with names of an even length have another one."""
    even = F.length("source") % 2 == 0
    common = [("answer_text", 0, "answer"), ("answer_text", 1, "explanation"), ("solution_code", 0, "code"),
              ("solution_code", 1, "solution"), ("difficulty", 2, "level"), ("question_text", 2, "text")]
    other = [("question_text", 0, "missing"), ("question_text", 1, "question"), ("difficulty", 1, "difficulty")]

    def candidates(rows: list[tuple], always: bool = False) -> Column:
        return F.array(*[F.struct(F.lit(t).alias("target"), F.lit(p).alias("place"), F.lit(f).alias("field"),
                                  F.lit(always).alias("always")) for t, p, f in rows])

    chosen = F.when(even, F.concat(candidates(common), candidates([("question_text", 0, "description")], True))) \
        .otherwise(F.concat(candidates(common), candidates(other)))
    rows = b.documents(spark, sf).select("source").distinct().select("source", F.inline(chosen))
    records = _records(spark, sf, *_unify_fields()).withColumn("source_site", mapping.field_text(F.col("record"), "title"))
    return mapping.map_by_rows(records, rows).select(
        "rec_id", "question_text", "answer_text", "solution_code", "difficulty")


def m3_multilang(spark: SparkSession, sf: str) -> DataFrame:
    solution = F.struct(
        F.col("text").alias("python"), F.expr("CASE WHEN n_chars % 2 = 0 THEN '' ELSE lang END").alias("java"),
        F.col("doc_id").alias("c"), F.col("source").alias("c++"))
    return _own_mapping(_records(spark, sf, solution.alias("solution")), solution_code=["code", "solution"]) \
        .select("rec_id", "solution_code")


def m4_solution_columns(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(
        spark, sf, F.col("text").alias("python"),
        F.expr("CASE WHEN n_chars % 2 = 0 THEN '' ELSE lang END").alias("java"), F.col("source").alias("c++"))
    return records.select("rec_id", mapping.solutions_from_columns(F.col("record")).alias("solution_code"))


def m5_nested_solutions(spark: SparkSession, sf: str) -> DataFrame:
    solutions = F.struct(
        F.struct(F.col("text").alias("solution")).alias("3"), F.struct(F.col("lang").alias("other")).alias("2"),
        F.struct(F.col("source").alias("solution")).alias("1"))
    records = _records(spark, sf, solutions.alias("solutions"))
    return records.select("rec_id", mapping.nested_solutions(F.col("record"), F.col("raw")).alias("solution_code"))


def m6_tags(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.expr("""CASE n_chars % 3 WHEN 0 THEN to_json(array(lang, source))
        WHEN 1 THEN '" ' || lang || ',  ' || source || ',,x "' ELSE CAST(doc_id AS STRING) END""")
    raw = F.concat(F.lit('{"tags": '), tags, F.lit("}"))
    records = b.documents(spark, sf).select(
        F.col("doc_id").alias("rec_id"), raw.alias("raw"), F.try_parse_json(raw).alias("record"))
    return _own_mapping(records, tags=["tags", "topics"]).select("rec_id", _joined("tags"))


def m7_source_overrides(spark: SparkSession, sf: str) -> DataFrame:
    mapped = mapping.map_fields(_records(spark, sf, *_unify_fields()))
    return mapped.select("rec_id", "source_site", "question_text", "problem_id", "difficulty", "solution_code",
                         _joined("test_cases"))


def m8_dataset_mapping(spark: SparkSession, sf: str) -> DataFrame:
    dataset = F.expr("CASE lang WHEN 'en' THEN 'leetcode' WHEN 'fr' THEN 'mbpp' WHEN 'de' THEN 'apps' "
                     "ELSE 'generic' END")
    records = _records(spark, sf, *_unify_fields()).join(
        b.documents(spark, sf).select(F.col("doc_id").alias("rec_id"), dataset.alias("dataset")), "rec_id")
    unified = mapping.normalise_by_dataset(records)
    return unified.select("rec_id", "source_site", "question_text", "solution_code", "problem_id",
                          "difficulty", "language", "question_type")


def m9_normalise(spark: SparkSession, sf: str) -> DataFrame:
    unified = mapping.normalise(_records(spark, sf, *_unify_fields()))
    return unified.select(
        "rec_id", "source_site", "question_text", "answer_text", "solution_code", "language", "question_type",
        "difficulty", "problem_id", _joined("tags"), _joined("test_cases"),
        F.col("time_limit").cast("bigint").alias("time_limit"))


def m10_nested_json(spark: SparkSession, sf: str) -> DataFrame:
    nested = b.documents(spark, sf).select(
        F.col("doc_id").alias("rec_id"), F.array("lang", "source").alias("tags"),
        F.struct("lang", "n_chars").alias("facts"))
    return mapping.nested_as_json(nested)


def m11_training_text(spark: SparkSession, sf: str) -> DataFrame:
    records = b.documents(spark, sf).select(
        F.col("doc_id").alias("rec_id"), F.col("text").alias("question_text"),
        F.expr("CASE WHEN n_chars % 2 = 0 THEN source ELSE ' ' END").alias("answer_text"),
        F.col("text").alias("solution_code"), F.expr(b.LANGUAGE).alias("language"),
        F.expr("CASE WHEN n_chars % 3 = 0 THEN '' ELSE lang END").alias("difficulty"))
    return mapping.training_items(records)


def m12_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return b.qa(spark, sf).select("rec_id", mapping.prompt(F.col("question_text")).alias("prompt"))


def m13_markdown(spark: SparkSession, sf: str) -> DataFrame:
    fenced = F.when(F.col("rec_id") % 2 == 0, F.concat(
        F.lit("See ```python\nfor x in range(3): "), F.col("answer_text"), F.lit("\n```"))) \
        .otherwise(F.col("answer_text"))
    answered = b.qa(spark, sf).withColumn("response", fenced) \
        .withColumn("code", code.extract_code(F.col("response")))
    return answered.select("rec_id", mapping.response_markdown(
        F.col("question_text"), F.col("response"), F.col("code")).alias("markdown"))


# Filters ----------------------------------------------------------------------------------------

def f1_valid(spark: SparkSession, sf: str) -> DataFrame:
    rule = filters.is_valid(F.col("question_text"), F.col("answer_text"), F.col("solution_code"))
    return b.docs(spark, sf).select("rec_id", rule.alias("is_valid"))


def f2_has_content(spark: SparkSession, sf: str) -> DataFrame:
    emptied = F.when(F.length("question_text") % 2 == 0, F.lit(" \n\t")).otherwise(F.col("question_text"))
    return b.docs(spark, sf).select("rec_id", filters.has_content(emptied, F.lit("")).alias("has_content"))


def f3_chatter(spark: SparkSession, sf: str) -> DataFrame:
    return b.docs(spark, sf).select("rec_id", filters.has_chatter(F.col("question_text")).alias("chatter"))


def f4_quality(spark: SparkSession, sf: str) -> DataFrame:
    records = b.docs(spark, sf).drop("solution_code").join(
        b.snippets(spark, sf).withColumnRenamed("snippet", "solution_code"), "rec_id")
    return filters.quality_filter(records).select("rec_id", "solution_code")


def f6_gate(spark: SparkSession, sf: str) -> DataFrame:
    gated = streams.gate(streams.classify(b.text_events(spark, sf)))
    return gated.select("event_id", "text", "confidence")


def f8_emitted(spark: SparkSession, sf: str) -> DataFrame:
    found = b.docs(spark, sf).select("rec_id", F.col("question_text").alias("text"))
    return streams.emit_questions(found).select(
        "rec_id", F.round("question_confidence", 6).alias("question_confidence"))


# Joins, duplicates, unions ----------------------------------------------------------------------

def d1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_dedup(b.docs(spark, sf).select("rec_id", "question_text"))


def d2_fuzzy_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return fuzzy.fuzzy_dedup(b.docs(spark, sf).select("rec_id", "question_text"), FUZZY_THRESHOLD)


def j2_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of different word sets, by the first document of each."""
    return setjoin.similar_sets(b.documents(spark, sf))[0]


def j2_jaccard_links(spark: SparkSession, sf: str) -> DataFrame:
    return setjoin.similar_sets(b.documents(spark, sf))[1]


def d4_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.text_events(spark, sf).select("event_id", "user_id", "ts", "event_type")
    return dedup.drop_consecutive(rows, "user_id", "event_type", "ts", "event_id") \
        .select("event_id", "user_id", "event_type")


def u1_union(spark: SparkSession, sf: str) -> DataFrame:
    frames = [
        b.documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text"), F.col("lang")),
        b.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("text"), F.col("role")),
        b.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text")),
    ]
    return dedup.union_all(frames)


def u3_sources(spark: SparkSession, sf: str) -> DataFrame:
    return stats.distinct_sources(b.docs(spark, sf))


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Valid, unique documents: what coverage compares with the inputs."""
    records = b.docs(spark, sf)
    valid = records.filter(filters.is_valid(
        F.col("question_text"), F.col("answer_text"), F.col("solution_code")))
    return dedup.exact_dedup(valid)


def _split_corpus(spark: SparkSession, sf: str) -> DataFrame:
    typed = b.docs(spark, sf).withColumn(
        "question_type", classify.question_type_by_parts(F.col("question_text")))
    return splits.stratified_split(typed.select(
        "rec_id", "source_site", "difficulty", "language", "question_type"))


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    return b.documents(spark, sf).select(
        F.col("source").alias("dataset"), F.lit(1).cast("bigint").alias("entries"),
        F.col("n_chars").alias("length"))


def j1_coverage(spark: SparkSession, sf: str) -> DataFrame:
    table = stats.coverage(_inputs(spark, sf), _corpus(spark, sf).select("source_site"))
    return table.withColumn("coverage_pct", F.round("coverage_pct", 6))


def j4_missing(spark: SparkSession, sf: str) -> DataFrame:
    inputs = b.docs(spark, sf).select("rec_id", "source_site")
    return stats.missing_records(inputs, _corpus(spark, sf))


def j4_digest_missing(spark: SparkSession, sf: str) -> DataFrame:
    """As ``j4_missing``, but only rows of buckets whose digests differ are joined."""
    inputs = b.docs(spark, sf).select("rec_id", "source_site")
    return digests.missing_by_digest(inputs, _corpus(spark, sf))


# Statistics -------------------------------------------------------------------------------------

def a1_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return stats.manifest(_split_corpus(spark, sf))


def a2_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return stats.split_sizes(splits.global_split(b.docs(spark, sf).select("rec_id")))


def a3_split_profile(spark: SparkSession, sf: str) -> DataFrame:
    with_gaps = _split_corpus(spark, sf).withColumn(
        "language", F.when(F.col("difficulty") == "en", F.lit("")))
    return stats.split_profile(with_gaps)


def a4_input_profile(spark: SparkSession, sf: str) -> DataFrame:
    return stats.input_profile(_inputs(spark, sf)).withColumn("size_mib", F.round("size_mib", 6))


def a5_quality(spark: SparkSession, sf: str) -> DataFrame:
    return stats.quality_report(_split_corpus(spark, sf)).withColumn("pct", F.round("pct", 6))


def a6_score(spark: SparkSession, sf: str) -> DataFrame:
    return stats.quality_score(_split_corpus(spark, sf)).withColumn("score", F.round("score", 6))


def a7_summary(spark: SparkSession, sf: str) -> DataFrame:
    per_dataset = _inputs(spark, sf).groupBy("dataset").agg(
        F.lit(1).alias("files"), F.sum("entries").alias("entries"))
    return stats.summary(per_dataset, _split_corpus(spark, sf)) \
        .withColumn("coverage_pct", F.round("coverage_pct", 6)) \
        .withColumn("quality_score", F.round("quality_score", 6))


def a9_top_word(spark: SparkSession, sf: str) -> DataFrame:
    counted = b.docs(spark, sf).withColumn("w", filters.top_word_share(F.col("question_text")))
    return counted.select("rec_id", "w.n_words", "w.top_count", F.round("w.top_share", 6).alias("top_share"))


def a10_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = text.words(F.col("text"))
    confidences = F.transform(tokens, lambda t, i: F.pmod(i * 37, F.lit(100)).cast("double"))
    assembled = b.documents(spark, sf).withColumn("a", stats.assemble_tokens(tokens, confidences, TOKEN_CONFIDENCE))
    return assembled.select(F.col("doc_id").alias("rec_id"), "a.text",
                            F.round("a.confidence", 6).alias("confidence"), "a.n_tokens")


def a11_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.table(spark, sf, "pages").select(F.octet_length("html").alias("length"))
    return inventory.totals(rows)


def a12_rate(spark: SparkSession, sf: str) -> DataFrame:
    facts = stats.rate_statistics(b.text_events(spark, sf), "ts", F.col("event_type") == "error")
    return facts.withColumn("uptime_s", F.round("uptime_s", 6)).withColumn("per_minute", F.round("per_minute", 6))


def a13_latency(spark: SparkSession, sf: str) -> DataFrame:
    """From order to shipment, as from question to response."""
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        "l_shipdate")
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, "o_orderkey").select(
        "o_orderkey", "l_linenumber",
        stats.latency_seconds(F.col("o_orderdate"), F.col("l_shipdate")).alias("seconds"))


QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)


def a13_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Days from order to shipment: a sketch per month and return flag, merged per flag, and whether the ranks
    of the merged quantiles are as near to the wanted ones as the bound says."""
    lines = b.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_shipdate")
    orders = b.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    days = (stats.latency_seconds(F.col("o_orderdate"), F.col("l_shipdate")) / 86_400).cast("bigint")
    rows = lines.join(orders, "o_orderkey").select("l_returnflag", F.trunc("l_shipdate", "month").alias("month"), days.alias("days"))
    sketches = stage(stats.quantile_sketches(rows, F.col("days"), "l_returnflag", "month"), "sketches")
    merged = stage(stats.merged_quantiles(sketches, QUANTILES, "l_returnflag"), "quantiles")
    wanted = merged.select("l_returnflag", "n", F.posexplode("quantiles").alias("i", "value"))
    counted = rows.groupBy("l_returnflag", "days").agg(F.count(F.lit(1)).alias("c")).join(wanted, "l_returnflag")
    ranks = counted.groupBy("l_returnflag", "i", "value", "n").agg(
        F.sum(F.when(F.col("days") < F.col("value"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("days") <= F.col("value"), F.col("c")).otherwise(0)).alias("up_to"))
    target = F.element_at(F.array(*[F.lit(q) for q in QUANTILES]), F.col("i") + 1) * F.col("n")
    slack = F.col("n") * stats.RANK_ERROR
    return ranks.select("l_returnflag", F.col("i").cast("bigint").alias("i"), "n",
                        ((F.col("below") - slack <= target) & (target <= F.col("up_to") + slack)).alias("within"))


# Splits, shards, windows ------------------------------------------------------------------------

def w1_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.stratified_split(b.docs(spark, sf).select("rec_id", "source_site", "difficulty"))


def w2_global_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.global_split(b.docs(spark, sf).select("rec_id"))


def w3_split_order(spark: SparkSession, sf: str) -> DataFrame:
    split = splits.global_split(b.docs(spark, sf).select("rec_id"))
    return splits.exact_rank(split, ["split"], "rec_id", "43").select("rec_id", "split", "rank")


def w4_shards(spark: SparkSession, sf: str) -> DataFrame:
    split = splits.global_split(b.docs(spark, sf).select("rec_id"))
    return splits.assign_shards(split, SHARD_SIZE).select("rec_id", "split", "shard")


def w5_last10(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.text_events(spark, sf).select("event_id", "user_id", "ts", "event_type")
    kept = dedup.drop_consecutive(rows, "user_id", "event_type", "ts", "event_id")
    return splits.last_n_per_key(kept, "user_id", ["ts", "event_id"]).select("event_id", "user_id")


# Generators -------------------------------------------------------------------------------------

def v1_variants(spark: SparkSession, sf: str) -> DataFrame:
    records = b.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("rec_id"), F.col("doc_id").cast("string").alias("problem_id"),
        F.expr("CASE WHEN n_chars % 7 = 0 THEN '' ELSE text END").alias("solution_code"),
        F.expr(b.LANGUAGE).alias("language"),
        F.expr("CASE WHEN n_chars % 5 = 0 THEN 'mcq' ELSE 'coding' END").alias("question_type"),
        F.col("n_chars").cast("int").alias("time_limit"))
    varied = variants.language_variants(records)
    return varied.select("rec_id", "problem_id", "solution_code", "language", "question_type",
                         F.col("time_limit").cast("bigint").alias("time_limit"), "variant_kind")


def v2_rewritten(spark: SparkSession, sf: str) -> DataFrame:
    records = b.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("rec_id"), F.col("doc_id").cast("string").alias("problem_id"),
        F.expr(b.FUNCTION_CODE).alias("solution_code"),
        F.expr("CASE WHEN lang = 'en' THEN 'Python' ELSE lang END").alias("language"),
        F.lit("coding").alias("question_type"))
    return variants.language_variants(records).select("rec_id", "language", "solution_code", "variant_kind")


def length_scorer(prompts: list[str]) -> list[str]:
    """A stand-in for a model: fails on prompts of an odd length."""
    if any(len(p) % 2 for p in prompts):
        raise ValueError("odd prompt")
    return [f"Use ```python\nprint({len(p)})\n```" for p in prompts]


def v3_score_batches(spark: SparkSession, sf: str) -> DataFrame:
    done = scoring.responses(scoring.score_batches(b.qa(spark, sf), length_scorer))
    return done.select("rec_id", "response", "code", "failed")


def v3_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """As ``v3_score_batches``, in batches of like length under a budget."""
    done = scoring.responses(scoring.score_bucketed(b.qa(spark, sf), length_scorer))
    return done.select("rec_id", "response", "code", "failed")


# Files: the tables written out in each format and read back -------------------------------------

def _written(df: DataFrame, label: str, fmt: str, suffix: str, **options: str) -> str:
    """Write a frame as files whose names carry the suffix the readers look for."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write.format(fmt)
    for key, value in options.items():
        writer = writer.option(key, value)
    writer.option("extension", suffix).save(path) if fmt == "csv" else writer.save(path)
    return path


def _fields(records: DataFrame, *names: str) -> DataFrame:
    return readers.good_records(records).select(
        *[mapping.as_text(mapping.field(F.col("record"), n)).alias(n) for n in names])


def s4_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as a CSV file tree by source; entries and rows counted per file, then per source."""
    rows = b.documents(spark, sf).select("source", F.col("doc_id").cast("string"), "text")
    path = scratch_path(spark, "entries")
    rows.write.partitionBy("source").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    files = inventory.exact_entries(spark, path, inventory.list_files(spark, path))
    folder = F.regexp_extract("relative_path", "source=([^/]+)/", 1)
    return files.groupBy(folder.alias("source"), "format").agg(F.sum("entries").alias("entries"))


def s6_csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.documents(spark, sf).select(F.col("doc_id").cast("string"), "text", "lang", "source")
    path = _written(rows, "csv", "csv", "csv", header="true", escape='"', quoteAll="true")
    return _fields(readers.read_csv(spark, path), "doc_id", "text", "lang", "source")


def s7_tsv_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.table(spark, sf, "nation").join(b.table(spark, sf, "customer"),
                                            F.col("n_nationkey") == F.col("c_nationkey")) \
        .select(F.col("c_custkey").cast("string"), "c_name", "n_name")
    path = _written(rows, "tsv", "csv", "tsv", header="true", sep="\t", escape='"')
    return _fields(readers.read_tsv(spark, path), "c_custkey", "c_name", "n_name")


def _lines(df: DataFrame, path: str, extension: str, *folders: str) -> str:
    """Write the texts of column ``value``, which have no line breaks, as files with any suffix."""
    writer = df.write.mode("append").partitionBy(*folders) if folders else df.write.mode("append")
    writer.option("extension", extension).option("quote", "").option("sep", "\u0001") \
        .option("escapeQuotes", False).option("emptyValue", "").csv(path)
    return path


def s8_json_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as JSON arrays of up to 500; both those read as one value and those read as streams."""
    row = F.struct("doc_id", "text", "lang")
    arrays = b.documents(spark, sf).groupBy(F.floor(F.col("doc_id") / 500).alias("part")) \
        .agg(F.to_json(F.collect_list(row)).alias("value")).select("part", "value")
    path = _lines(arrays, scratch_path(spark, "json files"), "json", "part")
    records = readers.read_json(spark, path, json_bytes=1_000_000)
    return _fields(records, "doc_id", "text", "lang")


def _flat(column: str) -> Column:
    return F.translate(F.col(column), "\r\n", "  ")


FILES_A_FOLDER = 1000
# Tasks that write files: many, as a file costs the same whatever its size.
FILE_TASKS = 64
_WRITTEN = "files bigint"


def _file_each(df: DataFrame, path: str, extension: str, id_col: str) -> str:
    """Write column ``value`` as a file for each id, ``<some folder>/<id_col>=<id>.<extension>``.

    Tasks write the files where they end up, some FILES_A_FOLDER in a folder, so that neither a folder nor a
    rename is needed for each. Rows of one id are lines of one file, without blanks around them and without empty ones. On a
    store that only Spark can open the files have a folder each.
    """
    spark, blanks = df.sparkSession, "".join(map(chr, range(33)))
    rows = df.select(id_col, F.coalesce(F.trim("value", F.lit(blanks)), F.lit("")).alias("value"))
    root = inventory.absolute(spark, path)
    if not inventory.listable(root):
        return _lines(rows, path, extension, id_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = (fs.LocalFileSystem(), root) if root.startswith("/") else fs.FileSystem.from_uri(root)
        name, lines, made, files = None, [], None, 0

        def close() -> None:
            nonlocal made, files
            folder, file = name
            if folder != made:
                store.create_dir(f"{base}/part={folder}", recursive=True)
                made = folder
            with store.open_output_stream(f"{base}/part={folder}/{id_col}={file}.{extension}", compression=None) as out:
                out.write("".join(f"{line}\n" for line in lines if line).encode("utf-8", "surrogatepass"))
            files += 1

        for batch in batches:
            for *this, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name is not None and this != name:
                    close()
                    lines = []
                name = this
                lines.append(line)
        if name is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    folder = F.coalesce(F.floor(F.col(id_col) / FILES_A_FOLDER).cast("string"), F.lit("none"))
    file = F.coalesce(F.col(id_col).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    dealt = rows.select(folder.alias("folder"), file.alias("file"), "value").repartition(FILE_TASKS, "folder", "file")
    stage(dealt.sortWithinPartitions("folder", "file").mapInArrow(write, _WRITTEN), "written")
    return path


def _id_of(path: Column, id_col: str) -> Column:
    return F.regexp_extract(path, f"{id_col}=([0-9]+)[./]", 1).cast("bigint").alias(id_col)


def s10_text_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A file per page, its URL as text."""
    rows = b.table(spark, sf, "pages").select("page_id", _flat("url").alias("value"))
    path = _file_each(rows, scratch_path(spark, "text files"), "TXT", "page_id")
    records = readers.good_records(readers.read_text(spark, path))
    return records.select(
        _id_of(F.col("src_path"), "page_id"),
        F.rtrim(mapping.as_text(mapping.field(F.col("record"), "content")), F.lit("\n")).alias("content"))


def s12_html_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A file per page; the texts must be those of the function on the table's column."""
    rows = b.table(spark, sf, "pages").select("page_id", _flat("html").alias("value"))
    path = _file_each(rows, scratch_path(spark, "html files"), "html", "page_id")
    records = readers.good_records(readers.read_html(spark, path))
    return records.select(
        _id_of(F.col("src_path"), "page_id"),
        F.rtrim(mapping.as_text(mapping.field(F.col("record"), "content")), F.lit("\n")).alias("text"))


def s13_xml_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A file per supplier, with a nested element and a repeated one, of which the last counts."""
    value = F.format_string("<r><k>%d</k><name>old</name><name>%s</name><at><nation>%d</nation></at></r>",
                            "s_suppkey", "s_name", "s_nationkey")
    rows = b.table(spark, sf, "supplier").select("s_suppkey", value.alias("value"))
    path = _file_each(rows, scratch_path(spark, "xml files"), "xml", "s_suppkey")
    record = F.col("record")
    return readers.good_records(readers.read_xml(spark, path)).select(
        F.try_variant_get(record, "$.k", "string").alias("k"), F.try_variant_get(record, "$.name", "string").alias("name"),
        F.try_variant_get(record, "$.at.nation", "string").alias("nation"))


def _tree(spark: SparkSession, sf: str) -> str:
    """Suppliers as a tree of files in several formats, one file per nation and format.

    A third of the lines is broken; names hold blanks and upper-case suffixes; one suffix is guessed.
    """
    root = scratch_path(spark, "tree of files")
    rows = b.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").repartition("s_nationkey")
    nation = F.col("s_nationkey").alias("n")
    line = F.to_json(F.struct("s_suppkey", "s_name"))
    broken = F.when(F.col("s_suppkey") % 3 == 0, F.left(line, F.length(line) - 1)).otherwise(line)
    _lines(rows.select(nation, broken.alias("value")), f"{root}/description2code_current/codechef", "JSONL", "n")
    _lines(rows.groupBy(nation).agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("value")), f"{root}/description2code_current/codeforces", "json", "n")
    _lines(rows.select(nation, F.col("s_name").alias("value")), f"{root}/description2code_current/hackerearth", "txt", "n")
    _lines(rows.select(nation, F.col("s_name").alias("value")), f"{root}/notes of all", "md", "n")
    rows.select(nation, "s_suppkey", "s_name").write.partitionBy("n").option("header", True) \
        .option("extension", "CSV").csv(f"{root}/tables")
    rows.select(nation, F.col("s_suppkey").alias("id"), F.col("s_name").alias("text")).write.partitionBy("n") \
        .parquet(f"{root}/columns")
    return root


def _top_folder() -> Column:
    return F.regexp_extract("relative_path", "^(?:description2code_current/)?([^/]+)/", 1).alias("folder")


def s1_inventory(spark: SparkSession, sf: str) -> DataFrame:
    files = inventory.list_files(spark, _tree(spark, sf))
    return files.groupBy(_top_folder(), "format").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("length") > 0).alias("filled"))


def f7_supported(spark: SparkSession, sf: str) -> DataFrame:
    files = inventory.list_files(spark, _tree(spark, sf))
    suffix = text.path_suffix(F.col("path"))
    return inventory.supported_files(files).groupBy(suffix.alias("suffix"), "format") \
        .agg(F.count(F.lit(1)).alias("files"))


def s3_estimates(spark: SparkSession, sf: str) -> DataFrame:
    root = _tree(spark, sf)
    files = inventory.estimated_rows(spark, root, inventory.list_files(spark, root))
    return files.groupBy(_top_folder(), "format").agg(F.sum("estimated_rows").alias("estimated_rows"))


def s4_tree_entries(spark: SparkSession, sf: str) -> DataFrame:
    root = _tree(spark, sf)
    files = inventory.exact_entries(spark, root, inventory.list_files(spark, root))
    return files.groupBy(_top_folder(), "format").agg(F.sum("entries").alias("entries"))


def s5_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Files by dataset; a file that fits several patterns of a dataset counts once."""
    routed = inventory.route_to_datasets(inventory.list_files(spark, _tree(spark, sf)))
    return routed.groupBy("dataset", "format").agg(
        F.count(F.lit(1)).alias("files"), F.countDistinct("path").alias("paths"))


def _archives(spark: SparkSession, sf: str) -> str:
    """The documents in archives of up to 500, by turns zip and tar.gz, each with members of four formats."""
    root = inventory.absolute(spark, scratch_path(spark, "archives"))
    rows = b.documents(spark, sf).select(F.floor(F.col("doc_id") / 500).alias("part"), F.col("doc_id").cast("string"), "text", "lang")

    def pack(part: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        records = frame[["doc_id", "text", "lang"]].astype(object).where(frame[["doc_id", "text", "lang"]].notna(), None)
        turns = [records.iloc[turn::4] for turn in range(4)]
        table = pa.Table.from_pandas(turns[3], preserve_index=False)
        parquet = pa.BufferOutputStream()
        pq.write_table(table.cast(pa.schema([(c, pa.string()) for c in table.column_names])), parquet)
        members = {
            "lines/a.jsonl": turns[0].to_json(orient="records", lines=True, force_ascii=False).encode(),
            "b.CSV": turns[1].to_csv(index=False, quoting=csv.QUOTE_ALL, lineterminator="\n").encode(),
            "c d.json": turns[2].to_json(orient="records", force_ascii=False).encode(),
            "p.parquet": parquet.getvalue().to_pybytes(), "skipped.bin": b"no reader"}
        packed, is_zip = io.BytesIO(), part[0] % 2 == 0
        with zipfile.ZipFile(packed, "w") if is_zip else tarfile.open(fileobj=packed, mode="w:gz") as archive:
            for name, content in members.items():
                if is_zip:
                    archive.writestr(name, content)
                else:
                    info = tarfile.TarInfo(name)
                    info.size = len(content)
                    archive.addfile(info, io.BytesIO(content))
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{part[0]}.{'zip' if is_zip else 'tar.gz'}", compression=None) as out:
            out.write(packed.getvalue())
        return pd.DataFrame({"part": [part[0]]})

    stage(rows.groupBy("part").applyInPandas(pack, "part bigint"), "packed")
    return root


def s15_archives(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in zip and tar.gz archives, read back through the readers of the members' formats."""
    fields = ("doc_id", "text", "lang")
    return _fields(readers.read_archives(spark, _archives(spark, sf), set(fields)), *fields)


def s16_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Records read and rejected by format, over a tree of all formats."""
    records = stage(readers.read_records(spark, _tree(spark, sf)).select("src_path", "format", "src_block", "src_row", "raw", "rec_id",
                                                                      readers.is_good().alias("good")), "tree-records")
    return records.groupBy("format").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("rejected"),
        F.countDistinct("rec_id").alias("ids"))


def s9_jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as lines of JSON; those of one language are cut short and must be rejected."""
    line = F.to_json(F.struct("doc_id", "text", "lang"))
    broken = F.expr("substring(line, 1, length(line) - 1)")
    rows = b.documents(spark, sf).select(line.alias("line"), "lang") \
        .select(F.when(F.col("lang") == "es", broken).otherwise(F.col("line")).alias("value"))
    path = _written(rows, "jsonl", "text", "txt")
    return _fields(readers.read_jsonl(spark, path, suffix="txt"), "doc_id", "text", "lang")


def s11_text_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.documents(spark, sf).select(
        F.col("doc_id").alias("rec_id"), F.col("text").alias("content"), "source")
    problems = mapping.text_problem(rows, "content", F.col("rec_id").cast("string"), F.col("source"))
    return problems.select("rec_id", "question_text", "question_type", "source_site", "problem_id")


def s14_parquet_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.documents(spark, sf).select(F.col("doc_id").alias("id"), "text", "lang", F.col("source").alias("unused"))
    path = _written(rows, "parquet", "parquet", "parquet")
    return _fields(readers.read_parquet(spark, path), "id", "text", "lang")


def s14_parquet_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of Parquet files per source, of two schemas: two scans, however many folders."""
    rows = b.documents(spark, sf).select(F.col("doc_id").alias("id"), "text", "lang", "source").repartition("source")
    path, even = scratch_path(spark, "parquet folders"), F.length("source") % 2 == 0
    rows.filter(even).write.partitionBy("source").parquet(f"{path}/even")
    rows.filter(~even).drop("lang").write.partitionBy("source").parquet(f"{path}/odd")
    found = readers.good_records(readers.read_parquet(spark, path))
    return found.select(*[mapping.as_text(mapping.field(F.col("record"), n)).alias(n) for n in ("id", "text", "lang")],
                        F.regexp_extract("src_path", "source=([^/]+)/", 1).alias("folder"))


def _as_unified(spark: SparkSession, sf: str) -> DataFrame:
    records = b.docs(spark, sf).withColumn("rec_id", F.col("rec_id").cast("string")).withColumns({
        "question_type": F.lit("coding"), "tags": F.array("source_site", "difficulty"),
        "problem_id": F.col("rec_id"), "constraints": F.lit(""),
        "examples": F.array().cast("array<string>"), "test_cases": F.array().cast("array<string>"),
        "time_limit": F.lit(None).cast("int"), "memory_limit": F.length("question_text")})
    return records.select("rec_id", *[f.name for f in UNIFIED])


def _split_rows(rows: DataFrame) -> DataFrame:
    return rows.select("rec_id", "split", "question_text", "source_site", _joined("tags"),
                       F.col("memory_limit").cast("bigint").alias("memory_limit"))


def k1_split_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    writers.write_splits(splits.stratified_split(_as_unified(spark, sf)), path)
    return _split_rows(corpus.read_splits(spark, path))


def k2_shard_files(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    writers.write_shards(splits.global_split(_as_unified(spark, sf)), path, SHARD_SIZE, ("parquet",))
    rows = spark.read.option("recursiveFileLookup", "false").schema(
        "rec_id string, question_text string, split string, shard string").parquet(f"{path}/parquet")
    return rows.select("rec_id", "split", "shard", F.length("question_text").cast("bigint").alias("n_chars"))


def k3_manifest(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    writers.write_manifest(splits.stratified_split(_as_unified(spark, sf)), path, SHARD_SIZE)
    return corpus.read_manifest(spark, path)


# Jobs -------------------------------------------------------------------------------------------

def _consolidated(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, validate, deduplicate, filter and split the documents."""
    records = mapping.once(b.docs(spark, sf), {
        "question_type": classify.question_type(F.col("question_text")),
        "question_text": text.clean_text(F.col("question_text"))})
    valid = records.filter(filters.is_valid(
        F.col("question_text"), F.col("answer_text"), F.col("solution_code")))
    refined = stage(jobs.refine(valid, create_variants=False), "refined")
    return splits.stratified_split(refined)


def z1_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    return stats.manifest(_consolidated(spark, sf))


def z1_records(spark: SparkSession, sf: str) -> DataFrame:
    return _consolidated(spark, sf).select("rec_id", "question_text", "solution_code", "question_type", "split")


def z1_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job on files: documents written as Parquet, consolidated, written and read back."""
    rows = b.documents(spark, sf).select(
        F.col("doc_id").alias("id"), F.col("text").alias("question"), F.col("text").alias("code"))
    path, output = _written(rows, "files", "parquet", "parquet"), scratch_path(spark, "consolidated")
    jobs.consolidate(spark, path, output, ("parquet",), create_variants=False, shard_size=SHARD_SIZE)
    return stats.split_sizes(corpus.read_splits(spark, f"{output}/jsonl"))


def z2_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    records = _records(spark, sf, F.col("text").alias("question"), F.col("doc_id").alias("id")) \
        .withColumn("dataset", F.lit("generic"))
    unified = mapping.normalise_by_dataset(records).select("rec_id", "question_text", "problem_id", "question_type")
    return splits.global_split(unified)


def z3_verification(spark: SparkSession, sf: str) -> DataFrame:
    corpus_rows = stage(_corpus(spark, sf).select("rec_id", "source_site", "difficulty", "language"), "corpus")
    outputs = splits.stratified_split(corpus_rows)
    per_dataset = _inputs(spark, sf).groupBy("dataset").agg(
        F.lit(1).alias("files"), F.sum("entries").alias("entries"))
    return stats.summary(per_dataset, outputs) \
        .withColumn("coverage_pct", F.round("coverage_pct", 6)) \
        .withColumn("quality_score", F.round("quality_score", 6))


def z4_training_items(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "corpus")
    writers.write_splits(splits.stratified_split(_as_unified(spark, sf)), path)
    return training.prepare_training(spark, path).select("rec_id", "split", "text")


# Streams ----------------------------------------------------------------------------------------

def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = b.table(spark, sf, "events").schema
    return streams.read_events(spark, sf, schema, "events.parquet").select(*b.event_columns())


def r1_stream_questions(spark: SparkSession, sf: str) -> DataFrame:
    emitted = streams.emit_questions(_stream(spark, sf)).select("event_id", "text", "is_question")
    return streams.run_to_table(emitted, "questions")


ALL_FILES = (1 << 31) - 1


def _event_parts(spark: SparkSession, sf: str, parts: int = 3) -> list[DataFrame]:
    """The events cut by time, without a time first: each part is to be one micro-batch."""
    events = b.table(spark, sf, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return [events]
    edges = [low + (high - low) * k / parts for k in range(1, parts)]
    part = F.lit(0)
    for edge in edges:
        part = part + F.coalesce((F.col("ts") >= F.lit(edge)).cast("int"), F.lit(0))
    return [events.filter(part == k) for k in range(parts)]


def _consecutive(spark: SparkSession, sf: str) -> tuple[DataFrame, str, DataFrame]:
    path, target = scratch_path(spark, "event-files"), scratch_path(spark, "consecutive")
    for part in _event_parts(spark, sf):
        part.write.mode("append").parquet(path)
        events = streams.read_events(spark, path, part.schema, max_files=ALL_FILES).select("event_id", "user_id", "ts", "event_type")
        table, state = streams.run_consecutive(events, "user_id", "ts", "event_id", "event_type", "consecutive", target=target)
    return table, state, events


def r2_stream_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    table, _, _ = _consecutive(spark, sf)
    return table.select("event_id", "user_id", "event_type", "history_size")


def r2_stream_history(spark: SparkSession, sf: str) -> DataFrame:
    """The last ten kept events of each user, as the stream leaves them."""
    _, state, events = _consecutive(spark, sf)
    schema = events.select("user_id", "event_id", "ts", "event_type").schema
    return streams.read_history(spark, state, schema).select("event_id", "user_id", "event_type")


def _keyed(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    path, target = scratch_path(spark, "event-files"), scratch_path(spark, "keyed")
    for part in _event_parts(spark, sf):
        part.write.mode("append").parquet(path)
        events = streams.read_events(spark, path, part.schema, max_files=ALL_FILES)
        table = keyed.run_into(keyed.keyed_consecutive(events, "user_id", "ts", "event_id", "event_type"), target)
    return table, target


def r2_state(spark: SparkSession, sf: str) -> DataFrame:
    """As ``r2_stream_consecutive``, with the state of each user in a state store."""
    return _keyed(spark, sf)[0].select("event_id", "user_id", "event_type", "history_size")


def r2_state_history(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.keyed_history(spark, _keyed(spark, sf)[1]).select("event_id", "user_id", "event_type")


def r4_stream_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each view with the purchases of the user in the six hours after it, as question and answers.

    When all events are in, a last pair far in the future moves the watermarks past all of them.
    """
    events = b.table(spark, sf, "events")
    path, target = scratch_path(spark, "event-files"), scratch_path(spark, "stream-join")
    end = events.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), (F.min("user_id") - 1).alias("user_id"))
    ends = end.withColumn("event_type", F.explode(F.array(F.lit("view"), F.lit("purchase")))) \
        .withColumns({c: F.lit(None).cast(t) for c, t in events.dtypes if c not in ("ts", "user_id", "event_type")})
    for part in (events, ends.select(*events.columns)):
        part.write.mode("append").parquet(path)
        views, purchases = (streams.read_events(spark, path, events.schema, max_files=ALL_FILES)
                            .filter(F.col("event_type") == kind) for kind in ("view", "purchase"))
        table = keyed.run_into(keyed.join_responses(views, purchases, "user_id", "ts", "6 hours"), target)
    return table.filter("event_id IS NOT NULL").select(
        F.col("key").alias("user_id"), "event_id", "answer_id",
        (F.unix_micros("answered") - F.unix_micros("asked")).alias("micros"))


def a12_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per micro-batch and what waits behind each, in totals, and the counts of the stages."""
    stream = streams.read_events(spark, sf, b.table(spark, sf, "events").schema, "events.parquet", 1).select(*b.event_columns())
    table, progress = keyed.run_with_progress(stream, "progress")
    waits = keyed.backlog(progress, table.count()).agg(F.sum("rows").alias("rows"), F.min("backlog").alias("backlog_end"))
    questions = streams.gate(streams.classify(table))
    good = scoring.responses(scoring.score_batches(questions, length_scorer, "text"), "text").filter("NOT failed")
    return keyed.stage_counts(table, questions, good).unionByName(waits, allowMissingColumns=True) \
        .agg(*(F.max(c).alias(c) for c in ("rows", "backlog_end", "captured", "processed", "generated", "waiting", "unanswered")))


def r6_stream_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """A polling stream that is stopped once all events there are have been committed."""
    gated = _stream(spark, sf).select("event_id", "event_type")
    return streams.run_to_table(gated, "bounded", {"processingTime": "1 second"}, whole=True)


def r3_stream_gate(spark: SparkSession, sf: str) -> DataFrame:
    gated = streams.gate(streams.classify(_stream(spark, sf))).select("event_id", "text", "confidence")
    return streams.run_to_table(gated, "gate")


def r4_stream_responses(spark: SparkSession, sf: str) -> DataFrame:
    questions = streams.gate(streams.classify(_stream(spark, sf))).select("event_id", "text")
    good, failed = streams.run_responses(questions, length_scorer, "responses")
    return good.unionByName(failed).select("event_id", "response", "code", "failed")


def r5_stream_rates(spark: SparkSession, sf: str) -> DataFrame:
    counts = streams.rolling_counts(_stream(spark, sf), "ts", "1 minute", ["event_type"])
    table = streams.run_rolling_counts(counts, "rates", ["event_type"])
    return table.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


def r7_event_ids(spark: SparkSession, sf: str) -> DataFrame:
    keyed = b.text_events(spark, sf).select(streams.event_id("user_id", "ts", "event_id").alias("id"))
    repeated = keyed.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return repeated.agg(F.sum("n").alias("events"), F.count(F.lit(1)).alias("ids"))


QUERIES = {name: fn for name, fn in list(globals().items())
           if name[0] in "acdfjkmqrsuvwxz" and name[1:2].isdigit() and callable(fn)}
