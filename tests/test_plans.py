"""Physical plans: what must and what must not be in them."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, filters, splits, stats
from corpusloom.queries import catalog
from corpusloom.sinks import writers

SF = "/root/testdata/sf0.001"
NATIVE = [n for n in catalog.QUERIES if n[0] in "acfjmqwx" or n in ("d1_exact_dedup", "d4_consecutive", "u1_union")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_operators_have_no_python_and_no_product(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert not re.search("EvalPython|InPandas|InArrow|CartesianProduct", text)


def test_exact_dedup_reduces_before_the_shuffle(spark):
    df = catalog.b.docs(spark, SF)
    text = plan(dedup.exact_dedup(df))
    assert re.search(r"WindowGroupLimit .*Partial", text) and text.count("Exchange hashpartitioning") == 1


def test_last_rows_per_key_reduce_before_the_shuffle(spark):
    df = catalog.b.text_events(spark, SF)
    assert re.search(r"WindowGroupLimit .*Partial", plan(splits.last_n_per_key(df, "user_id", ["ts"])))


def test_splits_do_not_shuffle_the_rows(spark):
    df = catalog.b.docs(spark, SF)
    text = plan(splits.stratified_split(df))
    assert "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_scan_reads_only_the_columns_it_needs(spark):
    text = plan(splits.stratified_split(catalog.b.docs(spark, SF).select("rec_id", "source_site", "difficulty")))
    assert "text:string" not in text


def test_filters_need_no_shuffle(spark):
    df = catalog.b.docs(spark, SF)
    assert "Exchange" not in plan(filters.quality_filter(df))


def test_manifest_is_one_pass(spark):
    df = catalog.b.docs(spark, SF).withColumns({"split": F.lit("train"), "question_type": F.lit("coding")})
    text = plan(stats.manifest(df))
    assert text.count("FileScan") == 1 and "Expand" in text


def test_shards_shuffle_the_rows_once(spark):
    df = catalog.b.docs(spark, SF).select(F.col("rec_id").cast("string").alias("rec_id"), "question_text",
                                          F.lit("train").alias("split"))
    text = plan(writers.with_shards(df, 100))
    with_text = [line for line in text.splitlines() if "Exchange" in line]
    assert sum("rangepartitioning" in line for line in with_text) == 1


def test_cleaning_is_not_repeated_by_filters(spark):
    from corpusloom.operators import mapping
    df = mapping.once(catalog.b.docs(spark, SF), {"question_text": F.regexp_replace("question_text", "zz+", "")})
    text = plan(df.filter(F.length("question_text") > 20))
    assert text.count("regexp_replace") == 1
