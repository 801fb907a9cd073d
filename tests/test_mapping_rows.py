"""The mapping as a table against the mapping tables of the plan."""

from pyspark.sql import functions as F

from corpusloom.operators import mapping
from corpusloom.schema import FIELD_CANDIDATES, UNIFIED

TARGETS = [f.name for f in UNIFIED if f.name != "source_site"]
RAWS = [
    '{"question": "q", "text": "t", "answer": 0, "explanation": "e", "tags": "a, b", "time": "7", "examples": [1, {"k": 2}]}',
    '{"content": "", "description": "d", "solution": {"python": "p", "java": ""}, "id": 5, "tags": ["x", "y"]}',
    '{"description": null, "code": "c", "rating": 900, "index": "A"}', '{}', '[1]', "broken",
]


def _records(spark, sources):
    rows = [(f"{s}-{i}", s, raw) for s in sources for i, raw in enumerate(RAWS)]
    return spark.createDataFrame(rows, "rec_id string, source_site string, raw string") \
        .withColumn("record", F.try_parse_json("raw"))


def _values(df):
    return {r.rec_id: tuple(r[t] for t in TARGETS) for r in df.select("rec_id", *TARGETS).collect()}


def test_rows_equal_the_tables(spark):
    sources = ["unknown", "codeforces", "codechef", "leetcode", None, "no such source"]
    records = _records(spark, sources)
    got = _values(mapping.map_by_rows(records, mapping.mapping_rows(spark)))
    members = F.try_variant_get("record", "$", "map<string,variant>")
    want = _values(records.withColumn("_m", members).select("rec_id", *[
        mapping._mapped(F.col("_m"), F.col("raw"), F.col("source_site"), t, FIELD_CANDIDATES).alias(t) for t in TARGETS]))
    assert got == want and len(got) == len(sources) * len(RAWS)
    assert got["unknown-0"][:3] == ("q", "e", None) and got["None-0"] == got["no such source-0"] == (None,) * len(TARGETS)


def test_a_present_key_may_count_whatever_its_value(spark):
    rows = spark.createDataFrame(
        [("s", "question_text", 0, "description", True), ("s", "question_text", 1, "code", None), ("s", "question_text", 1, "code", None),
         ("s", "no such target", 0, "code", False), ("s", None, 0, "code", False), (None, "question_text", 0, "code", False),
         ("s", "answer_text", 0, None, False)], mapping.mapping_rows(spark).schema)
    got = _values(mapping.map_by_rows(_records(spark, ["s"]).withColumn("answer_text", F.lit("old")), rows))
    assert [got[f"s-{i}"][0] for i in range(6)] == [None, "d", None, None, None, None]
    assert {v[1] for v in got.values()} == {None}


def test_a_thousand_sources_are_one_plan(spark):
    def plan(n):
        rows = spark.range(n).selectExpr("concat('s', id) AS source", "'question_text' AS target", "0 AS place",
                                         "concat('f', id) AS field", "false AS always")
        records = spark.range(2 * n).selectExpr("cast(id AS string) AS rec_id", f"concat('s', id % {n}) AS source_site",
                                                f"concat('{{\"f', id % {n}, '\": \"', id, '\"}}') AS raw") \
            .withColumn("record", F.try_parse_json("raw"))
        mapped = mapping.map_by_rows(records, rows)
        assert mapped.filter("question_text = rec_id").count() == 2 * n
        return mapped._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(1000) == plan(2)


def test_no_rows_and_no_records(spark):
    records = _records(spark, ["unknown"])
    assert {v for v in _values(mapping.map_by_rows(records, mapping.mapping_rows(spark).limit(0))).values()} == {(None,) * len(TARGETS)}
    assert mapping.map_by_rows(records.limit(0), mapping.mapping_rows(spark)).count() == 0
