"""How the given tables stand in for corpus records, files and text events.

The expressions are SQL that Spark and the reference database read alike. They decorate every row's
own text with code fences, markers and key phrases, since the tables hold plain prose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

NL = "chr(10)"
FENCE = "'```'"

# Text with fences, language markers, markup and loops, depending on its length.
SNIPPET = f"""CASE n_chars % 6
  WHEN 0 THEN text
  WHEN 1 THEN 'Answer:' || {NL} || '```python' || {NL} || text || {NL} || '``` and ```x```'
  WHEN 2 THEN '```javascript ' || text || '```'
  WHEN 3 THEN '# python' || {NL} || text || {NL} || {NL} || '# java' || {NL}
              || 'for i in range(n): for j in range(n): x.sort() ' || text
  WHEN 4 THEN '``` ' || text || ' while x: for y in range(3)'
  ELSE '<p>def f(x): return [x] # list ' || text || '</p> &amp;&#233;&eacute; ```cpp' || {NL} || 'x```'
END"""

# Text with a phrase that decides the question type.
PHRASED = """text || ' ' || CASE n_chars % 9
  WHEN 0 THEN 'Select one' WHEN 1 THEN 'a)foo' WHEN 2 THEN 'a) foo' WHEN 3 THEN 'Implement é'
  WHEN 4 THEN 'x__' WHEN 5 THEN ' __ ' WHEN 6 THEN 'debug' WHEN 7 THEN 'éfix time complexity'
  ELSE 'functions' END"""

LANGUAGE = """CASE lang WHEN 'en' THEN 'Python3' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'c++'
  ELSE '' END"""

SITE_PATH = """'/data/' || source || '/' || CASE lang WHEN 'en' THEN 'LeetCode-data/' WHEN 'fr' THEN 'mbpp-data/'
  WHEN 'de' THEN 'code_contests-data/' ELSE 'misc/' END || doc_id"""

FUNCTION_CODE = f"""'def f' || doc_id || '(a, b):' || {NL} || '    c = a' || {NL} || '    return a + ' || n_chars || {NL}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus records."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("rec_id"), F.col("text").alias("question_text"),
        F.lit("").alias("answer_text"), F.col("text").alias("solution_code"),
        F.lit("").alias("language"), F.col("source").alias("source_site"),
        F.col("lang").alias("difficulty"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("rec_id"), F.expr(SNIPPET).alias("snippet"))


def phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").alias("rec_id"), F.expr(PHRASED).alias("phrase"))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it. Turns are unique, so the join has no hot key."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question_text"))
    reply = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer_text"))
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("rec_id"), "question_text", "answer_text")


def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captured texts; every third part of the confidence scale is used."""
    return table(spark, sf_dir, "events").select(*event_columns())


def event_columns() -> list:
    return [
        F.col("event_id"), F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type"), F.expr(EVENT_TEXT).alias("text"),
        F.expr("CAST(event_id % 100 AS DOUBLE)").alias("confidence")]


EVENT_TEXT = "'Write a function for ' || event_type || ' ' || props"
