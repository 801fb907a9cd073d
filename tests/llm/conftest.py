import pytest

from pyspark.sql import types as T

SCHEMA = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string") \
    .add("source", "string").add("n_chars", "long")


@pytest.fixture(name="docs")
def docs_fixture(spark):
    """Documents from (id, text) or (id, text, lang) rows."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make
