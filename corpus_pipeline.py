"""The training-corpus pipeline: language ID, near duplicates, repeated passages, benchmark passages, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns they were given. Rows without text or with other gaps pass as each stage
says; columns other than ``doc_id``, ``text``, ``lang`` and ``n_chars`` are carried along, whatever their
names. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import bpe, crossparse, decontam, forest, substring
from corpusloom.llm.common import read, row_key, stage_compact
from corpusloom.session import ship_code

RANK_FILE = "byte_bpe_multi_50k.tiktoken"

ORACLE_SQL = None  # no stage but the fourth can be said in SQL; tests hold them against plain versions


class _Named:
    """Documents under column names by position, so that no name can clash, and the way back."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.columns = [f"c{i}" for i in range(len(self.names))]
        self.docs = docs.toDF(*self.columns)
        self.id, self.text = self["doc_id"], self["text"]

    def __getitem__(self, name: str) -> str:
        return self.columns[self.names.index(name)]

    def back(self, docs: DataFrame) -> DataFrame:
        return docs.select(*self.columns).toDF(*self.names)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are no language: a null text or one without a letter (``und``)."""
    ship_code(spark)
    named = _Named(docs)
    labelled = crossparse.learn(named.docs, ~crossparse.held_out(named.id), named.id, named.text, named["lang"])
    if not labelled:  # nothing to tell languages by
        return named.back(named.docs.filter(crossparse.has_letter(F.col(named.text))))
    found = crossparse.identify(named.docs, labelled, named.id, named.text, keep=named.columns)
    return named.back(found.filter("lang_pred != 'und'"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five words, 0.8).

    Documents without words are linked with nothing and stay. Of rows that agree in id and text, or have no
    id and the same text, one stays.
    """
    ship_code(spark)
    named = _Named(docs)
    keyed = named.docs.withColumns(
        {"oid": forest.node_id(named.id, named.text), "key": row_key(named.id, named.text)})
    dropped = forest.near_duplicates(named.docs, id_col=named.id, text_col=named.text) \
        .filter("oid != component").select("oid", "key")
    kept = forest.without(keyed, stage_compact(dropped, "near-duplicates"))
    return named.back(forest.one_of_each(kept, named.text))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words inside repeated windows out of the text; ``n_chars`` follows where it changes.

    A document of which nothing is left goes. Texts without repeats stay as they are, null texts too.
    """
    ship_code(spark)
    named = _Named(docs)
    kept = substring.without_repeats(named.docs, id_col=named.id, text_col=named.text, keep=named.columns,
                                     outputs=("kept_text",)).filter("n_words = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    new = {named.text: F.when(changed, F.col("kept_text")).otherwise(F.col(named.text))}
    if "n_chars" in docs.columns:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        new[named["n_chars"]] = F.when(changed, length).otherwise(F.col(named["n_chars"]))
    return named.back(kept.withColumns(new))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    ship_code(spark)
    named = _Named(docs)
    found = decontam.contamination(named.docs, read(spark, sf_dir, "benchmark"), id_col=named.id,
                                   text_col=named.text, keep=named.columns)
    return named.back(found.filter("n_hit = 0"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of the ids and of the text they decode to."""
    ship_code(spark)
    ranks = bpe.load_ranks(public_tokenizers.path(RANK_FILE))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage_compact(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
