"""One query per operator over the given tables, and the SQL each must equal where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    bpe, crossparse, decontam, forest, lattice, propagation, runs, substring, supervision, topk, trie,
    urlfilter, warczstd)
from .common import read
from .oracle import ORACLE  # noqa: F401

PIECE_FILE = "piece_bpe_32k.model"
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = substring.without_repeats(read(spark, sf, "documents"), outputs=("kept_words",))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


def op2_subword_lattice(spark: SparkSession, sf: str) -> DataFrame:
    weights = lattice.vocabulary(public_tokenizers.path(PIECE_FILE))
    return lattice.score_documents(read(spark, sf, "documents"), weights)


def op3_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path(RANK_FILE))
    coded = bpe.round_trip(read(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_lsh_forest(spark: SparkSession, sf: str) -> DataFrame:
    return forest.component_table(read(spark, sf, "documents"), shingle=2)


def op5_cross_parsing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    labelled = crossparse.learn(docs, ~crossparse.held_out())
    found = crossparse.identify(docs, labelled)
    return found.select("doc_id", crossparse.held_out().alias("held_out"), "lang_pred", "score")


def op6_weak_supervision(spark: SparkSession, sf: str) -> DataFrame:
    judged = supervision.judge_quality(read(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "quality")


def op7_label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    placed = propagation.assign_shards(read(spark, sf, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op8_warc_zstd(spark: SparkSession, sf: str) -> DataFrame:
    folder = warczstd.new_folder(spark)
    manifest = warczstd.write_archives(read(spark, sf, "pages"), folder)
    return warczstd.read_archives(manifest, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urlfilter.judge_urls(read(spark, sf, "pages"))


def op11_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(read(spark, sf, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie.prefix_trie(read(spark, sf, "conversations"))


def _planted(text: Column, doc_id: Column) -> Column:
    """With h the crc32 of the id: where h ends in 0, the words from some place on repeat with some period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def again(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        rest = F.transform(F.sequence(a, n - F.lit(1).cast("bigint")), lambda i: F.get(w, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), rest), " ")).otherwise("")

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), again)[0]).otherwise(text)


def op13_basic_factor_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", _planted(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.periodic_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.less")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.less")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_subword_lattice, op3_bpe_round_trip, op4_lsh_forest, op5_cross_parsing,
    op6_weak_supervision, op7_label_propagation, op8_warc_zstd, op9_decontamination, op10_url_filter, op11_top_k,
    op12_prefix_trie, op13_basic_factor_runs)}
