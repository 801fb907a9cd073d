"""Batch scoring of prompts with a function the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.code import extract_code
from .mapping import prompt, response_markdown

# Fixed value: the response of a row whose scoring failed.
FAILURE = "Error: Could not generate response"


def score_batches(df: DataFrame, scorer: Callable[[list[str]], list[str]], question: str = "question_text",
                  batch_size: int = 4) -> DataFrame:
    """Add ``prompt``, ``response`` and ``failed``; rows go to the scorer in small batches.

    A batch that fails is retried row by row, so that one bad row costs only itself.
    """
    prompted = df.withColumn("prompt", prompt(F.col(question)))
    schema = T.StructType(prompted.schema.fields + [
        T.StructField("response", T.StringType()), T.StructField("failed", T.BooleanType())])

    def one_by_one(prompts: list[str]) -> list[str | None]:
        answers: list[str | None] = []
        for text in prompts:
            try:
                answers.extend(scorer([text]))
            except Exception:
                answers.append(None)
        return answers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers: list[str | None] = []
            prompts = frame["prompt"].tolist()
            for start in range(0, len(prompts), batch_size):
                batch = prompts[start:start + batch_size]
                try:
                    answers.extend(scorer(batch))
                except Exception:
                    answers.extend(one_by_one(batch))
            failed = [a is None for a in answers]
            yield frame.assign(response=[FAILURE if a is None else a for a in answers], failed=failed)

    return prompted.mapInPandas(run, schema)


def score_bucketed(df: DataFrame, scorer: Callable[[list[str]], list[str]], question: str = "question_text",
                   budget: int = 8192, partitions: int | None = None) -> DataFrame:
    """As ``score_batches``, in batches of prompts of like length.

    Rows are range-partitioned and sorted by prompt length, ties spread by hash, so that a scorer that pads
    its batch to the longest prompt pads little. A batch takes rows while their number times the longest
    length is at most ``budget`` (a longer prompt is a batch by itself). A batch that fails is halved until
    the bad rows stand alone: one bad row among n costs about 2 log2(n) calls instead of n.
    """
    prompted = df.withColumn("prompt", prompt(F.col(question)))
    schema = T.StructType(prompted.schema.fields + [
        T.StructField("response", T.StringType()), T.StructField("failed", T.BooleanType())])
    length = F.coalesce(F.length("prompt"), F.lit(0))
    tasks = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = prompted.repartitionByRange(tasks, length, F.xxhash64("prompt")).sortWithinPartitions(length)

    def scored(prompts: list[str]) -> list[str | None]:
        try:
            answers = list(scorer(prompts))
            if len(answers) == len(prompts):
                return answers
        except Exception:
            pass
        if len(prompts) == 1:
            return [None]
        half = len(prompts) // 2
        return scored(prompts[:half]) + scored(prompts[half:])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts, answers, first = frame["prompt"].tolist(), [], 0
            for last in range(1, len(prompts) + 1):
                # Sorted by length, so the next prompt is the longest of the batch that it would join.
                if last == len(prompts) or (last - first + 1) * len(prompts[last] or "") > budget:
                    answers.extend(scored(prompts[first:last]))
                    first = last
            failed = [a is None for a in answers]
            yield frame.assign(response=[FAILURE if a is None else a for a in answers], failed=failed)

    return placed.mapInPandas(run, schema)


def responses(scored: DataFrame, question: str = "question_text") -> DataFrame:
    """Code and markdown of each response."""
    return scored.withColumn("code", extract_code(F.col("response"))).withColumn(
        "formatted_response", response_markdown(F.col(question), F.col("response"), F.col("code")))
