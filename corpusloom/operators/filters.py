"""Row predicates. Each returns a Column, so that it serves batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.code import primary_solution
from ..functions.text import let, strip, words

MIN_STRIPPED, MIN_LENGTH, MAX_LENGTH = 10, 20, 50_000
CHATTER_WORDS, CHATTER_SHARE = 10, 0.2
TRAIN_MIN, TRAIN_MAX, TRAIN_CODE = 50, 2000, 20
GATE_CONFIDENCE, GATE_MIN, GATE_MAX = 70.0, 20, 2000


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def is_valid(question: Column, answer: Column, code: Column) -> Column:
    """A question of reasonable length that comes with an answer or code."""
    return (
        F.coalesce(F.length(question).between(MIN_LENGTH, MAX_LENGTH)
                   & (F.length(strip(question)) >= MIN_STRIPPED), F.lit(False))
        & (_filled(answer) | _filled(code))
    )


def has_content(question: Column, code: Column) -> Column:
    """Question or code is not blank."""
    return _filled(strip(question)) | _filled(strip(code))


def has_chatter(text: Column, min_words: int = CHATTER_WORDS, share: float = CHATTER_SHARE) -> Column:
    """One word makes up more than ``share`` of at least ``min_words`` words.

    In the sorted word list a run of ``need`` equal words covers a position that is a multiple of
    ``need``, so only a handful of positions (1 / share) are looked at, not every word.
    """
    def check(ordered: Column) -> Column:
        n = F.size(ordered)
        need = F.floor(n.cast("double") * F.lit(share)).cast("int") + 1

        def long_run(position: Column) -> Column:
            word = F.element_at(ordered, position)
            last = F.array_position(ordered, word).cast("int") + need - 1
            return (last <= n) & (F.element_at(ordered, F.least(last, n)) == word)

        return (n >= min_words) & F.exists(F.sequence(F.least(need, n), n, need), long_run)

    return F.when(F.coalesce(strip(text), F.lit("")) == "", F.lit(False)) \
        .otherwise(let(F.sort_array(words(text)), check))


def top_word_share(text: Column) -> Column:
    """Struct of word count, count of the most frequent word, and its share."""
    def runs(ordered: Column) -> Column:
        start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best"))

        def step(acc: Column, word: Column) -> Column:
            run = F.when(word == acc["word"], acc["run"] + 1).otherwise(F.lit(1))
            return F.struct(word.alias("word"), run.alias("run"),
                            F.greatest(acc["best"], run).alias("best"))

        n = F.size(ordered).cast("bigint")
        best = F.aggregate(ordered, start, step)["best"].cast("bigint")
        share = F.when(n > 0, best.cast("double") / F.nullif(n, F.lit(0)).cast("double")) \
            .otherwise(F.lit(0.0))
        return F.struct(n.alias("n_words"), best.alias("top_count"), share.alias("top_share"))

    return let(F.sort_array(words(F.coalesce(text, F.lit("")))), runs)


def quality_filter(df: DataFrame, question: str = "question_text", code: str = "solution_code",
                   markers_only: bool = False) -> DataFrame:
    """Drop chatter, and keep only the primary solution of the rest."""
    kept = df.filter(~has_chatter(F.col(question)))
    return kept.withColumn(code, F.when(_filled(F.col(code)), primary_solution(F.col(code), markers_only))
                           .otherwise(F.col(code)))


def is_trainable(question: Column, code: Column) -> Column:
    """Length limits of a training item, on stripped texts."""
    return F.length(strip(question)).between(TRAIN_MIN, TRAIN_MAX) \
        & (F.length(strip(code)) >= TRAIN_CODE)


def passes_gate(text: Column, confidence: Column, is_question: Column,
                min_confidence: float = GATE_CONFIDENCE) -> Column:
    """Confident questions of an accepted length."""
    return (confidence >= min_confidence) & is_question & F.length(text).between(GATE_MIN, GATE_MAX)


def is_emitted(text: Column, is_question: Column) -> Column:
    """Non-empty texts that are questions."""
    return _filled(text) & is_question


def is_supported(fmt: Column, formats: tuple[str, ...]) -> Column:
    return fmt.isin(*formats)
