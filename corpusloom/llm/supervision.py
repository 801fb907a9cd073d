"""Quality by weak supervision: rules vote or abstain, EM estimates how far to trust each rule.

All text work is built-in expressions. The rules' votes are counted per pattern, of which there are at
most three to the power of the number of rules; EM runs on those counts. A document's posterior is then
a sum of one weight per vote.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.mapping import once
from .common import stage_compact

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def text_counts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Counts of each whole text; a null text counts as empty.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (words inside
    three-word windows that the text holds twice or more), ``n_lines`` (with a word), ``n_letters``,
    ``n_upper``, ``n_digits``, ``n_calls`` (exclamation marks). Repeats are found by sorting a text's windows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(text.alias("__text"), *[docs[c].alias(f"__{i}") for i, c in enumerate(keep)])
    names = [f"__{i}" for i in range(len(keep))]
    split = once(plain, {
        "words": F.filter(F.split("__text", SPACE), lambda w: w != ""),
        "lines": F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))})
    counted = split.select(
        *names, "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.regexp_count("__text", F.lit(r"\p{L}")).cast("bigint").alias("n_letters"),
        F.regexp_count("__text", F.lit("[0-9]")).cast("bigint").alias("n_digits"),
        F.regexp_count("__text", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count("__text", F.lit("!")).cast("bigint").alias("n_calls"))
    rest = [c for c in counted.columns if c != "words"]
    windows = once(counted, {"windows": F.when(
        F.col("n_words") >= 3,
        F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size("words") - 3),
            lambda i: F.struct(
                F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"),
                i.alias("at")))))}).select(*rest, "windows")

    def beside(window: Column, i: Column, step: int) -> Column:
        return F.coalesce(F.get("windows", i + step)["w"] == window["w"], F.lit(False))

    repeated = once(windows, {"places": F.sort_array(F.transform(
        F.filter("windows", lambda w, i: beside(w, i, -1) | beside(w, i, 1)), lambda w: w["at"]))})
    covered = F.aggregate(
        F.transform("places", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - at, F.lit(3)))),
        F.lit(0), lambda total, n: total + n)
    return repeated.select(*rest, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words")) \
        .withColumnsRenamed({f"__{i}": c for i, c in enumerate(keep)})


@dataclass(frozen=True)
class Rule:
    """Votes good, bad or abstains (neither condition holds; a null condition does not hold)."""
    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        """2 good, 0 bad, 1 abstains. Bad goes first where both hold."""
        return F.when(self.bad, 0).when(self.good, 2).otherwise(1).alias(self.name)


def default_rules() -> list[Rule]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    length = F.col("word_chars") / words
    symbols, digits = F.col("n_symbols") / words, F.col("n_digits") / chars
    marks = (F.col("word_chars") - F.col("n_letters") - F.col("n_digits")) / chars
    calls = F.col("n_calls") / words
    upper = F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))
    copies, repeats = F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words
    return [
        Rule("word_length", (length >= 3) & (length <= 9), (length < 2) | (length > 14)),
        Rule("few_symbols", symbols <= 0.02, symbols > 0.1),
        Rule("few_digits", digits <= 0.05, digits > 0.5),
        Rule("few_marks", marks <= 0.08, marks > 0.12),
        Rule("small_letters", upper <= 0.15, upper > 0.3),
        Rule("calm", calls <= 0.02, calls > 0.2),
        Rule("new_lines", copies <= 0.05, copies > 0.2),
        Rule("new_words", repeats <= 0.1, repeats > 0.3),
    ]


@dataclass(frozen=True)
class Trust:
    """Prior log odds of good quality, and per rule the log odds that a bad and a good vote add."""
    prior: float
    weights: list[tuple[float, float]]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(self.prior)
        for vote, (bad, good) in zip(votes, self.weights, strict=True):
            odds = odds + F.when(vote == 0, bad).when(vote == 2, good).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 50, good_share: float = 0.85,
             good_on_good: float = 0.97, good_on_bad: float = 0.6, belief: float = 0.01) -> Trust:
    """EM over counted vote patterns.

    Each rule has the chance to vote good on a good and on a bad document, given that it votes. A rule
    looks for one kind of fault, so most votes on a bad document are good too: that is where EM starts.
    Pseudo-votes worth ``belief`` of all documents (and at least ten) hold the chances and the share of
    good documents near the start, which keeps the two classes from changing places.
    """
    total = sum(n for _, n in patterns)
    pseudo = max(10.0, belief * total)
    share, on_good, on_bad = good_share, [good_on_good] * n_rules, [good_on_bad] * n_rules

    def weights() -> tuple[float, list[tuple[float, float]]]:
        return math.log(share / (1 - share)), [
            (math.log((1 - g) / (1 - b)), math.log(g / b)) for g, b in zip(on_good, on_bad, strict=True)]

    for _ in range(rounds):
        prior, add = weights()
        good = bad = 0.0
        seen = [[0.0, 0.0, 0.0, 0.0] for _ in range(n_rules)]  # good votes and votes, of good and of bad
        for votes, n in patterns:
            odds = prior + sum(add[j][v // 2] for j, v in enumerate(votes) if v != 1)
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good, bad = good + n * p, bad + n * (1 - p)
            for j, v in enumerate(votes):
                if v != 1:
                    seen[j][0] += n * p * (v == 2)
                    seen[j][1] += n * p
                    seen[j][2] += n * (1 - p) * (v == 2)
                    seen[j][3] += n * (1 - p)
        share = (good + pseudo * good_share) / (good + bad + pseudo)
        on_good = [(s[0] + pseudo * good_on_good) / (s[1] + pseudo) for s in seen]
        on_bad = [(s[2] + pseudo * good_on_bad) / (s[3] + pseudo) for s in seen]
    prior, add = weights()
    return Trust(prior, add)


def vote_patterns(counts: DataFrame, rules: list[Rule]) -> list[tuple[tuple[int, ...], int]]:
    """How many documents give each pattern of votes: at most 3 ** len(rules) rows."""
    names = [rule.name for rule in rules]
    rows = counts.select(*[rule.vote() for rule in rules]).groupBy(*names).count().collect()
    return sorted((tuple(r[name] for name in names), r["count"]) for r in rows)


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """Counts of each text, the base rule, the posterior ``quality`` and whether the document is kept.

    One row per input row. ``base_failed``: under 50 words, or more than half of the words repeated.
    ``kept``: false where the base rule fails, else whether the posterior reaches ``threshold``. A null
    or empty text has no words and fails. The texts are read once: their counts are staged, the votes
    counted from there.
    """
    rules = rules or default_rules()
    counts = stage_compact(text_counts(docs, text_col, [id_col]), "text-counts")
    trust = estimate(vote_patterns(counts, rules), len(rules))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = counts.withColumn("quality", trust.posterior([rule.vote() for rule in rules])) \
        .withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
