"""Code extraction and heuristics, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import SPACE, WORD, let, strip

FENCE = r"(?s)```(.*?)```"
MARKER = f"#[{SPACE}]*[{WORD}]+"
MARKER_LINE = r"(?m)^# (?:Language )?[\p{L}\p{N}_+]+$"
# A first line that starts so is a language name.
FENCE_LANGUAGES = ("python", "cpp", "java")


def extract_code(text: Column) -> Column:
    """Content of the first closed fence without its language line; else the whole text."""
    def inner(code: Column) -> Column:
        named = F.startswith(code, F.lit(FENCE_LANGUAGES[0]))
        for name in FENCE_LANGUAGES[1:]:
            named = named | F.startswith(code, F.lit(name))
        cut = F.instr(code, "\n")
        return F.when(named & (cut > 0), F.substring(code, cut + 1, F.length(code))).otherwise(code)

    fenced = F.contains(text, F.lit("```")) & F.rlike(text, F.lit(FENCE))
    return F.when(fenced, let(strip(F.regexp_extract(text, FENCE, 1)), inner)).otherwise(text)


def longest(parts: Column) -> Column:
    """Longest element, the first one on ties."""
    return F.reduce(parts, F.lit(""), lambda best, part: F.when(
        F.length(part) > F.length(best), part).otherwise(best))


def primary_solution(code: Column, markers_only: bool = False) -> Column:
    """Longest part between ``# word`` markers, stripped.

    Ordinary comments count as markers too; ``markers_only`` splits at language headers alone.
    """
    pattern = MARKER_LINE if markers_only else MARKER
    return F.when(F.contains(code, F.lit("#")), strip(longest(F.split(code, pattern)))) \
        .otherwise(strip(code))


def time_complexity(lowered: Column) -> Column:
    first = F.instr(lowered, "for")
    again = F.contains(F.substring(lowered, first + 3, F.length(lowered)), F.lit("for"))
    loops = F.contains(lowered, F.lit("for")) & F.contains(lowered, F.lit("range"))
    return (
        F.when(F.contains(lowered, F.lit("while")), F.lit("O(n)"))
        .when(F.contains(lowered, F.lit("sort")), F.lit("O(n log n)"))
        .when(loops & again, F.lit("O(n²)"))
        .otherwise(F.lit("O(n)"))
    )


def space_complexity(lowered: Column) -> Column:
    has = lambda part: F.contains(lowered, F.lit(part))
    linear = has("append") | has("list") | has("recursion") | (has("def") & has("return"))
    return F.when(linear, F.lit("O(n)")).otherwise(F.lit("O(1)"))


def complexity_note(code: Column) -> Column:
    """Two-line note on time and space; empty for empty code."""
    note = let(F.lower(code), lambda low: F.concat(
        F.lit("Time Complexity: "), time_complexity(low),
        F.lit("\nSpace Complexity: "), space_complexity(low)))
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit("")).otherwise(note)
