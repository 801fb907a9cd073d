"""Question typing and question detection, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import WORD, let

# Words per question type, in the order the types are tried.
TYPE_WORDS: dict[str, tuple[str, ...]] = {
    "mcq": ("multiple choice", "select", "choose", "option"),
    "coding": ("implement", "write", "function", "class", "algorithm", "code", "program"),
    "fill_blank": ("fill", "blank", "_____", "___", "__"),
    "debug": ("debug", "fix", "error", "bug", "correct"),
    "optimize": ("optimize", "efficient", "performance", "time complexity"),
}
# A letter and a bracket directly before a word also mean multiple choice.
CHOICE_MARKS = ("a)", "b)", "c)", "d)")
CHOICE_PATTERN = f"(^|[^{WORD}])[abcd]\\)[{WORD}]"
# Parts of words that mean coding when no type matched.
CODING_PARTS = ("function", "class", "algorithm", "implement")

# Parts of words per question type for the glob-routed profile; coding is the default.
TYPE_PARTS: dict[str, tuple[str, ...]] = {
    "coding": ("implement", "write", "function", "class"),
    "mcq": ("multiple choice", "select", "choose"),
    "fill_blank": ("fill", "blank", "_____"),
    "debug": ("debug", "fix", "error"),
}

# Keywords of a question, and of code (lower case; a word may be in both lists).
QUESTION_KEYWORDS = (
    "problem", "question", "task", "challenge", "write", "implement", "function", "algorithm",
    "program", "code", "solution", "find", "calculate", "determine", "compute", "solve", "given",
    "input", "output", "return", "print", "array", "string", "integer", "maximum", "minimum",
    "sum", "count", "reverse", "sort",
)
CODE_KEYWORDS = (
    "def ", "function", "class ", "if ", "for ", "while ", "return", "print", "input", "output",
    "algorithm", "complexity", "time", "space", "o(", "n)", "log", "sort", "search", "binary",
    "tree", "graph", "dynamic", "programming", "recursion", "iteration",
)
DETECT_CONFIDENCE = 30.0


def word_pattern(choices: tuple[str, ...]) -> str:
    """One of the choices with no word character on either side."""
    return f"(^|[^{WORD}])(?:{'|'.join(choices)})([^{WORD}]|\\z)"


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        found = found | F.contains(text, F.lit(part))
    return found


def question_type(text: Column) -> Column:
    """First type with a whole-word match, else coding on a part of a word, else unknown.

    A byte search for the words goes before each pattern, so that most rows run no pattern at all.
    """
    def decide(lowered: Column) -> Column:
        choice = (contains_any(lowered, TYPE_WORDS["mcq"])
                  & F.rlike(lowered, F.lit(word_pattern(TYPE_WORDS["mcq"])))) \
            | (contains_any(lowered, CHOICE_MARKS) & F.rlike(lowered, F.lit(CHOICE_PATTERN)))
        result = F.when(choice, F.lit("mcq"))
        for name in ("coding", "fill_blank", "debug", "optimize"):
            parts = TYPE_WORDS[name] if name != "fill_blank" else ("fill", "blank", "__")
            whole = F.rlike(lowered, F.lit(word_pattern(TYPE_WORDS[name])))
            result = result.when(contains_any(lowered, parts) & whole, F.lit(name))
        return result.when(contains_any(lowered, CODING_PARTS), F.lit("coding")) \
            .otherwise(F.lit("unknown"))

    return let(F.lower(text), decide)


def question_type_by_parts(text: Column) -> Column:
    """First type with a matching part of a word; coding otherwise."""
    def decide(lowered: Column) -> Column:
        result = None
        for name, parts in TYPE_PARTS.items():
            hit = contains_any(lowered, parts)
            result = F.when(hit, F.lit(name)) if result is None else result.when(hit, F.lit(name))
        return result.otherwise(F.lit("coding"))

    return let(F.lower(text), decide)


def keyword_hits(lowered: Column, keywords: tuple[str, ...]) -> Column:
    """How many of the keywords occur in the lower-case text."""
    total = F.lit(0)
    for keyword in keywords:
        total = total + F.contains(lowered, F.lit(keyword)).cast("int")
    return total


def detect_question(text: Column) -> Column:
    """Struct of the two hit counts, the confidence (0 to 100) and the decision."""
    everything = len(QUESTION_KEYWORDS) + len(CODE_KEYWORDS)

    def count(lowered: Column) -> Column:
        return F.struct(keyword_hits(lowered, QUESTION_KEYWORDS).alias("q"),
                        keyword_hits(lowered, CODE_KEYWORDS).alias("c"))

    def decide(hits: Column) -> Column:
        q, c = hits["q"], hits["c"]
        confidence = (q + c).cast("double") / F.lit(float(everything)) * F.lit(100.0)
        is_question = (q >= 2) | ((q >= 1) & (c >= 1)) | (confidence >= DETECT_CONFIDENCE)
        return F.struct(
            q.cast("bigint").alias("question_hits"), c.cast("bigint").alias("code_hits"),
            confidence.alias("confidence"), is_question.alias("is_question"))

    return let(let(F.lower(text), count), decide)
