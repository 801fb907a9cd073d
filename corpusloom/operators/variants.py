"""Language variants of coding records."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import VARIANT_LANGUAGES

# How a function is written in each language the rewriter knows.
SHELLS = {
    "cpp": ("auto {name}({args}) {{\n    {body}\n}}", "auto "),
    "java": ("public static Object {name}({args}) {{\n    {body}\n}}", "auto "),
    "javascript": ("function {name}({args}) {{\n    {body}\n}}", ""),
}


def function_shell(code: str, target: str) -> str | None:
    """A shell of the leading Python function with its top-level returns, or None if there is none."""
    shell = SHELLS.get(target)
    if shell is None:
        return None
    try:
        statements = ast.parse(code).body
        if not statements or not isinstance(statements[0], ast.FunctionDef):
            return None
        function = statements[0]
        returns = [f"return {ast.unparse(s.value)};" for s in function.body if isinstance(s, ast.Return)]
    except Exception:  # code that does not parse, or a bare return, is kept as it is
        return None
    template, mark = shell
    arguments = ", ".join(mark + a.arg for a in function.args.args)
    return template.format(name=function.name, args=arguments, body="\n    ".join(returns))


@F.pandas_udf(T.StringType())
def rewrite_code(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for codes, targets in batches:
        yield pd.Series([function_shell(c, t) if c is not None else None
                         for c, t in zip(codes, targets)], dtype=object)


def _targets(language: Column) -> Column:
    """Target languages whose name is no part of the record's language."""
    lowered = F.lower(F.coalesce(language, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in VARIANT_LANGUAGES]),
                    lambda target: ~F.contains(lowered, target))


def language_variants(df: DataFrame, rewrite: bool = True) -> DataFrame:
    """Originals plus one row per missing target language for coding records with code.

    One ``explode`` makes both: the original is the null target. ``variant_kind`` is ``original``,
    ``copied`` (code unchanged) or ``rewritten``. Only rows of Python code reach the rewriter.
    """
    eligible = (F.col("question_type") == "coding") & (F.coalesce("solution_code", F.lit("")) != "")
    nothing = F.array(F.lit(None).cast("string"))
    targets = F.when(eligible, F.concat(nothing, _targets(F.col("language")))).otherwise(nothing)
    fanned = df.withColumn("_target", F.explode(targets))
    is_variant = F.col("_target").isNotNull()
    columns = {
        "_source_language": F.lower(F.coalesce("language", F.lit(""))),
        "language": F.coalesce("_target", "language"),
        "problem_id": F.when(is_variant, F.concat_ws("_", F.coalesce("problem_id", F.lit("")), "_target"))
        .otherwise(F.col("problem_id")),
        "variant_kind": F.when(is_variant, F.lit("copied")).otherwise(F.lit("original")),
    }
    if "rec_id" in df.columns:
        columns["rec_id"] = F.when(is_variant, F.concat_ws("_", F.col("rec_id").cast("string"), "_target")) \
            .otherwise(F.col("rec_id").cast("string"))
    for limit in ("time_limit", "memory_limit"):
        if limit in df.columns:
            columns[limit] = F.when(is_variant, F.lit(None)).otherwise(F.col(limit))
    varied = fanned.withColumns(columns)
    if not rewrite:
        return varied.drop("_target", "_source_language")
    python_rows = is_variant & (F.col("_source_language") == "python") \
        & F.contains("solution_code", F.lit("def"))
    # A null code costs the rewriter nothing, and the batch stays in one plan.
    given = varied.withColumn("_shell", rewrite_code(
        F.when(python_rows, F.col("solution_code")), F.coalesce("_target", F.lit(""))))
    return given.withColumns({
        "variant_kind": F.when(F.col("_shell").isNotNull(), F.lit("rewritten"))
        .otherwise(F.col("variant_kind")),
        "solution_code": F.coalesce("_shell", "solution_code"),
    }).drop("_target", "_source_language", "_shell")
