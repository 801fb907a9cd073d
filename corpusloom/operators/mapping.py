"""Mapping raw records of any shape to the unified schema.

A raw record is a VARIANT column, with its JSON text (``raw``) beside it for the order of keys. All
rows of all sources go through one projection, so a new source is a new entry in a table of field
names, not a new reader.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.classify import question_type, question_type_by_parts
from ..functions.code import complexity_note
from ..functions.text import clean_text, let, strip
from ..schema import (
    DATASET_KEYS, FIELD_CANDIDATES, SOURCE_SITES, TEXT_FIELDS, UNIFIED, UNKNOWN_SOURCE,
)
from ..session import stage
from .filters import has_content, is_trainable, is_valid

# Texts of numbers, flags and collections that count as no value.
EMPTY_TEXTS = ("0", "0.0", "-0.0", "false", "[]", "{}")
# Languages whose own columns hold the solutions in the glob-routed profile.
SOLUTION_COLUMNS = ("java", "python", "c++", "javascript")
LIST_FIELDS = ("tags", "examples", "test_cases")
NUMBER_FIELDS = ("time_limit", "memory_limit")


def source_site(path: Column) -> Column:
    """Name of the first known source whose name occurs in the path."""
    lowered = F.lower(path)
    result = F.when(F.contains(lowered, F.lit(SOURCE_SITES[0])), F.lit(SOURCE_SITES[0]))
    for name in SOURCE_SITES[1:]:
        result = result.when(F.contains(lowered, F.lit(name)), F.lit(name))
    return result.otherwise(F.lit(UNKNOWN_SOURCE))


def _path(name: str) -> str:
    return f'$["{name}"]'


def field(record: Column, name: str) -> Column:
    return F.try_variant_get(record, _path(name), "variant")


def has_key(record: Column, name: str) -> Column:
    """The key is present, also with a null value."""
    return F.schema_of_variant(field(record, name)).isNotNull()


def as_text(value: Column) -> Column:
    """Text of a scalar; JSON of an array or object; null for an absent or null value."""
    return F.try_variant_get(value, "$", "string")


def field_text(record: Column, name: str) -> Column:
    return F.try_variant_get(record, _path(name), "string")


def _is_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def _is_object(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))


def _is_array(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def is_truthy(value: Column) -> Column:
    """Neither absent nor null, empty, zero or false."""
    text = as_text(value)
    return (text != "") & ~(text.isin(*EMPTY_TEXTS) & ~_is_string(value))


def truthy_text(record: Column, name: str) -> Column:
    """Text of a field that is neither absent nor null, empty, zero or false; else null."""
    text = field_text(record, name)
    void = text.isin(*EMPTY_TEXTS) & ~_is_string(field(record, name))
    return F.when((text != "") & ~void, text)


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A later filter on a plain projection is pushed below it, which repeats the projection's
    expressions inside the filter. ``inline`` keeps it above, so costly cleaning runs once.
    """
    rest = [c for c in df.columns if c not in columns]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*rest, F.inline(F.array(row)))


def _key_order(raw: Column, name: Column, members: Column) -> Column:
    """Keys of an object field in the order of the JSON text; a VARIANT sorts them."""
    path = F.concat(F.lit("$['"), name, F.lit("']"))
    text = F.call_function("get_json_object", raw, path)
    return F.coalesce(F.json_object_keys(text), F.map_keys(members))


def solutions_by_language(value: Column, raw: Column, name: Column, prefix: str = "# ") -> Column:
    """``# lang`` and its code per non-empty string member, joined by a blank line."""
    members = F.try_variant_get(value, "$", "map<string,variant>")
    codes = F.transform(
        _key_order(raw, name, members),
        lambda key: F.when(
            _is_string(F.try_element_at(members, key)) & (as_text(F.try_element_at(members, key)) != ""),
            F.concat(F.lit(prefix), key, F.lit("\n"), as_text(F.try_element_at(members, key)))))
    return F.array_join(F.array_compact(codes), "\n\n")


def solutions_from_columns(record: Column, languages: Sequence[str] = SOLUTION_COLUMNS) -> Column:
    """The same from one field per language, in the given order."""
    parts = [F.concat(F.lit(f"# {lang}\n"), truthy_text(record, lang)) for lang in languages]
    return F.concat_ws("\n\n", *parts)


def nested_solutions(record: Column, raw: Column, name: str = "solutions") -> Column:
    """``# Language <code>`` and its ``solution`` member per entry, joined by a blank line."""
    members = F.try_variant_get(field(record, name), "$", "map<string,variant>")

    def part(key: Column) -> Column:
        solution = F.try_variant_get(F.try_element_at(members, key), "$.solution", "variant")
        return F.when(F.schema_of_variant(solution).isNotNull(), F.concat(
            F.lit("# Language "), key, F.lit("\n"), F.coalesce(as_text(solution), F.lit("None"))))

    return F.array_join(F.array_compact(F.transform(_key_order(raw, F.lit(name), members), part)), "\n\n")


def text_list(value: Column) -> Column:
    """Elements of an array as texts, each nested one as JSON."""
    return F.transform(F.try_variant_get(value, "$", "array<variant>"), as_text)


def tag_list(value: Column) -> Column:
    """An array as it is; a text split at commas and stripped; null for anything else."""
    parts = F.transform(F.split(as_text(value), ","), strip)
    return F.when(_is_array(value), text_list(value)).when(_is_string(value), parts)


def first_present(record: Column, keys: Sequence[str], default: str | None = "") -> Column:
    """Text of the first key that is present, whatever its value; null counts as empty."""
    result = None
    for name in keys:
        value = F.coalesce(field_text(record, name), F.lit(""))
        hit = has_key(record, name)
        result = F.when(hit, value) if result is None else result.when(hit, value)
    return result.otherwise(F.lit(default))


def _by_source(source: Column, choices: Mapping[str, Column], default: Column | None = None) -> Column:
    """One CASE over the sources that differ from the default."""
    result = None
    for name, value in choices.items():
        result = F.when(source == name, value) if result is None else result.when(source == name, value)
    if result is None:
        return default if default is not None else F.lit(None)
    return result.otherwise(default) if default is not None else result


def _shaped(target: str, name: Column, value: Column, raw: Column) -> Column:
    """The value of a field as the target column wants it."""
    if target == "solution_code":
        return F.when(_is_object(value), solutions_by_language(value, raw, name)).otherwise(as_text(value))
    if target == "tags":
        return tag_list(value)
    if target in LIST_FIELDS:
        return F.when(_is_array(value), text_list(value)).when(value.isNotNull(), F.array(as_text(value)))
    if target in NUMBER_FIELDS:
        return as_text(value).try_cast("int")
    return as_text(value)


def _value_of(name: Column, members: Column, raw: Column, target: str) -> Column:
    found = let(name, lambda n: F.struct(n.alias("name"), F.try_element_at(members, n).alias("value")))
    return let(found, lambda f: _shaped(target, f["name"], f["value"], raw))


def _mapped(members: Column, raw: Column, source: Column, target: str,
            tables: Mapping[str, Mapping[str, Sequence[str]]]) -> Column:
    """The first truthy candidate of the row's source. The candidates are data, not one CASE each."""
    cells = [cell for name, table in tables.items() if target in table
             for cell in (F.lit(name), F.array(*[F.lit(c) for c in table[target]]))]
    if not cells:  # no table has this target
        return _shaped(target, F.lit(""), F.lit(None).cast("variant"), raw)
    candidates = F.try_element_at(F.create_map(*cells), source)
    first = F.try_element_at(F.filter(
        candidates, lambda n: F.coalesce(is_truthy(F.try_element_at(members, n)), F.lit(False))), F.lit(1))
    return _value_of(first, members, raw, target)


def mapping_rows(spark: SparkSession, tables: Mapping[str, Mapping[str, Sequence[str]]] = FIELD_CANDIDATES) -> DataFrame:
    """Mapping tables as rows, a candidate each: ``source``, ``target``, ``place``, ``field``, ``always``."""
    rows = [(source, target, place, name, False) for source, table in tables.items()
            for target, names in table.items() for place, name in enumerate(names)]
    return spark.createDataFrame(rows, "source string, target string, place int, field string, always boolean")


def map_by_rows(df: DataFrame, rows: DataFrame, source: str = "source_site", record: str = "record",
                raw: str = "raw") -> DataFrame:
    """The candidate fields of each row's source, where the mapping is a table and not part of the plan.

    ``rows`` has the columns of ``mapping_rows``. Of a target's fields, by place, the first counts that is
    truthy or, with ``always``, whose key is present whatever its value. A null source and one without rows
    give nulls; rows of unknown targets, and those without a source or field, say nothing. Candidates are
    gathered per source and staged, so the planner broadcasts them only when they are small.
    """
    targets = [f.name for f in UNIFIED if f.name != "source_site"]
    told = rows.filter(F.col("target").isin(*targets) & F.col("source").isNotNull() & F.col("field").isNotNull())
    one = F.struct("place", "field", F.coalesce("always", F.lit(False)).alias("always"))
    lists = told.groupBy("source", "target").agg(F.array_sort(F.collect_set(one)).alias("fields"))
    by_source = lists.groupBy(F.col("source").alias("_source")).agg(
        F.map_from_entries(F.collect_list(F.struct("target", "fields"))).alias("_fields"))
    joined = df.join(stage(by_source, "mapping"), df[source] == F.col("_source"), "left")
    opened = once(joined, {"_members": F.try_variant_get(record, "$", "map<string,variant>")})
    members = F.col("_members")

    def counts(c: Column) -> Column:
        named = c["always"] & F.map_contains_key(members, c["field"])
        return F.coalesce(named, F.lit(False)) | F.coalesce(is_truthy(F.try_element_at(members, c["field"])), F.lit(False))

    def first(target: str) -> Column:
        return F.try_element_at(F.filter(F.try_element_at(F.col("_fields"), F.lit(target)), counts), F.lit(1))["field"]

    return once(opened, {t: _value_of(first(t), members, F.col(raw), t) for t in targets}) \
        .drop("_source", "_fields", "_members")


def map_fields(df: DataFrame, record: str = "record", raw: str = "raw", path: str = "src_path",
               tables: Mapping[str, Mapping[str, Sequence[str]]] = FIELD_CANDIDATES) -> DataFrame:
    """Source, candidate fields, inferred type and per-source overrides, before any cleaning.

    The question type is inferred from the mapped question; the overrides come after it.
    """
    members, raw_text, source = F.col("_members"), F.col(raw), F.col("source_site")
    opened = once(df, {"source_site": source_site(F.col(path)),
                       "_members": F.try_variant_get(record, "$", "map<string,variant>")})
    targets = [f.name for f in UNIFIED if f.name != "source_site"]
    mapped = once(opened, {t: _mapped(members, raw_text, source, t, tables) for t in targets})
    typed = mapped.withColumn("question_type", F.when(
        F.coalesce("question_type", F.lit("")) == "",
        question_type(F.coalesce("question_text", F.lit("")))).otherwise(F.col("question_type")))

    def override(names: Mapping[str, str], target: str, make=as_text) -> Column:
        """Replace the target wherever the source's own key is present, even by nothing."""
        result = None
        for name, key in names.items():
            hit = (source == name) & F.map_contains_key(members, key)
            value = make(F.try_element_at(members, F.lit(key)))
            result = F.when(hit, value) if result is None else result.when(hit, value)
        return result.otherwise(F.col(target))

    has_solutions = (source == "code_contests") \
        & _is_object(F.try_element_at(members, F.lit("solutions")))
    return typed.withColumns({
        "question_text": override(
            {"leetcode": "content", "mbpp": "text", "code_contests": "description"}, "question_text"),
        "problem_id": override(
            {"leetcode": "title", "mbpp": "task_id", "code_contests": "name"}, "problem_id"),
        "difficulty": override(
            {"leetcode": "difficulty"}, "difficulty", lambda v: F.lower(as_text(v))),
        "test_cases": override({"mbpp": "test_list"}, "test_cases", text_list),
        "solution_code": F.when(has_solutions, nested_solutions(F.col(record), raw_text))
        .otherwise(override({"mbpp": "code"}, "solution_code")),
    }).drop("_members")


def fill_defaults(df: DataFrame) -> DataFrame:
    """Empty text and empty list where a field is absent; limits stay null."""
    def default(name: str) -> Column:
        if name in NUMBER_FIELDS:
            return F.col(name)
        empty = F.array().cast("array<string>") if name in LIST_FIELDS else F.lit("")
        return F.coalesce(F.col(name), empty)

    return df.withColumns({f.name: default(f.name) for f in UNIFIED})


def normalise(df: DataFrame, record: str = "record", raw: str = "raw", path: str = "src_path",
              tables: Mapping[str, Mapping[str, Sequence[str]]] = FIELD_CANDIDATES,
              clean_code: bool = False, valid: Column | None = None) -> DataFrame:
    """Map, clean the texts, fill defaults and drop invalid rows.

    Code is left as it is: cleaning removes the line breaks and marks that later stages need.
    ``valid`` replaces the validity rule.
    """
    cleaned = TEXT_FIELDS if clean_code else TEXT_FIELDS[:2]
    mapped = map_fields(df, record, raw, path, tables)
    texts = once(mapped, {name: clean_text(F.col(name)) for name in cleaned})
    rule = valid if valid is not None else is_valid(
        F.col("question_text"), F.col("answer_text"), F.col("solution_code"))
    keep = [c for c in df.columns if c not in (record, raw)]
    return fill_defaults(texts).filter(rule).select(*keep, *[f.name for f in UNIFIED])


def normalise_by_dataset(df: DataFrame, record: str = "record", raw: str = "raw",
                         dataset: str = "dataset") -> DataFrame:
    """Mapping of the glob-routed profile: no cleaning, a key is passed over only when absent."""
    rec, raw_text, name = F.col(record), F.col(raw), F.col(dataset)
    special = [n for n in DATASET_KEYS if n != "generic"]

    def pick(target: str) -> Column:
        generic = DATASET_KEYS["generic"].get(target)
        default = first_present(rec, generic) if generic else F.lit("")
        choices = {}
        for n in special:
            keys = DATASET_KEYS[n].get(target)
            choices[n] = first_present(rec, keys) if keys else F.lit("")
        if target == "solution_code":
            choices["leetcode"] = solutions_from_columns(rec)
            choices["code_contests"] = F.when(
                _is_object(field(rec, "solutions")), nested_solutions(rec, raw_text)).otherwise(F.lit(""))
        if target == "difficulty":
            choices["leetcode"] = F.lower(choices["leetcode"])
        return _by_source(name, choices, default)

    mapped = once(df, {
        "_question": pick("question_text"), "solution_code": strip(pick("solution_code")),
        "problem_id": pick("problem_id"), "difficulty": pick("difficulty"),
        "language": pick("language"), "source_site": name,
    })
    typed = once(mapped, {
        "question_type": question_type_by_parts(F.col("_question")),
        "question_text": strip(F.col("_question"))}).withColumns({
        "answer_text": F.lit(""),
        "constraints": F.lit(""), "tags": F.array().cast("array<string>"),
        "examples": F.array().cast("array<string>"), "test_cases": F.array().cast("array<string>"),
        "time_limit": F.lit(None).cast("int"), "memory_limit": F.lit(None).cast("int"),
    })
    keep = [c for c in df.columns if c not in (record, raw, dataset)]
    return typed.filter(has_content(F.col("question_text"), F.col("solution_code"))) \
        .select(*keep, *[f.name for f in UNIFIED])


def text_problem(df: DataFrame, content: str, problem_id: Column, source: Column,
                 min_length: int = 10, max_length: int = 2000) -> DataFrame:
    """A whole text file as a coding problem: short ones dropped, the question is its beginning."""
    kept = df.filter(F.length(strip(F.col(content))) >= min_length)
    return fill_defaults(kept.withColumns({
        "question_text": F.substring(F.col(content), 1, max_length),
        "answer_text": F.lit(""), "solution_code": F.lit(""), "language": F.lit(""),
        "question_type": F.lit("coding"), "source_site": source, "difficulty": F.lit(""),
        "problem_id": problem_id, "constraints": F.lit(""),
        "tags": F.array().cast("array<string>"), "examples": F.array().cast("array<string>"),
        "test_cases": F.array().cast("array<string>"),
        "time_limit": F.lit(None).cast("int"), "memory_limit": F.lit(None).cast("int"),
    }))


def nested_as_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON texts, for flat output formats."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    return df.withColumns({name: F.to_json(F.col(name)) for name in nested})


def training_text(question: Column, answer: Column, code: Column, language: Column,
                  difficulty: Column) -> Column:
    """Question, explanation, code and difficulty of a training item, empty parts left out."""
    def part(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    heading = F.when(F.coalesce(language, F.lit("")) != "",
                     F.concat(F.lit("Solution in "), language, F.lit(":"))).otherwise(F.lit("Solution:"))
    body = F.concat_ws("\n\n", F.concat(F.lit("Question: "), question), part("Explanation: ", answer),
                       heading, code, part("Difficulty: ", difficulty))
    return F.concat(body, F.lit("\n\n"))


def training_items(df: DataFrame) -> DataFrame:
    """Stripped fields, length limits, and the training text."""
    names = ("question_text", "answer_text", "solution_code", "language", "difficulty")
    rest = [c for c in ("rec_id", "split") if c in df.columns]
    bare = df.select(*rest, *[strip(F.coalesce(F.col(n), F.lit(""))).alias(n) for n in names])
    kept = bare.filter(is_trainable(F.col("question_text"), F.col("solution_code")))
    return kept.select(
        *rest,
        training_text(*[F.col(n) for n in names]).alias("text"),
        F.col("question_text").alias("question"), F.col("solution_code").alias("code"),
        "language", "difficulty")


def prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nSolution:"))


def response_markdown(question: Column, response: Column, code: Column,
                      complexity: bool = True) -> Column:
    """Question, explanation, fenced code and complexity note, one part per line."""
    has_code = F.coalesce(code, F.lit("")) != ""
    explained = (F.coalesce(response, F.lit("")) != "") & ~response.eqNullSafe(code)
    text = F.concat(
        F.lit("Question: "), question, F.lit("\n"),
        F.when(explained, F.concat(F.lit("\nExplanation:\n"), response, F.lit("\n"))).otherwise(F.lit("")),
        F.when(has_code, F.concat(F.lit("\nSolution:\n```python\n"), code, F.lit("\n```")))
        .otherwise(F.lit("")))
    if not complexity:
        return text
    note = F.when(has_code, F.concat(F.lit("\n\nComplexity Analysis:\n"), complexity_note(code)))
    return F.concat(text, F.coalesce(note, F.lit("")))
