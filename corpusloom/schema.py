"""The unified record schema and the per-source field mappings, kept as data."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT_FIELDS = ("question_text", "answer_text", "solution_code")

UNIFIED = T.StructType([
    T.StructField("question_text", T.StringType()),
    T.StructField("answer_text", T.StringType()),
    T.StructField("solution_code", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("question_type", T.StringType()),
    T.StructField("source_site", T.StringType()),
    T.StructField("difficulty", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("problem_id", T.StringType()),
    T.StructField("constraints", T.StringType()),
    T.StructField("examples", T.ArrayType(T.StringType())),
    T.StructField("test_cases", T.ArrayType(T.StringType())),
    T.StructField("time_limit", T.IntegerType()),
    T.StructField("memory_limit", T.IntegerType()),
])

# Columns the engine adds to every record: a stable id and where the record was read.
ENGINE = T.StructType([
    T.StructField("rec_id", T.StringType()),
    T.StructField("src_path", T.StringType()),
    T.StructField("src_block", T.LongType()),
    T.StructField("src_row", T.LongType()),
])

SPLITS = ("train", "validation", "test")

# Substrings of a path that name its source, tried in this order.
SOURCE_SITES = (
    "leetcode", "codechef", "codeforces", "hackerrank", "mbpp",
    "apps", "ds1000", "bigcodebench", "code_contests",
)
UNKNOWN_SOURCE = "unknown"

# Candidate field names per source, first usable one wins.
FIELD_CANDIDATES: dict[str, dict[str, tuple[str, ...]]] = {
    "unknown": {
        "question_text": ("question", "Question", "text", "content", "description", "problem"),
        "answer_text": ("answer", "Answer", "explanation", "solution_text"),
        "solution_code": ("code", "Code", "solution", "Solution", "implementation"),
        "language": ("language", "lang", "Language"),
        "question_type": ("type", "category", "Type"),
        "difficulty": ("difficulty", "level", "Difficulty"),
        "tags": ("tags", "categories", "topics", "Tags"),
        "problem_id": ("id", "problem_id", "task_id", "Id"),
        "constraints": ("constraints", "requirements", "Constraints"),
        "examples": ("examples", "sample_inputs", "Examples"),
        "test_cases": ("test_cases", "tests", "test_list", "TestCases"),
        "time_limit": ("time_limit", "time", "TimeLimit"),
        "memory_limit": ("memory_limit", "memory", "MemoryLimit"),
    },
    "leetcode": {
        "question_text": ("content", "description", "problem", "question"),
        "answer_text": ("explanation", "answer"),
        "solution_code": ("java", "python", "c++", "javascript", "solution"),
        "language": ("language", "lang"),
        "question_type": ("type", "category"),
        "difficulty": ("difficulty", "level"),
        "tags": ("tags", "categories", "topics"),
        "problem_id": ("id", "problem_id", "slug"),
        "constraints": ("constraints", "requirements"),
        "examples": ("examples", "sample_inputs"),
        "test_cases": ("test_cases", "tests"),
        "time_limit": ("time_limit", "time"),
        "memory_limit": ("memory_limit", "memory"),
    },
    "codechef": {
        "question_text": ("description", "problem", "question"),
        "solution_code": ("solution", "code", "answer"),
        "language": ("language", "lang"),
        "difficulty": ("difficulty", "level"),
        "tags": ("tags", "categories"),
        "problem_id": ("id", "problem_id", "code"),
        "constraints": ("constraints", "requirements"),
        "examples": ("examples", "sample_inputs"),
        "test_cases": ("test_cases", "tests"),
    },
    "codeforces": {
        "question_text": ("description", "problem", "question"),
        "solution_code": ("solution", "code", "answer"),
        "language": ("language", "lang"),
        "difficulty": ("difficulty", "level", "rating"),
        "tags": ("tags", "categories"),
        "problem_id": ("id", "problem_id", "index"),
        "constraints": ("constraints", "requirements"),
        "examples": ("examples", "sample_inputs"),
        "test_cases": ("test_cases", "tests"),
    },
    "mbpp": {
        "question_text": ("text", "description", "prompt"),
        "solution_code": ("code", "solution", "implementation"),
        "language": ("language", "lang"),
        "question_type": ("type", "category"),
        "difficulty": ("difficulty", "level"),
        "problem_id": ("task_id", "id"),
        "test_cases": ("test_list", "tests"),
    },
}

# Sources without an own list above use these, so that their rows are not lost.
FIELD_CANDIDATES.update({
    "code_contests": {"question_text": ("description",), "problem_id": ("name",),
                      "difficulty": ("difficulty",)},
    "bigcodebench": {"question_text": ("prompt", "description"),
                     "solution_code": ("canonical_solution",), "problem_id": ("task_id",)},
    "apps": {"question_text": ("question",), "solution_code": ("answer",), "problem_id": ("id",)},
    "ds1000": {"question_text": ("question",), "solution_code": ("answer",), "problem_id": ("id",)},
    "hackerrank": FIELD_CANDIDATES["unknown"],
})

# Glob patterns (relative to the root) that route a file to a dataset.
DATASET_GLOBS: dict[str, tuple[str, ...]] = {
    "leetcode": ("leetcode-data/*.jsonl", "leetcode-data/*.json"),
    "mbpp": ("mbpp-data/data/*.jsonl", "mbpp-data/data/*.json"),
    "code_contests": ("code_contests-data/data/*.parquet",),
    "bigcodebench": ("bigcodebench-data/data/*.parquet",),
    "apps": ("apps-data/*.jsonl", "apps-data/*.json"),
    "ds1000": ("ds1000-data/*.jsonl",),
    "codesearchnet": ("codesearchnet_python/data/*.parquet",),
    "codechef": ("description2code_current/codechef/**/*.txt",
                 "description2code_current/codechef/**/*.json"),
    "codeforces": ("description2code_current/codeforces/**/*.txt",
                   "description2code_current/codeforces/**/*.json"),
    "hackerearth": ("description2code_current/hackerearth/**/*.txt",
                    "description2code_current/hackerearth/**/*.json"),
    "generic": ("*.csv", "*.jsonl", "*.json", "*.parquet"),
}

# Keys per dataset for the glob-routed profile. The next key is used only when the
# one before it is absent from the record.
DATASET_KEYS: dict[str, dict[str, tuple[str, ...]]] = {
    "leetcode": {"question_text": ("content", "description"), "problem_id": ("title", "slug"),
                 "difficulty": ("difficulty",)},
    "mbpp": {"question_text": ("text",), "solution_code": ("code",), "problem_id": ("task_id",)},
    "code_contests": {"question_text": ("description",), "problem_id": ("name",),
                      "difficulty": ("difficulty",)},
    "bigcodebench": {"question_text": ("prompt", "description"),
                     "solution_code": ("canonical_solution",), "problem_id": ("task_id",)},
    "apps": {"question_text": ("question",), "solution_code": ("answer",), "problem_id": ("id",)},
    "ds1000": {"question_text": ("question",), "solution_code": ("answer",), "problem_id": ("id",)},
    "codesearchnet": {"question_text": ("docstring",), "solution_code": ("code",),
                      "problem_id": ("id",)},
    "generic": {"question_text": ("question", "text", "content"),
                "solution_code": ("answer", "code", "solution"),
                "problem_id": ("id", "problem_id"), "difficulty": ("difficulty",),
                "language": ("language",)},
}

# File suffixes that have a reader.
SUPPORTED_FORMATS = (
    "csv", "tsv", "json", "jsonl", "txt", "html", "xml", "parquet",
    "zip", "tar", "tar.gz", "tgz",
)
ARCHIVE_FORMATS = ("zip", "tar", "tar.gz", "tgz")

VARIANT_LANGUAGES = ("python", "java", "cpp", "javascript")
