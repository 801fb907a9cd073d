"""The same results as plain SQL, for a database that reads the tables on its own."""

from __future__ import annotations

from ..functions import classify
from ..functions.code import FENCE, MARKER
from ..functions.text import SPACE, SPACE_CHARS, WORD
from ..schema import SOURCE_SITES
from . import bindings as b
from .catalog import SHARD_SIZE, TOKEN_CONFIDENCE

_BLANKS = "(" + " || ".join(f"chr({ord(c)})" for c in SPACE_CHARS) + ")"
_NL = "chr(10)"
# A plainer reading of pages than the library's, right for the pages of the table.
HIDDEN_BLOCKS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>"
TAGS = r"(?s)<[!?/a-zA-Z][^>]*>"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip(x)}, {q(f'[{SPACE}]+')}), lambda w: w <> '')"


def html(x: str) -> str:
    bare = sub(sub(x, HIDDEN_BLOCKS, ""), TAGS, "")
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&#233;", "é"),
                         ("&eacute;", "é"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = f"replace({bare}, {q(entity)}, {q(char)})"
    return bare


def clean(x: str) -> str:
    plain = f"CASE WHEN contains({x}, '<') AND contains({x}, '>') THEN {html(x)} ELSE {x} END"
    unfenced = sub(f"({plain})", "(?s)```.*?```", " ")
    return f"trim({sub(sub(unfenced, '[#*_>`]+', ' '), f'[{SPACE}]+', ' ')})"


def norm(x: str) -> str:
    return f"trim({sub(sub(f'lower({x})', f'[{SPACE}]+', ' '), f'[^{WORD} ]+', '')})"


def has_any(x: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in parts) + ")"


def hits(x: str, parts: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({x}), {q(p)}) AS BIGINT)" for p in parts) + ")"


def question_type(x: str) -> str:
    low = f"lower({x})"
    cases = [f"WHEN regexp_matches({low}, {q(classify.word_pattern(classify.TYPE_WORDS['mcq']))}) "
             f"OR regexp_matches({low}, {q(classify.CHOICE_PATTERN)}) THEN 'mcq'"]
    for name in ("coding", "fill_blank", "debug", "optimize"):
        cases.append(f"WHEN regexp_matches({low}, {q(classify.word_pattern(classify.TYPE_WORDS[name]))}) THEN '{name}'")
    cases.append(f"WHEN {has_any(low, classify.CODING_PARTS)} THEN 'coding'")
    return f"CASE {' '.join(cases)} ELSE 'unknown' END"


def question_type_by_parts(x: str) -> str:
    cases = [f"WHEN {has_any(f'lower({x})', parts)} THEN '{name}'" for name, parts in classify.TYPE_PARTS.items()]
    return f"CASE {' '.join(cases)} ELSE 'coding' END"


def is_question(x: str) -> str:
    qh, ch = hits(x, classify.QUESTION_KEYWORDS), hits(x, classify.CODE_KEYWORDS)
    return f"({qh} >= 2 OR ({qh} >= 1 AND {ch} >= 1) OR ({qh} + {ch}) / 56.0 * 100 >= 30)"


def confidence(x: str) -> str:
    qh, ch = hits(x, classify.QUESTION_KEYWORDS), hits(x, classify.CODE_KEYWORDS)
    return f"round(CAST({qh} + {ch} AS DOUBLE) / CAST(56 AS DOUBLE) * 100, 6)"


def extract_code(x: str) -> str:
    inner = strip(f"regexp_extract({x}, {q(FENCE)}, 1)")
    named = " OR ".join(f"starts_with({inner}, '{n}')" for n in ("python", "cpp", "java"))
    cut = f"strpos({inner}, {_NL})"
    return (f"CASE WHEN regexp_matches({x}, {q(FENCE)}) THEN CASE WHEN ({named}) AND {cut} > 0 "
            f"THEN substr({inner}, {cut} + 1) ELSE {inner} END ELSE {x} END")


def longest(parts: str) -> str:
    return f"list_reduce({parts}, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END)"


def primary(x: str) -> str:
    return strip(longest(f"regexp_split_to_array({x}, {q(MARKER)})"))


def complexity(x: str) -> str:
    low = f"lower({x})"
    again = f"contains(substr({low}, strpos({low}, 'for') + 3), 'for')"
    time = (f"CASE WHEN contains({low}, 'while') THEN 'O(n)' WHEN contains({low}, 'sort') THEN 'O(n log n)' "
            f"WHEN contains({low}, 'for') AND contains({low}, 'range') AND {again} THEN 'O(n²)' ELSE 'O(n)' END")
    space = (f"CASE WHEN contains({low}, 'append') OR contains({low}, 'list') OR contains({low}, 'recursion') "
             f"OR (contains({low}, 'def') AND contains({low}, 'return')) THEN 'O(n)' ELSE 'O(1)' END")
    return f"'Time Complexity: ' || ({time}) || {_NL} || 'Space Complexity: ' || ({space})"


def valid(question: str, answer: str, code: str) -> str:
    return (f"(length({question}) BETWEEN 20 AND 50000 AND length({strip(question)}) >= 10 "
            f"AND ({answer} <> '' OR {code} <> ''))")


SNIPPETS = f"snippets AS (SELECT doc_id AS rec_id, {b.SNIPPET} AS snippet FROM documents)"
PHRASES = f"phrases AS (SELECT doc_id AS rec_id, {b.PHRASED} AS phrase FROM documents)"
DOCS = """docs AS (SELECT doc_id AS rec_id, text AS question_text, '' AS answer_text, text AS solution_code,
  '' AS language, source AS source_site, lang AS difficulty FROM documents)"""
QA = """qa AS (SELECT u.conv_id * 1000 + u.turn AS rec_id, u.text AS question_text, a.text AS answer_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""
EVENTS = f"""captured AS (SELECT event_id, user_id, ts, event_type, {b.EVENT_TEXT} AS text,
  CAST(event_id % 100 AS DOUBLE) AS confidence FROM events)"""
PATHS = f"paths AS (SELECT *, {b.SITE_PATH} AS src_path FROM documents)"


def chatter_counts(source: str, key: str, x: str) -> str:
    """Words and count of the most frequent word per row."""
    return f"""chatter AS (
      SELECT {key}, CAST(sum(c) AS BIGINT) AS n_words, CAST(max(c) AS BIGINT) AS top_count
      FROM (SELECT {key}, w, count(*) AS c FROM (SELECT {key}, unnest({words(x)}) AS w FROM {source}) GROUP BY ALL)
      GROUP BY {key})"""


CHATTY = "(n_words >= 10 AND top_count > n_words * CAST(0.2 AS DOUBLE))"


def split_case(rank: str, total: str) -> str:
    train = f"CAST(floor({total} * CAST(0.9 AS DOUBLE)) AS BIGINT)"
    last = f"({train} + CAST(floor({total} * CAST(0.05 AS DOUBLE)) AS BIGINT))"
    return f"CASE WHEN {rank} <= {train} THEN 'train' WHEN {rank} <= {last} THEN 'validation' ELSE 'test' END"


def split_of(source: str, keys: str, id_col: str = "rec_id") -> str:
    over = f"PARTITION BY {keys}" if keys else ""
    rank = f"row_number() OVER ({over} ORDER BY md5('42:' || {id_col}))"
    return f"SELECT *, {split_case(rank, f'count(*) OVER ({over})')} AS split FROM {source}"


STRATA = "source_site, difficulty"
CORPUS = f"""corpus AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5({norm('question_text')})
  ORDER BY rec_id) AS n FROM docs WHERE {valid('question_text', 'answer_text', 'solution_code')}) WHERE n = 1)"""
SPLIT_DOCS = f"split_docs AS ({split_of('typed', STRATA)})"
TYPED = f"typed AS (SELECT *, {question_type_by_parts('question_text')} AS question_type FROM docs)"


def manifest_of(source: str) -> str:
    parts = [f"SELECT 'total' AS metric, '' AS key, count(*) AS n FROM {source}"]
    for field in ("split", "source_site", "difficulty", "question_type"):
        parts.append(f"SELECT '{field}', {field}, count(*) FROM {source} GROUP BY {field}")
    return " UNION ALL ".join(parts)


def score(entries: str, splits: str, sources: str) -> str:
    return (f"round(least(100.0, CAST({splits} AS DOUBLE) / 3 * 30 + least(CAST({sources} AS DOUBLE) / 10, 1) * 30 "
            f"+ least(CAST({entries} AS DOUBLE) / 5000, 1) * 40), 6)")


def summary_of(outputs: str) -> str:
    return f"""SELECT original_entries, consolidated_entries,
        round(CAST(consolidated_entries AS DOUBLE) / original_entries * 100, 6) AS coverage_pct, datasets, files,
        consolidated_entries > 0 AS success, {score('consolidated_entries', 'splits', 'sources')} AS quality_score,
        consolidated_entries > 0 AND CAST(consolidated_entries AS DOUBLE) / original_entries * 100 > 50 AS accepted
      FROM (SELECT count(*) AS original_entries, count(DISTINCT source) AS datasets,
                   count(DISTINCT source) AS files FROM documents),
           (SELECT count(*) AS consolidated_entries, count(DISTINCT split) AS splits,
                   count(DISTINCT source_site) AS sources FROM {outputs})"""


# Field values of the raw records built for the mapping queries.
DESCRIPTION = "CASE WHEN n_chars % 2 = 0 THEN text END"
CODE = "CASE WHEN n_chars % 4 = 0 THEN '' ELSE source END"
MAPPED_CODE = "source"
ANSWER = "CASE WHEN n_chars % 2 = 0 THEN 'true' ELSE lang END"
LEVEL = "CASE WHEN n_chars % 5 = 0 THEN upper(lang) ELSE CAST(n_chars % 5 AS VARCHAR) END"
SITE = "CASE lang WHEN 'en' THEN 'leetcode' WHEN 'fr' THEN 'mbpp' WHEN 'de' THEN 'code_contests' ELSE 'unknown' END"
DATASET = "CASE lang WHEN 'en' THEN 'leetcode' WHEN 'fr' THEN 'mbpp' WHEN 'de' THEN 'apps' ELSE 'generic' END"

# What each source's list and overrides make of those records.
SITE_QUESTION = f"CASE WHEN {SITE} = 'code_contests' THEN ({DESCRIPTION}) ELSE text END"
SITE_ID = "CASE lang WHEN 'en' THEN source WHEN 'fr' THEN CAST(doc_id AS VARCHAR) WHEN 'de' THEN lang ELSE CAST(doc_id AS VARCHAR) END"
SITE_DIFFICULTY = (f"CASE WHEN {SITE} = 'leetcode' THEN lower(CAST(n_chars % 5 AS VARCHAR)) "
                   f"WHEN {SITE} = 'code_contests' THEN nullif(CAST(n_chars % 5 AS VARCHAR), '0') ELSE {LEVEL} END")
SITE_CODE = (f"CASE {SITE} WHEN 'leetcode' THEN source WHEN 'mbpp' THEN {CODE} "
             f"WHEN 'code_contests' THEN NULL ELSE {MAPPED_CODE} END")
SITE_TESTS = f"CASE WHEN {SITE} IN ('mbpp', 'unknown') THEN lang || '|' || source END"

# The tree of files that the inventory queries write: files and rows of each folder.
TREE = """WITH tree AS (SELECT folder, format, suffix, n_files, n_rows FROM (VALUES ('codechef', 'jsonl', 'jsonl'),
  ('codeforces', 'json', 'json'), ('hackerearth', 'txt', 'txt'), ('notes of all', 'txt', 'md'), ('tables', 'csv', 'csv'),
  ('columns', 'parquet', 'parquet')) AS v(folder, format, suffix),
  (SELECT count(*) AS n_rows, count(DISTINCT s_nationkey) AS n_files FROM supplier))"""
S12_HTML = "translate(html, chr(13) || chr(10), '  ')"

ORACLE: dict[str, str] = {
    "c1_clean_text": f"WITH {SNIPPETS} SELECT rec_id, {clean('snippet')} AS clean FROM snippets",
    "c2_html_text": f"SELECT page_id, {html('html')} AS text FROM pages",
    "c2_html_exact": f"""SELECT page_id, page_id || 'kept' || 'x <b> y' || '1 < 2 </i>' || {html('html')} AS text FROM pages""",
    "c3_dedup_key": f"SELECT doc_id AS rec_id, {norm('text')} AS norm, md5({norm('text')}) AS dedup_key FROM documents",
    "c5_artefact_clean": f"""SELECT rec_id, CASE WHEN length(t) < 10 THEN '' ELSE trim(substr(t, 1, 5000)) END AS clean
      FROM (SELECT doc_id AS rec_id, translate(trim({sub('text', f'[{SPACE}]+', ' ')}), '|01', 'IOl') AS t FROM documents)""",
    "q1_question_type": f"WITH {PHRASES} SELECT rec_id, {question_type('phrase')} AS question_type FROM phrases",
    "q2_question_type": f"WITH {PHRASES} SELECT rec_id, {question_type_by_parts('phrase')} AS question_type FROM phrases",
    "x1_fenced_code": f"WITH {SNIPPETS} SELECT rec_id, {extract_code('snippet')} AS code FROM snippets",
    "x2_primary_solution": f"WITH {SNIPPETS} SELECT rec_id, {primary('snippet')} AS solution FROM snippets",
    "x3_complexity": f"WITH {SNIPPETS} SELECT rec_id, CASE WHEN snippet = '' THEN '' ELSE {complexity('snippet')} END AS note FROM snippets",
    "x5_question_detect": f"""WITH {PHRASES} SELECT rec_id, {hits('phrase', classify.QUESTION_KEYWORDS)} AS question_hits,
      {hits('phrase', classify.CODE_KEYWORDS)} AS code_hits, {confidence('phrase')} AS confidence,
      {is_question('phrase')} AS is_question FROM phrases""",
    "x7_path_parts": f"""WITH {PATHS} SELECT doc_id AS rec_id, doc_id || '.tar' AS stem, 'tar.gz' AS suffix,
      substr(src_path, 7) || '.tar.GZ' AS relative_path FROM paths""",
    "w6_longest_part": f"SELECT doc_id AS rec_id, {longest('regexp_split_to_array(text, ' + q('[.,]') + ')')} AS longest FROM documents",
    "w7_prefix": "SELECT doc_id AS rec_id, substr(text, 1, 2000) AS head FROM documents",
    "m1_source_site": f"""SELECT page_id, CASE {' '.join(f"WHEN contains(p, '{s}') THEN '{s}'" for s in SOURCE_SITES)}
      ELSE 'unknown' END AS source_site FROM (SELECT page_id, lower(url || CASE length(url) % 5
      WHEN 0 THEN '/LeetCode/mbpp' WHEN 1 THEN '/apps' WHEN 2 THEN '/x/Code_Contests' WHEN 3 THEN '/ds1000'
      ELSE '' END) AS p FROM pages)""",
    "m2_coalesce_fields": f"""SELECT doc_id AS rec_id, text AS question_text, {ANSWER} AS answer_text,
      {MAPPED_CODE} AS solution_code, {LEVEL} AS difficulty FROM documents""",
    "m2_mapping_table": f"""SELECT doc_id AS rec_id, CASE WHEN length(source) % 2 = 0 THEN {DESCRIPTION} ELSE text END AS question_text,
      {ANSWER} AS answer_text, {MAPPED_CODE} AS solution_code,
      CASE WHEN length(source) % 2 = 0 THEN upper(lang) ELSE {LEVEL} END AS difficulty FROM documents""",
    "m3_multilang": f"""SELECT doc_id AS rec_id, '# python' || {_NL} || text || CASE WHEN n_chars % 2 = 0 THEN ''
      ELSE {_NL} || {_NL} || '# java' || {_NL} || lang END || {_NL} || {_NL} || '# c++' || {_NL} || source
      AS solution_code FROM documents""",
    "m4_solution_columns": f"""SELECT doc_id AS rec_id, CASE WHEN n_chars % 2 = 0 THEN '' ELSE '# java' || {_NL} || lang
      || {_NL} || {_NL} END || '# python' || {_NL} || text || {_NL} || {_NL} || '# c++' || {_NL} || source
      AS solution_code FROM documents""",
    "m5_nested_solutions": f"""SELECT doc_id AS rec_id, '# Language 3' || {_NL} || text || {_NL} || {_NL}
      || '# Language 1' || {_NL} || source AS solution_code FROM documents""",
    "m6_tags": """SELECT doc_id AS rec_id, CASE n_chars % 3 WHEN 0 THEN lang || '|' || source
      WHEN 1 THEN lang || '|' || source || '||x' END AS tags FROM documents""",
    "m7_source_overrides": f"""SELECT doc_id AS rec_id, {SITE} AS source_site, {SITE_QUESTION} AS question_text,
      {SITE_ID} AS problem_id, {SITE_DIFFICULTY} AS difficulty, {SITE_CODE} AS solution_code,
      {SITE_TESTS} AS test_cases FROM documents""",
    "m8_dataset_mapping": f"""SELECT * FROM (SELECT doc_id AS rec_id, {DATASET} AS source_site,
      CASE WHEN {DATASET} = 'apps' OR {DATASET} = 'generic' THEN {strip("CASE WHEN n_chars % 3 = 0 THEN '' ELSE text END")}
        ELSE {strip('text')} END AS question_text,
      CASE {DATASET} WHEN 'leetcode' THEN '' WHEN 'mbpp' THEN {CODE}
        ELSE CASE WHEN n_chars % 2 = 0 THEN 'true' ELSE 'false' END END AS solution_code,
      CASE {DATASET} WHEN 'leetcode' THEN source ELSE CAST(doc_id AS VARCHAR) END AS problem_id,
      CASE WHEN {DATASET} IN ('leetcode', 'generic') THEN CAST(n_chars % 5 AS VARCHAR) ELSE '' END AS difficulty,
      '' AS language,
      CASE WHEN {DATASET} IN ('apps', 'generic') AND n_chars % 3 = 0 THEN 'coding'
        ELSE {question_type_by_parts('text')} END AS question_type
      FROM documents) WHERE question_text <> '' OR solution_code <> ''""",
    "m9_normalise": f"""SELECT rec_id, source_site, question_text, answer_text, solution_code, language, question_type,
      difficulty, problem_id, tags, test_cases, time_limit FROM (
      SELECT doc_id AS rec_id, {SITE} AS source_site, coalesce({clean(f'({SITE_QUESTION})')}, '') AS question_text,
      coalesce(CASE {SITE} WHEN 'leetcode' THEN {clean('lang')} WHEN 'unknown' THEN {clean(f'({ANSWER})')} END, '') AS answer_text,
      coalesce({SITE_CODE}, '') AS solution_code,
      CASE WHEN {SITE} = 'code_contests' THEN '' ELSE lang END AS language,
      CASE WHEN {SITE} = 'code_contests' AND n_chars % 2 <> 0 THEN 'unknown' ELSE {question_type('text')} END AS question_type,
      coalesce({SITE_DIFFICULTY}, '') AS difficulty, coalesce({SITE_ID}, '') AS problem_id,
      CASE WHEN {SITE} IN ('leetcode', 'unknown') THEN lang || '|' || source || '||x' ELSE '' END AS tags,
      coalesce({SITE_TESTS}, '') AS test_cases,
      CASE WHEN {SITE} IN ('leetcode', 'unknown') THEN n_chars END AS time_limit
      FROM documents) WHERE {valid('question_text', 'answer_text', 'solution_code')}""",
    "m10_nested_json": """SELECT doc_id AS rec_id, '["' || lang || '","' || source || '"]' AS tags,
      '{"lang":"' || lang || '","n_chars":' || n_chars || '}' AS facts FROM documents""",
    "m11_training_text": f"""SELECT rec_id, 'Question: ' || t || {_NL} || {_NL}
      || CASE WHEN n_chars % 2 = 0 THEN 'Explanation: ' || source || {_NL} || {_NL} ELSE '' END
      || CASE WHEN l <> '' THEN 'Solution in ' || l || ':' ELSE 'Solution:' END || {_NL} || {_NL} || t || {_NL} || {_NL}
      || CASE WHEN d <> '' THEN 'Difficulty: ' || d || {_NL} || {_NL} ELSE '' END AS text,
      t AS question, t AS code, l AS language, d AS difficulty
      FROM (SELECT doc_id AS rec_id, n_chars, source, {strip('text')} AS t, {b.LANGUAGE} AS l,
            CASE WHEN n_chars % 3 = 0 THEN '' ELSE lang END AS d FROM documents)
      WHERE length(t) BETWEEN 50 AND 2000""",
    "m12_prompt": f"WITH {QA} SELECT rec_id, 'Question: ' || question_text || {_NL} || {_NL} || 'Solution:' AS prompt FROM qa",
    "m13_markdown": f"""WITH {QA}, answered AS (SELECT rec_id, question_text, CASE WHEN rec_id % 2 = 0 THEN 'See ```python' || {_NL}
      || 'for x in range(3): ' || answer_text || {_NL} || '```' ELSE answer_text END AS response FROM qa),
      coded AS (SELECT *, {extract_code('response')} AS code FROM answered)
      SELECT rec_id, 'Question: ' || question_text || {_NL}
      || CASE WHEN response <> '' AND response <> code THEN {_NL} || 'Explanation:' || {_NL} || response || {_NL} ELSE '' END
      || CASE WHEN code <> '' THEN {_NL} || 'Solution:' || {_NL} || '```python' || {_NL} || code || {_NL} || '```' || {_NL} || {_NL}
         || 'Complexity Analysis:' || {_NL} || {complexity('code')} ELSE '' END AS markdown FROM coded""",
    "f1_valid": f"WITH {DOCS} SELECT rec_id, {valid('question_text', 'answer_text', 'solution_code')} AS is_valid FROM docs",
    "f2_has_content": f"SELECT doc_id AS rec_id, CASE WHEN length(text) % 2 = 0 THEN false ELSE {strip('text')} <> '' END AS has_content FROM documents",
    "f3_chatter": f"""WITH {DOCS}, {chatter_counts('docs', 'rec_id', 'question_text')}
      SELECT rec_id, coalesce({CHATTY}, false) AS chatter FROM docs LEFT JOIN chatter USING (rec_id)""",
    "f4_quality": f"""WITH {DOCS}, {SNIPPETS}, {chatter_counts('docs', 'rec_id', 'question_text')}
      SELECT rec_id, {primary('snippet')} AS solution_code FROM snippets LEFT JOIN chatter USING (rec_id)
      WHERE NOT coalesce({CHATTY}, false)""",
    "f6_gate": f"""WITH {EVENTS} SELECT event_id, text, confidence FROM captured
      WHERE confidence >= 70 AND {is_question('text')} AND length(text) BETWEEN 20 AND 2000""",
    "f8_emitted": f"SELECT doc_id AS rec_id, {confidence('text')} AS question_confidence FROM documents WHERE text <> '' AND {is_question('text')}",
    "d1_exact_dedup": f"""SELECT rec_id, question_text FROM (SELECT doc_id AS rec_id, text AS question_text,
      row_number() OVER (PARTITION BY md5({norm('text')}) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""",
    "d4_consecutive": """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id
      ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before""",
    "u1_union": """SELECT doc_id AS id, text, lang, NULL AS role FROM documents UNION ALL
      SELECT conv_id, text, NULL, role FROM conversations UNION ALL SELECT item_id, text, NULL, NULL FROM benchmark""",
    "u3_sources": "SELECT DISTINCT source AS source_site FROM documents",
    "j1_coverage": f"""WITH {DOCS}, {CORPUS}, got AS (SELECT source_site, count(*) AS n FROM corpus GROUP BY 1),
      one AS (SELECT source AS dataset, count(*) AS original, coalesce(max(n), 0) AS consolidated
              FROM documents LEFT JOIN got ON source_site = source GROUP BY 1),
      every AS (SELECT * FROM one UNION ALL SELECT 'total', sum(original), sum(consolidated) FROM one)
      SELECT dataset, CAST(original AS BIGINT) AS original, CAST(consolidated AS BIGINT) AS consolidated,
      round(CAST(consolidated AS DOUBLE) / original * 100, 6) AS coverage_pct,
      CAST(original - consolidated AS BIGINT) AS missing FROM every""",
    "j4_missing": f"""WITH {DOCS}, {CORPUS} SELECT rec_id, source_site FROM docs
      WHERE rec_id NOT IN (SELECT rec_id FROM corpus)""",
    "a1_manifest": f"WITH {DOCS}, {TYPED}, {SPLIT_DOCS} {manifest_of('split_docs')}",
    "a2_split_sizes": f"""WITH {DOCS}, s AS ({split_of('docs', '')})
      SELECT split, count(*) AS n FROM s GROUP BY split UNION ALL SELECT 'total', count(*) FROM s""",
    "a3_split_profile": f"""WITH {DOCS}, {TYPED}, {SPLIT_DOCS} SELECT split, 'source_site' AS field, source_site AS value,
      count(*) AS n FROM split_docs GROUP BY ALL UNION ALL SELECT split, 'difficulty', difficulty, count(*) FROM split_docs
      GROUP BY ALL UNION ALL SELECT split, 'language', CASE WHEN difficulty = 'en' THEN '' ELSE 'unknown' END, count(*)
      FROM split_docs GROUP BY ALL""",
    "a4_input_profile": """SELECT coalesce(source, 'total') AS dataset, count(*) AS files, count(*) AS entries,
      round(CAST(sum(n_chars) AS DOUBLE) / 1048576, 6) AS size_mib FROM documents GROUP BY ROLLUP (source)""",
    "a5_quality": f"""WITH {DOCS}, {TYPED}, {SPLIT_DOCS} SELECT 'split' AS metric, key, count(split) AS n,
      round(CAST(count(split) AS DOUBLE) / (SELECT count(*) FROM docs) * 100, 6) AS pct
      FROM (VALUES ('train'), ('validation'), ('test')) AS names(key) LEFT JOIN split_docs ON split = key GROUP BY key
      UNION ALL SELECT 'difficulty', difficulty, count(*), NULL FROM split_docs GROUP BY difficulty
      UNION ALL SELECT 'language', language, count(*), NULL FROM split_docs GROUP BY language
      UNION ALL SELECT 'unique_sources', '', count(DISTINCT source_site), NULL FROM split_docs""",
    "a6_score": f"""WITH {DOCS}, {TYPED}, {SPLIT_DOCS} SELECT splits, sources, entries, {score('entries', 'splits', 'sources')} AS score
      FROM (SELECT count(DISTINCT split) AS splits, count(DISTINCT source_site) AS sources, count(*) AS entries FROM split_docs)""",
    "a7_summary": f"WITH {DOCS}, {TYPED}, {SPLIT_DOCS} {summary_of('split_docs')}",
    "a9_top_word": f"""WITH {DOCS}, {chatter_counts('docs', 'rec_id', 'question_text')} SELECT rec_id,
      coalesce(n_words, 0) AS n_words, coalesce(top_count, 0) AS top_count,
      coalesce(round(CAST(top_count AS DOUBLE) / n_words, 6), 0) AS top_share FROM docs LEFT JOIN chatter USING (rec_id)""",
    "a10_tokens": f"""WITH t AS (SELECT doc_id AS rec_id, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS pos
        FROM (SELECT doc_id, {words('text')} AS w FROM documents)),
      kept AS (SELECT *, (pos * 37) % 100 AS c FROM t WHERE (pos * 37) % 100 > {TOKEN_CONFIDENCE}),
      one AS (SELECT rec_id, string_agg(tok, ' ' ORDER BY pos) AS text, round(avg(CAST(c AS DOUBLE)), 6) AS confidence,
              count(*) AS n_tokens FROM kept GROUP BY rec_id)
      SELECT doc_id AS rec_id, coalesce(one.text, '') AS text, coalesce(confidence, 0) AS confidence,
      coalesce(n_tokens, 0) AS n_tokens FROM documents LEFT JOIN one ON one.rec_id = doc_id""",
    "a11_totals": "SELECT count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages",
    "a12_rate": """SELECT processed, errors, round(up, 6) AS uptime_s, round(processed / up * 60, 6) AS per_minute FROM (
      SELECT count(*) AS processed, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors,
      CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000 AS up FROM events)""",
    "a13_latency": """SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
      CAST(epoch_us(CAST(l_shipdate AS TIMESTAMP)) - epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS DOUBLE) / 1000000 AS seconds
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "a13_quantiles": """SELECT l_returnflag, i, count(*) AS n, true AS within FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey, range(5) AS r(i) GROUP BY ALL""",
    "w1_stratified_split": f"WITH {DOCS} SELECT rec_id, source_site, difficulty, split FROM ({split_of('docs', STRATA)})",
    "w2_global_split": f"WITH {DOCS} SELECT rec_id, split FROM ({split_of('docs', '')})",
    "w3_split_order": f"""WITH {DOCS}, s AS ({split_of('docs', '')}) SELECT rec_id, split,
      row_number() OVER (PARTITION BY split ORDER BY md5('43:' || rec_id)) AS rank FROM s""",
    "w4_shards": f"""WITH {DOCS}, s AS ({split_of('docs', '')}) SELECT rec_id, split,
      CASE WHEN count(*) OVER (PARTITION BY split) > {SHARD_SIZE}
      THEN (row_number() OVER (PARTITION BY split ORDER BY md5('43:' || rec_id)) - 1) // {SHARD_SIZE} END AS shard FROM s""",
    "w5_last10": """WITH kept AS (SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)
      AS before FROM events) WHERE event_type IS DISTINCT FROM before)
      SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n
      FROM kept) WHERE n <= 10""",
    "v1_variants": f"""WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN n_chars % 7 = 0 THEN '' ELSE text END AS code,
        {b.LANGUAGE} AS l, CASE WHEN n_chars % 5 = 0 THEN 'mcq' ELSE 'coding' END AS kind, n_chars FROM documents)
      SELECT id AS rec_id, id AS problem_id, code AS solution_code, l AS language, kind AS question_type,
        n_chars AS time_limit, 'original' AS variant_kind FROM r
      UNION ALL SELECT id || '_' || t, id || '_' || t, code, t, kind, NULL, 'copied' FROM r
      CROSS JOIN (VALUES ('python'), ('java'), ('cpp'), ('javascript')) AS targets(t)
      WHERE kind = 'coding' AND code <> '' AND NOT contains(lower(l), t)""",
    "v2_rewritten": f"""WITH r AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, {b.FUNCTION_CODE} AS code, n_chars,
        CASE WHEN lang = 'en' THEN 'Python' ELSE lang END AS l FROM documents)
      SELECT id AS rec_id, l AS language, code AS solution_code, 'original' AS variant_kind FROM r
      UNION ALL SELECT id || '_' || t, t, CASE WHEN l <> 'Python' THEN code ELSE
        CASE t WHEN 'cpp' THEN 'auto f' || doc_id || '(auto a, auto b)'
               WHEN 'java' THEN 'public static Object f' || doc_id || '(auto a, auto b)'
               ELSE 'function f' || doc_id || '(a, b)' END
        || ' {{' || {_NL} || '    return a + ' || n_chars || ';' || {_NL} || '}}' END,
        CASE WHEN l <> 'Python' THEN 'copied' ELSE 'rewritten' END
      FROM r CROSS JOIN (VALUES ('python'), ('java'), ('cpp'), ('javascript')) AS targets(t)
      WHERE NOT contains(lower(l), t)""",
    "v3_score_batches": f"""WITH {QA}, p AS (SELECT rec_id, length(question_text) + 21 AS n FROM qa)
      SELECT rec_id, CASE WHEN n % 2 = 0 THEN 'Use ```python' || {_NL} || 'print(' || n || ')' || {_NL} || '```'
        ELSE 'Error: Could not generate response' END AS response,
      CASE WHEN n % 2 = 0 THEN 'print(' || n || ')' ELSE 'Error: Could not generate response' END AS code,
      n % 2 <> 0 AS failed FROM p""",
    "s4_entries": "SELECT source, 'csv' AS format, count(*) AS entries FROM documents GROUP BY source",
    "s6_csv_scan": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents",
    "s7_tsv_scan": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, n_name
      FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "s8_json_scan": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents",
    "s15_archives": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents",
    "s10_text_scan": """SELECT page_id, rtrim(translate(url, chr(13) || chr(10), '  '), chr(10)) AS content FROM pages""",
    "s12_html_scan": f"SELECT page_id, rtrim({html(S12_HTML)}, chr(10)) AS text FROM pages",
    "s13_xml_scan": """SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation
      FROM supplier""",
    "s1_inventory": f"{TREE} SELECT folder, format, n_files AS files, n_files AS filled FROM tree",
    "f7_supported": f"{TREE} SELECT suffix, format, n_files AS files FROM tree",
    "s3_estimates": f"""{TREE} SELECT folder, format, CASE WHEN format = 'txt' THEN n_files
      WHEN format = 'csv' THEN n_files + n_rows ELSE n_rows END AS estimated_rows FROM tree""",
    "s4_tree_entries": f"{TREE} SELECT folder, format, n_rows AS entries FROM tree",
    "s5_routing": f"""{TREE} SELECT folder AS dataset, format, n_files AS files, n_files AS paths FROM tree
      WHERE folder IN ('codeforces', 'hackerearth')""",
    "s16_rejects": f"""{TREE}, bad AS (SELECT count(*) FILTER (WHERE s_suppkey % 3 = 0) AS n FROM supplier), r AS (
      SELECT format, sum(CASE WHEN format = 'txt' THEN n_files ELSE n_rows END) AS n FROM tree GROUP BY format)
      SELECT format, CAST(r.n AS BIGINT) - CASE WHEN format = 'jsonl' THEN bad.n ELSE 0 END AS good,
      CASE WHEN format = 'jsonl' THEN bad.n ELSE 0 END AS rejected, CAST(r.n AS BIGINT) AS ids FROM r, bad""",
    "s9_jsonl_scan": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents WHERE lang <> 'es'",
    "s11_text_records": f"""SELECT doc_id AS rec_id, substr(text, 1, 2000) AS question_text, 'coding' AS question_type,
      source AS source_site, CAST(doc_id AS VARCHAR) AS problem_id FROM documents WHERE length({strip('text')}) >= 10""",
    "s14_parquet_groups": "SELECT CAST(doc_id AS VARCHAR) AS id, text, CASE WHEN length(source) % 2 = 0 THEN lang END AS lang, source AS folder FROM documents",
    "s14_parquet_scan": "SELECT CAST(doc_id AS VARCHAR) AS id, text, lang FROM documents",
    "k1_split_files": f"""WITH {DOCS} SELECT CAST(rec_id AS VARCHAR) AS rec_id, split, question_text, source_site,
      source_site || '|' || difficulty AS tags, length(question_text) AS memory_limit FROM ({split_of('docs', STRATA)})""",
    "k2_shard_files": f"""WITH {DOCS}, s AS ({split_of('docs', '')}) SELECT CAST(rec_id AS VARCHAR) AS rec_id, split,
      CASE WHEN count(*) OVER (PARTITION BY split) > {SHARD_SIZE} THEN lpad(CAST((row_number() OVER (PARTITION BY split
      ORDER BY md5('43:' || rec_id)) - 1) // {SHARD_SIZE} AS VARCHAR), 3, '0') ELSE 'all' END AS shard,
      length(question_text) AS n_chars FROM s""",
    "k3_manifest": f"""WITH {DOCS}, coded AS (SELECT *, 'coding' AS question_type FROM docs), s AS ({split_of('coded', STRATA)})
      {manifest_of('s')} UNION ALL SELECT 'shards', split,
      CASE WHEN count(*) > {SHARD_SIZE} THEN CAST(ceil(count(*) / CAST({SHARD_SIZE} AS DOUBLE)) AS BIGINT) ELSE 1 END FROM s GROUP BY split
      UNION ALL SELECT 'output_format', 'jsonl', 1
      UNION ALL SELECT 'shard', split || '/' || CASE WHEN n <= {SHARD_SIZE} THEN 'all' ELSE lpad(CAST(i AS VARCHAR), 3, '0') END,
      least({SHARD_SIZE}, n - i * {SHARD_SIZE}) FROM (SELECT split, n, unnest(range(CAST(ceil(n / {SHARD_SIZE}.0) AS BIGINT))) AS i
      FROM (SELECT split, count(*) AS n FROM s GROUP BY split))""",
    "z2_by_dataset": f"""WITH {PATHS}, u AS (SELECT doc_id AS rec_id, {strip('text')} AS question_text,
      CAST(doc_id AS VARCHAR) AS problem_id, {question_type_by_parts('text')} AS question_type FROM paths
      WHERE {strip('text')} <> '') SELECT rec_id, question_text, problem_id, question_type, split FROM ({split_of('u', '')})""",
    "z3_verification": f"WITH {DOCS}, {CORPUS}, s AS ({split_of('corpus', STRATA)}) {summary_of('s')}",
    "z4_training_items": f"""WITH {DOCS}, s AS ({split_of('docs', STRATA)}) SELECT CAST(rec_id AS VARCHAR) AS rec_id, split,
      'Question: ' || t || {_NL} || {_NL} || 'Solution:' || {_NL} || {_NL} || t || {_NL} || {_NL} || 'Difficulty: '
      || difficulty || {_NL} || {_NL} AS text FROM (SELECT *, {strip('question_text')} AS t FROM s)
      WHERE length(t) BETWEEN 50 AND 2000""",
    "r1_stream_questions": f"WITH {EVENTS} SELECT event_id, text, true AS is_question FROM captured WHERE text <> '' AND {is_question('text')}",
    "r2_stream_consecutive": """WITH kept AS (SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id
      ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before)
      SELECT event_id, user_id, event_type, least(10, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS history_size
      FROM kept""",
    "r2_stream_history": """WITH kept AS (SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id
      ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before)
      SELECT event_id, user_id, event_type FROM kept
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10""",
    "r6_stream_bounded": "SELECT event_id, event_type FROM events",
    "r3_stream_gate": f"""WITH {EVENTS} SELECT event_id, text, confidence FROM captured
      WHERE confidence >= 70 AND {is_question('text')} AND length(text) BETWEEN 20 AND 2000""",
    "r4_stream_responses": f"""WITH {EVENTS}, p AS (SELECT event_id, length(text) + 21 AS n FROM captured
      WHERE confidence >= 70 AND {is_question('text')} AND length(text) BETWEEN 20 AND 2000)
      SELECT event_id, CASE WHEN n % 2 = 0 THEN 'Use ```python' || {_NL} || 'print(' || n || ')' || {_NL} || '```'
        ELSE 'Error: Could not generate response' END AS response,
      CASE WHEN n % 2 = 0 THEN 'print(' || n || ')' ELSE 'Error: Could not generate response' END AS code,
      n % 2 <> 0 AS failed FROM p""",
    "r5_stream_rates": """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n
      FROM events GROUP BY ALL""",
    "r7_event_ids": "SELECT count(*) AS events, count(DISTINCT event_id) AS ids FROM events",
}

_REFINED = f"""cleaned AS (SELECT * REPLACE ({clean('question_text')} AS question_text),
    {question_type('question_text')} AS question_type FROM docs),
  uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY md5({norm('question_text')}) ORDER BY rec_id) AS n
    FROM cleaned WHERE {valid('question_text', 'answer_text', 'solution_code')}) WHERE n = 1),
  {chatter_counts('uniq', 'rec_id', 'question_text')},
  good AS (SELECT * REPLACE ({primary('solution_code')} AS solution_code) FROM uniq LEFT JOIN chatter USING (rec_id)
    WHERE NOT coalesce({CHATTY}, false)),
  s AS ({split_of('good', STRATA)})"""
ORACLE["z1_consolidate"] = f"WITH {DOCS}, {_REFINED} {manifest_of('s')}"
ORACLE["z1_records"] = f"WITH {DOCS}, {_REFINED} SELECT rec_id, question_text, solution_code, question_type, split FROM s"

ORACLE["z1_from_files"] = f"""WITH {DOCS}, {_REFINED.replace(STRATA, "answer_text")}
  SELECT split, count(*) AS n FROM s GROUP BY split UNION ALL SELECT 'total', count(*) FROM s"""

_SETS = f"""d AS (SELECT doc_id, list_sort(list_distinct(list_filter(string_split({norm("coalesce(text, '')")}, ' '), lambda w: w <> ''))) AS w
    FROM documents WHERE doc_id IS NOT NULL),
  c AS (SELECT w, min(doc_id) AS id FROM d GROUP BY w), t AS (SELECT id, len(w) AS n, unnest(w) AS word FROM c),
  shared AS (SELECT x.id AS a, y.id AS b, x.n + y.n AS sizes, count(*) AS shared FROM t x JOIN t y ON x.word = y.word AND x.id < y.id
    AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n GROUP BY ALL),
  pairs AS (SELECT a, b, shared, sizes - shared AS total FROM shared WHERE 100 * shared >= 80 * (sizes - shared))"""
ORACLE["j2_jaccard_pairs"] = f"WITH {_SETS} SELECT * FROM pairs"
ORACLE["j2_jaccard_links"] = f"""WITH {_SETS}, k AS (SELECT id, count(*) AS n FROM (SELECT unnest([a, b]) AS id FROM pairs) GROUP BY id)
  SELECT d.doc_id AS id, c.id AS class_id, coalesce(n, 0) AS n_links FROM d JOIN c USING (w) LEFT JOIN k ON k.id = c.id"""

ORACLE["r2_state"], ORACLE["r2_state_history"] = ORACLE["r2_stream_consecutive"], ORACLE["r2_stream_history"]
ORACLE["j4_digest_missing"] = ORACLE["j4_missing"]
ORACLE["r4_stream_join"] = """SELECT q.user_id, q.event_id, a.event_id AS answer_id, epoch_us(a.ts) - epoch_us(q.ts) AS micros
  FROM events q LEFT JOIN events a ON a.user_id = q.user_id AND a.event_type = 'purchase' AND a.ts >= q.ts
    AND a.ts <= q.ts + INTERVAL 6 HOURS WHERE q.event_type = 'view' AND q.ts IS NOT NULL AND q.user_id IS NOT NULL"""
ORACLE["a12_backlog"] = f"""WITH {EVENTS}, p AS (SELECT length(text) + 21 AS n FROM captured
    WHERE confidence >= 70 AND {is_question('text')} AND length(text) BETWEEN 20 AND 2000),
  t AS (SELECT (SELECT count(*) FROM events) AS rows, (SELECT count(*) FROM p) AS processed,
    (SELECT count(*) FROM p WHERE n % 2 = 0) AS generated)
  SELECT rows, 0 AS backlog_end, rows AS captured, processed, generated, rows - processed AS waiting, processed - generated AS unanswered FROM t"""
ORACLE["v3_bucketed"] = ORACLE["v3_score_batches"]
