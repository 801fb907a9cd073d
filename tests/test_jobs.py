"""Whole jobs on files, and the operators around them."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dedup, mapping, scoring, splits, stats, variants
from corpusloom.plans import consolidate as jobs, training, verify
from corpusloom.queries.catalog import length_scorer
from corpusloom.sinks import writers
from corpusloom.sources import corpus, readers


@pytest.fixture(scope="module")
def four_records(tmp_path_factory):
    root = tmp_path_factory.mktemp("four")
    (root / "test.csv").write_text(
        'Question,Answer\n"Write a function that adds\ntwo numbers together","def add(a, b):\n    return a + b"\n'
        '"Explain how a binary search works on lists","It halves the list\nat every step."\n')
    lines = [
        {"text": "Write a function to reverse a string in place", "code": "def r(s):\n    return s[::-1]",
         "task_id": 1, "test_list": ["assert r('a') == 'a'"]},
        {"text": "Write a function to find the maximum of a list", "code": "def m(x):\n    return max(x)",
         "task_id": 2, "test_list": ["assert m([1]) == 1"]}]
    (root / "test.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    return str(root)


def test_four_records_end_to_end(spark, four_records, tmp_path):
    out = str(tmp_path / "out")
    split = jobs.consolidate(spark, four_records, out, create_variants=False, shard_size=1,
                             output_formats=("jsonl", "parquet"))
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 3, "test": 1}
    assert {r.source_site for r in split.collect()} == {"unknown"}
    back = corpus.read_splits(spark, f"{out}/jsonl")
    assert back.count() == 4
    tests = {tuple(r.test_cases) for r in back.collect()}
    assert ("assert r('a') == 'a'",) in tests
    manifest = {(r.metric, r.key): r.n for r in corpus.read_manifest(spark, out).collect()}
    assert manifest[("total", "")] == 4 and manifest[("split", "train")] == 3 and manifest[("shards", "train")] == 3
    assert spark.read.parquet(f"{out}/parquet").count() == 4
    items = training.prepare_training(spark, f"{out}/jsonl")
    assert items.count() == 0  # no question has 50 characters


def test_dataset_profile_and_verification(spark, tmp_path):
    root = tmp_path / "in"
    (root / "leetcode-data").mkdir(parents=True)
    (root / "description2code_current" / "codechef" / "x").mkdir(parents=True)
    (root / "leetcode-data" / "a.jsonl").write_text("\n".join([
        json.dumps({"content": " Two Sum ", "title": "two-sum", "difficulty": "EASY", "python": "pass", "java": ""}),
        json.dumps({"description": "used when absent", "slug": "s", "difficulty": None}),
        json.dumps({"content": "", "description": "not used", "title": "t"})]) + "\n")
    (root / "description2code_current" / "codechef" / "x" / "p1.txt").write_text("A problem of some length")
    (root / "description2code_current" / "codechef" / "short.txt").write_text("tiny")
    (root / "q.csv").write_text("id,question,answer\n5,What?,Because\n")
    out = str(tmp_path / "out")
    split = jobs.consolidate_by_dataset(spark, str(root), out)
    got = sorted((r.source_site, r.question_text, r.solution_code, r.problem_id, r.difficulty)
                 for r in split.collect())
    assert got == [
        ("codechef", "A problem of some length", "", "p1", ""), ("generic", "What?", "Because", "5", ""),
        ("leetcode", "Two Sum", "# python\npass", "two-sum", "easy"), ("leetcode", "used when absent", "", "s", "")]
    report = verify.verify(spark, str(root), f"{out}/jsonl", str(tmp_path / "report"))
    coverage = {r.dataset: (r.original, r.consolidated) for r in report["coverage"].collect()}
    assert coverage == {"codechef": (2, 1), "generic": (1, 1), "leetcode": (3, 2), "total": (6, 4)}
    summary = report["summary"].first()
    assert summary.files == 4 and summary.datasets == 3 and verify.is_accepted(report["summary"])


def test_rerun_does_not_read_its_own_output(spark, four_records):
    out = f"{four_records}/consolidated"
    jobs.consolidate(spark, four_records, out, create_variants=False)
    again = jobs.consolidate(spark, four_records, out, create_variants=False)
    assert again.count() == 4


@pytest.mark.parametrize("n,expected", [(1, (0, 0, 1)), (3, (2, 0, 1)), (4, (3, 0, 1)), (19, (17, 0, 2)),
                                        (20, (18, 1, 1)), (21, (18, 1, 2)), (100, (90, 5, 5))])
def test_split_sizes(spark, n, expected):
    df = spark.range(n).select(F.col("id").alias("rec_id"), F.lit("s").alias("source_site"),
                               F.lit(None).cast("string").alias("difficulty"))
    got = {r.split: r["count"] for r in splits.stratified_split(df).groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "validation", "test")) == expected


def test_split_of_hot_stratum_equals_plain_ranking(spark):
    df = spark.range(3000).select(
        F.col("id").alias("rec_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7))
        .alias("source_site"), (F.col("id") % 2).cast("string").alias("difficulty"))
    from pyspark.sql import Window
    w = Window.partitionBy("source_site", "difficulty")
    rank = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("42:"), F.col("rec_id").cast("string")))))
    n = F.count("*").over(w)
    train, last = splits.split_limits(n, 0.9, 0.05)
    plain = df.select("rec_id", F.when(rank <= train, "train").when(rank <= last, "validation").otherwise("test")
                      .alias("split"))
    got = splits.stratified_split(df).select("rec_id", "split")
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_shards_are_full_and_ordered(spark, tmp_path):
    df = spark.range(250).select(F.col("id").cast("string").alias("rec_id"), F.lit("train").alias("split"))
    writers.write_shards(df, str(tmp_path), 100, ("parquet",))
    sizes = {r.shard: r["count"] for r in spark.read.schema("rec_id string, split string, shard string")
             .parquet(f"{tmp_path}/parquet").groupBy("shard").count().collect()}
    assert sizes == {"000": 100, "001": 100, "002": 50}


def test_first_copy_is_kept_and_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(3, "A  b"), (1, "a b!"), (2, "c"), (4, "C.")], "rec_id int, question_text string")
    once = dedup.exact_dedup(df)
    assert sorted(r.rec_id for r in once.collect()) == [1, 2]
    assert sorted(r.rec_id for r in dedup.exact_dedup(once).collect()) == [1, 2]


def test_truthiness_of_candidates(spark):
    cases = {"null": "next", '""': "next", "0": "next", "false": "next", "[]": "next", "{}": "next", '"0"': "0",
             '" "': " ", "1.0": "1", "true": "true", "[1]": "[1]"}
    rows = [(i, '{"a": %s, "b": "next"}' % value, "/data/misc") for i, value in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, raw string, src_path string").withColumn("record", F.try_parse_json("raw"))
    mapped = mapping.map_fields(df, tables={"unknown": {"question_text": ["missing", "a", "b"]}})
    assert [r.question_text for r in mapped.orderBy("i").collect()] == list(cases.values())


def test_variants_and_rewriting(spark, rows):
    data = [("1", "coding", "def f(a, b):\n    x = 1\n    return a + b", "Python"), ("2", "coding", "x", "c++"),
            ("3", "coding", "y", "javascript"), ("4", "mcq", "z", ""), ("5", "coding", "", ""),
            ("6", "coding", "def broken(", "python"), ("7", "coding", "class A: pass", "python")]
    df = spark.createDataFrame([(a, a, b, c, d) for a, b, c, d in data],
                               "rec_id string, problem_id string, question_type string, solution_code string, language string")
    out = variants.language_variants(df)
    kinds = {(r.rec_id, r.language): (r.variant_kind, r.solution_code) for r in out.collect()}
    assert kinds[("1_cpp", "cpp")] == ("rewritten", "auto f(auto a, auto b) {\n    return a + b;\n}")
    assert kinds[("1_javascript", "javascript")] == ("rewritten", "function f(a, b) {\n    return a + b;\n}")
    assert kinds[("6_java", "java")] == ("copied", "def broken(")
    assert ("1_python", "python") not in kinds and ("3_java", "java") not in kinds
    assert kinds[("2_cpp", "cpp")] == ("copied", "x")
    assert sum(1 for k in kinds if k[0].startswith(("4", "5"))) == 2


def test_scoring_isolates_failures(spark):
    df = spark.createDataFrame([(i, "q" * i) for i in range(9)], "rec_id int, question_text string")
    done = scoring.score_batches(df, length_scorer).collect()
    assert all(r.failed == (len(r.prompt) % 2 == 1) for r in done)
    assert {r.response for r in done if r.failed} == {scoring.FAILURE}


def test_merged_quantiles_of_windows(spark):
    rows = spark.range(20_000).selectExpr("id % 24 AS hour", "CASE WHEN id % 5 = 0 THEN 7 ELSE id END AS v", "id % 2 AS g")
    sketches = stats.quantile_sketches(rows, F.col("v"), "g", "hour")
    merged = {r.g: r for r in stats.merged_quantiles(sketches, (0.1, 0.5, 0.9), "g").collect()}
    assert all(merged[g].n == 10_000 for g in (0, 1))
    for g in (0, 1):
        ordered = sorted(7 if i % 5 == 0 else i for i in range(20_000) if i % 2 == g)
        for rank, value in zip((0.1, 0.5, 0.9), merged[g].quantiles):
            below, up_to = sum(v < value for v in ordered), sum(v <= value for v in ordered)
            assert below - 200 <= rank * 10_000 <= up_to + 200
    none = stats.quantile_sketches(rows.selectExpr("CAST(NULL AS BIGINT) AS v", "g"), F.col("v"), "g")
    assert [(r.n, r.quantiles) for r in stats.merged_quantiles(none, (0.5,), "g").collect()] == [(0, None)] * 2


def test_bucketed_scoring_batches_by_length_and_halves(spark):
    rows = [(i, "x" * (10 + i % 7 * 30)) for i in range(200)] + [(900, "bad one"), (901, None), (902, "y" * 5000)]
    df = spark.createDataFrame(rows, "rec_id bigint, question_text string")
    calls = spark.sparkContext.accumulator(0)
    overhead = len(scoring_prompt(spark, ""))

    def scorer(prompts):
        calls.add(1)
        assert len(prompts) == 1 or len(prompts) * max(map(len, prompts)) <= 4000
        if any("bad one" in p for p in prompts):
            raise ValueError
        return [str(len(p)) for p in prompts]

    done = {r.rec_id: r for r in scoring.score_bucketed(df, scorer, budget=4000, partitions=1).collect()}
    assert len(done) == len(rows) and sorted(k for k, r in done.items() if r.failed) == [900, 901]
    assert all(done[i].response == str(len(t) + overhead) for i, t in rows if i < 200 or i == 902)
    assert calls.value < 60  # row by row there are 203


def scoring_prompt(spark, text):
    from corpusloom.operators.mapping import prompt
    return spark.createDataFrame([(text,)], "q string").select(prompt(F.col("q"))).first()[0]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "rec_id string, split string, source_site string, difficulty string, "
                                      "language string, question_type string")
    assert stats.quality_score(empty).first().score == 0.0
    report = {(r.metric, r.key): r.pct for r in stats.quality_report(empty).collect()}
    assert report[("split", "train")] == 0.0
    assert stats.manifest(empty).isEmpty()


def test_invalid_records_are_dropped_by_a_custom_rule(spark, four_records):
    rule = F.contains(F.col("question_text"), F.lit("reverse"))
    assert jobs.read_normalised(spark, four_records, ("csv", "jsonl"), valid=rule).count() == 1


def test_bad_records_are_reported(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "ok"}\nnope\n')
    records = readers.read_records(spark, str(tmp_path), ("jsonl",))
    assert [r.raw for r in readers.rejected_records(records).collect()] == ["nope"]


def test_command_line(spark, four_records, tmp_path):
    from corpusloom.__main__ import main
    out = str(tmp_path / "out")
    assert main(["consolidate", "--root", four_records, "--output", out, "--no-variants"]) == 0
    assert main(["verify", "--root", four_records, "--corpus", f"{out}/jsonl", "--output", str(tmp_path / "r")]) == 0
    assert main(["training", "--corpus", f"{out}/jsonl", "--output", str(tmp_path / "t")]) == 0
    assert main(["inventory", "--root", four_records, "--output", str(tmp_path / "i")]) == 0
    empty = tmp_path / "none"
    (empty / "split=train").mkdir(parents=True)
    (empty / "split=train" / "a.json").write_text("not a record\n")
    assert main(["verify", "--root", four_records, "--corpus", str(empty), "--output", str(tmp_path / "r2")]) == 1


def test_consolidation_reads_its_inputs_once(spark, four_records, tmp_path, monkeypatch):
    read, calls = readers.read_records, []
    monkeypatch.setattr(readers, "read_records", lambda *a, **k: calls.append(1) or read(*a, **k))
    jobs.consolidate(spark, four_records, str(tmp_path / "once"), create_variants=False)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert len(calls) == 1
    assert scans(jobs.read_unified(spark, four_records, ("txt", "xml"))) == scans(read(spark, four_records, ("txt", "xml")))
