"""Nothing of an input is lost: long values, wide tables, odd paths, repeated records."""

import io
import json
import os
import time

import pytest

from corpusloom.operators import dedup, mapping
from corpusloom.plans import consolidate
from corpusloom.sinks import writers
from corpusloom.sources import corpus, inventory, jsonstream, readers


def put(folder, name, content):
    path = os.path.join(str(folder), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w" if isinstance(content, str) else "wb", **({"newline": ""} if isinstance(content, str) else {})) as f:
        f.write(content)
    return path


def raws(df):
    return [r.raw for r in df.orderBy("src_path", "src_block", "src_row").collect()]


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_streamed_elements(size):
    values = [1, 22, -3.5e2, "a,]\"}", {"k": [1, {"x": "é\n"}]}, [], None, True, "🙂" * 50]
    text = " [ " + " ,\n".join(json.dumps(v, ensure_ascii=False) for v in values) + "\t]  "
    got = list(jsonstream.elements(io.BytesIO(text.encode()), size))
    assert [json.loads(g) for g in got] == values
    assert list(jsonstream.elements(io.BytesIO(b' {"a": [1]} '), size)) == ['{"a": [1]} ']
    assert list(jsonstream.elements(io.BytesIO(b"[1, {bad"), size)) == ["1", "{bad"]
    assert list(jsonstream.elements(io.BytesIO(b" "), size)) == []


def test_long_json_documents_are_streamed(spark, tmp_path):
    rows = [{"id": i, "text": "x" * 50} for i in range(300)]
    put(tmp_path, "a.json", json.dumps(rows))
    put(tmp_path, "b.json", "﻿" + json.dumps(rows[:2]))
    put(tmp_path, "c.json", json.dumps(rows[0]))
    whole, streamed = (readers.read_json(spark, str(tmp_path), n) for n in (1 << 20, 1000))
    assert raws(whole.select("*")) != [] and [json.loads(r) for r in raws(whole)] == [json.loads(r) for r in raws(streamed)]
    assert readers.good_records(streamed).count() == 303
    ids = [r.rec_id for r in streamed.collect()]
    assert len(set(ids)) == len(ids)


@pytest.mark.parametrize("limit", [5, 1 << 20])
def test_one_rule_for_damaged_json(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(inventory, "JSON_BYTES", limit)
    put(tmp_path, "a.json", '[{"a":1},{"a":2},{"a":3}, {"a":')
    put(tmp_path, "b.json", '\ufeff[{"a":4}, "text", "{\\"a\\": 5}", null, 7, [8]]')
    put(tmp_path, "c.json", '{"a": 6')
    records = readers.read_json(spark, str(tmp_path), limit)
    assert [json.loads(r)["a"] for r in raws(readers.good_records(records))] == [4, 5]
    bad = sorted((os.path.basename(r.src_path), r.raw or "", r.reason) for r in readers.rejected_records(records).collect())
    assert bad == [("a.json", '[{"a":1},{"a":2},{"a":3}, {"a":', "bad JSON"), ("b.json", "", "unreadable"), ("b.json", "7", "no object"),
                   ("b.json", "[8]", "no object"), ("b.json", "text", "bad JSON"), ("c.json", '{"a": 6', "bad JSON")]
    files = inventory.exact_entries(spark, str(tmp_path), inventory.list_files(spark, str(tmp_path)))
    assert {os.path.basename(r.path): r.entries for r in files.collect()}["a.json"] == 0


def test_long_files_are_spread_and_elements_bounded(spark, tmp_path):
    for i in range(24):
        put(tmp_path, f"{i}.json", json.dumps([{"a": i}]))
    files = inventory.whole_files(spark, str(tmp_path), "*.json", 1).filter("too_long")
    assert jsonstream.json_items(files).rdd.getNumPartitions() == 24
    assert list(jsonstream.elements(io.BytesIO(b'[1, "' + b"x" * 999), 10, 100)) == ["1", None]
    assert list(jsonstream.elements(io.BytesIO(b"x" * 999), 10, 100)) == [None]


def test_json_array_beyond_a_variant(spark, tmp_path):
    line = json.dumps({"text": "y" * 1_000_000})
    put(tmp_path, "big.json", "[" + ",".join([line] * 140) + "]")
    assert readers.good_records(readers.read_json(spark, str(tmp_path))).count() == 140
    files = inventory.exact_entries(spark, str(tmp_path), inventory.list_files(spark, str(tmp_path)))
    assert [r.entries for r in files.collect()] == [140]


def test_long_strings_and_equal_keys(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"text":"one","text":"two"}\n' + json.dumps({"text": "z" * 21_000_000}) + "\n{bad\n")
    good = readers.good_records(readers.read_jsonl(spark, str(tmp_path)))
    got = good.selectExpr("length(try_variant_get(record, '$.text', 'string')) AS n").collect()
    assert sorted(r.n for r in got) == [3, 21_000_000]


@pytest.mark.parametrize("head", ["\nid,question,answer", '"id\nno",question,answer', '"a\n\n",\n"b\n""x"",\nc",d'.replace(",\n", ","),
                                  "\n\n  \nid,question,answer".replace("  \n", "")])
def test_tables_keep_all_columns(spark, tmp_path, head):
    put(tmp_path, "t.csv", head + "\n1,q,a\n")
    record = json.loads(raws(readers.read_csv(spark, str(tmp_path)))[0])
    assert list(record.values()) == ["1", "q", "a"]


def test_header_of_many_lines(spark, tmp_path):
    names = [f"n{i}\nx" for i in range(40)]
    put(tmp_path, "t.csv", ",".join(f'"{n}"' for n in names) + "\n" + ",".join(f'"v{i}\n"' for i in range(40)) + "\n")
    record = json.loads(raws(readers.read_csv(spark, str(tmp_path)))[0])
    assert record == {n: f"v{i}\n" for i, n in enumerate(names)}


def test_texts_full_of_separators(spark, tmp_path):
    put(tmp_path, "a.csv", "id,text\n1,\"" + ",x" * 100_000 + "\"\n2,b" + ",c" * 30_000 + "\n" + "3,d\n" * 2000)
    put(tmp_path, "b.csv", ",".join(f"n{i}" for i in range(200)) + "\n" + ",".join(map(str, range(200))) + "\n")
    start = time.monotonic()
    got = [json.loads(r) for r in raws(readers.read_csv(spark, str(tmp_path)))]
    assert time.monotonic() - start < 20
    assert got[0] == {"id": "1", "text": ",x" * 100_000} and got[1] == {"id": "2", "text": "b"}
    assert got[2:2002] == [{"id": "3", "text": "d"}] * 2000 and got[2002] == {f"n{i}": str(i) for i in range(200)}


def test_tables_of_two_encodings(spark, tmp_path):
    put(tmp_path, "a.csv", "naïve,b,b\né,ü€,\n,,2\n".encode())
    put(tmp_path, "b.csv", "naïve,b\né,ü\n".encode("latin-1"))
    put(tmp_path, "c.csv", "\ufeffnaïve,b\n€é,ü\n".encode())
    got = [json.loads(r) for r in raws(readers.read_csv(spark, str(tmp_path)))]
    assert got == [{"naïve": "é", "b": "ü€"}, {"b": "2"}, {"naïve": "é", "b": "ü"}, {"naïve": "€é", "b": "ü"}]


def test_paths_that_need_escapes(spark, tmp_path):
    root = tmp_path / "my data+%41"
    put(root, "a é.csv", "text\none\ntwo\n")
    put(root, "b {x}[1]/c*.jsonl", '{"text":"three"}\n')
    files = inventory.exact_entries(spark, str(root), inventory.list_files(spark, str(root)))
    assert {(r.relative_path, r.entries) for r in files.collect()} == {("a é.csv", 2), ("b {x}[1]/c*.jsonl", 1)}
    paths = {r.src_path for r in readers.read_records(spark, str(root), ("csv", "jsonl")).collect()}
    assert paths == {r.path for r in files.collect()}


def test_relative_root_and_output(spark, tmp_path, monkeypatch):
    work = spark._jvm.java.lang.System.getProperty("user.dir")
    root = os.path.relpath(str(tmp_path), work)
    put(tmp_path, "leetcode-x.jsonl", '{"text":"a question that is long enough","title":"t"}\n')
    put(tmp_path, "out/jsonl/old.jsonl", '{"text":"an output of an earlier run"}\n')
    assert readers.read_records(spark, root, ("jsonl",), exclude=f"{root}/out").count() == 1
    assert {r.relative_path for r in inventory.list_files(spark, root).collect()} == \
        {"leetcode-x.jsonl", "out/jsonl/old.jsonl"}


def test_parquet_folders_with_keys(spark, tmp_path):
    spark.createDataFrame([("one",)], "text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t[a]")
    spark.createDataFrame([("two",), ("three",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/t[a]/k=1")
    got = readers.read_parquet(spark, str(tmp_path))
    assert sorted(json.loads(r)["text"] for r in raws(got)) == ["one", "three", "two"]
    files = inventory.exact_entries(spark, str(tmp_path), inventory.list_files(spark, str(tmp_path)))
    assert sum(r.entries for r in files.filter("format = 'parquet'").collect()) == 3


def test_own_tables_reach_parquet_columns(spark, tmp_path):
    spark.createDataFrame([("What is a heap, and why?",)], "my_text string").coalesce(1).write.parquet(f"{tmp_path}/p")
    tables = {"unknown": {"question_text": ["my_text"]}}
    got = consolidate.read_normalised(spark, str(tmp_path), ("parquet",), tables=tables, valid=readers.F.lit(True))
    assert [r.question_text for r in got.collect()] == ["What is a heap, and why?"]


def test_empty_files_are_listed(spark, tmp_path):
    put(tmp_path, "a.csv", "")
    put(tmp_path, "deep/er/k=1/b é.txt", "x")
    put(tmp_path, "deep/_hidden.txt", "x")
    os.makedirs(tmp_path / "empty folder")
    files = inventory.list_files(spark, str(tmp_path))
    assert {(r.relative_path, r.format, r.length) for r in files.collect()} == {("a.csv", "csv", 0), ("deep/er/k=1/b é.txt", "txt", 1)}
    assert files.filter("modificationTime IS NULL").isEmpty()
    entries = inventory.exact_entries(spark, str(tmp_path), files)
    assert {r.relative_path: r.entries for r in entries.collect()} == {"a.csv": 0, "deep/er/k=1/b é.txt": 1}
    assert inventory.list_files(spark, str(tmp_path / "empty folder")).isEmpty()


def test_guessed_formats_are_read(spark, tmp_path):
    put(tmp_path, "a.txt", "plain")
    put(tmp_path, "b.MD", "# mark")
    put(tmp_path, "c.htm", "<p>x</p>")
    listed = {r.relative_path for r in inventory.list_files(spark, str(tmp_path)).filter("format = 'txt'").collect()}
    read = {os.path.basename(r.src_path) for r in readers.read_text(spark, str(tmp_path)).collect()}
    assert listed == read == {"a.txt", "b.MD", "c.htm"}


def test_a_file_too_long_for_a_value_is_rejected_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "WHOLE_BYTES", 100)
    put(tmp_path, "a.txt", "short")
    put(tmp_path, "b.txt", "long" * 100)
    records = readers.read_text(spark, str(tmp_path))
    assert readers.good_records(records).count() == 1
    assert [os.path.basename(r.src_path) for r in readers.rejected_records(records).collect()] == ["b.txt"]


def test_equal_lines_have_ids_of_their_own(spark, tmp_path):
    line = json.dumps({"text": "How do I reverse a linked list in place?", "code": "def f(): pass"})
    put(tmp_path, "a.jsonl", "\n".join([line] * 20) + "\n")
    records = readers.read_jsonl(spark, str(tmp_path))
    assert sorted(r.src_row for r in records.collect()) == list(range(20))
    for threshold in (1.0, 0.9):
        unified = consolidate.read_normalised(spark, str(tmp_path), ("jsonl",))
        refined = consolidate.refine(unified, consolidate.RECORD_ORDER, threshold, create_variants=False)
        assert [r.src_row for r in refined.collect()] == [0]


def test_ids_do_not_depend_on_the_cut(spark, tmp_path):
    put(tmp_path, "a.jsonl", "".join(json.dumps({"n": i}) + "\n" for i in range(3000)))
    one = {r.raw: r.rec_id for r in readers.read_jsonl(spark, str(tmp_path)).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        two = {r.raw: r.rec_id for r in readers.read_jsonl(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert one == two and len(set(one.values())) == 3000


def test_near_copies_keep_the_first_in_file_order(spark, tmp_path):
    base = "What is the difference between a stack and a queue in terms of order of removal, in short? "
    put(tmp_path, "a.jsonl", "".join(json.dumps({"text": base + str(i)}) + "\n" for i in range(12)))
    unified = consolidate.read_normalised(spark, str(tmp_path), ("jsonl",), valid=readers.F.lit(True))
    refined = consolidate.refine(unified, consolidate.RECORD_ORDER, 0.9, create_variants=False)
    assert [r.src_row for r in refined.collect()] == [0]


def test_null_times_stay(spark):
    rows = spark.createDataFrame([(1, 1, None, "a"), (1, 2, None, "b"), (1, 3, "2024-01-01 00:00:00", "b")],
                                 "k int, id int, t string, text string").withColumn("t", readers.F.col("t").cast("timestamp"))
    got = dedup.drop_consecutive(rows, "k", "text", "t", "id").collect()
    assert sorted(r.id for r in got) == [1, 2]


def test_lists_are_arrays_in_split_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", "train", ["a", "b"])], "rec_id string, split string, tags array<string>")
    writers.write_splits(rows, str(tmp_path / "o"))
    lines = [line for r in spark.read.text(str(tmp_path / "o")).collect() for line in [r.value]]
    assert json.loads(lines[0])["tags"] == ["a", "b"]


def test_a_target_in_no_table(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"q":"Some question text here"}\n')
    records = readers.good_records(readers.read_jsonl(spark, str(tmp_path)))
    got = mapping.normalise(records, tables={"unknown": {"question_text": ["q"]}}, valid=readers.F.lit(True)).collect()
    assert [r.question_text for r in got] == ["Some question text here"]


def test_rejects_are_written_and_counted(spark, tmp_path):
    put(tmp_path / "in", "a.jsonl", '{"text":"What is a red-black tree good for?"}\n{bad\n[1]\n')
    put(tmp_path / "in", "b.json", '{"text": ')
    out = str(tmp_path / "out")
    consolidate.consolidate(spark, str(tmp_path / "in"), out, ("jsonl", "json"), create_variants=False, shard_size=1)
    got = {(os.path.basename(r.src_path), r.reason) for r in spark.read.parquet(f"{out}/rejected").collect()}
    assert got == {("a.jsonl", "bad JSON"), ("a.jsonl", "no object"), ("b.json", "bad JSON")}
    manifest = {(r.metric, r.key): r.n for r in corpus.read_manifest(spark, out).collect()}
    assert manifest["rejected", "jsonl/bad JSON"] == manifest["rejected", "jsonl/no object"] == 1
    assert manifest["output_format", "jsonl"] == 1
