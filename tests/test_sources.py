import gzip
import io
import json
import tarfile
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.operators.mapping import as_text, field
from corpusloom.queries import catalog
from corpusloom.sources import archives, inventory, readers


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "a.csv").write_bytes('id,question,answer\n1,"two\nlines, ""quoted""",x\n2,,é\n'.encode())
    (root / "sub" / "LATIN.CSV").write_bytes("text,extra,more\ncafé,1,\n".encode("latin-1"))
    (root / "bom.csv").write_bytes("﻿id,text\n7,bom\n".encode())
    (root / "t.tsv").write_text("id\ttext\n1\ta,b\n")
    (root / "lines.jsonl").write_text(
        '{"id": 1, "text": "one"}\n\n   \n{bad\n[1, 2]\n{"id": 2, "text": null}\n')
    (root / "list.json").write_text('[{"id": 1, "s": {"b": "1", "a": "2"}}, {"id": 2}]')
    (root / "object.json").write_text('{"id": 3,\n "text": "x"}')
    (root / "scalar.json").write_text("5")
    (root / "broken.json").write_text('[{"id": 1}, {')
    (root / "note.txt").write_bytes(b"first\n\nsecond \xff end\n")
    (root / "page.html").write_text("<html><script>'</p>'</script><p>A &amp; B</p></html>")
    (root / "doc.xml").write_text('<r x="1"><a>1</a><a>2</a><b><c>3</c></b>mixed<d/></r>')
    (root / "noext").write_text("x")
    (root / "odd.md").write_text("# x\n")
    (root / "empty.jsonl").write_text("")
    pq.write_table(pa.table({"id": [1, 2], "text": ["p", None], "unused": [1, 2]}), root / "sub" / "p.parquet")
    pq.write_table(pa.table({"id": ["x"], "question": ["q"]}), root / "sub" / "deep" / "p.parquet")
    (root / "sub" / "deep" / "cut.parquet").write_bytes(b"PAR1 truncated")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("inside.jsonl", '{"id": 99}\n')
    with zipfile.ZipFile(root / "z.zip", "w") as z:
        z.writestr("m/a.jsonl", '{"id": 10}\n{"id": 11}\n')
        z.writestr("m/b.csv", "id,text\n12,hi\n")
        z.writestr("m/bad.json", "{")
        z.writestr("m/c.html", "<p>page</p>")
        z.writestr("inner.zip", inner.getvalue())
    with tarfile.open(root / "t.tar.gz", "w:gz") as t:
        data = b'[{"id": 20}]'
        info = tarfile.TarInfo("x.json")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    (root / "broken.tgz").write_bytes(gzip.compress(b"not a tar"))
    return str(root)


def values(df, *names):
    good = readers.good_records(df)
    return sorted((tuple(r) for r in good.select(
        *[as_text(field(F.col("record"), n)).alias(n) for n in names]).collect()), key=str)


def test_inventory_formats_and_totals(spark, tree):
    files = inventory.list_files(spark, tree)
    found = {r.relative_path: r.format for r in files.collect()}
    assert found["sub/LATIN.CSV"] == "csv"
    assert found["t.tar.gz"] == "tar.gz"
    assert found["noext"] == "unknown"
    assert found["odd.md"] in ("txt", "unknown")
    total = inventory.totals(files).first()
    assert total.files == len(found) and total.bytes > 0
    kept = {r.relative_path for r in inventory.supported_files(files).collect()}
    assert "noext" not in kept and "a.csv" in kept


def test_row_counts(spark, tree):
    files = inventory.list_files(spark, tree)
    estimated = {r.relative_path: r.estimated_rows for r in inventory.estimated_rows(spark, tree, files).collect()}
    assert estimated["a.csv"] == 4 and estimated["lines.jsonl"] == 6 and estimated["list.json"] == 2
    assert estimated["sub/p.parquet"] == 2 and estimated["note.txt"] == 1 and estimated["broken.json"] == 1
    exact = {r.relative_path: r.entries for r in inventory.exact_entries(spark, tree, files).collect()}
    assert exact["a.csv"] == 2 and exact["lines.jsonl"] == 4 and exact["list.json"] == 2
    assert exact["object.json"] == 1 and exact["scalar.json"] == 0 and exact["broken.json"] == 0
    assert exact["sub/p.parquet"] == 2 and exact["note.txt"] == 0 and exact["page.html"] == 1


def test_csv_columns_and_encodings_differ_per_file(spark, tree):
    csv = readers.read_csv(spark, tree)
    assert values(csv, "id", "question", "answer", "text", "extra") == [
        ("1", 'two\nlines, "quoted"', "x", None, None), ("2", None, "é", None, None),
        ("7", None, None, "bom", None), (None, None, None, "café", "1")]
    in_file = csv.filter(F.endswith("src_path", F.lit("a.csv"))).orderBy("src_block", "src_row")
    assert [json.loads(r.raw)["id"] for r in in_file.collect()] == ["1", "2"]
    assert values(readers.read_tsv(spark, tree), "id", "text") == [("1", "a,b")]


def test_jsonl_skips_blank_and_rejects_bad_lines(spark, tree):
    lines = readers.read_jsonl(spark, tree)
    assert values(lines, "id", "text") == [("1", "one"), ("2", None)]
    assert sorted(r.raw for r in readers.rejected_records(lines).collect()) == ["[1, 2]", "{bad"]


def test_json_documents(spark, tree):
    docs = readers.read_json(spark, tree)
    assert values(docs, "id") == [("1",), ("2",), ("3",)]
    raw = [r.raw for r in docs.collect() if r.raw and '"s"' in r.raw]
    assert list(json.loads(raw[0])["s"]) == ["b", "a"]


def test_text_html_xml(spark, tree):
    text = readers.read_text(spark, tree).filter(F.endswith("src_path", F.lit("note.txt")))
    assert values(text, "content") == [("first\n\nsecond  end\n",)]
    assert values(readers.read_html(spark, tree), "content") == [("A & B",)]
    record = json.loads(readers.read_xml(spark, tree).first().raw)
    assert record == {"a": "2", "b": {"c": "3"}, "d": None}


def test_parquet_folders_have_own_schemas(spark, tree):
    rows = readers.read_parquet(spark, tree)
    assert values(rows, "id", "text", "question") == [
        ("1", "p", None), ("2", None, None), ("x", None, "q")]
    assert all("unused" not in r.raw for r in rows.collect())


def test_parquet_folders_of_one_schema_are_one_scan(spark, tmp_path):
    for k in range(12):
        folder = tmp_path / f"k={k} [x]"
        folder.mkdir()
        table = {"id": [k], "text": [str(k)]} if k % 3 else {"id": [str(k)], "question": [None]}
        schema = pa.schema([("id", pa.string()), ("question", pa.string())]) if k % 3 == 0 else None
        pq.write_table(pa.table(table, schema=schema), folder / "a.parquet")
    (tmp_path / "cut.parquet").write_bytes(b"PAR1 no")
    (tmp_path / "empty.parquet").write_bytes(b"")
    rows = readers.read_parquet(spark, str(tmp_path))
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    assert values(rows, "id", "text") == sorted([(str(k), str(k) if k % 3 else None) for k in range(12)], key=str)
    assert len({r.rec_id for r in rows.collect()}) == 12
    footers = {r.path.rsplit("/", 1)[1]: r.n for r in inventory.parquet_footers(spark, str(tmp_path)).collect()}
    assert footers == {"a.parquet": 1, "cut.parquet": None, "empty.parquet": None}
    (tmp_path / "none").mkdir()
    assert readers.read_parquet(spark, str(tmp_path / "none")).count() == 0


def test_archives_one_level(spark, tree):
    records = readers.read_archives(spark, tree)
    assert values(records, "id", "text", "content") == [
        ("10", None, None), ("11", None, None), ("12", "hi", None), ("20", None, None), (None, None, "page")]
    rejected = {r.src_path.rsplit("/", 1)[-1] for r in readers.rejected_records(records).collect()}
    assert "bad.json" in rejected and "broken.tgz" in rejected


def test_archive_members_are_read_as_files_are(spark, tmp_path):
    """The same files in a folder and in an archive give the same records, good and bad."""
    members = {"a.csv": b'k,v\n1,"x\ny"\n2,\n', "b.tsv": b"k\tv\n1\tz\n", "c.json": b'[{"k": 12345678901234567890}, {"k": 1',
               "d.jsonl": b'{"k": 1}\nbad\n', "e.txt": b"text \xff", "f.md": b"guessed", "g.xml": b"<r><k>1</k></r>", "h.html": b"<p>&eacute;</p>"}
    (tmp_path / "plain").mkdir()
    (tmp_path / "packed").mkdir()
    for name, content in members.items():
        (tmp_path / "plain" / name).write_bytes(content)
    columns = [pa.table({"id": [n], "text": [f"t{n}"]}) for n in range(6)] + [pa.table({"question": ["q"]})]
    with zipfile.ZipFile(tmp_path / "packed" / "all.zip", "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
        for n, table in enumerate(columns):
            pq.write_table(table, tmp_path / "plain" / f"p{n}.parquet")
            z.write(tmp_path / "plain" / f"p{n}.parquet", f"p{n}.parquet")
        z.writestr("cut.parquet", b"PAR1 no")

    def found(frame):
        name = F.regexp_extract("src_path", "([^/!]*)$", 1)
        raw = F.when(F.col("format") == "txt", F.get_json_object("raw", "$.content")).when(
            F.col("format") == "html", F.get_json_object("raw", "$.content")).otherwise(F.col("raw"))
        rows = frame.select(name, "format", "src_row", raw, readers.is_good())
        return sorted((tuple(r) for r in rows.collect() if not r[0].endswith("parquet")), key=str)

    plain = found(readers.read_records(spark, str(tmp_path / "plain")))
    packed = readers.read_archives(spark, str(tmp_path / "packed")).cache()
    assert found(packed) == plain and len(plain) == 10
    assert values(packed.filter("format = 'parquet'"), "id", "text", "question") == sorted(
        [(str(n), f"t{n}", None) for n in range(6)] + [(None, None, "q")], key=str)
    assert [r.src_path.rsplit("!", 1)[1] for r in packed.filter("format = 'parquet' AND raw IS NULL").collect()] == ["cut.parquet"]


def test_parquet_members_of_one_schema_share_a_folder(spark, tmp_path):
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            for name, table in (("a", {"id": [n]}), ("b", {"id": [str(n)]})):
                held = io.BytesIO()
                pq.write_table(pa.table(table), held)
                z.writestr(f"{name}.parquet", held.getvalue())
    folder, _ = archives.extract_members(spark, str(tmp_path), ["parquet"])
    assert len(inventory.parquet_folders(spark, folder)) == 2


def test_all_formats_together(spark, tree):
    everything = readers.read_records(spark, tree)
    good = readers.good_records(everything)
    assert {r.format for r in good.select("format").distinct().collect()} >= {
        "csv", "tsv", "json", "jsonl", "txt", "html", "xml", "parquet"}
    ids = [r.rec_id for r in good.select("rec_id").collect()]
    assert len(ids) == len(set(ids))


def test_routing_by_pattern(spark, rows):
    paths = ["leetcode-data/a.jsonl", "leetcode-data/x/a.jsonl", "a.csv", "x/a.csv", "mbpp-data/data/m.json",
             "description2code_current/codechef/p.txt", "description2code_current/codechef/a/b/p.txt"]
    files = spark.createDataFrame([(p,) for p in paths], "relative_path string")
    assert rows(inventory.route_to_datasets(files)) == sorted([
        ("leetcode-data/a.jsonl", "leetcode"), ("a.csv", "generic"), ("mbpp-data/data/m.json", "mbpp"),
        ("description2code_current/codechef/p.txt", "codechef"),
        ("description2code_current/codechef/a/b/p.txt", "codechef")], key=str)


def test_a_file_each_without_a_folder_each(spark, tmp_path):
    """Rows of one id are lines of one file; a null value or blanks are no line, and an empty file is not read."""
    rows = [(i, f" text {i} ") for i in range(2500)] + [(7, "again"), (8, None), (None, "no id"), (2500, None), (2501, " ")]
    path = catalog._file_each(spark.createDataFrame(rows, "id bigint, value string"), f"{tmp_path}/files", "TXT", "id")
    files = sorted(p for p in tmp_path.rglob("*.TXT"))
    assert len(files) == 2503 and len({p.parent for p in files}) == 4
    found = {p.name: p.read_text() for p in files}
    assert found["id=5.TXT"] == "text 5\n" and sorted(found["id=7.TXT"].split("\n")) == ["", "again", "text 7"]
    assert found["id=8.TXT"] == "text 8\n" and found["id=2500.TXT"] == found["id=2501.TXT"] == ""
    assert found["id=__HIVE_DEFAULT_PARTITION__.TXT"] == "no id\n"
    read = readers.good_records(readers.read_text(spark, path))
    named = read.filter(~F.contains("src_path", F.lit("HIVE")))
    assert read.count() == 2501 and sorted(r[0] for r in named.select(catalog._id_of(F.col("src_path"), "id")).collect()) == list(range(2500))
