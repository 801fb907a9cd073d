"""The pipeline's stages, one by one, on documents with known cases."""

import random

import pytest

import corpus_pipeline as pipeline

rng = random.Random(11)
WORDS = [f"wort{i}" for i in range(3000)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + ".\n"


def stages(spark, frame, folder):
    for name, function in pipeline.STAGES:
        frame = function(spark, frame, folder)
        yield name, frame


@pytest.fixture(name="folder")
def folder_fixture(spark, tmp_path):
    spark.createDataFrame([(1, text(40))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_known_cases(spark, docs, folder):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    clean = [(i, text(80), "en" if i % 2 else "de") for i in range(40)]
    near = clean[3][1].split()
    near[5] = "changed"
    passage = text(60).strip()
    rows = clean + [(100, clean[2][1], "de"), (101, " ".join(near), "en"), (102, text(50) + passage + "\n" + text(40), "en"),
                    (103, text(30) + passage + " " + text(20), "en"), (104, text(20) + item + text(20), "en"),
                    (105, None, "en"), (106, "", None), (107, "12 34", None), (None, text(30), None)]
    frame = docs(rows).selectExpr("*", "lang AS row", "text AS oid", "lang AS key", "lang AS score")
    out = dict(stages(spark, frame, folder))
    for name in [n for n, _ in pipeline.STAGES[:-1]]:
        assert out[name].columns == frame.columns
    ids = {name: {r.doc_id for r in out[name].select("doc_id").collect()} for name in out}
    assert ids["language"] == {r[0] for r in rows} - {105, 106, 107}
    assert ids["near_duplicates"] == ids["language"] - {100, 101}
    assert ids["repeated_passages"] == ids["near_duplicates"]
    cut = {r.doc_id: r for r in out["repeated_passages"].collect()}
    assert cut[103].text == rows[43][1].replace(passage + " ", "") and cut[103].n_chars == len(cut[103].text)
    for i, t, *_ in rows:
        if i in cut and i != 103:
            assert cut[i].text == t
    assert ids["benchmark_passages"] == ids["repeated_passages"] - {104}
    final = out["tokens"].collect()
    assert {r.doc_id for r in final} == ids["benchmark_passages"]
    import hashlib
    assert all(r.decoded_sha256 == hashlib.sha256(cut[r.doc_id].text.encode()).hexdigest() for r in final)


def test_one_of_repeated_rows_and_of_copies_without_id_stays(spark, docs, folder):
    copy, other = text(80), text(80)
    rows = [(None, copy, "en")] * 3 + [(7, other, "en")] * 4 + [(None, other + "more words here", "de"), (8, None, "en"), (8, None, "en"),
                                                               (9, " ", "en"), (9, " ", "en"), (None, None, "en"), (None, None, "en")]
    rows += [(50 + i, text(70), "en") for i in range(5)]
    got = pipeline.near_duplicates(spark, docs(rows), folder).collect()
    kept = sorted(((r.doc_id, r.text) for r in got if r.text and r.text.strip()), key=str)
    # The document without id that is like document 7 has a number above all ids, so 7 stays.
    assert kept == sorted([(None, copy), (7, other)] + [(r[0], r[1]) for r in rows[-5:]], key=str)
    assert sum(1 for r in got if not (r.text or "").strip()) == 6


def test_empty(spark, docs, folder):
    for _, frame in stages(spark, docs([]), folder):
        assert frame.count() == 0


def test_run_over_tables(spark):
    folder = "/root/testdata/sf0.001"
    got = pipeline.run(spark, folder).collect()
    total = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert 0.5 * total < len(got) < total and len({r.doc_id for r in got}) == len(got)
