"""Parts and rules against a plain parser; the model on URLs that rules do not decide."""

import random
import re

import pytest

from corpusloom.llm import urlfilter

SCHEMA = "page_id bigint, url string, html string"


def plain(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, name, start in urlfilter.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start):
            if best is None or len(name + start) > len(best[0]):
                best = (name + start, verdict)
    return host, path, *(best or (None, None))


URLS = [None, "", "nothing", "http://", "http://net", "http://net/", "HTTP://A.NET/x?y#z", "http://example.net/en/1",
        "https://m.Example.NET/en", "http://example.net/en/?q", "http://example.com/de/", "http://xexample.com/de/",
        "http://b.example.com/DE/", "ftp://w.org/fr/#a/b", "http://org?/fr/", "a://b://c.net/d", "http://a.net?x=/y",
        "http://é.net/ü\nx", "http://x.com/" + "ab/" * 30_000]


def test_parts_and_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(None, URLS[6], None), (6, URLS[6], "x")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "url AS host", "url AS path", "url AS rule", "html AS p_block")
    got = urlfilter.judge_urls(frame).collect()
    assert len(got) == len(rows)
    urls = {i: u for i, u, _ in rows}
    for r in got:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


@pytest.mark.parametrize("labelled", [False, True])
def test_model_learns_from_labels(spark, labelled):
    rng = random.Random(2)
    make = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    rows = [(i, f"http://{make()}.spam.{'net' if i < 200 else 'info'}/buy/{i}" if i % 2 else
             f"http://{make()}.news.{'org/fr' if i < 200 else 'info'}/story/{i}", None) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame([(f"{make()}.spam.info", f"/buy/{i}", 1) for i in range(40)]
                                  + [(f"{make()}.news.info", f"/story/{i}", 0) for i in range(40)],
                                  "host string, path string, blocked int") if labelled else None
    got = {r.page_id: r for r in urlfilter.judge_urls(frame, labelled=table).collect()}
    open_ = [i for i in got if got[i].rule is None]
    assert len(open_) == 100
    assert sum((got[i].verdict == "block") == bool(i % 2) for i in open_) >= 97


def test_empty_and_one_class(spark):
    assert urlfilter.judge_urls(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, "http://a.net/", ""), (2, "http://b.com/", "")], SCHEMA)
    assert {r.page_id: r.verdict for r in urlfilter.judge_urls(rows).collect()} == {1: "block", 2: "block"}
