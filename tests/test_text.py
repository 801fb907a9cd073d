"""Text functions against short stdlib definitions of the same rules."""

import hashlib
import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import classify, code, html, text
from corpusloom.operators import filters

PIECES = ["a", "B", "é", "ß", "_", "__", "-", ".", ",", " ", " ", "\n", "\r\n", "\t", " ", "  ", "#",
          "# python", "```", "```python\n", "*", ">", "😀", "0", "1", "|", "for", "range", "sort", "while", "def ",
          "return", "select", "a)", "a)x", "fill", "fix", "functions", "optimize", "write", "中文", "x"]
TEXTS = st.lists(st.sampled_from(PIECES), min_size=0, max_size=25).map("".join)


def strip_fences(value: str) -> str:
    return re.sub(r"```.*?```", " ", value, flags=re.DOTALL)


def expected_clean(value: str) -> str:
    value = re.sub(r"[#*_>`]+", " ", strip_fences(value)).replace("\r", "\n")
    return re.sub(r"\s+", " ", value).strip()


def expected_dedup(value: str) -> str:
    return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", value.lower())).strip()


def expected_chatter(value: str) -> bool:
    found = value.split()
    return len(found) >= 10 and max(Counter(found).values()) > len(found) * 0.2


def expected_type(value: str) -> str:
    rules = [("mcq", r"\b(?:multiple choice|select|choose|option|[abcd]\))\b")]
    rules += [(name, r"\b(?:%s)\b" % "|".join(classify.TYPE_WORDS[name]))
              for name in ("coding", "fill_blank", "debug", "optimize")]
    low = value.lower()
    for name, pattern in rules:
        if re.search(pattern, low):
            return name
    return "coding" if any(p in low for p in classify.CODING_PARTS) else "unknown"


def expected_code(value: str) -> str:
    parts = value.split("```")
    if len(parts) < 3:
        return value
    body = parts[1].strip()
    first, newline, rest = body.partition("\n")
    return rest if newline and body.startswith(("python", "cpp", "java")) else body


def expected_solution(value: str) -> str:
    return max(re.split(r"#\s*\w+", value), key=len).strip()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXTS, min_size=40, max_size=60))
def test_text_functions(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    t = F.col("t")
    got = df.select(
        "i", text.clean_text(F.translate(t, "<", "")).alias("clean"), text.dedup_text(t).alias("dedup"),
        text.dedup_key(t).alias("key"), text.strip(t).alias("strip"), filters.has_chatter(t).alias("chatter"),
        classify.question_type(t).alias("kind"), code.extract_code(t).alias("code"),
        code.primary_solution(t).alias("solution"), F.size(text.words(t)).alias("words")).collect()
    for row in got:
        value = values[row.i]
        assert row.clean == expected_clean(value)
        assert row.dedup == expected_dedup(value)
        assert row.key == hashlib.md5(expected_dedup(value).encode()).hexdigest()
        assert row.strip == value.strip()
        assert row.chatter == expected_chatter(value)
        assert row.kind == expected_type(value)
        assert row.code == expected_code(value)
        assert row.solution == expected_solution(value)
        assert row.words == len(value.split())


def test_chatter_at_the_limit(spark):
    rng = random.Random(3)
    cases = []
    for n in (9, 10, 11, 15, 20, 99, 100, 1000):
        for count in (int(n * 0.2), int(n * 0.2) + 1):
            words = ["w"] * count + [f"x{i}" for i in range(n - count)]
            rng.shuffle(words)
            cases.append(" ".join(words))
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(filters.has_chatter(F.col("t"))).collect()] == [expected_chatter(c) for c in cases]


@pytest.mark.parametrize("value,kind", [
    ("a)foo", "mcq"), ("a) foo", "unknown"), ("x__ y", "unknown"), (" __ ", "fill_blank"),
    ("functions", "coding"), ("decode", "unknown"), ("éfix", "unknown"), ("please fix it", "debug")])
def test_question_type_edges(spark, value, kind):
    assert spark.createDataFrame([(value,)], "t string").select(classify.question_type(F.col("t"))).first()[0] == kind


def test_artefacts(spark):
    values = ["  a|b 0 1  c d e f ", "short", "x" * 6000, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string")
           .select(text.clean_artefacts(F.col("t"))).collect()]
    assert got == ["aIb O l c d e f", "", "x" * 5000, None]


def test_html(spark):
    page = ("<!-- <p>no</p> --><style>p{}</style><SCRIPT>var a='</p>';</SCRIPT><p class='x'>A &lt;b&gt; &amp;lt; "
            "&#65;&#x1F600;&eacute;&bogus; 1 < 2</p>")
    got = spark.createDataFrame([(page,)], "h string").select(html.html_to_text(F.col("h"))).first()[0]
    assert got == "A <b> &lt; A😀é&bogus; 1 < 2"


def test_html_in_one_pass(spark):
    pages = [
        ('<a title="x > y" b=\'>\' c=">">t</a>', "t"), ('<a title="<!--">kept</a><!-- gone <b> -->', "kept"),
        ("<p don't>a</p><p x=\"open>b</p>", "ab"), ("<title>a <b> &lt;</title><textarea x='>'></p></textarea >c", "a <b> <</p>c"),
        ("a<script>if (x) '<p>'</script foo>b<style>p > q", "ab"), ("a < b > c <3 =\"d", "a < b > c <3 =\"d"),
        ("<title>open <i>x", "open x"), ("", ""), (None, None), ("<p", "<p"),
        ("<a " + "b='>' c " * 50_000 + ">long" + "<script>" + "<" * 100_000, "long")]
    frame = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "i int, h string")
    got = dict(frame.select("i", html.html_to_text(F.col("h"))).collect())
    assert got == {i: want for i, (_, want) in enumerate(pages)}


@pytest.mark.parametrize("value,time,space", [
    ("for i in range(3): for j in x", "O(n²)", "O(1)"), ("for i in range(3): pass", "O(n)", "O(1)"),
    ("x.sort()", "O(n log n)", "O(1)"), ("x.sort() while", "O(n)", "O(1)"),
    ("def f(): return 1", "O(n)", "O(n)"), ("x.append(1)", "O(n)", "O(n)")])
def test_complexity(spark, value, time, space):
    got = spark.createDataFrame([(value,)], "t string").select(code.complexity_note(F.col("t"))).first()[0]
    assert got == f"Time Complexity: {time}\nSpace Complexity: {space}"


def test_paths_and_percentage(spark):
    df = spark.createDataFrame([("/r/a/b.Tar.GZ", 1, 0), ("/r/x.CSV", 1, 4), ("/q/noext", 0, 2)],
                               "p string, a int, b int")
    got = df.select(text.path_suffix(F.col("p")), text.path_stem(F.col("p")), text.relative_path(F.col("p"), "/r/"),
                    text.percentage(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("tar.gz", "b.Tar", "a/b.Tar.GZ", 0.0), ("csv", "x", "x.CSV", 25.0),
                                       ("", "noext", "/q/noext", 0.0)]


def test_entities_are_those_of_the_standard(spark):
    import html as standard
    names = [f"&{n}" for n in standard.entities.html5 if n.endswith(";")]
    numbers = [f"&#{n};" for n in (*range(128, 256), 38, 8364, 0x1F600, 0x10FFFD, 0, 0xD800, 0x110000, 10**7, 10**80)]
    forms = ["&#x80;", "&#X1f600;", "&#x000000000041;", "&#00000000000065;", "&#xFFFFFFFFFF;", "&amp;lt;", "&NoSuch;", "&;", "a & b", "&#;"]
    texts = [f"<{e}> {e}{e}" for e in names + numbers + forms]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", html.decode_entities(F.col("t")).alias("d"))
    got = {r.t: r.d for r in found.collect()}
    assert len(names) > 2100 and {t: d for t, d in got.items() if d != standard.unescape(t)} == {}
    # Characters that Unicode never assigns are kept, as the HTML standard says; the library drops them.
    last = spark.range(1).select(html.decode_entities(F.lit("&#1114111;"))).first()[0]
    assert last == chr(0x10FFFF)
