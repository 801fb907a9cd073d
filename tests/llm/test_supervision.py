"""Counts of texts against plain counting, and EM on votes drawn from known accuracies."""

import math
import random
import re

from corpusloom.llm import supervision

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_counts_equal_plain_counting(docs):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "naïve ", "😀", "#", "|", "\t", "\r\n", " ", "Xy "])
                        for _ in range(rng.randrange(120)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "   \n \n"), (203, "a a a a"), (204, "same\nsame\n \nsame"), (None, "one two"),
             (203, "a a a a"), (205, "x y z " * 3000)]
    frame = docs(rows).selectExpr("*", "text AS words", "lang AS windows", "n_chars AS n_words", "lang AS quality")
    got = supervision.judge_quality(frame).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words
        assert n == ((9000, 9000, 0, 0, 9000) if r.doc_id == 205 else plain(texts[r.doc_id])), r.doc_id
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and (not failed or not r.kept)


def test_empty_table(docs):
    assert supervision.judge_quality(docs([])).count() == 0


def test_em_finds_accuracies():
    rng, counts = random.Random(8), {}
    truth = [(0.98, 0.3), (0.95, 0.5), (0.9, 0.4), (0.97, 0.2)]  # chance of a good vote on good and on bad
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple(1 if rng.random() < 0.2 else 2 * (rng.random() < t[not good]) for t in truth)
        counts[votes] = counts.get(votes, 0) + 1
    trust = supervision.estimate(list(counts.items()), 4, rounds=300, belief=0.0)
    for (bad_weight, good_weight), (on_good, on_bad) in zip(trust.weights, truth, strict=True):
        assert abs(good_weight - math.log(on_good / on_bad)) < 0.25
        assert bad_weight < -0.8


def test_clean_documents_stay_and_junk_goes(docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    clean = [(i, " ".join(word() for _ in range(100)) + ".") for i in range(200)]
    junk = [(1000 + i, " ".join(word() + "%%%" for _ in range(100))) for i in range(15)]
    kept = {r.doc_id: r.kept for r in supervision.judge_quality(docs(clean + junk)).collect()}
    assert all(kept[i] for i, _ in clean)
    assert not any(kept[i] for i, _ in junk)
