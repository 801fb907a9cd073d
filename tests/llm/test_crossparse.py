"""Suffix automata and greedy parsing against plain search; accuracy on held-out rows."""

import random

import numpy as np

from corpusloom.llm import crossparse


def greedy(text, labelled):
    """Phrases of a text by plain substring search, per stretch."""
    total = 0
    for start in range(0, len(text), crossparse.STRETCH):
        part, at = text[start:start + crossparse.STRETCH], 0
        while at < len(part):
            stop = at + 1
            while stop < len(part) and part[at:stop + 1] in labelled:
                stop += 1
            total, at = total + 1, stop
    return total


def test_automaton_accepts_exactly_the_substrings():
    text = b"abracadabra abra"
    moves = crossparse.suffix_automaton(text)
    def accepts(word):
        state = 0
        for symbol in word:
            state = moves[state].get(symbol)
            if state is None:
                return False
        return True
    inside = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(accepts(w) for w in inside)
    assert not any(accepts(w + b"z") for w in inside)
    assert not accepts(b"rac ") and not accepts(b"bb")


def test_phrases_equal_plain_search():
    rng = random.Random(7)
    labelled = (("x", bytes(rng.choice(b"abc ") for _ in range(400))), ("y", bytes(rng.choice(b"abd ") for _ in range(300))))
    texts = [bytes(rng.choice(b"abcd z") for _ in range(n)) for n in (0, 1, 5, 255, 256, 257, 1500)]
    number, models = crossparse.tables(labelled)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    symbols = number[np.frombuffer(b"".join(texts), np.uint8)]
    for (_, text), (_, table, _) in zip(labelled, models, strict=True):
        got = crossparse.phrases(symbols, bounds, table, int(number.max()) + 1)
        assert got.tolist() == [greedy(t, text) for t in texts]


EN = "the quick brown fox jumps over the lazy dog and runs away from the house with the other animals "
DE = "der schnelle braune fuchs springt über den faulen hund und läuft vom haus mit den anderen tieren weg "


def test_languages_and_edges(docs):
    rng = random.Random(1)
    pick = lambda text: " ".join(rng.choices(text.split(), k=25))
    rows = [(i, pick(EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(200)]
    rows += [(300, None, "en"), (301, "", "de"), (302, "123 !?", None), (303, pick(DE), None), (None, pick(EN), "en"),
             (304, pick(DE) * 2000, None), (3, rows[3][1], "en"), (305, "日本語", None)]
    frame = docs(rows).selectExpr("*", "lang AS lang_pred", "lang AS score")
    labelled = crossparse.learn(frame, ~crossparse.held_out())
    assert [name for name, _ in labelled] == ["de", "en"]
    got = crossparse.identify(frame.drop("lang"), labelled).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (300, 301, 302)] == ["und"] * 3
    assert by_id[303] == by_id[304] == "de" and by_id[None] == "en" and by_id[305] in ("de", "en")
    assert sum(by_id[i] == label for i, _, label in rows[:200]) >= 198


def test_header_of_a_source_is_not_all_that_is_learned(docs):
    rng = random.Random(2)
    pick = lambda text: " ".join(rng.choices(text.split(), k=150))
    notice = "all rights reserved " * 30
    rows = [(i, notice + pick(EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(200)]
    rows += [(i, "12 34 !?", "en") for i in range(1000, 3000)]  # no letters, so no use to learn from
    labelled = crossparse.learn(docs(rows), ~crossparse.held_out())
    assert [name for name, _ in labelled] == ["de", "en"]
    assert all(20_000 < len(text) <= 1.1 * crossparse.SAMPLE_ROWS * crossparse.SAMPLE_CHARS for _, text in labelled)
    tests = [(i, pick(EN if i % 2 else DE)) for i in range(100)]
    got = {r.doc_id: r.lang_pred for r in crossparse.identify(docs(tests), labelled).collect()}
    assert all(got[i] == ("en" if i % 2 else "de") for i, _ in tests)


def test_nothing_learned_and_empty(docs):
    assert crossparse.learn(docs([]), ~crossparse.held_out()) == ()
    assert crossparse.identify(docs([(1, "some text")]), ()).first().lang_pred == "und"
    labelled = (("en", EN.encode()),)
    assert crossparse.identify(docs([]), labelled).count() == 0
    row = crossparse.identify(docs([(1, "some text")]), labelled).first()
    assert (row.lang_pred, row.score) == ("en", 1.0)
