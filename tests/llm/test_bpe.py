"""BPE coding against the library on whole texts, and exact round trips."""

import numpy as np
import public_tokenizers
import pytest

from corpusloom.llm import bpe


@pytest.fixture(scope="module", name="ranks")
def ranks_fixture():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


TEXTS = ["", None, "Hello  world\n\n it's", "naïve ça 日本語 😀  \t x", " " * 50, "a" * 3000, "<|endoftext|> x",
         "don't  stop\r\n " * 20_000, "1234 5678" * 5000, "\u2003x\u00a0y " * 9000, "é" * 70_000]


def test_equal_to_the_library_and_back(docs, ranks):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (2, TEXTS[2])]
    frame = docs(rows).selectExpr("*", "lang AS n_tokens", "lang AS decoded")
    got = bpe.round_trip(frame, ranks, public_tokenizers.PATTERN).collect()
    assert len(got) == len(rows)
    encoder = bpe.encoding(ranks, public_tokenizers.PATTERN)
    texts = dict(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        assert ids == encoder.encode_ordinary(text) and r.n_tokens == len(ids), r.doc_id
        assert bytes(r.decoded) == text.encode()


@pytest.mark.parametrize("limit", [1, 7, 100])
def test_cuts_are_safe(ranks, monkeypatch, limit):
    monkeypatch.setattr(bpe, "PIECE_CHARS", limit)
    encoder = bpe.encoding(ranks, public_tokenizers.PATTERN)
    for text in [t[:5000] for t in TEXTS if t]:
        parts = list(bpe.pieces(text, limit))
        assert "".join(parts) == text
        assert [i for p in parts for i in encoder.encode_ordinary(p)] == encoder.encode_ordinary(text)


def test_decode_column(spark, ranks):
    frame = spark.createDataFrame([(1, bytearray(np.array([0, 1], "<u4").tobytes())), (2, None)], "i int, token_ids binary")
    got = {r.i: r.token_ids for r in bpe.decode(frame, ranks, public_tokenizers.PATTERN).collect()}
    encoder = bpe.encoding(ranks, public_tokenizers.PATTERN)
    assert bytes(got[1]) == encoder.decode_bytes([0, 1]) and got[2] is None


def test_empty_table(docs, ranks):
    assert bpe.round_trip(docs([]), ranks, public_tokenizers.PATTERN).count() == 0


def test_long_texts_are_not_cut_before_controls():
    # The library does not count U+001C to U+001F as white space: symbols and such a control are one match.
    text = "a" * 10 + " +\x1c+\x1f+ \x1d- b"
    parts = list(bpe.pieces(text, 11))
    assert "".join(parts) == text
    assert all(not part.startswith(("\x1c", "\x1d", "\x1e", "\x1f")) for part in parts)
