import os
import random

import pytest

from askmill.llm import encode

pytestmark = pytest.mark.skipif(not os.path.exists(encode.rank_file()), reason="no vocabulary files here")
PIECES = ["a", "b", " ", "  ", "\n", "'s", "'re", "é", "日本", "1", "23", "!!", "…", "é", "the ", "ing", "😀", "x" * 40, "=-" * 20, " " * 30, "<|endoftext|>"]


def test_join_equals_whole_encoding():
    enc, draw = encode.encoder(encode.rank_file()), random.Random(3)
    for _ in range(600):
        some = draw.sample(PIECES, draw.randint(1, 6))
        text = "".join(draw.choice(some) for _ in range(draw.randint(1, 150)))
        cut = draw.randint(0, len(text))
        assert encode.join_ids(enc, enc.encode_ordinary(text[:cut]), enc.encode_ordinary(text[cut:])) == enc.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "日本語" * 4000, "".join(random.Random(5).choices("abcdefgh", k=20_000)), " " * 5000 + "x", "\n" * 9000 + "x", " \t\n" * 3000, "-- " * 6000, "a" + " " * 9000])
def test_join_within_one_piece(text):
    enc, k = encode.encoder(encode.rank_file()), len(text) // 2
    assert encode.join_ids(enc, enc.encode_ordinary(text[:k]), enc.encode_ordinary(text[k:])) == enc.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["-- ", "… ", " \n", "=\t= "])
def test_join_of_marks_and_blanks_reads_a_window_only(monkeypatch, unit):
    enc = encode.encoder(encode.rank_file())
    text = unit * 60_000
    left, right = enc.encode_ordinary(text[: len(text) // 2 + 1]), enc.encode_ordinary(text[len(text) // 2 + 1 :])
    want, seen = enc.encode_ordinary(text), []

    class Watched:
        def __getattr__(self, name):
            return getattr(enc, name)

        def encode_ordinary(self, t):
            seen.append(len(t))
            return enc.encode_ordinary(t)

    assert encode.join_ids(Watched(), left, right) == want and max(seen, default=0) < 1000


def test_tree_over_documents(spark):
    draw = random.Random(9)
    texts = ["".join(draw.choice(PIECES) for _ in range(n)) for n in (0, 1, 20, 300, 1000, 2500)] + [None, "", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, node int")
    enc = encode.encoder(encode.rank_file())
    want = {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in encode.token_ids(df, leaf=64).collect()} == want
    assert {r.doc_id: r.ids for r in encode.token_ids(df).collect()} == want


def test_empty_table(spark):
    assert encode.token_ids(spark.createDataFrame([], "doc_id long, text string")).count() == 0
