import random

import pytest

from askmill.llm import leaks as L
from askmill.llm.wordforms import words

ITEM = (
    "Under glass at Klibruzarg lies a crooked chart, drawn by Dorem Brihinox in 1801, whose 6797 soundings Talvo Mibedik later called doubtful. "
    "When Vikka Gimiklolm auctioned the walnut manuscripts in 1668, bidder Ostin Sisolusk paid 678 florins."
)
W = ITEM.split()
AROUND = ("The brewery was closed for repairs. ", " It is best known for the orchard.")


def found(spark, texts, items=(ITEM,), **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)], "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in L.leaked(docs, held, **how).collect()}


def changed(every):
    return " ".join("former" if i % every == every - 1 else w for i, w in enumerate(W))


def test_kinds_of_copies(spark):
    texts = [
        ITEM, ITEM.upper(), ITEM.replace(" ", "\n"), " ".join(f"[[{w}]]" for w in W), " ".join(f"{w}[12]" for w in W), ITEM.replace("a", "а"), changed(8),
        ITEM.replace("soundings", "sounidngs").replace("chart", "charrt"), " ".join(W[5:21]), "<b>" + "</b> <i>".join(W) + "</i>",
    ]
    assert found(spark, [AROUND[0] + t + AROUND[1] for t in texts]) == {(i, 100) for i in range(len(texts))}


def test_what_is_no_leak(spark):
    other = "Under glass at Tuvidran lies a smoky chart, drawn by Quorra Nofarosk in 1968, whose 3473 soundings Ambri Botrugelm later called doubtful."
    texts = [" ".join(W[5:16]), other, " ".join(W[:8] + ["x"] * 9 + W[20:28]), None, "", "—", "Dorem Brihinox", changed(3)]
    assert found(spark, texts) == set()


def test_equal_items_each_count_whatever_the_filter_lets_through(spark):
    items = (ITEM, "other words only", ITEM, None, "")
    for size in (1, L.FILTER_WORDS):
        assert found(spark, [ITEM, "nothing of it " * 9, None], items, filter_words=size) == {(0, 100), (0, 102)}


@pytest.mark.parametrize("start", range(0, 20, 3))
def test_every_stretch_with_spread_changes_is_hit(start):
    draw, item = random.Random(start), words(ITEM)
    for _ in range(60):
        size, doc = draw.randint(12, 16), list(item)
        at = start + draw.randrange(6)
        while at < start + size:
            doc[at % len(doc)] = "changed"
            at += L.CHANGE_GAP + 1 + draw.randrange(3)
        _, _, a = L.seeds([item[start : start + size]])
        _, _, b = L.seeds([doc[start : start + size]])
        assert set(a) & set(b)


def test_empty_wide_and_long(spark, empty_and_wide):
    docs = spark.createDataFrame([(1, "filler words here " * 20_000 + ITEM)], "doc_id long, text string")
    held = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    empty, wide = empty_and_wide(docs)
    assert L.leaked(empty, held).count() == 0
    assert L.leaked(docs, held.limit(0)).count() == 0
    assert [(r.doc_id, r.item_id, r.n_words) for r in L.leaked(wide, empty_and_wide(held)[1]).collect()] == [(1, 5, len(W))]


def test_item_under_many_ids_with_one_changed_word(spark):
    # runs of eleven and twelve words: too short for a third of the item without the change between them
    item = " ".join(words(ITEM) + [f"more{i}" for i in range(30)])
    part = words(ITEM)[:11] + ["former"] + words(ITEM)[12:24]
    other = [f"other text number{i} of its own" for i in range(3)]
    want = {(0, 100 + i) for i in range(10)}
    assert found(spark, [" ".join(part)], [item] * 10 + other) == want
    assert found(spark, [" ".join(part)], [item] * 5 + [item.upper()] * 5 + other, filter_words=1) == want


def test_items_of_one_mould_and_two_changed_words(spark):
    changed_twice = " ".join("former" if i in (7, 20) else w for i, w in enumerate(W))
    assert found(spark, [changed_twice], [ITEM] * 6) == found(spark, [changed_twice], [ITEM] * 6, filter_words=1)
