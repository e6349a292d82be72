import random

import pytest

from askmill.llm import reading as R

EASY = ["You can see the cat.", "It is red.", "Look at the box.", "We like the hat.", "The dog is wet and it is big."]
MIDDLE = ["After the flood of 1811 the garrison financed the main staircase.", "The library was closed for repairs between 1916 and 1922.", "Critics generally compared it with the eastern committee."]
HARD = [
    "Notwithstanding the juridico-political reconfiguration of liturgical performance, the unacknowledged historicity of archival provenance destabilises interpretation.",
    "Methodologically, the heuristic interdependence of monumental commemoration proves irreducible to antecedent historiographical categorisation.",
]


@pytest.fixture(scope="module")
def tables(spark):
    draw, docs, labels = random.Random(4), [], []
    for i in range(240):
        band = i % 3
        own = (EASY, MIDDLE, HARD)[band]
        text = [draw.choice(own) for _ in range(draw.randint(5, 9))]
        text.insert(draw.randrange(len(text)), draw.choice(MIDDLE))
        docs.append((i, " ".join(text), f"s{i % 5}" if i % 7 else None))
        if i < 150:
            labels += [(i, g, band + 1) for g in "ab"] + [(i, "c", None)]
    labels.append((0, "a", 1))
    docs += [(900, None, "s1"), (901, "", "s1"), (902, " — ", "s1"), (903, EASY[0] * 3000, "s1")]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, source string"),
        spark.createDataFrame(labels, "doc_id long, grader string, band int"),
    )


def test_held_out_documents(spark, tables, empty_and_wide):
    docs, labels = tables
    got = {r.doc_id: r.band for r in R.bands(empty_and_wide(docs)[1], empty_and_wide(labels)[1]).collect()}
    assert set(got) == {*range(240), 903}
    agree = sum(got[i] == i % 3 + 1 for i in range(150, 240))
    assert agree >= 86


def test_quality_by_source(tables):
    rows = R.by_source(*tables).collect()
    assert sum(r.n for r in rows) == 150 and all(r.agree > 0.9 for r in rows)


def test_no_grades_and_no_documents(tables):
    docs, labels = tables
    assert {r.band for r in R.bands(docs, labels.limit(0)).collect()} == {None}
    assert R.bands(docs.limit(0), labels).count() == 0
