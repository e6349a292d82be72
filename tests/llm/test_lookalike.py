import unicodedata

import pytest

from askmill.llm import lookalike as L

ALIKE = [
    ("Film", "Ｆｉｌｍ"), ("café", "café"), ("ab", "a​b"), ("a b", "a  b "), ("Mount Brom", "Mоunt Вrоm"), ("VI", "Ⅵ"), ("fi", "ﬁ"),
    ("ë", "ё"), ("", "​"), ("Klerafas", "Κlеrаfаѕ"),
]
DIFFERENT = [("Film", "film"), ("cafe", "café"), ("a-b", "ab"), ("a b", "ab"), ("ß", "ss"), ("o", "ø"), ("1", "l"), ("a", "б"), ("a.", "a")]


def pairs(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return {tuple(r) for r in L.alike_pairs(L.classes(df)).collect()}


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(spark, a, b):
    assert pairs(spark, [a, b, a, None]) == {tuple(sorted((a, b)))}


def test_different(spark):
    for a, b in DIFFERENT:
        assert pairs(spark, [a, b]) == set()


def test_canonical_member(spark):
    df = spark.createDataFrame([(v,) for v in ("Ｆilm", "Film", "Film ", "other")], "value string")
    got = {r.value: r.canonical for r in L.canonical_members(L.classes(df)).collect()}
    assert got == {"Ｆilm": "Film", "Film": "Film", "Film ": "Film"}


def test_real_titles_against_brute_force(spark, data):
    from askmill.tables import table

    values = [r.value for r in L.titles(table(spark, data, "documents"), table(spark, data, "gold")).collect()]
    fold = str.maketrans(L.ALIKE_FROM, L.ALIKE_TO)

    def plain(v):
        v = "".join(c for c in unicodedata.normalize("NFKC", v) if unicodedata.category(c) != "Cf").translate(fold)
        return unicodedata.normalize("NFKC", " ".join(v.split()))

    groups = {}
    for v in values:
        if v is not None:
            groups.setdefault(plain(v), []).append(v)
    assert pairs(spark, values) == {(a, b) for g in groups.values() for a in g for b in g if a < b}


def test_empty_and_wide(spark, empty_and_wide):
    docs = spark.createDataFrame([(1, "A b", "A b", "t")], "doc_id long, title string, document_id string, text string")
    gold = spark.createDataFrame([([("A  b", 0), None],), (None,)], "supporting_facts array<struct<title string, sentence_id int>>")
    empty, wide = empty_and_wide(docs)
    assert L.classes(L.titles(empty, gold.limit(0))).count() == 0
    assert L.alike_pairs(L.classes(L.titles(wide, gold))).count() == 3
    assert L.classes(spark.createDataFrame([("x" * 100_000,), ("ｘ" * 100_000,)], "value string")).count() == 2
