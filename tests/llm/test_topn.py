import random

from askmill.llm.topn import best_documents, top_n

SCHEMA = "example_id string, retrieved array<struct<rank int, document_id string, title string, score double>>"
INF, NAN = float("inf"), float("nan")


def batches(spark, rows):
    return spark.createDataFrame([(e, None if h is None else [(0, d, d, s) for d, s in h]) for e, h in rows], SCHEMA)


def test_ties_repeats_and_what_does_not_count(spark):
    rows = [
        ("e", [("b", 1.0), ("a", 1.0), ("c", NAN), ("d", INF), ("f", -INF), (None, 9.0), ("g", None)]),
        ("e", [("b", 3.0), ("é", 0.5), ("z", 0.5), ("Z", 0.5), ("y", 0.5)]),
        ("e", [("b", 3.0)]), ("e", None), ("e", []), (None, [("a", 1.0)]), ("x", [("a", None)]),
    ]
    got = [tuple(r) for r in best_documents(batches(spark, rows)).orderBy("place_no").collect()]
    assert got == [("e", 1, "b"), ("e", 2, "a"), ("e", 3, "Z"), ("e", 4, "y"), ("e", 5, "z")]


def test_hot_group_against_brute_force(spark):
    draw = random.Random(1)
    hits = [("hot" if draw.random() < 0.7 else f"g{draw.randrange(40)}", f"d{draw.randrange(300)}", float(draw.randrange(20))) for _ in range(6000)]
    got = {}
    for r in top_n(spark.createDataFrame(hits, "grp string, item string, score double").repartition(16), 7).collect():
        got.setdefault(r.grp, []).append((r.place_no, r.item, r.score))
    want = {}
    for g, d, s in hits:
        best = want.setdefault(g, {})
        best[d] = max(s, best.get(d, s))
    for g, best in want.items():
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert sorted(got[g]) == [(i + 1, d, s) for i, (d, s) in enumerate(top)]


def test_group_limit_on_both_sides_of_the_shuffle(spark):
    plan = top_n(spark.createDataFrame([], "grp string, item string, score double"), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_empty_and_wide(spark, empty_and_wide):
    empty, wide = empty_and_wide(batches(spark, [("e", [("a", 1.0)])]))
    assert best_documents(empty).count() == 0
    assert best_documents(wide).count() == 1
