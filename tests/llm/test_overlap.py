import random

import pytest

from askmill.llm import overlap as O
from askmill.llm.graph import components
from askmill.llm.wordforms import slip, words

SCHEMA = "record_id long, identifier string, question string, answer string, question_type string, level string, split_name string, source string"
BASE = "In which town is the lake Lake Tudradend that Bastok Fibroklosk worked on located?"


def rows(spark, items):
    return spark.createDataFrame([(i, "x", q, a, None, None, s, "src") for i, (q, a, s) in enumerate(items)], SCHEMA)


def found(spark, items):
    return {tuple(r) for r in O.overlaps(rows(spark, items)).collect()}


def test_same_question(spark):
    variants = [
        lambda q: q, str.upper, lambda q: q + " ", lambda q: "Q: " + q, lambda q: q.replace("the lake", "lake"), lambda q: q.replace("town", "twon"),
        lambda q: q.replace("worked", "woorked"), lambda q: q.replace("Lake", "Ｌаkе"), lambda q: q.replace("located", "located exactly"), lambda q: "(multi-hop) " + q.replace(" ", "  "),
    ]
    names = "Tudradend Klobesto Vupivekam Natrohond Zibermask Gorwinthe Pelluxamo Quistorni Hefradolu Jamblenka".split()
    items = []
    for name, other in zip(names, variants, strict=True):
        q = BASE.replace("Tudradend", name)
        items += [(q, "Rotukusk", "train"), (other(q), "rotukusk.", "test"), (other(q), None, "validation")]
    assert found(spark, items) == {(3 * k, 3 * k + i) for k in range(len(names)) for i in (1, 2)}


def test_other_questions(spark):
    items = [
        (BASE, "A", "train"), (BASE, "B", "test"), (BASE.replace("Tudradend", "Zetifisk"), "A", "test"), (BASE, "A", "train"), (None, "A", "test"), ("?", "A", "test"),
        ("Which is older, the ship Vidrorg or the lake Nupaful?", "C", "train"), ("Which is newer, the ship Vidrorg or the lake Nupaful?", "C", "test"),
        ("Which is older, the lake Nupaful or the ship Vidrorg?", "C", "test"), (BASE, "A", None),
    ]
    assert found(spark, items) == {(6, 8)}


def test_wordings_that_are_no_neighbours_meet(spark):
    wordings = [BASE, BASE.replace("town", "twon"), BASE.replace("town", "toown"), "Q: " + BASE, BASE.replace("located", "loctaed")]
    items = [(w, "A", s) for w in wordings for s in ("train", "test")]
    assert len(found(spark, items)) == len(wordings) ** 2


def test_brute_force_over_a_sample(spark, data):
    from askmill.tables import table

    examples = table(spark, data, "examples")
    got = {tuple(r) for r in O.overlaps(examples).collect()}
    records = [(r.record_id, words(r.question), " ".join(words(r.answer)), r.answer, r.split_name) for r in examples.collect() if r.question]
    train = [r for r in records if r[4] == "train"]
    held = [r for r in records if r[4] != "train"]
    want = {
        (min(a[0], b[0]), max(a[0], b[0]))
        for a in train
        for b in held
        if O.same_question(a[1], b[1]) and (a[3] is None or b[3] is None or a[2] == b[2])
    }
    assert want <= got


def test_report_empty_wide_and_long(spark, empty_and_wide):
    df = rows(spark, [(BASE, "A", "train"), (BASE, "A", "test"), (BASE.replace("Bastok", "Gorim"), "A", "test"), ("word " * 5000, "A", "test"), ("word " * 5000, "A", "train")])
    empty, wide = empty_and_wide(df)
    assert O.overlaps(empty).count() == 0 and O.overlap_report(empty).count() == 0
    assert [tuple(r) for r in O.overlap_report(wide).collect()] == [("test", "src", 3, 2)]


def test_slips():
    assert slip("which", "whihc") and slip("town", "toown") and slip("town", "twn") and slip("abc", "abd")
    assert not slip("older", "newer") and not slip("first", "last") and not slip("ab", "ba c")


def test_components_of_chains(spark):
    nodes = list(range(60))
    random.Random(1).shuffle(nodes)
    links = [(f"{a:03d}", f"{b:03d}") for a, b in zip(nodes, nodes[1:])] + [("900", "901"), ("901", "900")]
    got = components(spark.createDataFrame(links, "a string, b string")).collect()
    assert {r.component for r in got} == {"000", "900"} and len(got) == 62
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def slipped(word):
    """Different words one slip of typing away from ``word``."""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in "bkqvwxyz"]


def test_many_wordings_of_one_split_meet_the_other(spark):
    train = [(BASE.replace("located", w), "A", "train") for w in slipped("located")[:40]]
    assert found(spark, [*train, (BASE, "A", "test")]) == {(i, 40) for i in range(40)}


def test_wordings_of_one_split_chain(spark):
    steps = [BASE, BASE.replace("located", "lcoated").replace("worked", "wokred")]
    steps.append(steps[1].replace("town", "twon").replace("Bastok", "Batsok"))
    assert not O.same_question(words(steps[0]), words(steps[2]))
    assert found(spark, [(steps[0], "A", "test"), (steps[1], "A", "train"), (steps[2], "A", "train")]) == {(0, 1), (0, 2)}


def drawn_texts():
    draw = random.Random(7)
    vocabulary = ["the", "of", "in", "who", "town", "twon", "towns", "river", "rivre", "1685", "1686", "thee", "aa", "ab", "x" * 40, "x" * 39 + "y", "x" * 39]
    return sorted({" ".join(draw.choices(vocabulary, k=draw.randint(1, 7))) for _ in range(400)})


@pytest.mark.parametrize(("interval", "rare"), [(4096, 64), (7, 0), (40, 100_000)])
def test_links_hold_every_pair(spark, monkeypatch, interval, rare):
    monkeypatch.setattr(O, "INTERVAL", interval)
    monkeypatch.setattr(O, "RARE", rare)
    texts = drawn_texts()
    got = {r.wording: r.question for r in O.same_texts(spark.createDataFrame([(t,) for t in texts], "wording string")).collect()}
    label = {t: t for t in texts}
    for a in texts:
        for b in texts:
            if label[a] != label[b] and O.same_question(a.split(), b.split()):
                old, new = label[a], label[b]
                label = {t: new if v == old else v for t, v in label.items()}
    groups = {}
    for t, v in label.items():
        groups.setdefault(v, set()).add(t)
    found = {}
    for t, v in got.items():
        found.setdefault(v, set()).add(t)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_name_with_swapped_letters_in_a_crowd_of_one_template(spark):
    draw = random.Random(11)
    names = list({"".join(draw.choice("bdfgklmnprst") + draw.choice("aeiou") for _ in range(4)) for _ in range(3000)})
    items = [(f"In which town is the lake {n.title()} located?", "A", "train") for n in names]
    twins = [n for n in names if n[0] != n[1]][:40]
    items += [(f"In which town is the lake {(n[1] + n[0] + n[2:]).title()} located?", "A", "test") for n in twins]
    assert {(names.index(n), len(names) + i) for i, n in enumerate(twins)} <= found(spark, items)


def test_small_words_only(spark):
    assert found(spark, [("of the", "A", "train"), ("of the", "A", "test"), ("the of", "A", "test"), ("who of the", "A", "test")]) == {(0, 1)}


def test_long_texts_with_one_letter_changed(spark):
    draw = random.Random(3)
    long = " ".join("".join(draw.choices("abcdefghij", k=7)) for _ in range(600))
    assert found(spark, [(long, "A", "train"), (long[:2400] + "z" + long[2401:], "A", "test")]) == {(0, 1)}


def test_texts_of_some_length_with_a_slip(spark):
    items, want = [], set()
    for size in (850, 1200, 2800, 5500):
        draw = random.Random(size)
        long, other = (" ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(size // 7)) for _ in range(2))
        want.add((len(items), len(items) + 1))
        items += [(long, "A", "train"), ("z" + long, None, "test"), (other, "A", "train"), (other[: size // 2] + other[: size // 2], "A", "test")]
    assert found(spark, items) == want
