from pyspark.sql import functions as F

from askmill.llm import minhash
from askmill.llm.responses import defects

Q = "Which town lies closest to Pofedrirg Gallery, the museum documented in 1685?"
PROMPT = "Evidence:\n[1] Pofedrirg Gallery: Pofedrirg Gallery stands close to the town of Klobestond.\n\nQuestion: " + Q
SCHEMA = (
    "prediction_id long, example_id string, prediction string, extraction struct<answer string, status string, method string>, "
    "raw_output string, prompt string, gold_answer string"
)
REASON = "The passage on Pofedrirg Gallery seems to be the relevant one.\n"
CASES = {
    "Answer: Klobestond": None, "Answer: it lies close to the town of Klobestond": None, "Answer: $\\boxed{Klobestond}$": None, "Final answer: Wrongtown<|im_end|>": None,
    "I cannot rule out that there is another one.\nAnswer: Klobestond": None, Q + "\nAnswer: Klobestond": None, "Answer: klobestond": None,
    "": "empty", "  \n": "empty", "Answer:": "empty", "Answer: -": "empty", "Answer: N/A": "empty", "<think>It is there.</think>\n": "empty", "<|im_end|>": "empty", None: "empty",
    "<think>It is": "truncated", REASON + "The museum belongs to": "truncated", "Answer: Klobes": "truncated", "Answer: Pofedrirg Gal": "truncated",
    "Answer: I am unable to answer this from the evidence given.": "refusal", "I'm sorry, but I can't help with that request.": "refusal",
    "Leider kann ich diese Frage nicht beantworten.": "refusal", "It would not be appropriate for me to comment on Pofedrirg Gallery.": "refusal",
    "Answer: " + Q.upper(): "copied_question", Q[:-1]: "copied_question", Q + " " + Q: "copied_question",
    "Answer: il se trouve près de la ville de Klobestond": "other_language", "Answer: Es liegt nahe der Stadt Klobestond.": "other_language",
}


def table(spark, outputs, prompt=PROMPT):
    return spark.createDataFrame([(i, f"e{i}", None, None, t, prompt, "Klobestond") for i, t in enumerate(outputs)], SCHEMA)


def gold(spark, rows=()):
    return spark.createDataFrame(list(rows), "example_id string, question string")


def test_each_kind(spark):
    outputs = list(CASES)
    got = {r.prediction_id: r.defect for r in defects(table(spark, outputs), gold(spark)).collect()}
    assert {t: got.get(i) for i, t in enumerate(outputs)} == CASES


def test_question_comes_from_gold_without_a_prompt(spark):
    rows = table(spark, ["Answer: " + Q, "Answer: " + Q], prompt=None)
    got = defects(rows, gold(spark, [("e0", Q), ("e0", Q), (None, "x")]))
    assert [(r.prediction_id, r.defect) for r in got.collect()] == [(0, "copied_question")]


def test_nulls_repeats_empty_and_wide(spark, empty_and_wide):
    rows = table(spark, ["Answer: x", "Answer: " + "Aa " * 20_000 + "."])
    nulls = rows.select("prediction_id", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "prediction_id"))
    assert {r.defect for r in defects(nulls.unionByName(nulls), gold(spark)).collect()} == {"empty"}
    empty, wide = empty_and_wide(rows)
    assert defects(empty, gold(spark)).count() == 0
    assert {(r.prediction_id, r.defect) for r in defects(wide, empty_and_wide(gold(spark, [("e", "q")]))[1]).collect()} == {(r.prediction_id, r.defect) for r in defects(rows, gold(spark)).collect()}


def test_clusters_are_verified(spark):
    a = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    texts = [a, a + " seventeen", "six five four three two one", "one two", None, a]
    got = {r.text: r.cluster for r in minhash.clusters(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got[a] == got[a + " seventeen"] and len(got) == 4 and len(set(got.values())) == 3


def test_refusal_without_a_listed_phrase_recurs_and_says_nothing(spark):
    said = {"Answer: Someone else would be better placed for such things.": "refusal", "Answer: It stands by the old water tower.": None, "Answer: Ask me another time, my friend.": None}
    unlisted, wrong, once = said
    asked = [f"Which town lies closest to {n} Gallery, the museum documented in 1685?" for n in ("Pofed", "Rirg", "Tudra", "Dend")]
    rows = [(q, t, "water tower" if t == wrong and i == 0 else "Klobestond") for i, q in enumerate(asked) for t in (unlisted, wrong)] + [(asked[0], once, "Klobestond")]
    df = spark.createDataFrame([(i, f"e{i}", None, None, t, f"Evidence: none\n\nQuestion: {q}", g) for i, (q, t, g) in enumerate(rows)], SCHEMA)
    got = {r.prediction_id: r.defect for r in defects(df, gold(spark)).collect()}
    assert [got.get(i) for i in range(len(rows))] == [said[t] for _, t, _ in rows]


def test_declining_templates_without_a_listed_phrase(spark):
    towns = [f"Mo{a}{b}rim" for a in "bdfgk" for b in "aeiouläö"]
    asked = [f"In which town is the lake Lake {t} located?" for t in towns]
    templates = ["That falls outside the topics I discuss.", "You had better put that to someone with more time."]
    rows = [(q, "Answer: " + t, "Klobestond") for q in asked for t in templates]
    rows += [(q, f"Answer: it lies close to the town of {t}", t) for q, t in zip(asked, towns)] + [(q, "Answer: by the old water tower", "the old water tower") for q in asked]
    df = spark.createDataFrame([(i, f"e{i}", None, None, t, f"Evidence: none\n\nQuestion: {q}", g) for i, (q, t, g) in enumerate(rows)], SCHEMA)
    got = {r.prediction_id: r.defect for r in defects(df, gold(spark)).collect()}
    assert got == {i: "refusal" for i in range(len(asked) * len(templates))}


def test_short_answers_that_are_whole(spark):
    df = spark.createDataFrame([(1, "e", None, None, "Answer: no", PROMPT, "Norubald"), (2, "e", None, None, "Answer: 168", PROMPT, "1685"), (3, "e", None, None, "Answer: Norub", PROMPT, "Norubald")], SCHEMA)
    assert {r.prediction_id: r.defect for r in defects(df, gold(spark)).collect()} == {3: "truncated"}


def test_clusters_against_all_pairs(spark):
    import random

    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        base = draw.choices(vocabulary, k=draw.randint(20, 40))
        for _ in range(draw.randint(1, 4)):
            texts.append(" ".join(base[draw.randint(0, 2) :] + draw.choices(vocabulary, k=draw.randint(0, 2))))
    texts = sorted(set(texts))

    def runs(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    pairs = [(a, b) for a in texts for b in texts if a < b and len(runs(a) & runs(b)) >= 0.8 * len(runs(a) | runs(b))]
    of = {r.text: r.cluster for r in minhash.clusters(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert pairs and sum(of[a] == of[b] for a, b in pairs) >= 0.9 * len(pairs)


def test_clusters_leave_out_no_pair(spark):
    import random

    draw, texts = random.Random(11), set()
    words = [f"w{i}" for i in range(40)]
    for length, families in ((8, 40), (9, 40), (11, 40), (14, 30), (25, 30), (60, 10)):
        for _ in range(families):
            base = draw.choices(words, k=length)
            for _ in range(12):
                start, end = draw.randint(0, 2), draw.choices(words, k=draw.randint(0, 2))
                texts.add(" ".join(base[start : length - draw.randint(0, 2)] + end))
    texts = sorted(texts) + ["", "one"]

    def runs(t):
        w = t.split(" ")
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    sets, of = {t: runs(t) for t in texts}, {t: t for t in texts}

    def top(t):
        return t if of[t] == t else top(of[t])

    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                of[top(b)] = top(a)
    got = {r.text: r.cluster for r in minhash.clusters(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert len(got) == len(texts)
    assert len(set(got.values())) == len({top(t) for t in texts}) == len({(got[t], top(t)) for t in texts})
