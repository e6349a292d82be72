import json

from pyspark.sql import types as T

from askmill.operators.shred import KEY, assemble, leaves, shred
from askmill.plans.nested import flat_tables, keyed_records, resolved_facts
from askmill.sources.qa import RECORD, parse_records

SCHEMA = T.StructType([T.StructField(KEY, T.StringType()), RECORD["context"], RECORD["supporting_facts"]])
CONTEXT = [
    None,
    [],
    [None, ("A", None), ("B", []), (None, ["x", None, ""]), ("A", ["y"])],
    [("C", [None])],
]


def frame(spark, contexts=CONTEXT):
    return spark.createDataFrame([(str(k), c, None) for k, c in enumerate(contexts)], SCHEMA)


def test_levels(spark):
    column = shred(frame(spark), KEY, ["context"])["context[].sentences[]"]
    got = {}
    for r in column.orderBy(KEY, "seq").collect():
        got.setdefault(r[KEY], []).append((r.rep, r["def"], r.value))
    assert got["0"] == [(0, 0, None)]
    assert got["1"] == [(0, 1, None)]
    assert got["2"] == [(0, 2, None), (1, 3, None), (1, 4, None), (1, 6, "x"), (2, 5, None), (2, 6, ""), (1, 6, "y")]
    assert [x.max_def for x in leaves(T.StructType([RECORD["context"]]))] == [4, 6]


def test_tables_from_levels(spark):
    shredded = shred(frame(spark), KEY, ["context"])
    paragraphs = assemble(shredded, RECORD, "context[]").where(f"{KEY} = '2'").orderBy("i1").collect()
    assert [(r.i1, r.present, r.title) for r in paragraphs] == [(0, False, None), (1, True, "A"), (2, True, "B"), (3, True, None), (4, True, "A")]
    sentences = assemble(shredded, RECORD, "context[].sentences[]").orderBy(KEY, "i1", "i2").collect()
    assert [(r[KEY], r.i1, r.i2, r.value) for r in sentences] == [
        ("2", 3, 0, "x"), ("2", 3, 1, None), ("2", 3, 2, ""), ("2", 4, 0, "y"), ("3", 0, 0, None),
    ]
    assert [r.present for r in sentences] == [True, False, True, True, False]


def test_three_deep(spark):
    schema = T.StructType([T.StructField(KEY, T.LongType()), T.StructField("v", T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType()))))])
    value = [[[1, 2], [], [3]], [], None, [[None], [4]]]
    shredded = shred(spark.createDataFrame([(7, value)], schema))
    rows = assemble(shredded, schema, "v[][][]").orderBy("i1", "i2", "i3").collect()
    assert [(r.i1, r.i2, r.i3, r.value) for r in rows] == [(0, 0, 0, 1), (0, 0, 1, 2), (0, 2, 0, 3), (3, 0, 0, None), (3, 1, 0, 4)]


def raw(spark, payloads):
    return spark.createDataFrame([(k, p) for k, p in enumerate(payloads)], "raw_id long, payload string")


def test_both_layouts(spark):
    a = {"_id": "e", "question": "q", "supporting_facts": [["A", 1], None, ["B", -1]], "context": [["A", ["x", None]], None, ["B", []]]}
    b = {"id": "f", "supporting_facts": {"title": ["A"], "sent_id": [0]}, "context": {"title": ["A", None], "sentences": [["x"], None]}}
    whole = json.dumps(a)
    got = {r.example_id: r for r in parse_records(raw(spark, [whole, json.dumps(b), None, whole[:-9], "", "[]", whole + "x"])).collect()}
    assert set(got) == {"e", "f"}
    assert [f and tuple(f) for f in got["e"].supporting_facts] == [("A", 1), None, ("B", -1)]
    assert [p and (p.title, p.sentences) for p in got["e"].context] == [("A", ["x", None]), None, ("B", [])]
    assert [(p.title, p.sentences) for p in got["f"].context] == [("A", ["x"]), (None, None)]


def test_facts_lead_to_sentences(spark):
    context = [("A", ["x", "", None]), ("A", ["y"]), None]
    facts = [("A", 0), ("A", 1), ("A", 2), ("A", 5), (None, 0), ("a", 0), ("A", None), None, ("A", 0)]
    record = ("e", None, None, None, None, facts, context)
    gold = spark.createDataFrame([record, record], RECORD)
    records = keyed_records(gold, raw(spark, []))
    assert records.first().n_copies == 2
    got = {tuple(r) for r in resolved_facts(flat_tables(records)).collect()}
    assert got == {("e", 0, 0, 0), ("e", 0, 1, 0), ("e", 1, 0, 1), ("e", 8, 0, 0), ("e", 8, 1, 0)}


def test_empty_and_wider_tables(spark):
    from pyspark.sql import functions as F

    gold = spark.createDataFrame([], RECORD).withColumn("seq", F.lit(1)).withColumn("value", F.lit("x"))
    tables = flat_tables(keyed_records(gold, raw(spark, []).withColumn("r", F.lit(1))))
    assert resolved_facts(tables).count() == 0
    assert all(t.count() == 0 for t in tables.values())


def test_long_record(spark):
    context = [(str(k), [str(j) for j in range(50)]) for k in range(200)]
    rows = assemble(shred(frame(spark, [context]), KEY, ["context"]), RECORD, "context[].sentences[]")
    assert rows.where("i1 = 199 AND i2 = 49 AND value = '49'").count() == 1
    assert rows.count() == 10_000


def test_values_come_back_exactly(spark):
    import datetime

    inner = "xs array<struct<b: binary, d: double, f: float, t: timestamp, n: decimal(20,5), s: string>>"
    xs = [
        (bytearray(b"\xff\x00a"), 0.1 + 0.2, 1.1, datetime.datetime(2026, 10, 25, 2, 30, 0, 123456), None, ""),
        (bytearray(b""), float("inf"), float("-0.0"), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), None, None),
        (None, 5e-324, 3.4028235e38, None, None, "é\n"),
    ]
    df = spark.createDataFrame([("k", xs)], f"{KEY} string, {inner}")
    got = assemble(shred(df, KEY, ["xs"]), df.select("xs").schema, "xs[]").orderBy("i1").select("b", "d", "f", "t", "n", "s").collect()
    assert [repr(tuple(r)) for r in got] == [repr(tuple(r)) for r in df.selectExpr("inline(xs)").collect()]
