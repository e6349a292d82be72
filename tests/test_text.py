import pytest
from pyspark.sql import functions as F

from askmill.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "expected"),
    [("The U.S.-based cat!", "usbased cat"), ("  An   Answer ", "answer"), ("", ""), (None, None), ("a an the", ""), ("theatre", "theatre")],
)
def test_normalize_answer(spark, value, expected):
    assert one(spark, T.normalize_answer, value) == expected


def test_tokens(spark):
    assert one(spark, T.tokens, "Straße ÉCOLE naïve_x 12½ x²") == ["strasse", "école", "naïve_x", "12½", "x²"]


@pytest.mark.parametrize(
    ("value", "answer", "status", "method"),
    [
        ("Answer: midfielder\nFinal answer: defender", "defender", "ok", "last_answer_line"),
        ("text\nAnswer: $\\boxed{Paris}$", "Paris", "ok", "last_answer_line"),
        ("Answer: \\boxed{\\text{Paris}}", "Paris", "ok", "last_answer_line"),
        ("Answer: $\\text{ Paris }$ ", "Paris", "ok", "last_answer_line"),
        ("no line here", None, "missing_final_answer", "none"),
        ("Reason\nAnswer:", None, "missing_final_answer", "none"),
        ("Answer:\n\nParis", "Paris", "ok", "last_answer_line"),
        ("Answer: $ $", None, "empty_final_answer", "answer_line"),
        ("Answer: \\boxed{}", None, "empty_final_answer", "answer_line"),
        ("", None, "empty", "none"),
        (" \u00a0\n", None, "empty", "none"),
        (None, None, "empty", "none"),
        ("Answer: a<|im_end|>\nAnswer: b", "a", "ok", "last_answer_line"),
        ("Answer: a<|end|>", "a<|end|>", "ok", "last_answer_line"),
        ("The answer: x\nANSWER\u00a0: y\u2003", "y", "ok", "last_answer_line"),
    ],
)
def test_final_answer(spark, value, answer, status, method):
    assert tuple(one(spark, T.final_answer, value)) == (answer, status, method)


@pytest.mark.parametrize(
    ("value", "content"),
    [
        ("\\boxed{a}", "a"), ("x \\boxed{\\frac{1}{2}} y", "\\frac{1}{2}"), ("\\boxed{open", None), ("none", None), (None, None),
        ("\\boxed{ one } then \\boxed{two}", "one"), ("\\boxed{open \\boxed{two}", None), ("a}b \\boxed{x}}", "x"),
    ],
)
def test_boxed_content(spark, value, content):
    assert one(spark, T.boxed_content, value) == content


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("\\boxed{Paris}", ("Paris", "ok", "latex_boxed")), ("so \\boxed{\\mathrm{Paris}} it is", ("Paris", "ok", "latex_boxed")),
        ("\n  Answer: $Paris$\nmore", ("Paris", "ok", "first_line")), ("FINAL ANSWER: Paris", ("Paris", "ok", "first_line")), ("Paris<|box_end|>x", ("Paris", "ok", "first_line")),
        ("\\boxed{}\nnext", ("\\boxed{}", "ok", "first_line")), ("Answer:", (None, "empty", "none")), ("", (None, "empty", "none")), (None, (None, "empty", "none")),
    ],
)
def test_short_answer(spark, value, expected):
    assert tuple(one(spark, T.short_answer, value)) == expected


@pytest.mark.parametrize(
    ("value", "present", "method", "content"),
    [
        ("<think>\n\n</think>\nAnswer: a", False, "closed_think_block", ""),
        ("<think>because</think>Answer: a", True, "closed_think_block", "because"),
        ("Text before.<think></think>\nAnswer: a", False, "closed_think_block", ""),
        ("<think>one<think> two \n three</think>", True, "closed_think_block", "two three"),
        ("<think>because", True, "unclosed_think_block", "because"),
        ("<think><|start|>", False, "unclosed_think_block", ""),
        ("So it is.\nAnswer: a", True, "pre_answer_text", "So it is."),
        ("Answer: a", False, "pre_answer_text", ""),
        ("Answer: a<|im_end|><think>late</think>", False, "pre_answer_text", ""),
        (None, False, "pre_answer_text", ""),
    ],
)
def test_reasoning(spark, value, present, method, content):
    assert tuple(one(spark, T.reasoning, value)) == (present, method, content)


@pytest.mark.parametrize(
    ("value", "expected"),
    [("Because.\nAnswer: a", True), ("Answer: a", False), ("\n final  answer : a\n", False), ("Answer: a<|im_end|>\nmore", False), ("Answer: a\nmore", True), (None, False)],
)
def test_explicit_reasoning(spark, value, expected):
    assert one(spark, T.explicit_reasoning, value) is expected


def test_serialized_context(spark):
    df = spark.createDataFrame([(" Who? ", [("A", [" one ", "two"]), None, ("B", [])])], "q string, c array<struct<title:string,sentences:array<string>>>")
    got = df.select(T.serialized_context(F.col("q"), F.col("c")).alias("y")).first().y
    assert got == "Question: Who?\n\nEvidence:\n[Document 1] A\n(0) one\n(1) two\n\n[Document 2] B\n"


def test_instructed_query(spark):
    assert one(spark, T.instructed_query, "Who?") == "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery:Who?"
    with pytest.raises(Exception, match="blank"):
        one(spark, T.instructed_query, "  ")


def test_canonical_title(spark):
    assert one(spark, T.canonical_title, " Ｆilm  x ") == "Film x"


def test_joined_text(spark):
    rows = [('"a"', "a"), ('["a","b"]', "ab"), ('[["a","b"],[" "],["c"]]', "ab\nc"), ("3", None)]
    df = spark.createDataFrame(rows, "j string, e string").select(T.joined_text(F.try_parse_json("j")).alias("y"), "e")
    assert all(r.y == r.e for r in df.collect())
