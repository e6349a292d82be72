"""Scalar text functions as Spark expressions; Arrow functions only where Spark has none."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the 32 ASCII punctuation characters.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
_SPACE = r"(?U)\s+"


def fold(text: Column) -> Column:
    """Lower case with the one folding that matters in the corpus languages."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def normalize_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and the words a, an, the; single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    bare = F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(?:a|an|the)(?![\p{L}\p{N}_])", " ")
    return F.trim(F.regexp_replace(bare, _SPACE, " "))


def answer_tokens(text: Column) -> Column:
    """The words of a normalised answer; an empty one has none."""
    return F.filter(F.split(normalize_answer(text), " "), lambda w: w != "")


@F.pandas_udf(T.StringType())
def canonical_title(title: pd.Series) -> pd.Series:
    """Compatibility normal form with single spaces, case kept."""
    return title.map(lambda s: " ".join(unicodedata.normalize("NFKC", s).split()), na_action="ignore")


def paragraph_text(sentences: Column) -> Column:
    """The sentences of a paragraph as one text; null sentences are left out."""
    return F.trim(F.array_join(sentences, ""))


def joined_text(value: Column) -> Column:
    """The text of a JSON value: a string, a list of strings (joined directly) or lists of them (by lines).

    Blank lines of nested lists are dropped; anything else is null.
    """
    flat = F.try_variant_get(value, "$", "array<string>")
    nested = F.try_variant_get(value, "$", "array<array<string>>")
    kind = F.schema_of_variant(value)
    lines = F.filter(F.transform(nested, lambda p: F.trim(F.array_join(p, ""))), lambda s: s != "")
    return F.trim(
        F.when(kind.startswith("ARRAY<ARRAY"), F.array_join(lines, "\n"))
        .when(kind.startswith("ARRAY"), F.array_join(flat, ""))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    )


#: White space in texts (fixed value): the ASCII kinds, the separators of Unicode and the next-line sign.
BLANK = r"[\s\p{Z}\x1C-\x1F\x85]"
#: Marks at which a generated text ends.
END_MARKS = ("<|im_end|>", "<|endoftext|>")


def stripped(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def before_marks(text: Column, marks: tuple[str, ...] = END_MARKS) -> Column:
    """``text`` up to the first of the marks."""
    for mark in marks:
        text = F.substring_index(text, mark, 1)
    return text


def serialized_context(question: Column, context: Column) -> Column:
    """The question, then numbered documents (from 1) with numbered sentences (from 0); the layout is a fixed value.

    Null sentences are empty lines of their own, null paragraphs have no place.
    """
    paragraphs = F.transform(
        F.filter(context, lambda p: p.isNotNull()),
        lambda p, i: F.concat(
            F.lit("[Document "),
            (i + 1).cast("string"),
            F.lit("] "),
            F.coalesce(p.title, F.lit("")),
            F.lit("\n"),
            F.array_join(
                F.transform(
                    F.coalesce(p.sentences, F.array().cast("array<string>")),
                    lambda s, j: F.concat(F.lit("("), j.cast("string"), F.lit(") "), stripped(F.coalesce(s, F.lit(""))), F.lit("\n")),
                ),
                "",
            ),
        ),
    )
    whole = F.concat(F.lit("Question: "), stripped(question), F.lit("\n\nEvidence:\n"), F.array_join(paragraphs, "\n"))
    return F.concat(F.regexp_replace(whole, rf"{BLANK}+\z", ""), F.lit("\n"))


_ANSWER_LINE = rf"(?imd)^{BLANK}*(?:final{BLANK}+)?answer{BLANK}*:{BLANK}*(.+?){BLANK}*$"
_ANSWER_START = rf"(?imd)^{BLANK}*(?:final{BLANK}+)?answer{BLANK}*:"


def _unwrapped(value: Column, commands: str) -> Column:
    """What ``command{...}`` holds if it is the whole value, else the value."""
    return F.regexp_replace(value, rf"(?s)\A\\(?:{commands})\{{{BLANK}*(.*?){BLANK}*\}}\z", "$1")


def _without_dollars(value: Column) -> Column:
    return F.regexp_replace(stripped(value), rf"\A\$+{BLANK}*|{BLANK}*\$+\z", "")


def unwrap_box(value: Column) -> Column:
    r"""An answer without dollar signs, without ``\boxed{}`` around it, and then without ``\text{}`` around it."""
    return _unwrapped(_unwrapped(_without_dollars(value), "boxed"), "text")


def unwrap_latex_text(value: Column) -> Column:
    r"""An answer without dollar signs and without the first of ``\text{}``, ``\mathrm{}``, ``\operatorname{}`` around it."""
    return _unwrapped(_without_dollars(value), "text|mathrm|operatorname")


def _with(value: Column, body) -> Column:
    """``body(value)``, where ``value`` is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def final_answer(text: Column) -> Column:
    """struct(answer, status, method) of the last answer line before an end mark.

    Status: ``empty`` (null text too), ``missing_final_answer`` (no line, or none with anything behind the colon),
    ``empty_final_answer`` (nothing but wrapping), ``ok``.
    """
    def judged(x: Column) -> Column:
        status = (
            F.when(F.coalesce(x.kept, F.lit("")) == "", "empty")
            .when(x.line.isNull(), "missing_final_answer")
            .when(x.answer == "", "empty_final_answer")
            .otherwise("ok")
        )
        return F.struct(x.answer.alias("answer"), status.alias("status"))

    def line(kept: Column) -> Column:
        last = F.try_element_at(F.regexp_extract_all(kept, F.lit(_ANSWER_LINE), F.lit(1)), F.lit(-1))
        return F.struct(kept.alias("kept"), last.alias("line"), unwrap_box(last).alias("answer"))

    def named(x: Column) -> Column:
        method = F.when(x.status == "ok", "last_answer_line").when(x.status == "empty_final_answer", "answer_line").otherwise("none")
        return F.struct(F.when(x.status == "ok", x.answer).alias("answer"), x.status.alias("status"), method.alias("method"))

    return _with(_with(_with(stripped(before_marks(text)), line), judged), named)


def explicit_reasoning(text: Column) -> Column:
    """True if a line before the end marks is neither blank nor an answer line; null text has none."""
    lines = F.transform(F.split(before_marks(text), r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"), stripped)
    return F.coalesce(F.exists(lines, lambda x: (x != "") & ~x.rlike(rf"(?i)^(?:final{BLANK}+)?answer{BLANK}*:")), F.lit(False))


def boxed_content(text: Column) -> Column:
    """What the first box holds up to its own closing brace; null if it is never closed or there is none."""
    opened = F.instr(text, "\\boxed{")
    after = F.substr(text, opened + 7)
    braces = F.aggregate(
        F.split(after, ""),
        F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at")),
        lambda acc, c: F.when(
            acc.depth > 0,
            F.struct((acc.depth + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"), (acc.at + 1).alias("at")),
        ).otherwise(acc),
    )
    return F.when((opened > 0) & (braces.depth == 0), stripped(F.substr(after, F.lit(1), braces.at - 1)))


def short_answer(text: Column) -> Column:
    """struct(answer, status, method): the content of the first box, else the first line without its answer prefix."""
    kept = stripped(before_marks(text, ("<|box_end|>", *END_MARKS)))
    boxed = unwrap_latex_text(boxed_content(kept))
    lines = F.transform(F.split(kept, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"), stripped)
    first = F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))
    first = _without_dollars(F.regexp_replace(first, rf"(?i)^(?:final )?answer:{BLANK}*", ""))
    in_box = F.coalesce(boxed != "", F.lit(False))
    answer = F.when(in_box, boxed).otherwise(F.nullif(first, F.lit("")))
    return F.struct(
        answer.alias("answer"),
        F.when(answer.isNull(), "empty").otherwise("ok").alias("status"),
        F.when(answer.isNull(), "none").when(in_box, "latex_boxed").otherwise("first_line").alias("method"),
    )


def without_control_tokens(text: Column) -> Column:
    """``text`` without control tokens and think tags, with single spaces."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<\|[^>]+\|>", " "), r"</?think>", " ")
    return stripped(F.regexp_replace(bare, rf"{BLANK}+", " "))


def reasoning(text: Column) -> Column:
    """struct(present, method, content): reasoning in a closed or unclosed think block, or before the first answer line.

    Only what stands before the end marks counts, of a block what follows its last opening tag; markup alone is no
    reasoning. A null text has none.
    """
    kept = F.coalesce(before_marks(text), F.lit(""))
    closed, opened = F.contains(kept, F.lit("</think>")), F.contains(kept, F.lit("<think>"))
    within = F.substring_index(F.substring_index(kept, "</think>", 1), "<think>", -1)
    before = F.element_at(F.split(kept, _ANSWER_START, 2), 1)
    method = F.when(closed, "closed_think_block").when(opened, "unclosed_think_block").otherwise("pre_answer_text")
    content = F.when(closed, without_control_tokens(within)).when(opened, without_control_tokens(F.substring_index(kept, "<think>", -1)))
    content = content.otherwise(without_control_tokens(before))
    return F.struct((content != "").alias("present"), method.alias("method"), content.alias("content"))


#: Fixed value: the instruction that the vector model's queries begin with.
QUERY_INSTRUCTION = "Given a web search query, retrieve relevant passages that answer the query"


def instructed_query(question: Column) -> Column:
    """The question under the retrieval instruction; a blank or null question is an error."""
    blank = F.coalesce(stripped(question), F.lit("")) == ""
    return F.when(blank, F.raise_error("a query can't be blank").cast("string")).otherwise(
        F.concat(F.lit(f"Instruct: {QUERY_INSTRUCTION}\nQuery:"), question)
    )


def example_seed(seed: Column, example_id: Column) -> Column:
    """The first eight bytes of a hash as an unsigned number."""
    digest = F.sha2(F.concat(seed.cast("string"), F.lit("\x00"), example_id), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
