"""Evidence put together under a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.functions.text import BLANK, serialized_context, stripped

#: The texts around a prompt.
DIRECT_INSTRUCTION = 'Answer each question using only its evidence. Return only the shortest answer after "Answer:".'
CHAT_INSTRUCTION = (
    'Use only the provided evidence. Reason briefly and explicitly. End with exactly one final line in the form "Answer: <shortest answer>".'
)
DIRECT_START, DIRECT_END = "<|im_start|><|object_ref_start|>", "<|im_end|>"


def budgeted_sentences(sentences: DataFrame, budget: int, cost: Column) -> DataFrame:
    """The sentences of each example, in order, as long as their running cost keeps to the budget.

    ``sentences(example_id, paragraph_index, sentence_index, sentence)``. After the first sentence that goes
    over, nothing more is taken, even if a later one is shorter.
    """
    order = Window.partitionBy("example_id").orderBy("paragraph_index", "sentence_index").rowsBetween(Window.unboundedPreceding, 0)
    return sentences.withColumn("running", F.sum(cost).over(order)).where(F.col("running") <= budget)


def truncation(sentences: DataFrame, kept: DataFrame) -> DataFrame:
    """(example_id, n_sentences, n_kept, cost, truncated)."""
    whole = sentences.groupBy("example_id").agg(F.count("*").alias("n_sentences"))
    part = kept.groupBy("example_id").agg(F.count("*").alias("n_kept"), F.max("running").alias("cost"))
    return whole.join(part, "example_id", "left").select(
        "example_id", "n_sentences", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("cost", F.lit(0)).alias("cost"),
        (F.coalesce("n_kept", F.lit(0)) < F.col("n_sentences")).alias("truncated"),
    )


def gold_paragraphs(context: Column, facts: Column) -> Column:
    """The paragraphs that a fact names, in the order of the context."""
    titles = F.transform(facts, lambda f: f.title)
    return F.filter(context, lambda p: F.coalesce(F.array_contains(titles, p.title), F.lit(False)))


def append_distractors(evidence: DataFrame, extra: DataFrame) -> DataFrame:
    """(example_id, place, document_id, distractor): evidence in its order, then the distractors in theirs."""
    both = evidence.select("example_id", F.col("place").alias("at"), "document_id", F.lit(False).alias("distractor")).unionByName(
        extra.select("example_id", F.col("place").alias("at"), "document_id", F.lit(True).alias("distractor"))
    )
    order = Window.partitionBy("example_id").orderBy("distractor", "at")
    return both.withColumn("place", F.row_number().over(order)).select("example_id", "place", "document_id", "distractor")


def spaced_words(text: Column) -> Column:
    """The number of runs without white space: the token count where no tokenizer is given."""
    return F.size(F.filter(F.split(text, rf"{BLANK}+"), lambda w: w != ""))


def chat_markup(messages: Column) -> Column:
    """An array of (role, content) as one text between turn marks: the rendering where no other is given."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m.role, F.lit("\n"), m.content, F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(turns, ""), F.lit("<|im_start|>assistant\n"))


def first_sentences(context: Column, n: Column) -> Column:
    """The paragraphs of ``context`` with its first ``n`` sentences over all; paragraphs left without one are dropped."""
    sizes = F.transform(context, lambda p: F.coalesce(F.size(p.sentences), F.lit(0)))
    before = F.transform(context, lambda p, i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    cut_off = F.transform(
        F.arrays_zip(context.alias("p"), before.alias("b")),
        lambda z: F.struct(z.p.title.alias("title"), F.slice(z.p.sentences, F.lit(1), F.greatest(n - z.b, F.lit(0))).alias("sentences")),
    )
    return F.filter(cut_off, lambda p: F.size(p.sentences) > 0)


def within_budget(rows: DataFrame, render: Callable[[Column], Column], token_count: Callable[[Column], Column], budget: int) -> DataFrame:
    """``rows(example_id, question, context)`` with prompt, input_tokens, n_documents, n_sentences, dropped_documents,
    dropped_sentences, truncated and status.

    ``render`` makes the whole prompt of a context and ``token_count`` counts it, so that the count need not be a sum. If the whole
    evidence is too long, sentences are taken in order up to the first with which the prompt goes over the budget. If
    none fits, or there is no evidence, there is no prompt and the status says so.
    """
    if budget < 1:
        raise ValueError("the budget must be positive")
    empty = F.array().cast("array<struct<title:string,sentences:array<string>>>")
    known = F.transform(
        F.filter(F.coalesce("context", empty), lambda p: p.isNotNull()),
        lambda p: F.struct(p.title.alias("title"), F.filter(F.coalesce(p.sentences, F.array().cast("array<string>")), lambda s: s.isNotNull()).alias("sentences")),
    )
    total = F.aggregate("known", F.lit(0), lambda a, p: a + F.size(p.sentences))
    rows = rows.withColumn("known", known).withColumn("total", total)
    rows = rows.withColumn("whole", token_count(render(F.col("known"))) <= budget)
    over = F.transform(F.sequence(F.lit(1), "total"), lambda k: token_count(render(first_sentences(F.col("known"), k))) > budget)
    first_over = F.array_position(over, True).cast("int")
    kept = F.when(F.col("whole"), F.col("total")).when(F.col("total") == 0, 0).when(first_over > 0, first_over - 1).otherwise(F.col("total"))
    rows = rows.withColumn("kept", kept)
    used = F.when(F.col("whole"), F.col("known")).otherwise(first_sentences(F.col("known"), F.col("kept")))
    rows = rows.withColumn("used", used)
    status = F.when(F.size("known") == 0, "no_evidence").when(F.size("used") == 0, "no_sentence_fits").otherwise("ok")
    rows = rows.withColumn("status", status).withColumn("prompt", F.when(F.col("status") == "ok", render(F.col("used"))))
    ok = F.col("status") == "ok"
    return rows.select(
        "example_id", "prompt", token_count(F.col("prompt")).alias("input_tokens"),
        F.when(ok, F.size("used")).alias("n_documents"), F.when(ok, F.col("kept")).alias("n_sentences"),
        F.when(ok, F.size("known") - F.size("used")).alias("dropped_documents"), F.when(ok, F.col("total") - F.col("kept")).alias("dropped_sentences"),
        F.when(ok, ~F.col("whole")).alias("truncated"), "status",
    )


def _evidence(question: Column, context: Column) -> Column:
    return F.regexp_replace(serialized_context(question, context), rf"{BLANK}+\z", "")


def demonstration_messages(rows: DataFrame, rationale: bool = False) -> DataFrame:
    """One row (asked, answered): arrays of the demonstrations' evidence and answers, in the order of example_id.

    ``rows(example_id, question, answer, supporting_facts, context)``, a few stated examples. One without an answer or without
    a paragraph that a fact names is an error. With ``rationale`` the sentences that the facts name stand before the answer.
    """
    facts = F.transform(F.filter("supporting_facts", lambda f: f.isNotNull()), lambda f: F.struct(f.title.alias("t"), f.sentence_id.alias("i")))
    named = F.flatten(
        F.transform(
            F.filter("context", lambda p: p.isNotNull()),
            lambda p: F.filter(F.transform(p.sentences, lambda s, i: F.when(F.array_contains(facts, F.struct(p.title.alias("t"), i.alias("i"))), stripped(s))), lambda s: s.isNotNull()),
        )
    )
    evidence = gold_paragraphs(F.col("context"), F.col("supporting_facts"))
    usable = F.col("answer").isNotNull() & (F.coalesce(F.size(evidence), F.lit(0)) > 0)
    answer = F.concat(F.lit("Answer: "), F.col("answer"))
    if rationale:
        answer = F.concat(F.lit("Reasoning: "), F.array_join(named, " "), F.lit("\n"), answer)
        usable &= F.coalesce(F.size(named), F.lit(0)) > 0
    checked = F.when(usable, F.struct("example_id", _evidence(F.col("question"), evidence).alias("asked"), answer.alias("answered")))
    checked = F.coalesce(checked, F.raise_error(F.concat(F.lit("no demonstration: "), F.coalesce("example_id", F.lit("null")))).cast("struct<example_id:string,asked:string,answered:string>"))
    one = rows.agg(F.array_sort(F.collect_list(checked)).alias("d"))
    return one.select(F.transform("d", lambda x: x.asked).alias("asked"), F.transform("d", lambda x: x.answered).alias("answered"))


def direct_prompts(targets: DataFrame, demonstrations: DataFrame, budget: int, token_count: Callable[[Column], Column] = spaced_words) -> DataFrame:
    """The few-shot prompt of each of ``targets(example_id, question, context)``; only the target's evidence is shortened."""
    shown = demonstration_messages(demonstrations)
    blocks = F.zip_with("asked", "answered", lambda q, a: F.concat(q, F.lit("\n"), a))

    def render(context: Column) -> Column:
        body = F.array_join(F.concat(F.array(F.lit(DIRECT_INSTRUCTION)), blocks, F.array(F.concat(_evidence(F.col("question"), context), F.lit("\nAnswer:")))), "\n\n")
        return F.concat(F.lit(DIRECT_START), body, F.lit(DIRECT_END))

    return within_budget(targets.crossJoin(shown), render, token_count, budget)  # one row


def chat_prompts(
    targets: DataFrame,
    demonstrations: DataFrame,
    budget: int,
    token_count: Callable[[Column], Column] = spaced_words,
    render_chat: Callable[[Column], Column] = chat_markup,
    rationale: bool = False,
) -> DataFrame:
    """The chat prompt of each target after exactly two demonstrations; the target's own answer is never read."""
    shown = demonstration_messages(demonstrations, rationale)
    pair = F.when(F.size("asked") == 2, F.col("asked")).otherwise(F.raise_error("there must be two demonstrations").cast("array<string>"))
    shown = shown.select(pair.alias("asked"), "answered")

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = F.flatten(F.zip_with("asked", "answered", lambda q, a: F.array(message("user", q), message("assistant", a))))

    def render(context: Column) -> Column:
        return render_chat(F.concat(F.array(message("system", F.lit(CHAT_INSTRUCTION))), turns, F.array(message("user", _evidence(F.col("question"), context)))))

    return within_budget(targets.crossJoin(shown), render, token_count, budget)  # one row


def first_chunk(tokens: Column, size: int) -> Column:
    """struct(chunk, n_chunks, truncated): what a reader of ``size`` tokens sees of a text, and whether anything is left over."""
    n = F.greatest(F.ceil(F.size(tokens) / size), F.lit(1)).cast("int")
    return F.struct(F.slice(tokens, 1, size).alias("chunk"), n.alias("n_chunks"), (n > 1).alias("truncated"))
