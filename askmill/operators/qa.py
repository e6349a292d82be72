"""Scores of answers and of supporting facts against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.functions.text import answer_tokens, normalize_answer


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def answer_score(prediction: Column, gold: Column) -> Column:
    """struct(em, f1, prec, recall) of multiset token overlap.

    If either side is yes, no or noanswer and the other differs, all but the exact match is 0 as well.
    """
    p, g = answer_tokens(prediction), answer_tokens(gold)
    np_, ng = normalize_answer(prediction), normalize_answer(gold)
    common = F.aggregate(
        F.array_distinct(p),
        F.lit(0),
        lambda acc, t: acc + F.least(F.size(F.filter(p, lambda x: x == t)), F.size(F.filter(g, lambda x: x == t))),
    )
    closed = ("yes", "no", "noanswer")
    veto = (np_.isin(*closed) | ng.isin(*closed)) & (np_ != ng)
    none = veto | (common == 0)
    prec = F.when(none, 0.0).otherwise(common / F.greatest(F.size(p), F.lit(1)))
    recall = F.when(none, 0.0).otherwise(common / F.greatest(F.size(g), F.lit(1)))
    return F.struct((np_ == ng).cast("double").alias("em"), _f1(prec, recall).alias("f1"), prec.alias("prec"), recall.alias("recall"))


def support_score(predicted: Column, gold: Column) -> Column:
    """struct(sp_em, sp_f1, sp_prec, sp_recall) of two arrays of (title, sentence_id) taken as sets; both empty match exactly with f1 0."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    tp = F.size(F.array_intersect(p, g))
    prec = F.when(F.size(p) > 0, tp / F.size(p)).otherwise(0.0)
    recall = F.when(F.size(g) > 0, tp / F.size(g)).otherwise(0.0)
    em = (F.size(F.array_except(p, g)) + F.size(F.array_except(g, p)) == 0).cast("double")
    return F.struct(em.alias("sp_em"), _f1(prec, recall).alias("sp_f1"), prec.alias("sp_prec"), recall.alias("sp_recall"))


def joint_score(answer: Column, support: Column, both: Column) -> Column:
    """struct(joint_em, joint_f1, joint_prec, joint_recall) from the products of precision and recall; 0 unless ``both``."""
    prec = F.when(both, answer.prec * support.sp_prec).otherwise(0.0)
    recall = F.when(both, answer.recall * support.sp_recall).otherwise(0.0)
    em = F.when(both, answer.em * support.sp_em).otherwise(0.0)
    return F.struct(em.alias("joint_em"), _f1(prec, recall).alias("joint_f1"), prec.alias("joint_prec"), recall.alias("joint_recall"))


METRICS = ("em", "f1", "prec", "recall", "sp_em", "sp_f1", "sp_prec", "sp_recall", "joint_em", "joint_f1", "joint_prec", "joint_recall")


def evaluate(examples: DataFrame, answers: DataFrame, support: DataFrame) -> DataFrame:
    """Twelve scores per example.

    ``examples(example_id, answer, facts)``, ``answers(example_id, prediction)``, ``support(example_id,
    predicted)``, where facts and predicted are arrays of struct(title, sentence_id). A missing answer counts as "", missing support as none; joint scores are 0 unless both are there.
    """
    joined = examples.join(answers, "example_id", "left").join(support, "example_id", "left")
    both = F.col("prediction").isNotNull() & F.col("predicted").isNotNull()
    none = F.array().cast(examples.schema["facts"].dataType)
    scored = joined.select(
        "example_id",
        F.col("prediction").isNull().alias("missing_answer"),
        F.col("predicted").isNull().alias("missing_support"),
        both.alias("both"),
        answer_score(F.coalesce("prediction", F.lit("")), F.coalesce("answer", F.lit(""))).alias("a"),
        support_score(F.coalesce("predicted", none), F.coalesce("facts", none)).alias("s"),
    )
    return scored.select("*", joint_score(F.col("a"), F.col("s"), F.col("both")).alias("j")).select(
        "example_id", "missing_answer", "missing_support", "a.*", "s.*", "j.*"
    )


def macro(scored: DataFrame) -> DataFrame:
    """One row: the number of examples, of missing answers and support, and the mean of every score."""
    return scored.agg(
        F.count("*").alias("n"),
        F.count_if("missing_answer").alias("missing_answers"),
        F.count_if("missing_support").alias("missing_support"),
        *(F.round(F.avg(m), 9).alias(m) for m in METRICS),
    )
