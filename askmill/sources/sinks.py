"""Outputs of a run: nested rankings, predictions, manifests."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.operators.qa import answer_score


def nested_rankings(ranking: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """One row per query with its ranked list (bounded by the k of the ranking) and, if given, its metrics."""
    lists = ranking.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("rank", "document_id", "score"))).alias("retrieved"))
    if metrics is None:
        return lists
    names = [c for c in metrics.columns if c != "example_id"]
    return lists.join(metrics.select("example_id", F.struct(*names).alias("metrics")), "example_id", "left")


def write_jsonl(df: DataFrame, folder: str) -> None:
    """JSON lines in a new folder; an existing one is an error."""
    df.write.mode("errorifexists").json(folder)


def delivered_records(records: DataFrame) -> DataFrame:
    """Records in the delivered layout, lists of [title, sentence_id] and [title, [sentences]] as JSON texts: (payload).

    The order of facts, paragraphs and sentences is kept; type and level are left out where they are null. Null
    elements keep their place.
    """
    def quoted(value):
        """A string, number or list as JSON."""
        listed = F.to_json(F.array(value))
        return F.substr(listed, F.lit(2), F.length(listed) - 2)

    facts = F.transform("supporting_facts", lambda f: F.when(f.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), quoted(f.title), F.lit(","), quoted(f.sentence_id), F.lit("]"))))
    context = F.transform("context", lambda p: F.when(p.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), quoted(p.title), F.lit(","), quoted(p.sentences), F.lit("]"))))

    def listed(parts):
        return F.coalesce(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")), F.lit("null"))

    members = [
        F.concat(F.lit('"_id":'), quoted(F.col("example_id"))), F.concat(F.lit('"question":'), quoted(F.col("question"))), F.concat(F.lit('"answer":'), quoted(F.col("answer"))),
        F.concat(F.lit('"supporting_facts":'), listed(facts)), F.concat(F.lit('"context":'), listed(context)),
        F.when(F.col("question_type").isNotNull(), F.concat(F.lit('"type":'), quoted(F.col("question_type")))),
        F.when(F.col("level").isNotNull(), F.concat(F.lit('"level":'), quoted(F.col("level")))),
    ]
    return records.select(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("payload"))


def prediction_records(predictions: DataFrame) -> DataFrame:
    """(example_id, prediction, gold_answer, answer_score): outputs with their score embedded, for ``write_jsonl``."""
    score = answer_score(F.coalesce("prediction", F.lit("")), F.coalesce("gold_answer", F.lit("")))
    named = F.struct(score.em.alias("exact_match"), score.f1.alias("f1"), score.prec.alias("precision"), score.recall.alias("recall"))
    return predictions.select("example_id", "prediction", "gold_answer", F.when(F.col("gold_answer").isNotNull(), named).alias("answer_score"))


def not_applicable(examples: DataFrame, reason: str) -> DataFrame:
    """(example_id, status, reason): a placeholder for each example of a run that makes no predictions."""
    return examples.select("example_id", F.lit("not_applicable").alias("status"), F.lit(reason).alias("reason"))


def write_json_atomic(path: str, payload: dict) -> None:
    """A small driver-side file with sorted keys, put in place by one rename."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, sort_keys=True, indent=2)
        f.write("\n")
    os.replace(temporary, path)


def manifest(df: DataFrame, key: str, seed: int) -> dict:
    """Count, distinct keys and an order-free digest of a dataset slice."""
    row = df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("digest")).first()
    return {"rows": row.n, "distinct_keys": row["keys"], "key_digest": str(row.digest), "seed": seed}
