"""Quality of rankings against relevant items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_hits(batches: DataFrame, k: int) -> DataFrame:
    """(example_id, rank, document_id, score): one list of the ``k`` best documents over all batches of an example.

    Hits without a document or a finite score don't count; a document counts with its best score.
    """
    hits = batches.where("example_id IS NOT NULL").select("example_id", F.explode("retrieved").alias("h"))
    hits = hits.select("example_id", "h.document_id", "h.score").where(
        "document_id IS NOT NULL AND score < double('Infinity') AND score > double('-Infinity')"
    )
    best = hits.groupBy("example_id", "document_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("example_id").orderBy(F.desc("score"), "document_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("example_id", "rank", "document_id", "score")


def relevant_titles(batches: DataFrame) -> DataFrame:
    """(example_id, document_id): the different gold titles of each example."""
    rows = batches.where("example_id IS NOT NULL").select("example_id", F.explode("gold_titles").alias("document_id"))
    return rows.where("document_id IS NOT NULL").distinct()


def gold_ranks(relevant: DataFrame, ranking: DataFrame) -> DataFrame:
    """(example_id, document_id, rank): the rank of every relevant item, null where it is missing."""
    return relevant.join(ranking.select("example_id", "document_id", "rank"), ["example_id", "document_id"], "left")


def recall_at(ranks: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """(example_id, recall_at_k..., all_at_k...): one ranking serves all cutoffs."""
    aggregates = []
    for k in cutoffs:
        found = F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False)))
        aggregates += [
            (found / F.count("*")).alias(f"recall_at_{k}"),
            (found == F.count("*")).cast("int").alias(f"all_at_{k}"),
        ]
    return ranks.groupBy("example_id").agg(*aggregates)


def fact_recall_at(facts: DataFrame, ranking: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """(example_id, n_facts, fact_recall_at_k...): every fact row counts, repeated ones as well."""
    joined = facts.join(ranking.select("example_id", "document_id", "rank"), ["example_id", "document_id"], "left")
    return joined.groupBy("example_id").agg(
        F.count("*").alias("n_facts"),
        *((F.count_if(F.coalesce(F.col("rank") <= k, F.lit(False))) / F.count("*")).alias(f"fact_recall_at_{k}") for k in cutoffs),
    )


def outcomes(ranks: DataFrame) -> DataFrame:
    """(outcome, n, rate): examples with all, some or none of their relevant items found."""
    per = ranks.groupBy("example_id").agg(F.count("rank").alias("found"), F.count("*").alias("wanted"))
    named = per.select(
        F.when(F.col("found") == F.col("wanted"), "complete").when(F.col("found") > 0, "partial").otherwise("none").alias("outcome")
    )
    counted = named.groupBy("outcome").agg(F.count("*").alias("n"))
    return counted.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 9))


BINS = ("1", "2", "3-5", "6-10", "missing")


def rank_bins(ranks: DataFrame) -> DataFrame:
    """(bin, n) in fixed bins; bins without an item have 0."""
    r = F.col("rank")
    binned = F.when(r == 1, "1").when(r == 2, "2").when(r <= 5, "3-5").when(r <= 10, "6-10").otherwise("missing")
    counted = ranks.groupBy(binned.alias("bin")).agg(F.count("*").alias("n"))
    fixed = ranks.sparkSession.createDataFrame([(b,) for b in BINS], "bin string")
    return fixed.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def missing_top(ranks: DataFrame, n: int) -> DataFrame:
    """(document_id, n): the relevant items that are missing most often."""
    missing = ranks.where("rank IS NULL").groupBy("document_id").agg(F.count("*").alias("n"))
    return missing.orderBy(F.desc("n"), "document_id").limit(n)


def grouped_means(per_example: DataFrame, attributes: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """(grouping, value_of, n, mean) for each grouping alone; null values are 'unknown'. One pass for all."""
    known = attributes.select("example_id", *(F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in by))
    joined = per_example.join(known, "example_id").select(
        F.explode(F.array(*(F.struct(F.lit(c).alias("grouping"), F.col(c).alias("value_of")) for c in by))).alias("g"), value
    )
    return joined.groupBy("g.grouping", "g.value_of").agg(F.count("*").alias("n"), F.round(F.avg(value), 9).alias("mean"))
