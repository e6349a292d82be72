"""The N best items of every group, pruned before and after the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(score: Column) -> Column:
    """True where a score is neither null, NaN nor infinite (NaN sorts above infinity in Spark)."""
    return score.isNotNull() & (score < F.lit(float("inf"))) & (score > F.lit(float("-inf")))


def top_n(hits: DataFrame, n: int) -> DataFrame:
    """The ``n`` best items of each group of ``hits(grp, item, score)`` as (grp, item, score, place_no).

    An item counts once, with its highest score. Higher scores come first; of equal scores the smaller
    item by code points. Rows with a null group, a null item or a score that is null, NaN or infinite
    don't count; a group with fewer items yields what it has; repeated rows change nothing; an empty
    table yields no rows. Further columns are ignored.

    Repeats are folded by a partial aggregate, so a hot group is spread over (grp, item) before it is
    ranked. The rank filter directly above row_number lets the optimiser put a group limit before the
    second shuffle (each task sends at most ``n`` rows of a group) and again after it.
    """
    best = (
        hits.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & finite(F.col("score")))
        .groupBy("grp", "item")
        .agg(F.max(F.col("score") + F.lit(0.0)).alias("score"))
    )
    return hits.sparkSession.sql(
        """
        SELECT grp, item, score, place_no FROM (
          SELECT grp, item, score,
                 row_number() OVER (PARTITION BY grp ORDER BY score DESC, item ASC) AS place_no
          FROM {best})
        WHERE place_no <= {n}
        """,
        best=best,
        n=n,
    )


def hits_of(retrieval: DataFrame) -> DataFrame:
    """Every hit of the delivered batches as (grp, item, score); null and empty lists give none."""
    return retrieval.select("example_id", F.explode("retrieved").alias("hit")).select(
        F.col("example_id").alias("grp"), F.col("hit.document_id").alias("item"), F.col("hit.score").alias("score")
    )


def best_documents(retrieval: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best documents of each example over all its batches."""
    return top_n(hits_of(retrieval), n).select(
        F.col("grp").alias("example_id"), "place_no", F.col("item").alias("document_id")
    )
