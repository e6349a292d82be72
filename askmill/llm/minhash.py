"""Clusters of texts whose word shingles nearly agree, by an exact join of the sets of shingle hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.llm.graph import components
from askmill.tables import cut

SHINGLE = 5
SIMILARITY = 0.8
#: Two sets with fewer members together than this that are alike differ by one member at most.
LARGE = 2 * (1 + SIMILARITY) / (1 - SIMILARITY) - 1e-6


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of the runs of ``size`` words; a shorter text is one shingle as a whole."""
    w = F.split(text, " ")
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " "))
    )
    return F.array_distinct(runs)


def clusters(texts: DataFrame) -> DataFrame:
    """(text, cluster) for the different values of ``texts(text)``; a text like no other is its own cluster.

    Two texts are linked if the Jaccard similarity of their shingles is ``SIMILARITY`` or more, and no such pair is left
    out. Texts of the same shingles are one set. Small sets that are alike are equal but for one member, so that the
    larger without one of its members is looked up among the whole ones, a few keys for each set. Pairs of larger sets
    share one of the rarest members of either and are compared if they do. Null texts have no row.
    """
    own = texts.where("text IS NOT NULL").select("text").distinct()
    own = cut(own.select(F.monotonically_increasing_id().alias("id"), "text", F.array_sort(shingles(F.col("text"))).alias("hashes")))  # numbers hold from here on
    sets = cut(own.groupBy("hashes").agg(F.min("id").alias("set"), F.size("hashes").alias("n")).select("set", "n", "hashes"))
    whole = sets.select(F.col("set").alias("a"), F.xxhash64("hashes").alias("key"))
    less = F.transform("hashes", lambda h: F.xxhash64(F.array_except("hashes", F.array(h))))
    small = sets.where((F.col("n") > 1) & (F.col("n") - 1 >= SIMILARITY * F.col("n")) & (2 * F.col("n") - 1 < LARGE))
    pairs = small.select(F.col("set").alias("b"), F.explode(less).alias("key")).join(whole, "key").select("a", "b")
    if (sets.agg(F.max("n")).first()[0] or 0) * 2 >= LARGE:
        pairs = pairs.unionByName(_large_pairs(sets)).distinct()
    side = sets.select("set", "hashes")
    both = pairs.join(side.toDF("a", "ha"), "a").join(side.toDF("b", "hb"), "b")
    alike = F.size(F.array_intersect("ha", "hb")) >= SIMILARITY * F.size(F.array_union("ha", "hb"))
    named = components(both.where(alike).select("a", "b")).toDF("set", "component")
    named = sets.join(named, "set", "left").select("hashes", F.coalesce("component", "set").alias("cluster"))
    return own.join(named, "hashes").select("text", "cluster")


def _large_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) of ``sets(set, n, hashes)``: with ``LARGE`` members or more together, each of a pair that is alike.

    All but so many members of a set are in the other one; of so many and one more, the rarest, one is in the other's.
    """
    rows = sets.where(F.col("n") >= SIMILARITY * LARGE / 2 - 1).select("set", "n", F.explode("hashes").alias("h"))
    ranked = rows.join(rows.groupBy("h").agg(F.count("*").alias("df")), "h").groupBy("set", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("all"))
    missing = F.col("n") - F.ceil(SIMILARITY * F.col("n") - 1e-9)
    rare = ranked.select("set", "n", F.explode(F.slice("all", F.lit(1), (missing + 1).cast("int"))).alias("m")).select("set", "n", F.col("m.h").alias("h"))
    a, b = rare.toDF("a", "na", "h"), rare.toDF("b", "nb", "h")
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    near = (F.col("na") + F.col("nb") >= LARGE) & (F.col("na") >= SIMILARITY * F.col("nb") - 1e-9)
    return a.join(b, "h").where(ordered & near).select("a", "b").distinct()
