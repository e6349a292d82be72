"""Uncertainty of means and of paired differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.tables import cut

#: Sums are taken over whole multiples of 2^-40, so that they don't depend on the order of their terms.
UNIT = float(1 << 40)


def paired(values: DataFrame, pair: str, group: str, baseline: str, candidate: str, value: str) -> DataFrame:
    """(pair, diff): candidate less baseline where both have a finite value."""
    sides = values.where(F.col(group).isin(baseline, candidate)).groupBy(pair).agg(
        F.max(F.when(F.col(group) == baseline, F.col(value))).alias("base"),
        F.max(F.when(F.col(group) == candidate, F.col(value))).alias("cand"),
    )
    diff = F.col("cand") - F.col("base")
    return sides.select(pair, diff.alias("diff")).where("diff IS NOT NULL AND NOT isnan(diff)")


def quantiles(values: DataFrame, by: str, value: str, levels: tuple[float, ...]) -> DataFrame:
    """(by, n, q_0, q_1...): exact quantiles with linear interpolation between neighbours, one row for each ``by``.

    Values are ranged over the cluster, numbered within each range and shifted by the counts of the ranges before, and only
    the two values around each quantile are picked, so that no group's values lie in one task. Null and NaN
    values don't count.
    """
    known = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(by, F.col(value).cast("double").alias("_v"))
    ranged = cut(known.repartitionByRange(by, "_v").withColumn("_part", F.spark_partition_id()))
    numbered = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part", by).orderBy("_v")))
    sizes = ranged.groupBy("_part", F.col(by).alias("_by")).agg(F.count("*").alias("_size"))  # a few rows for each range
    before = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", "_by", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy("_by")).alias("n"))
    same = (numbered["_part"] == sizes["_part"]) & numbered[by].eqNullSafe(sizes["_by"])
    placed = numbered.join(sizes, same).select(by, "n", "_v", (F.col("_n") + F.col("_before") - 1).alias("_at"))
    spots = [(F.col("n") - 1) * F.lit(q) for q in levels]
    wanted = [c for spot in spots for c in (F.floor(spot), F.ceil(spot))]
    picked = placed.where(F.col("_at").isin(*wanted))

    def at(spot):
        return F.max(F.when(F.col("_at") == spot, F.col("_v")))

    def between(q: float):
        spot = (F.first("n") - 1) * F.lit(q)
        low, high = at(F.floor((F.col("n") - 1) * F.lit(q))), at(F.ceil((F.col("n") - 1) * F.lit(q)))
        return low + (high - low) * (spot - F.floor(spot))

    return picked.groupBy(by).agg(F.first("n").alias("n"), *(between(q).alias(f"q_{k}") for k, q in enumerate(levels)))


def require_paired(values: DataFrame, pair: str, group: str, baseline: str, candidate: str, value: str) -> None:
    """An error unless both groups hold every pair exactly once, with a finite value, and there is one at all."""
    x, side = F.col(value).cast("double"), F.col(group)
    finite = F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False))
    pairs = values.where(side.isin(baseline, candidate)).groupBy(pair).agg(
        F.count_if(side == baseline).alias("b"), F.count_if(side == candidate).alias("c"), F.count_if(~finite).alias("bad")
    )
    row = pairs.agg(F.count("*").alias("n"), F.count_if((F.col("b") != 1) | (F.col("c") != 1)).alias("unpaired"), F.count_if(F.col("bad") > 0).alias("bad")).first()
    if not row.n or row.unpaired or row.bad:
        raise ValueError(f"{row.n} pairs, of which {row.unpaired} are not complete and {row.bad} not finite")


def cohens_dz(diffs: DataFrame) -> DataFrame:
    """(n, mean_diff, dz): mean over sample deviation; without dispersion 0 or plus or minus infinity."""
    mean, sd = F.avg("diff"), F.stddev_samp("diff")
    dz = F.when(sd > 0, F.round(mean / sd, 9)).when(F.abs(mean) < 1e-15, 0.0).otherwise(F.signum(mean) * F.lit(float("inf")))
    return diffs.agg(F.count("*").alias("n"), F.round(mean, 9).alias("mean_diff"), dz.alias("dz"))


def sign_flip_exact(diffs: DataFrame, limit: int = 16) -> DataFrame:
    """(n, observed, extreme, total, p_value) over all 2^n sign assignments; at most ``limit`` differences.

    Sums are taken over whole numbers, so that ties with the observed sum are exact.
    """
    counted = diffs.select("diff").limit(limit + 1).count()
    if counted > limit:
        raise ValueError(f"{counted} or more differences; the exact test takes {limit}")
    spark = diffs.sparkSession
    whole = F.round(F.col("diff") * F.lit(UNIT)).cast("bigint")
    numbered = diffs.select((F.row_number().over(Window.orderBy("diff")) - 1).alias("i"), whole.alias("d"))
    flips = spark.range(1 << counted).withColumnRenamed("id", "mask").crossJoin(F.broadcast(numbered))  # at most 16 rows
    signed = F.when(F.expr("shiftright(mask, i) & 1") == 1, -F.col("d")).otherwise(F.col("d"))
    sums = flips.groupBy("mask").agg(F.abs(F.sum(signed)).alias("s"))
    observed = numbered.agg(F.abs(F.sum("d")).alias("o"), F.count("*").alias("n"))
    return sums.crossJoin(observed).groupBy("n", "o").agg(F.count_if(F.col("s") >= F.col("o")).alias("extreme"), F.count("*").alias("total")).select(
        "n", F.round(F.col("o") / F.lit(UNIT) / F.col("n"), 9).alias("observed"), "extreme", "total",
        F.round(F.col("extreme") / F.col("total"), 9).alias("p_value"),
    )


def sign_flip_sampled(diffs: DataFrame, key: str, permutations: int = 200, seed: int = 0) -> DataFrame:
    """(n, observed, extreme, total, p_value) over ``permutations`` sign assignments drawn by hash.

    The sign of a difference in a draw is a bit of a hash of seed, draw and ``key``: draws are the same on
    every cluster and partitioning. Each row adds to all draws where it lies, and only sums are shuffled.
    """
    draws = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))
    whole = F.round(F.col("diff") * F.lit(UNIT)).cast("bigint")
    rows = diffs.select(F.col(key).cast("string").alias("k"), whole.alias("d"), draws.alias("draw"))
    bit = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), "k"), 256), 1, 1), 16, 10).cast("int") >= 8
    sums = rows.groupBy("draw").agg(F.abs(F.sum(F.when(bit, -F.col("d")).otherwise(F.col("d")))).alias("s"))
    observed = diffs.agg(F.abs(F.sum(whole)).alias("o"), F.count("*").alias("n"))
    return sums.crossJoin(observed).groupBy("n", "o").agg(F.count_if(F.col("s") >= F.col("o")).alias("extreme"), F.count("*").alias("total")).select(
        "n", F.round(F.col("o") / F.lit(UNIT) / F.col("n"), 9).alias("observed"), "extreme", "total",
        F.round((F.col("extreme") + 1) / (F.col("total") + 1), 9).alias("p_value"),
    )


def _weight(seed: int, draw: Column, key: Column) -> Column:
    """How often a row is drawn, by hash: the Poisson approximation of resampling with replacement."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), key), 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    # cumulative Poisson(1) probabilities
    steps, p, total = [], 0.36787944117144233, 0.0
    for n in range(1, 9):
        total += p
        steps.append(total)
        p /= n
    return sum((F.when(u >= s, 1).otherwise(0) for s in steps), F.lit(0))


def bootstrap(values: DataFrame, key: str, value: str, resamples: int = 100, seed: int = 0, level: float = 0.95, by: str | None = None) -> DataFrame:
    """(n, estimate, low, high): percentile interval of the mean over resamples drawn by hash; with ``by`` first, one row for each of its values.

    Weights replace positions, so that a resample needs no join and no order: every row meets all draws where
    it lies, and one partial sum per group, draw and task is shuffled. A group without values has no interval and,
    with ``by``, no row; rows with a null ``by`` are a group. A draw that takes no value has no mean and is left out.
    """
    group = [] if by is None else [by]
    draws = F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))
    known = values.where(F.col(value).isNotNull())
    rows = known.select(*group, F.col(key).cast("string").alias("k"), F.col(value).alias("v"), draws.alias("draw"))
    weighted = rows.select(*group, "draw", "v", _weight(seed, F.col("draw"), F.col("k")).alias("w"))
    whole = F.round(F.col("v") * F.lit(UNIT)).cast("bigint")
    means = weighted.groupBy(*group, "draw").agg((F.sum(whole * F.col("w")) / F.lit(UNIT) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    tail = (1 - level) / 2
    bounds = means.groupBy(*group).agg(F.round(F.percentile("m", F.lit(tail)), 9).alias("low"), F.round(F.percentile("m", F.lit(1 - tail)), 9).alias("high"))
    if by is None:
        return values.agg(F.count(value).alias("n"), F.round(F.avg(value), 9).alias("estimate")).crossJoin(bounds)
    estimate = known.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 9).alias("estimate"))
    same = estimate[by].eqNullSafe(bounds[by])
    return estimate.join(bounds, same).select(estimate[by], "n", "estimate", "low", "high")
