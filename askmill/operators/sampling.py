"""Samples that depend on keys alone, not on order or partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.tables import cut

#: Fixed value: what stands between the parts of a hashed key.
NUL = "\x00"
#: Documents for each one asked for that are expected below the first bound of a hash.
BELOW = 24
#: Examples that are broadcast at once, about 20 MB.
SENT_EXAMPLES = 300_000


def hash_key(seed: int, *parts: Column) -> Column:
    """The digest by which samples are ordered: of the seed and the parts, with NUL between them."""
    return F.sha2(F.concat_ws(NUL, F.lit(str(seed)), *(p.cast("string") for p in parts)), 256)


def hash_slice(rows: DataFrame, key: str, size: int, seed: int, clip: bool = False) -> DataFrame:
    """The ``size`` rows with the smallest hash of seed and key.

    A size below 1, one beyond the number of rows (unless ``clip``) and repeated or null keys are errors.
    """
    if size < 1:
        raise ValueError("size must be positive")
    row = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("different")).first()
    if size > row.n and not clip:
        raise ValueError(f"size {size} exceeds the {row.n} rows")
    if row.n != row.different:
        raise ValueError(f"{key} must be unique and not null")
    return rows.orderBy(hash_key(seed, F.col(key)), key).limit(size)


def two_phase_slice(parts: list[DataFrame], key: str, size: int, seed: int) -> DataFrame:
    """The same slice taken from each part first and then from all of them together; a key in two parts is an error."""
    slices = [hash_slice(p, key, size, seed, clip=True) for p in parts]
    return hash_slice(reduce(DataFrame.unionByName, slices), key, size, seed)


def ordinals(rows: DataFrame, key: str, name: str = "rowid") -> DataFrame:
    """Consecutive numbers from 1 in the order of ``key``, without sorting everything in one task.

    Rows are ranged into partitions, numbered within each, and shifted by the counts of the partitions before.
    """
    ranged = rows.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy("_part").orderBy(key)
    numbered = ranged.withColumn("_n", F.row_number().over(within))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row for each partition
    return numbered.join(before.select("_part", "_before"), "_part").withColumn(name, F.col("_n") + F.col("_before")).drop("_part", "_n", "_before")


def systematic(numbered: DataFrame, size: int, rowid: str = "rowid") -> DataFrame:
    """The rows at positions floor(i * N / size) + 1."""
    total = numbered.agg(F.count("*").alias("total"))
    wanted = numbered.sparkSession.range(size).crossJoin(total).select((F.floor(F.col("id") * F.col("total") / size) + 1).alias(rowid))
    return numbered.join(wanted, rowid, "left_semi")


def distractors(base: DataFrame, pool: DataFrame, count: int, seed: int) -> DataFrame:
    """(example_id, document_id, place): for each example the ``count`` documents of the pool, less its base, with the
    smallest hash of seed, example and document.

    ``base(example_id, document_id)`` are the examples of a stated query set, ``pool(document_id)`` is hashed whole for each of
    them: the hash is the example's own, so no order is shared. Only hashes below a bound leave the join to be sorted, a
    few for each example: if ``count`` or more of them are there, the smallest of the whole pool are among them. Examples that
    have fewer are asked again under a higher bound, at last without one. A pool with fewer documents than asked for is an error.
    """
    if count < 0:
        raise ValueError("count can't be negative")
    # by number: names are small, so that their partitions are not to be put together again
    parts = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    documents = cut(pool.select("document_id").where("document_id IS NOT NULL").repartition(parts, "document_id").distinct())
    own = cut(base.select("example_id", "document_id").where("example_id IS NOT NULL").distinct())
    asked, taken = own.select("example_id").distinct(), []
    order = Window.partitionBy("example_id").orderBy(hash_key(seed, F.col("example_id"), F.col("document_id")), "document_id")
    share = (count + 1) * BELOW / max(documents.count(), 1)
    while True:
        below = _below(documents, asked, seed, share).join(own, ["example_id", "document_id"], "left_anti")
        rows = cut(below.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count))
        found = rows.groupBy("example_id").agg(F.count("*").alias("n"))
        lacking = cut(asked.join(found, "example_id", "left").where(F.coalesce("n", F.lit(0)) < count).select("example_id"))
        taken.append(rows.join(lacking, "example_id", "left_anti") if taken or not lacking.isEmpty() else rows)
        if lacking.isEmpty():
            return reduce(DataFrame.unionByName, taken).select("example_id", "document_id", "place")
        if share >= 1:
            raise ValueError(f"there are fewer than {count} documents besides the base of an example")
        asked, share = lacking, share * 16


def _below(documents: DataFrame, asked: DataFrame, seed: int, share: float) -> DataFrame:
    """(example_id, document_id): the pairs with a hash within the lowest ``share`` of all hashes, from 1 on every pair."""
    bound = "g" if share >= 1 else f"{int(share * 16**15):015x}"  # every digit is below g
    sent = F.broadcast(asked) if asked.count() <= SENT_EXAMPLES else asked
    sent = sent.withColumn("head", F.concat_ws(NUL, F.lit(str(seed)), "example_id", F.lit("")))  # of the hashed key, made once
    return documents.join(sent, F.sha2(F.concat("head", "document_id"), 256) < bound).select("example_id", "document_id")
