"""Exact vector search and the checks of a vector store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors that are broadcast at a time; more are searched for in blocks.
BLOCK = 4096


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors of largest inner product, then smaller vec_id.

    ``vectors(vec_id, embedding)``, ``queries(query_id, embedding)`` without null vectors. Each task multiplies
    its rows by a block of queries and keeps ``k`` of them a query, so that a shuffle carries k rows for each
    query and task, whatever the number of vectors. Scores are compared and given to six places.
    """
    wanted = queries.count()
    out = None
    for start in range(0, max(1, -(-wanted // block))):
        blocks = -(-wanted // block)
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))) == start).collect()
        found = _block_top_k(vectors, part, k)
        out = found if out is None else out.unionByName(found)
    return out


def _block_top_k(vectors: DataFrame, part: list, k: int) -> DataFrame:
    ids = np.array([r["query_id"] for r in part], dtype=np.int64)
    matrix = np.array([r["embedding"] for r in part], dtype=np.float64)
    held = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, q = held.value
        least = np.full(len(query_ids), -np.inf)  # the k-th best score so far
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for rows in batches:
            if not len(rows) or not len(query_ids):
                continue
            vec = rows["vec_id"].to_numpy()
            scores = np.round(np.stack(rows["embedding"].to_numpy()).astype(np.float64) @ q.T, 6) + 0.0
            i, j = np.nonzero(scores >= least)
            at, ids, score = (np.concatenate(x) for x in zip(best, (j, vec[i], scores[i, j]), strict=True))
            order = np.lexsort((ids, -score, at))
            at, ids, score = at[order], ids[order], score[order]
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
            place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            least[at[place == k - 1]] = score[place == k - 1]
            best = at[place < k], ids[place < k], score[place < k]
        yield pd.DataFrame({"query_id": query_ids[best[0]], "vec_id": best[1], "score": best[2]})

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    local = vectors.where("embedding IS NOT NULL").mapInPandas(nearest, "query_id long, vec_id long, score double")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def shortened(v: Column, dims: int) -> Column:
    """The first ``dims`` dimensions, scaled to length 1."""
    head = F.slice(v, 1, dims)
    return F.transform(head, lambda x: x.cast("double") / norm(head))


@F.pandas_udf(T.DoubleType())
def _half_norm(v: pd.Series) -> pd.Series:
    return v.map(lambda x: float(np.linalg.norm(np.asarray(x, dtype=np.float16).astype(np.float64))), na_action="ignore")


def half_precision_error(v: Column) -> Column:
    """How far the length of a unit vector is from 1 once it is stored in half precision."""
    return F.abs(_half_norm(v) - 1.0)


def storage_bytes(documents: Column, dims: int, bytes_each: int = 2) -> Column:
    return documents * dims * bytes_each


def compute_projection(measured: Column, seconds: Column, total: Column, reserve: float) -> Column:
    """struct(rate, seconds, units): time for ``total`` documents at the measured rate with a reserve, and whole hours started."""
    rate = measured / seconds
    projected = total / rate * reserve
    return F.struct(rate.alias("rate"), projected.alias("seconds"), F.floor(projected / 3600 + 0.999999999).alias("hours"))
