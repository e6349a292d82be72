"""Term statistics kept up to date from a stream of documents, and a resumable shard build."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.operators.audit import bound_issues, contiguity_issues, require_counts
from askmill.operators.lexical import term_frequencies
from askmill.tables import cut, exists, read_json, remove, rename, write_json

#: Files of one micro-batch, at most.
FILES_AT_ONCE = 64


def stream_term_counts(spark: SparkSession, source: str, schema, out: str, checkpoint: str, files: str = "*") -> None:
    """Term counts of every new file of a folder that ``files`` matches, as one partition of ``out`` for each micro-batch.

    A batch that is run again after a failure writes its own partition again, so that nothing counts twice.
    """
    def fold_in(batch: DataFrame, epoch: int) -> None:
        counts = term_frequencies(batch).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        counts.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_AT_ONCE).option("pathGlobFilter", files).parquet(source)
    query = stream.writeStream.foreachBatch(fold_in).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_term_counts(spark: SparkSession, out: str) -> DataFrame:
    """(term, df, cf) over all batches so far."""
    return spark.read.parquet(out).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


#: What must be equal for a half built store to be gone on with or cleared away.
INVARIANT = ("corpus_sha256", "model_id", "model_revision", "dimension", "max_input_tokens", "batch_size", "shard_documents")


class ShardStore:
    """Vectors in shards of consecutive rows with a ledger, in ``folder + ".building"`` until they are all there.

    ``identity`` says what is built: a store is gone on with only if it is the same. A shard counts once it stands in
    the ledger, which is written after its rows; rows without their ledger row are written again.
    """

    def __init__(self, spark: SparkSession, folder: str, document_count: int, identity: dict):
        self.spark, self.folder, self.document_count, self.identity = spark, folder, document_count, identity
        self.building = folder + ".building"
        self.vectors, self.rows, self.info = f"{self.building}/vectors", f"{self.building}/ledger", f"{self.building}/build-info.json"

    def open(self) -> int:
        """The number of documents that are done. Another identity, a finished store, and gaps in the ledger are errors."""
        if exists(self.spark, self.folder):
            raise FileExistsError(self.folder)
        wanted = {"document_count": self.document_count, "identity": self.identity, "status": "building"}
        if not exists(self.spark, self.building):
            write_json(self.spark, self.info, wanted)
        elif read_json(self.spark, self.info) != wanted:
            raise ValueError(f"{self.building} was begun for something else")
        return self._completed()

    def ledger(self) -> DataFrame | None:
        return self.spark.read.parquet(self.rows) if exists(self.spark, self.rows) else None

    def _completed(self) -> int:
        ledger = self.ledger()
        if ledger is None:
            return 0
        issues = contiguity_issues(ledger.select("shard_index", "start_rowid", "end_rowid", "document_count"))
        if not issues.isEmpty():
            raise ValueError("the shards of the ledger don't follow each other")
        return ledger.agg(F.max("end_rowid")).first()[0] or 0

    def build(self, numbered: DataFrame, size: int, encode, most_shards: int | None = None) -> int:
        """Encodes the rows of ``numbered(rowid, ...)`` that are not done, up to ``most_shards`` shards; the number done since.

        ``encode`` maps a DataFrame to (rowid, vector, tokens, truncated, norm_error). Only the new shards are read back.
        """
        done = self._completed()
        if done % size and done < self.document_count:
            raise ValueError("the last shard is not full")
        last = self.document_count if most_shards is None else min(self.document_count, done + most_shards * size)
        todo = numbered.where(F.col("rowid").between(done + 1, last))
        first = done // size
        sharded = encode(todo).withColumn("shard_index", F.floor((F.col("rowid") - 1) / size).cast("bigint"))
        sharded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_index").parquet(self.vectors)
        written = self.spark.read.parquet(self.vectors).where(F.col("shard_index") >= first)
        new = cut(full_ledger(written.withColumn("shard_index", F.col("shard_index").cast("bigint"))))
        issues = bound_issues(new)
        if not issues.isEmpty():
            raise ValueError(f"impossible shards: {issues.limit(5).collect()}")
        new.write.mode("append").parquet(self.rows)
        return self._completed() - done

    def finalise(self, indexed_documents: int) -> dict:
        """Checks that everything is there and without gaps, writes the manifest and puts the store in place by a rename."""
        if self._completed() != self.document_count or indexed_documents != self.document_count:
            raise ValueError("the store does not hold all documents")
        totals = ledger_totals(self.ledger()).first().asDict()
        require_counts(totals, {"document_count": self.document_count})
        manifest = {"status": "complete", "identity": self.identity, "index": totals}
        write_json(self.spark, f"{self.building}/manifest.json", manifest)
        write_json(self.spark, self.info, {"document_count": self.document_count, "identity": self.identity, "status": "complete"})
        rename(self.spark, self.building, self.folder)
        return manifest

    def recover(self) -> bool:
        """Clears away a store that was begun for the same thing and holds no shard; True if it did."""
        found = read_json(self.spark, self.info) if not exists(self.spark, self.folder) else None
        same = found and found.get("status") == "building" and found.get("document_count") == self.document_count
        theirs = (found or {}).get("identity") or {}
        if not same or any(k not in theirs or theirs[k] != self.identity.get(k) for k in INVARIANT) or self.ledger() is not None:
            return False
        remove(self.spark, self.building)
        return True


def shard_ledger(sharded: DataFrame) -> DataFrame:
    """(shard_index, start_rowid, end_rowid, document_count) of a sharded table."""
    return sharded.groupBy(F.col("shard_index").cast("bigint").alias("shard_index")).agg(
        F.min("rowid").alias("start_rowid"), F.max("rowid").alias("end_rowid"), F.count("*").alias("document_count")
    )


def full_ledger(built: DataFrame) -> DataFrame:
    """The ledger of ``built(shard_index, rowid, tokens, truncated)`` with what was read of its documents.

    ``max_norm_error`` is that of ``built`` if it has one, else 0: texts alone have no vectors.
    """
    error = F.max("norm_error") if "norm_error" in built.columns else F.lit(0.0)
    return built.groupBy("shard_index").agg(
        F.min("rowid").alias("start_rowid"), F.max("rowid").alias("end_rowid"), F.count("*").alias("document_count"),
        F.sum("tokens").alias("tokens_processed"), F.count_if("truncated").alias("truncated_documents"), error.alias("max_norm_error"),
    )


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """One row: shards, documents, tokens, truncated documents and the largest norm error; zeros for an empty ledger."""
    zero = F.lit(0).cast("bigint")
    return ledger.agg(
        F.count("*").alias("shard_count"),
        *(F.coalesce(F.sum(c), zero).alias(c) for c in ("document_count", "tokens_processed", "truncated_documents")),
        F.coalesce(F.max("max_norm_error"), F.lit(0.0)).alias("max_norm_error"),
    )
