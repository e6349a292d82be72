"""Checks as tables of violations, comparisons of runs and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.operators.sampling import ordinals
from askmill.tables import cut


def record_violations(records: DataFrame) -> DataFrame:
    """(example_id, rule): broken constraints of evaluation records."""
    titles = F.transform("context", lambda p: p.title)
    named = F.filter(titles, lambda t: t.isNotNull())
    facts = F.filter("supporting_facts", lambda f: f.isNotNull())
    rules = {
        "blank_id": F.trim(F.coalesce("example_id", F.lit(""))) == "",
        "blank_question": F.trim(F.coalesce("question", F.lit(""))) == "",
        "repeated_title": F.size(F.array_distinct(named)) < F.size(named),
        "negative_sentence_id": F.exists(facts, lambda f: f.sentence_id < 0),
        "unknown_title": F.exists(facts, lambda f: ~F.coalesce(F.array_contains(named, f.title), F.lit(False))),
    }
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(rule)) for rule, cond in rules.items())))
    return records.select("example_id", F.explode(broken).alias("rule"))


def reference_issues(facts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Facts whose sentence id lies beyond the sentences of a paragraph with their title.

    ``facts(example_id, title, sentence_id)``, ``paragraphs(example_id, title, n_sentences)``.
    """
    return facts.join(paragraphs, ["example_id", "title"]).where(F.col("sentence_id") >= F.col("n_sentences"))


def ranking_violations(lists: DataFrame) -> DataFrame:
    """(batch_id, rule, n): entries of delivered rankings that break the order of their list.

    ``lists(batch_id, retrieved)``: rank must be the position from 1, scores finite and not rising, documents
    not null and not repeated.
    """
    hits = lists.select("batch_id", F.posexplode("retrieved").alias("pos", "h"))
    own = Window.partitionBy("batch_id").orderBy("pos")
    seen = Window.partitionBy("batch_id", "h.document_id").orderBy("pos")
    finite = (F.col("h.score") < float("inf")) & (F.col("h.score") > float("-inf"))
    checked = hits.withColumns({"before": F.lag("h.score").over(own), "copy": F.row_number().over(seen)})
    no = F.lit(False)
    rules = {
        "rank": F.coalesce(F.col("h.rank") != F.col("pos") + 1, F.lit(True)),
        "not_finite": ~F.coalesce(finite, no),
        "rising": F.coalesce(finite & (F.col("before") < F.col("h.score")), no),
        "no_document": F.col("h.document_id").isNull(),
        "repeated": F.col("h.document_id").isNotNull() & (F.col("copy") > 1),
    }
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(rule)) for rule, cond in rules.items())))
    return checked.select("batch_id", F.explode(broken).alias("rule")).groupBy("batch_id", "rule").agg(F.count("*").alias("n"))


def contiguity_issues(ledger: DataFrame) -> DataFrame:
    """Shards whose range does not go on from the one before or does not hold its number of documents."""
    # by place and not by index: the one before a missing shard is the last that is there
    numbered = cut(ordinals(ledger, "shard_index", "_place"))
    before = numbered.select((F.col("_place") + 1).alias("_place"), F.col("end_rowid").alias("_end"))
    checked = numbered.join(before, "_place", "left").withColumn("expected", F.coalesce("_end", F.lit(0)) + 1).select(*ledger.columns, "expected")
    return checked.where((F.col("start_rowid") != F.col("expected")) | (F.col("end_rowid") - F.col("start_rowid") + 1 != F.col("document_count")))


def segments(numbered: DataFrame, size: int, rowid: str = "rowid", name: str = "shard_index") -> DataFrame:
    """The rows with the number of their segment of ``size`` consecutive ordinals."""
    return numbered.withColumn(name, F.floor((F.col(rowid) - 1) / size).cast("bigint"))


def unpivoted(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return rows.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns))).alias("u")).select(key, "u.*")


def compare_fields(reported: DataFrame, expected: DataFrame, key: str, columns: list[str], tolerance: float = 0.0, relative: bool = False) -> DataFrame:
    """(key, field, reported, expected) of fields that differ by more than ``tolerance``, of the expected value if ``relative``, or
    stand on one side only."""
    a = unpivoted(reported, key, columns).withColumnRenamed("value", "reported").withColumn("a", F.lit(1))
    b = unpivoted(expected, key, columns).withColumnRenamed("value", "expected").withColumn("b", F.lit(1))
    both = a.join(b, [key, "field"], "full")
    room = F.abs("expected") * tolerance if relative else F.lit(tolerance)
    same = F.coalesce(F.abs(F.col("reported") - F.col("expected")) <= room, F.col("reported").isNull() & F.col("expected").isNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
    return both.where(~same).select(key, "field", "reported", "expected")


def set_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of one side only, with multiplicity: (columns..., side)."""
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def run_comparison(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(pairs, same_prompt, same_output, same_answer): two runs joined on their example."""
    left, right = (runs.where(F.col("run_name") == r).select("example_id", "prompt", "raw_output", "prediction") for r in (a, b))
    joined = left.alias("a").join(right.alias("b"), "example_id")
    return joined.agg(
        F.count("*").alias("pairs"),
        *(F.count_if(F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(n) for n, c in (("same_prompt", "prompt"), ("same_output", "raw_output"), ("same_answer", "prediction"))),
    )


def paired_by_position(left: DataFrame, right: DataFrame, order: str, key: str) -> DataFrame:
    """(place, left, right): two sequences joined row by row, each in the order of ``order``.

    Where one is longer its rows stand alone. Places come from ranged partitions, so that no sequence is sorted in one task.
    """
    a = ordinals(left.select(F.col(order).alias("_o"), F.col(key).alias("left")), "_o", "place").select("place", "left", F.lit(True).alias("_a"))
    b = ordinals(right.select(F.col(order).alias("_o"), F.col(key).alias("right")), "_o", "place").select("place", "right", F.lit(True).alias("_b"))
    return a.join(b, "place", "full").select("place", "left", "right", F.col("_a").isNotNull().alias("has_left"), F.col("_b").isNotNull().alias("has_right"))


def position_mismatches(paired: DataFrame) -> DataFrame:
    """Rows of ``paired_by_position`` that stand alone or hold different keys; a strict join has none."""
    return paired.where(~(F.col("has_left") & F.col("has_right") & F.col("left").eqNullSafe(F.col("right"))))


def not_increasing(rows: DataFrame, order: str, value: str) -> DataFrame:
    """(order, value, before): rows whose value is not above the one of the row before in the order of ``order``."""
    numbered = cut(ordinals(rows.select(order, value), order, "_place"))
    before = numbered.select((F.col("_place") + 1).alias("_place"), F.col(value).alias("before"))
    return numbered.join(before, "_place").where(~F.coalesce(F.col(value) > F.col("before"), F.lit(False))).select(order, value, "before")


def incomplete_rankings(queries: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    """(example_id, n): queries for which the ranking does not hold exactly ``k`` documents, none at all included."""
    counted = ranking.groupBy("example_id").agg(F.count("*").alias("n"))
    return queries.select("example_id").distinct().join(counted, "example_id", "left").select("example_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") != k)


def require_counts(observed: dict[str, int], expected: dict[str, int]) -> None:
    """An error that names every count that is not as expected."""
    wrong = [f"{k}: {observed.get(k)} instead of {v}" for k, v in expected.items() if observed.get(k) != v]
    if wrong:
        raise ValueError("; ".join(wrong))


def bound_issues(ledger: DataFrame, norm_limit: float = 0.002) -> DataFrame:
    """(shard_index, rule): rows of a ledger whose numbers can't be: no documents, fewer tokens than documents,
    more truncated documents than documents or fewer than none, a norm error outside of 0 to ``norm_limit``."""
    n, no = F.col("document_count"), F.lit(False)
    rules = {
        "no_documents": ~F.coalesce(n > 0, no),
        "tokens": ~F.coalesce(F.col("tokens_processed") >= n, no),
        "truncated": ~F.coalesce(F.col("truncated_documents").between(0, n), no),
        "norm_error": ~F.coalesce(F.col("max_norm_error").between(0, norm_limit), no),
    }
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(rule)) for rule, cond in rules.items())))
    return ledger.select("shard_index", F.explode(broken).alias("rule"))


def batch_issues(batches: DataFrame, numbered: DataFrame, size: int, rowid: str = "rowid") -> DataFrame:
    """(batch_index, field, reported, expected): batches whose first or last row or number of documents is not that of the
    consecutive rows of ``numbered(rowid)``, or that stand on one side only.

    ``batches(batch_index, first_rowid, last_rowid, document_count)``.
    """
    expected = segments(numbered.select(rowid), size, rowid, "batch_index").groupBy("batch_index").agg(
        F.min(rowid).alias("first_rowid"), F.max(rowid).alias("last_rowid"), F.count("*").alias("document_count")
    )
    return compare_fields(batches, expected, "batch_index", ["first_rowid", "last_rowid", "document_count"])


def calibration_summary(batches: DataFrame) -> DataFrame:
    """One row: batches, documents, tokens and the largest norm error of a calibration run; zeros for none."""
    zero = F.lit(0).cast("bigint")
    return batches.agg(
        F.count("*").alias("batch_count"),
        F.coalesce(F.sum("document_count"), zero).alias("document_count"),
        F.coalesce(F.sum("processed_tokens"), zero).alias("processed_tokens"),
        F.coalesce(F.max("max_l2_norm_error_after_fp16_cast"), F.lit(0.0)).alias("max_norm_error"),
    )


def within_limits(seconds: Column, most_seconds: Column, reserved: Column, most_reserved: Column, host: Column, most_host: Column) -> Column:
    """True if the projected time and the reserved memory keep to their limits, and the host's memory does, if it has a limit.

    A measurement that is null keeps to no limit.
    """
    no = F.lit(False)
    return F.coalesce(seconds <= most_seconds, no) & F.coalesce(reserved <= most_reserved, no) & (most_host.isNull() | F.coalesce(host <= most_host, no))


def manifest_issues(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, issue) of a full join of ``manifest(path, length, sha256)`` with ``files``: missing, unlisted, length, sha256."""
    joined = manifest.alias("m").join(files.alias("f"), "path", "full")
    issue = (
        F.when(F.col("f.length").isNull(), "missing")
        .when(F.col("m.length").isNull(), "unlisted")
        .when(F.col("m.length") != F.col("f.length"), "length")
        .when(~F.col("m.sha256").eqNullSafe(F.col("f.sha256")), "sha256")
    )
    return joined.select("path", issue.alias("issue")).where("issue IS NOT NULL")


def file_inventory(spark, folder: str) -> DataFrame:
    """(path, length, sha256, md5) of the files under a folder, relative to it; a file above 2 GB does not fit in a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative: Column = F.regexp_replace("path", r"^.*?" + folder.rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(relative.alias("path"), "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))
