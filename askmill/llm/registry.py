"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from askmill.llm import encode, leaks, lookalike, overlap, reading, responses, topn
from askmill.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return responses.defects(table(spark, d, "predictions"), table(spark, d, "gold"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.best_documents(table(spark, d, "retrieval"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "examples"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "examples"))


def _alike(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.classes(lookalike.titles(table(spark, d, "documents"), table(spark, d, "gold")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_pairs(_alike(spark, d))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_members(_alike(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.bands(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p8_by_source(spark: SparkSession, d: str) -> DataFrame:
    return reading.by_source(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p4_found": p4_found,
        "p4_canonical": p4_canonical,
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p8_found": p8_found,
        "p8_by_source": p8_by_source,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": """
SELECT example_id, place_no::INT AS place_no, document_id FROM (
  SELECT example_id, document_id, row_number() OVER (PARTITION BY example_id ORDER BY score DESC, document_id) AS place_no
  FROM (
    SELECT example_id, h.document_id AS document_id, max(h.score) AS score
    FROM (SELECT example_id, unnest(retrieved) AS h FROM retrieval)
    WHERE example_id IS NOT NULL AND h.document_id IS NOT NULL AND h.score IS NOT NULL AND isfinite(h.score)
    GROUP BY 1, 2))
WHERE place_no <= 5"""
    }
