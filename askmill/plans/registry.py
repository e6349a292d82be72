"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from askmill.plans import core, core_sql, nested, nested_sql

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        **core.QUERIES,
        "p5_found": nested.p5_found,
        "p5_records": nested.p5_records,
        "p5_paragraphs": nested.p5_paragraphs,
        "p5_sentences": nested.p5_sentences,
        "p5_facts": nested.p5_facts,
    }


def oracle_sql() -> dict[str, str]:
    return {**core_sql.SQL, **nested_sql.SQL}
