"""Flat tables of the nested evaluation records, and the facts that lead to a sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askmill.operators.shred import KEY, assemble, shred
from askmill.sources.qa import RECORD, all_records
from askmill.tables import table


def keyed_records(gold: DataFrame, gold_raw: DataFrame) -> DataFrame:
    """Every different record once, under a key made from its whole content, with its number of copies.

    The rows of a record stay in one partition from here on, so that the windows over its level
    sequences and the rebuilding of its tables need no further shuffle.
    """
    names = [f.name for f in RECORD.fields]
    keyed = all_records(gold, gold_raw).withColumn(KEY, F.sha2(F.to_json(F.struct(*names)), 256))
    return keyed.groupBy(KEY).agg(*(F.first(n).alias(n) for n in names), F.count("*").alias("n_copies"))


def flat_tables(records: DataFrame) -> dict[str, DataFrame]:
    """records, paragraphs, sentences and facts, linked by record_key and ordinals."""
    shredded = shred(records, KEY, ["supporting_facts", "context"])
    facts = assemble(shredded, RECORD, "supporting_facts[]").withColumnRenamed("i1", "fact_index")
    paragraphs = assemble(shredded, RECORD, "context[]").withColumnRenamed("i1", "paragraph_index")
    sentences = assemble(shredded, RECORD, "context[].sentences[]").withColumnsRenamed(
        {"i1": "paragraph_index", "i2": "sentence_index", "value": "sentence"}
    )
    roots = records.select(KEY, "example_id", "question", "answer", "question_type", "level", "n_copies")
    return {"records": roots, "paragraphs": paragraphs, "sentences": sentences, "facts": facts}


def resolved_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """(example_id, fact_index, paragraph_index, sentence_index) of every fact that leads to a sentence.

    A fact leads to each paragraph of its record with exactly its title, if the sentence at its id is
    not null there; an empty sentence counts. Facts with a null title or id lead nowhere.
    """
    facts = tables["facts"].where("title IS NOT NULL AND sentence_id IS NOT NULL")
    there = tables["sentences"].where("present").select(KEY, "paragraph_index", "sentence_index")
    return (
        facts.join(tables["paragraphs"].where("title IS NOT NULL").select(KEY, "paragraph_index", "title"), [KEY, "title"])
        .withColumn("sentence_index", F.col("sentence_id").cast("bigint"))
        .join(there, [KEY, "paragraph_index", "sentence_index"])
        .join(tables["records"].select(KEY, "example_id"), KEY)
        .select(
            "example_id",
            *(F.col(c).cast("int").alias(c) for c in ("fact_index", "paragraph_index", "sentence_index")),
        )
        .distinct()
    )


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return flat_tables(keyed_records(table(spark, d, "gold"), table(spark, d, "gold_raw")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return resolved_facts(_tables(spark, d))


def _linked(spark: SparkSession, d: str, name: str, columns: list[str]) -> DataFrame:
    tables = _tables(spark, d)
    rows = tables[name]
    if name != "records":
        rows = rows.join(tables["records"].select(KEY, "example_id", "n_copies"), KEY)
    return rows.select("example_id", *(F.col(c).cast("int").alias(c) if c.endswith("_index") else c for c in columns), "n_copies")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d, "records", ["question", "answer", "question_type", "level"])


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d, "paragraphs", ["paragraph_index", "present", "title"])


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d, "sentences", ["paragraph_index", "sentence_index", "present", "sentence"])


def p5_facts(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d, "facts", ["fact_index", "present", "title", "sentence_id"])
