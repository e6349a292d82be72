"""Question-answering records: one schema for the two physical layouts they are delivered in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("sentence_id", T.IntegerType())]))
CONTEXT = T.ArrayType(
    T.StructType([T.StructField("title", T.StringType()), T.StructField("sentences", T.ArrayType(T.StringType()))])
)
RECORD = T.StructType(
    [
        T.StructField("example_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("question_type", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("supporting_facts", FACTS),
        T.StructField("context", CONTEXT),
    ]
)
#: Members of a delivered record; nested ones stay JSON text until their layout is known.
_DELIVERED = "_id string, id string, question string, answer string, type string, level string, supporting_facts string, context string"


def parse_records(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Records of the JSON texts in ``payload``, in the shape of ``RECORD``.

    Either layout is read: lists of [title, sentence_id] and [title, [sentences]], or parallel arrays
    {title, sent_id} and {title, sentences}; the id stands in _id or id. A payload that is null, cut off
    or otherwise not complete JSON is no record; a member that is missing or null is null. Null elements
    keep their place. A sentence id that is no whole number is null.
    """
    # the JSON parser stops at the end of the first value, so that the text must end with it, too
    whole = raw.where(F.expr(f"try_parse_json(`{payload}`) IS NOT NULL") & F.col(payload).rlike(r"(?s)^\s*\{.*\}\s*$"))
    parsed = whole.select(F.from_json(F.col(f"`{payload}`"), _DELIVERED).alias("r")).select("r.*")
    pairs = "array<array<string>>"
    facts_list = F.transform(
        F.from_json("supporting_facts", pairs),
        lambda f: F.when(
            f.isNotNull(),
            F.struct(F.get(f, F.lit(0)).alias("title"), F.get(f, F.lit(1)).try_cast("int").alias("sentence_id")),
        ),
    )
    facts_zip = F.from_json("supporting_facts", "title array<string>, sent_id array<string>")
    facts_zip = F.transform(
        F.arrays_zip(facts_zip.title.alias("title"), facts_zip.sent_id.alias("sent_id")),
        lambda f: F.struct(f.title.alias("title"), f.sent_id.try_cast("int").alias("sentence_id")),
    )
    context_list = F.transform(
        F.from_json("context", pairs),
        lambda p: F.when(
            p.isNotNull(),
            F.struct(
                F.get(p, F.lit(0)).alias("title"),
                F.from_json(F.get(p, F.lit(1)), "array<string>").alias("sentences"),
            ),
        ),
    )
    context_zip = F.from_json("context", "title array<string>, sentences array<array<string>>")
    context_zip = F.transform(
        F.arrays_zip(context_zip.title.alias("title"), context_zip.sentences.alias("sentences")),
        lambda p: F.struct(p.title.alias("title"), p.sentences.alias("sentences")),
    )
    return parsed.select(
        F.coalesce("_id", "id").alias("example_id"),
        "question",
        "answer",
        F.col("type").alias("question_type"),
        "level",
        F.when(F.ltrim("supporting_facts").startswith("["), facts_list).otherwise(facts_zip).alias("supporting_facts"),
        F.when(F.ltrim("context").startswith("["), context_list).otherwise(context_zip).alias("context"),
    )


def all_records(gold: DataFrame, gold_raw: DataFrame) -> DataFrame:
    """The nested records of both deliveries in one shape."""
    names = [f.name for f in RECORD.fields]
    return gold.select(*names).unionByName(parse_records(gold_raw).select(*names))


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a Parquet table in the nested shape, or of JSON: a top-level list or one record a line, in either layout."""
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select(*(f.name for f in RECORD.fields))
    texts = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("payload"))
    lists = texts.where(F.startswith("payload", F.lit("[")))
    each = lists.select(F.explode(F.from_json("payload", "array<variant>")).alias("v")).select(F.to_json("v").alias("payload"))
    lines = spark.read.text(path).select(F.trim("value").alias("payload")).where(F.startswith("payload", F.lit("{")) & F.endswith("payload", F.lit("}")))
    return parse_records(lines.unionByName(each) if lists.isEmpty() else each)


def load_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(example_id, prediction) and (example_id, predicted) of a prediction file {"answer": {...}, "sp": {...}}.

    ``predicted`` is an array of struct(title, sentence_id). A file without both members is an error.
    """
    raw = spark.read.schema("answer map<string,string>, sp map<string,array<array<string>>>").option("multiLine", True).json(path)
    if raw.where("answer IS NULL OR sp IS NULL").limit(1).count() or raw.isEmpty():
        raise ValueError(f"{path}: a prediction file has the members answer and sp")
    facts = F.transform("facts", lambda f: F.struct(F.get(f, F.lit(0)).alias("title"), F.get(f, F.lit(1)).try_cast("int").alias("sentence_id")))
    answers = raw.select(F.explode("answer").alias("example_id", "prediction"))
    return answers, raw.select(F.explode("sp").alias("example_id", "facts")).select("example_id", facts.alias("predicted"))
