"""One consistent form for strings that look alike although their characters differ."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askmill.tables import cut

#: Letters of other alphabets that are drawn like Latin ones (fixed values: Cyrillic, Greek, Armenian).
_ALIKE = (
    ("АВЕЅІЈКМНОРСТУХҮԛԝԚԜ", "ABESIJKMHOPCTYXYqwQW"),
    ("аеѕіјорсухһԁӏӀ", "aesijopcyxhdlI"),
    ("ЁЇёїӒӓӦӧ", "ËÏëïÄäÖö"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"),
    ("αινορυ", "aivopu"),
    ("άίόύϊϋΆΈΊΌΎ", "áíóúïüÁÉÍÓÝ"),
    ("օսհոց", "ouhng"),
)
ALIKE_FROM = "".join(a for a, _ in _ALIKE)
ALIKE_TO = "".join(b for _, b in _ALIKE)

#: Characters that print nothing and are no space: formats, controls, fillers, variation selectors.
NOT_PRINTED = r"[\p{Cf}\x00-\x08\x0E-\x1B\x7F-\x84\x86-\x9F͏ᅟᅠ឴឵᠋-᠏ㅤﾠ︀-️]"
SPACES = r"(?U)[\s\p{Z}]+"


def mapped(text: Column) -> Column:
    """``text`` with look-alike letters as Latin ones, nothing that prints nothing, and single inner spaces."""
    alike = F.translate(F.regexp_replace(text, NOT_PRINTED, ""), ALIKE_FROM, ALIKE_TO)
    return F.trim(F.regexp_replace(alike, SPACES, " "))


@F.pandas_udf(T.StringType())
def normal_form(text: pd.Series) -> pd.Series:
    """Compatibility normal form; used only to check members of a class that has several."""
    return text.map(lambda s: " ".join(unicodedata.normalize("NFKC", s).split()), na_action="ignore")


def classes(values: DataFrame, column: str = "value") -> DataFrame:
    """(value, class_form): the different values of ``column`` that look like another one, with their class.

    Values are mapped (look-alike letters, characters that print nothing, spaces) and grouped in SQL
    under the accent-sensitive collation UNICODE_CI: width and compatibility forms, the composition of
    accents and ignorable characters don't separate values there; accents, punctuation and letters do.
    Case, which it does not see, is told apart within each class of several members by the exact normal
    form, which also guards against two values that the collation takes for equal and that differ visibly.

    Null values have no row; the empty string looks like any string that prints nothing. Repeated rows
    change nothing; values that look like no other are left out; an empty table gives no rows.
    """
    different = values.select(F.col(f"`{column}`").alias("value")).where("value IS NOT NULL").distinct()
    grouped = different.sparkSession.sql(
        """
        SELECT m.value, m.mapped, c.class_key
        FROM {m} m JOIN (
          SELECT min(mapped) AS class_key, mapped COLLATE UNICODE_CI AS key
          FROM {m} GROUP BY mapped COLLATE UNICODE_CI HAVING count(*) > 1
        ) c ON (m.mapped COLLATE UNICODE_CI) = c.key
        """,
        m=different.withColumn("mapped", mapped(F.col("value"))),
    )
    checked = grouped.withColumn("form", mapped(normal_form("mapped")))
    several = checked.groupBy("class_key", "form").agg(F.count("*").alias("members")).where("members > 1")
    # pairs and canonical members read the classes twice
    return cut(checked.join(several, ["class_key", "form"]).select("value", F.col("form").alias("class_form")))


def alike_pairs(members: DataFrame) -> DataFrame:
    """All pairs (title_a, title_b) of members of a class, the smaller string by code points first."""
    a = members.select("class_form", F.col("value").alias("title_a"))
    b = members.select("class_form", F.col("value").alias("title_b"))
    return a.join(b, "class_form").where("title_a < title_b").select("title_a", "title_b")


def canonical_members(members: DataFrame) -> DataFrame:
    """(value, canonical): for each member the member of its class that stands for all of them.

    It is the member that is written in the plain form, if there is one, else the one with the fewest
    bytes, else the smallest by code points. The choice depends on the set of values alone.
    """
    plain = (F.col("value") != F.col("class_form")).cast("int")
    best = members.groupBy("class_form").agg(F.min(F.struct(plain, F.octet_length("value"), "value")).alias("best"))
    return members.join(best, "class_form").select("value", F.col("best.value").alias("canonical"))


def titles(documents: DataFrame, gold: DataFrame) -> DataFrame:
    """Every string that names a page: documents.title, documents.document_id, gold.supporting_facts.title."""
    facts = gold.select(F.explode("supporting_facts").alias("f")).select(F.col("f.title").alias("value"))
    names = documents.select(F.explode(F.array("title", "document_id")).alias("value"))
    return names.unionByName(facts).distinct()
