"""How demanding each document is to read, in the bands of a graded sample."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.tables import cut

#: Graded documents that the trees are fitted on, at most; of more, those with the smallest hash of their id.
FIT_ROWS = 20_000
FOLDS = 4
TREES = 24
DEPTH = 4
QUARTILES = (0.25, 0.5, 0.75)
#: Frequent small words that tell the languages of the corpus apart, since word length means
#: something else in each.
TELLING = {"en": "the of and which is was", "de": "der die das und wurde ist", "fr": "le la les et une est", "es": "el la los y una es"}

_WORD = r"[\p{L}\p{M}]+"
#: Signs that part or join clauses (fixed value).
_CLAUSE = "[,;:—(]"


def _sentence(x: Column) -> Column:
    """The words of one sentence, given as it stands and in small letters, and what is counted in its characters."""
    return F.struct(
        F.regexp_extract_all(x.small, F.lit(_WORD), F.lit(0)).alias("w"),
        F.regexp_count(x.small, F.lit(r"[aeiouyäöüàâéèêëîïôûùáíóúœæ]+")).alias("syllables"),
        F.regexp_count(x.s, F.lit(_CLAUSE)).alias("marks"),
        F.regexp_count(x.s, F.lit(r"\p{Lu}(?<![\p{L}\p{M}]\p{Lu})")).alias("capitals"),
        F.regexp_count(x.s, F.lit(r"\p{N}+")).alias("numbers"),
    )


def _measures(x: Column) -> Column:
    """Length, vocabulary and syntax of one sentence, from the lengths of its words."""
    lengths = x.lengths
    n = F.greatest(F.size(x.w), F.lit(1)).cast("double")

    def share(condition) -> Column:
        return F.size(F.filter(lengths, condition)) / n

    return F.struct(
        n.alias("words"),
        (F.aggregate(lengths, F.lit(0), lambda total, k: total + k) / n).alias("letters"),
        share(lambda k: k >= 9).alias("long"),
        share(lambda k: k >= 13).alias("longest"),
        (x.syllables / n).alias("syllables"),
        share(lambda k: k <= 3).alias("short"),
        (x.marks / n).alias("marks"),
        (n / (x.marks + 1)).alias("clause"),
        (x.capitals / n).alias("capitals"),
        (x.numbers / n).alias("numbers"),
    )


_SENTENCE = ("words", "letters", "long", "longest", "syllables", "short", "marks", "clause", "capitals", "numbers")


def _among(words: str, known: list[str]) -> Column:
    """How many of the words are ``known``."""
    return F.size(F.filter(words, lambda w: w.isin(*known)))


def features(documents: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, source, features, carried...) of every document with at least one sentence, that is, at least one word.

    Each measure of a sentence enters by the quartiles of its distribution over the text, so that a stray
    sentence of another kind moves none of them far; cohesion by the words that neighbouring sentences
    share. Texts are read whole; everything is an expression over the document's own row.
    """
    # patterns that begin with a look behind are tried at every character
    sentences = F.filter(F.split("text", r"[.!?…][»”\"')\]]*\s+"), lambda s: s.rlike(r"\p{L}"))
    rows = (
        documents.where(F.col("text").rlike(r"\p{L}"))
        .select("doc_id", "source", *carried, sentences.alias("s"))
        .select("doc_id", "source", *carried, F.transform("s", lambda s: F.struct(s.alias("s"), F.lower(s).alias("small"))).alias("t"))
        .withColumn("t", F.transform("t", _sentence))
        # the words of a sentence are found and measured once; everything else is counted from them
        .withColumn("t", F.transform("t", lambda x: F.struct(x.w.alias("w"), F.transform(x.w, lambda w: F.length(w)).alias("lengths"), *(x[c].alias(c) for c in ("syllables", "marks", "capitals", "numbers")))))
        .withColumn("m", F.transform("t", _measures))
        .withColumn("w", F.transform("t", lambda x: F.array_distinct(x.w)))
    )
    all_telling = " ".join(TELLING.values()).split()
    rows = rows.withColumn("every", F.flatten("w")).withColumn("telling", F.filter("every", lambda w: w.isin(*all_telling)))
    at = F.size("m") - 1
    for name in _SENTENCE:
        rows = rows.withColumn(f"o_{name}", F.sort_array(F.col("m").getField(name)))
    columns = {f"{name}_{int(q * 100)}": F.get(f"o_{name}", F.round(at * q).cast("int")) for name in _SENTENCE for q in QUARTILES}
    shared = F.transform(
        F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
        lambda p: F.when(p.b.isNotNull(), F.size(F.array_intersect(p.a, p.b)) / F.greatest(F.least(F.size(p.a), F.size(p.b)), F.lit(1))),
    )
    shared = F.filter(shared, lambda x: x.isNotNull())
    columns["cohesion"] = F.when(F.size(shared) > 0, F.aggregate(shared, F.lit(0.0), lambda a, x: a + x) / F.size(shared)).otherwise(0.0)
    columns["sentences"] = F.log1p(F.size("m")).cast("double")
    every = F.col("every")
    columns["variety"] = F.size(F.array_distinct(every)) / F.greatest(F.size(every), F.lit(1))
    for language, small in TELLING.items():
        columns[f"small_{language}"] = _among("telling", small.split()) / F.size("w")
    named = rows.select("doc_id", "source", *carried, *(c.cast("double").alias(k) for k, c in columns.items()))
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep").transform(named).select(
        "doc_id", "source", "features", *carried
    )


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the mean of the graders' bands; a grader who graded a document repeatedly counts once."""
    each = labels.where("band IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "grader").agg(F.avg("band").alias("band"))
    return each.groupBy("doc_id").agg(F.avg("band").alias("grade"))


def graded_sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, features, grade, fold) of at most ``FIT_ROWS`` graded documents; a source is in one fold."""
    graded = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    # graded texts are picked before anything is measured
    rows = features(documents.select("doc_id", "text", "source").join(graded, "doc_id"), "grade")
    rows = cut(rows.repartition(FOLDS))
    # the largest source alone in the first fold, the others dealt out in turn; of a bounded sample, so is the window
    named = F.coalesce("source", F.lit("")).alias("named")
    order = F.row_number().over(Window.orderBy(F.desc("n"), "named")) - 1
    folds = rows.groupBy(named).agg(F.count("*").alias("n")).select("named", order.alias("k"))
    folds = folds.select("named", F.when(F.col("k") < FOLDS, F.col("k")).otherwise(1 + F.col("k") % (FOLDS - 1)).alias("fold"))
    return cut(rows.join(folds, F.coalesce("source", F.lit("")) == F.col("named")).drop("named").repartition(FOLDS))


def _trees() -> GBTRegressor:
    return GBTRegressor(
        labelCol="grade",
        featuresCol="features",
        predictionCol="raw",
        maxIter=TREES,
        maxDepth=DEPTH,
        stepSize=0.2,
        subsamplingRate=0.8,
        featureSubsetStrategy="onethird",
        seed=7,
    )


def _at_once(jobs: list):
    """The results of ``jobs``, which are run side by side: a fit is a long row of short jobs and fills no cluster."""
    with ThreadPoolExecutor(max_workers=len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def fitted(sample: DataFrame):
    """(model, predicted): trees fitted on the whole sample, and (doc_id, source, grade, fold, raw), each graded document
    as predicted by trees that saw no document of its fold's sources. With one fold nothing is held out."""
    folds = sorted(r.fold for r in sample.select("fold").distinct().collect())
    if len(folds) < 2:
        model = _trees().fit(sample)
        return model, model.transform(sample).select("doc_id", "source", "grade", "fold", "raw")
    parts = [sample, *(sample.where(F.col("fold") != k) for k in folds)]
    model, *others = _at_once([partial(_trees().fit, part) for part in parts])
    predicted = [m.transform(sample.where(F.col("fold") == k)) for m, k in zip(others, folds, strict=True)]
    return model, cut(reduce(DataFrame.unionByName, predicted).select("doc_id", "source", "grade", "fold", "raw"))


def calibration(predicted: DataFrame):
    """The monotone step from held-out predictions to expected grades."""
    return IsotonicRegression(labelCol="grade", featuresCol="raw", predictionCol="expected").fit(predicted)


def calibrated_out_of_fold(predicted: DataFrame) -> DataFrame:
    """``predicted`` with expected grades by a calibration that saw nothing of the fold's sources either."""
    folds = sorted(r.fold for r in predicted.select("fold").distinct().collect())
    if len(folds) < 2:
        return calibration(predicted).transform(predicted)
    steps = _at_once([partial(calibration, predicted.where(F.col("fold") != k)) for k in folds])
    return reduce(DataFrame.unionByName, [s.transform(predicted.where(F.col("fold") == k)) for s, k in zip(steps, folds, strict=True)])


def _band(expected: Column) -> Column:
    return F.greatest(F.round(expected), F.lit(1)).cast("int")


def bands(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, band) of every document of ``documents(doc_id, text, source)`` that has a sentence.

    Gradient-boosted trees are fitted on the graded sample; predictions that are held out source by source
    calibrate them to expected grades, which are rounded to a band. Null, empty and wordless texts have no
    row. Without any usable grade every band is null. Equal texts have equal bands.
    """
    rows = features(documents)
    sample = graded_sample(documents, labels)
    if sample.isEmpty():
        return rows.select("doc_id", F.lit(None).cast("int").alias("band"))
    model, predicted = fitted(sample)
    step = calibration(predicted)
    return step.transform(model.transform(rows).select("doc_id", "raw")).select("doc_id", _band(F.col("expected")).alias("band"))


def by_source(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Held-out quality per source: (source, n, rmse, agree), where agree is the share of equal rounded bands.

    Neither the trees nor the calibration that a document is scored by saw a document of its source.
    """
    expected = calibrated_out_of_fold(fitted(graded_sample(documents, labels))[1])
    return expected.groupBy("source").agg(
        F.count("*").alias("n"),
        F.round(F.sqrt(F.avg(F.pow(F.col("expected") - F.col("grade"), 2))), 4).alias("rmse"),
        F.round(F.avg((_band(F.col("expected")) == F.round("grade")).cast("int")), 4).alias("agree"),
    )
