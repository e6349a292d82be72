"""Records of evaluation splits that stand, the same or nearly the same, in the training split too.

A suffix array over the texts of all records: one suffix for each word that is not small, going on over the
end of its text with the beginning, so that two things named in the other order still lie in one suffix.
Suffixes are brought together by their first word and sorted; suffixes next to each other share a span as
long as their common prefix, and what the suffixes of two texts share is their coverage. Texts that
cover each other but for slips and a lead-in are compared word by word.

Not a window of neighbours is read but whole intervals of the array, and enough of them that no pair is lost:
two wordings of one question may differ by small words, slips of typing and a lead-in on one side, so of any
three words that are not small and stand in the text without the lead-in, one stands in the other, too. Where the
third rarest word of a text is frequent, its rarest word alone is followed, in the intervals of this word and of
those a slip away from it. What is read of the array grows with the texts that share rare words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askmill.llm.graph import components
from askmill.llm.wordforms import slip, words
from askmill.tables import cut

#: Slips of typing that two wordings of one question may differ by, and words of a lead-in.
SLIPS = 2
LEAD = 4
#: A text whose third rarest word stands in no more suffixes than these is looked up by its three rarest words, without weighing.
RARE = 256
#: Words of a suffix that are kept for sorting and coverage; texts that go on behind them are compared whole.
SUFFIX = 32
#: Suffixes of one interval that one task holds; larger intervals are split.
INTERVAL = 4096
#: Words up to this length are looked up with one letter left out, longer ones by their halves.
SHORT = 24
#: Small words that may be added or dropped (fixed values; English, German, French, Spanish).
SMALL = frozenset(
    "a an the of in on at to for by and exactly please just now then so well here actually really also "
    "genau bitte denn eigentlich der die das den dem des ein eine einen im am vom zu von und "
    "exactement donc le la les l un une de du des en et au aux à "
    "exactamente por favor el los las unos unas del al y en una uno".split()
)


@F.pandas_udf(T.StringType())
def wording(text: pd.Series) -> pd.Series:
    """The words of a text, joined by single spaces; null and wordless texts have none."""
    return text.map(lambda s: " ".join(words(s)) or None, na_action="ignore")


def texts_of(records: DataFrame) -> DataFrame:
    """The different wordings of ``records(wording)`` as (tid, wording, c), where c are the words that are not small."""
    content = F.filter(F.split("wording", " "), lambda w: ~w.isin(sorted(SMALL)))
    texts = records.select("wording").distinct().select(F.monotonically_increasing_id().alias("tid"), "wording", content.alias("c"))
    return cut(texts.where(F.size("c") > 0))  # numbers hold from here on


def _slip_keys(w: Column) -> Column:
    """Hashes of which two words of three letters or more share one at least if one slip leads from one to the other.

    Short words: the word, and the word less each of its letters. In long ones a slip touches two neighbouring
    letters at most and leaves the first or the last letters, just under a half, as they were; these are
    kept with the larger length of the two words. Linear in the length of a long word.
    """
    n = F.length(w)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))))
    short = F.when(n <= SHORT, F.array_append(less, F.xxhash64(w)))
    halves = []
    for more in (0, 1):
        size = n + more
        half = F.floor(size / 2).cast("int") - 1
        halves += [F.xxhash64(size, F.lit("first"), F.left(w, half)), F.xxhash64(size, F.lit("last"), F.right(w, half))]
    long = F.when(n >= SHORT, F.array(*halves))
    none = F.array().cast("array<bigint>")
    return F.array_distinct(F.concat(F.coalesce(short, none), F.coalesce(long, none)))


@F.pandas_udf(T.BooleanType())
def _slips(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x.isalpha() and y.isalpha() and slip(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def near_words(chosen: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(w, near): words of ``vocabulary(w)`` that ``same_question`` takes for slips of a word of ``chosen(w)``."""
    def keys(df):
        long_enough = df.where((F.length("w") > 2) & ~F.col("w").rlike("[0-9]"))
        return long_enough.select("w", F.explode(_slip_keys(F.col("w"))).alias("key"))

    pairs = keys(chosen).join(keys(vocabulary).withColumnRenamed("w", "near"), "key").where("w != near").select("w", "near").distinct()
    return pairs.where(_slips("w", "near"))


def looked_up(placed: DataFrame) -> DataFrame:
    """(tid, w, first, n): the suffixes at which each text is looked up, by their first word, and the size of the interval.

    ``placed(tid, w)``: the words of each text that are not small. ``first`` is ``w`` or a word a slip away from it.
    Of the three rarest words and any of them with its slips a text takes what stands in the fewest suffixes.
    Intervals of one suffix are left out.
    """
    vocabulary = cut(placed.groupBy("w").agg(F.count("*").alias("n")))
    rarest = placed.join(vocabulary, "w").groupBy("tid").agg(F.array_sort(F.collect_set(F.struct("n", "w"))).alias("r"))
    rarest = cut(rarest.select("tid", F.slice("r", 1, SLIPS + 1).alias("r")))
    enough = F.coalesce(F.get("r", F.lit(SLIPS)).n <= RARE, F.lit(False))
    unsure = rarest.where(~enough).select("tid", "r", F.aggregate("r", F.lit(0).cast("bigint"), lambda total, x: total + x.n).alias("all"), F.explode("r").alias("o"))
    unsure = unsure.select("tid", "r", F.when(F.size("r") > SLIPS, F.col("all")).alias("all"), "o.w", "o.n")
    near = cut(near_words(unsure.select("w").distinct(), vocabulary.select("w")).join(vocabulary.withColumnRenamed("w", "near"), "near"))
    more = near.groupBy("w").agg(F.sum("n").alias("more"))
    costs = unsure.join(more, "w", "left").withColumn("cost", F.col("n") + F.coalesce("more", F.lit(0)))
    chosen = costs.groupBy("tid").agg(F.min_by(F.struct("w", "n", "cost"), F.struct("cost", "w")).alias("o"), F.first("r").alias("r"), F.first("all").alias("all"))
    by_all = F.coalesce(F.col("all") <= F.col("o.cost"), F.lit(False))
    chosen = cut(chosen.withColumn("by_all", by_all))
    three = rarest.where(enough).select("tid", "r").unionByName(chosen.where("by_all").select("tid", "r")).select("tid", F.inline("r"))
    one = chosen.where("NOT by_all").select("tid", "o.w", "o.n")
    own = three.unionByName(one.select("tid", "n", "w")).where("n > 1").select("tid", "w", F.col("w").alias("first"), "n")
    return own.unionByName(one.select("tid", "w").join(near, "w").select("tid", "w", F.col("near").alias("first"), "n"))


def suffixes(texts: DataFrame) -> DataFrame:
    """(first, part, suffix, tid, own, marks, asks): the suffixes of ``texts(tid, c)`` in the intervals that are read.

    A suffix is kept as the hashes of its words and goes on with the beginning of its text; ``own`` is the number of the
    text's words and ``marks`` has a bit for each of them. Large intervals are split in blocks of at most ``INTERVAL`` suffixes
    that ask and blocks of those that are there; each pair of blocks is a part.
    """
    placed = texts.select("tid", F.explode(F.array_distinct("c")).alias("w"))
    asked = cut(looked_up(placed))
    blocks = [F.ceil(size / INTERVAL).cast("int").alias(name) for name, size in (("askers", F.count("*")), ("parts", F.max("n")))]
    wanted = asked.groupBy("first").agg(*blocks)
    there = placed.join(wanted.withColumnRenamed("first", "w"), "w").select("tid", "w", F.col("w").alias("first"), "askers", "parts", F.lit(False).alias("asks"))
    asking = asked.join(wanted, "first").select("tid", "w", "first", "askers", "parts", F.lit(True).alias("asks"))
    places = there.unionByName(asking).groupBy("tid", "w", "first", "askers", "parts").agg(F.max("asks").alias("asks"))
    places = places.groupBy("tid").agg(F.collect_list(F.struct("w", "first", "askers", "parts", "asks")).alias("places"))

    h = F.transform("c", lambda w: F.hash(w))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(64)))
    marks = F.aggregate("h", F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(bit(x)))
    rows = texts.join(places, "tid").select("tid", "c", "places", h.alias("h"))
    rows = rows.select("tid", "c", "h", marks.alias("marks"), F.explode("places").alias("p")).select("tid", "c", "h", "marks", "p.*")
    ahead = F.slice("h", F.array_position("c", F.col("w")).cast("int"), SUFFIX)
    around = F.slice(F.concat(ahead, F.slice("h", F.lit(1), F.array_position("c", F.col("w")).cast("int") - 1)), 1, SUFFIX)
    ask, at = (F.pmod(F.xxhash64("tid"), F.col(c)).cast("int") for c in ("askers", "parts"))
    as_there = F.transform(F.sequence(F.lit(0), F.col("askers") - 1), lambda k: F.struct(k.alias("ask"), at.alias("at")))
    as_asking = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(ask.alias("ask"), k.alias("at")))
    cells = F.when(F.col("asks"), F.array_distinct(F.concat(as_there, as_asking))).otherwise(as_there)
    rows = rows.select("tid", F.xxhash64("first").alias("first"), around.alias("suffix"), F.size("c").alias("own"), "marks", "asks", "c", ask.alias("mine"), F.explode(cells).alias("cell"))
    return rows.select(
        "first", (F.col("cell.ask").cast("bigint") * (1 << 31) + F.col("cell.at")).alias("part"), "suffix", "tid", "own", "marks",
        (F.col("asks") & (F.col("cell.ask") == F.col("mine"))).alias("asks"), F.xxhash64("suffix", F.size("c")).alias("run"),
    )


def _covers(a: np.ndarray, b: np.ndarray) -> bool:
    """True unless the words of two suffixes that lie outside of what they share are too many: on one side at
    most ``SLIPS``, on the other a lead-in more."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    span = differ[0] if len(differ) else n  # the common prefix needs no counting
    left, right = Counter(a[span:].tolist()), Counter(b[span:].tolist())
    over_a, over_b = (left - right).total(), (right - left).total()
    return min(over_a, over_b) <= SLIPS and max(over_a, over_b) <= SLIPS + LEAD


def _covering(tid, own, marks, asks, run, suffix_of) -> tuple[list, list]:
    """The pairs of one interval of sorted suffixes."""
    whole = own <= SUFFIX
    # neighbours of the same words are chained: all that they have in common lies next to each other
    chained = np.flatnonzero((run[1:] == run[:-1]) & whole[1:])
    a, b = [tid[chained]], [tid[chained + 1]]
    askers = np.flatnonzero(asks)
    step = max(1, (1 << 20) // len(tid))
    for k in range(0, len(askers), step):
        some = askers[k : k + step]
        mine, theirs = marks[some, None], marks[None, :]
        over, under = np.bitwise_count(mine & ~theirs), np.bitwise_count(theirs & ~mine)
        fits = (np.minimum(over, under) <= SLIPS) & (np.maximum(over, under) <= SLIPS + LEAD)
        fits &= (np.abs(own[some, None] - own[None, :]) <= SLIPS + LEAD) & (tid[some, None] != tid[None, :])
        fits &= (run[some, None] != run[None, :]) | ~whole[some, None]
        i, j = np.nonzero(fits)
        i = some[i]
        keep = [not (whole[x] and whole[y]) or _covers(suffix_of(x), suffix_of(y)) for x, y in zip(i, j, strict=True)]
        a.append(tid[i[keep]])
        b.append(tid[j[keep]])
    return a, b


def _read_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes to pairs; an interval that goes on in the next batch waits for it."""

    def read(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        first, part, suffix, tid, own, marks, asks, run = (c.combine_chunks() if len(c.chunks) != 1 else c.chunk(0) for c in rows.columns)
        tid, own, marks, run = (c.to_numpy(zero_copy_only=False) for c in (tid, own, marks, run))
        marks, asks = marks.view(np.uint64), asks.to_numpy(zero_copy_only=False)
        flat, at = suffix.values.to_numpy(), suffix.offsets.to_numpy()
        a, b = [], []
        for s, e in zip(starts[:-1], starts[1:]):
            if e - s > 1:
                got = _covering(tid[s:e], own[s:e], marks[s:e], asks[s:e], run[s:e], lambda k, s=s: flat[at[s + k] : at[s + k + 1]])
                a += got[0]
                b += got[1]
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        key = np.stack([rows.column(k).to_numpy() for k in ("first", "part")], axis=1)
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(key) else np.zeros(1, int)
        if len(starts) > 1:
            yield read(rows.slice(0, starts[-1]), starts)
        rest = rows.slice(starts[-1])
    if rest is not None and len(rest):
        yield read(rest, np.array([0, len(rest)]))


def candidates(texts: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of ``texts(tid, c)`` that cover each other but for slips and a lead-in, among them every
    pair of ``same_question``; of texts of the same words in the same order, those next to each other."""
    sorted_ = suffixes(texts).repartition("first", "part").sortWithinPartitions("first", "part", "suffix", "tid")
    return sorted_.mapInArrow(_read_intervals, "a bigint, b bigint").distinct()


def same_question(a: list[str], b: list[str]) -> bool:
    """True if two wordings differ by small words, a lead-in, slips of typing or the order of words only.

    A wording of small words only is the same as itself and no other.
    """
    if SMALL.issuperset(a) or SMALL.issuperset(b):
        return a == b
    ca, cb = Counter(a), Counter(b)
    ra, rb = list((ca - cb).elements()), list((cb - ca).elements())
    slips = 0
    for t in list(ra):
        for u in rb:
            if len(t) > 2 and len(u) > 2 and t.isalpha() and u.isalpha() and slip(t, u):
                ra.remove(t)
                rb.remove(u)
                slips += 1
                break
    if slips > SLIPS:
        return False
    for rest, whole in ((ra, a), (rb, b)):
        lead = []
        for w in whole[:LEAD]:
            if w not in rest:
                break
            lead.append(w)
        other = rb if rest is ra else ra
        if not [w for w in other if w not in SMALL]:
            for w in lead:
                if w.isalpha() and w in rest:  # a word that leads twice may be left over once
                    rest.remove(w)
    return all(w in SMALL for w in (*ra, *rb))


@F.pandas_udf(T.BooleanType())
def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_question(x.split(), y.split()) for x, y in zip(a, b, strict=True)], dtype=bool)


def same_texts(records: DataFrame) -> DataFrame:
    """(wording, question): wordings of ``records(wording)`` that put one question in different words, with the name they share.

    Links between wordings of any splits are closed transitively.
    """
    texts = texts_of(records)
    side = texts.select("tid", "wording")
    verified = candidates(texts).join(side.toDF("a", "wa"), "a").join(side.toDF("b", "wb"), "b").where(_same("wa", "wb"))
    named = components(verified.select("a", "b")).toDF("tid", "question")
    return side.join(named, "tid").select("wording", F.col("question").cast("string").alias("question"))


def keyed(examples: DataFrame) -> DataFrame:
    """Records with a wording: (record_id, wording, held, answer_form, split_name, source)."""
    return (
        examples.where("record_id IS NOT NULL AND question IS NOT NULL AND split_name IN ('train', 'validation', 'test')")
        .select(
            "record_id",
            wording("question").alias("wording"),
            wording("answer").alias("answer_form"),
            (F.col("split_name") != "train").alias("held"),
            "split_name",
            "source",
        )
        .where("wording IS NOT NULL")
    )


def named_records(examples: DataFrame) -> DataFrame:
    """The records of ``keyed`` with the name of their ``question``."""
    records = cut(keyed(examples))
    return records.join(same_texts(records), "wording", "left").withColumn("question", F.coalesce("question", F.md5("wording")))


def overlaps(examples: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b) of records of which one is in training, the other held out, and both put the
    same question, with answers that agree but for case, spacing and punctuation or are null on a side.

    ``examples(record_id, question, answer, split_name, source)``. A null or wordless question or a null id is in no pair;
    a record of another or no split neither. The smaller id stands first; repeated rows change nothing; an
    empty table gives no rows.
    """
    rows = named_records(examples)
    train = rows.where("NOT held").select("question", F.col("record_id").alias("t"), F.col("answer_form").alias("ta"))
    held = rows.where("held").select("question", F.col("record_id").alias("h"), F.col("answer_form").alias("ha"))
    return (
        train.join(held, "question")
        .where("ta IS NULL OR ha IS NULL OR ta = ha")
        .select(F.least("t", "h").alias("record_id_a"), F.greatest("t", "h").alias("record_id_b"))
        .distinct()
    )


def overlap_report(examples: DataFrame) -> DataFrame:
    """(split_name, source, n_records, n_overlapping): per held-out split and source its records, and those that training
    holds as well. No pair is made: an answer is looked up among the different answers that training gives to the question."""
    rows = named_records(examples)
    train = rows.where("NOT held").select("question", F.col("answer_form").alias("ta")).distinct()
    any_ = train.groupBy("question").agg(F.max(F.col("ta").isNull()).alias("open"))
    held = rows.where("held").select("record_id", "question", F.col("answer_form").alias("ta"))
    known = train.where("ta IS NOT NULL").withColumn("same", F.lit(True))
    hit = held.join(any_, "question").join(known, ["question", "ta"], "left").where("ta IS NULL OR open OR same")
    hit = hit.select("record_id").distinct().withColumn("hit", F.lit(1))
    asked = examples.where("split_name IN ('validation', 'test')").select("record_id", "split_name", "source").distinct()
    return (
        asked.join(hit, "record_id", "left")
        .groupBy("split_name", "source")
        .agg(F.count("*").alias("n_records"), F.count("hit").alias("n_overlapping"))
    )
