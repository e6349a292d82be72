"""Held-out texts that stand, whole or in part, in the documents of a corpus.

Spaced-seed hashing: fixed masks over a few words, some positions of which are ignored, are hashed on both
sides. Equal hashes are joined, hits on the same diagonal of a document and an item are one candidate,
and the overlap around it is verified word by word, where single changed or misspelt words are let pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.wordforms import slip, words
from askmill.tables import cut

#: 1: the word counts; 0: it is ignored. Any stretch of twelve words in which changed words have at least
#: five words between them is hit by one of them.
MASKS = ("111111", "1111011", "1110111", "1101111")
LEAST_WORDS = 12
LEAST_SHARE = 1 / 3
#: Words that stand between two changed ones, and changed words in the words of a stretch, at most.
CHANGE_GAP = 5
CHANGE_SHARE = 1 / 7
#: Words of 64 bits of the filter that passes over seeds no item has: one for each seed of the items, but no more than these (32 MB).
FILTER_WORDS = 1 << 22

_MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(8)], dtype=np.uint64)


def _word_hashes(flat: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(flat, dtype=object), categorize=True)


def seeds(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of every placement of every mask in each list of words."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    if not lengths.sum():
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    h = _word_hashes([w for t in texts for w in t])
    row = np.repeat(np.arange(len(texts)), lengths)
    start = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = []
    for number, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        if n <= 0:
            continue
        whole = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
        key = np.full(len(whole), number + 1, dtype=np.uint64)
        for k, c in enumerate(mask):
            if c == "1":
                key = (key ^ (h[whole + k] * _MIX[k])) * np.uint64(0x100000001B3)
                key ^= key >> np.uint64(29)
        out.append((row[whole], whole - start[whole], key.astype(np.int64)))
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _item_seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        row, pos, key = seeds([t.split(" ") for t in batch["wording"]])
        yield pd.DataFrame({"item_id": batch["item_id"].to_numpy()[row], "item_pos": pos.astype(np.int32), "hash": key})


def _marks(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a filter of ``size`` words that each hash is looked up in, and its four bits there."""
    h = key.astype(np.uint64)
    mask = np.zeros(len(h), dtype=np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return ((h >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64), mask


def _filter_words(size: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Seeds as (word, mask) of a filter of ``size`` words, those of a batch in the same word put together."""
    for batch in batches:
        at, mask = _marks(batch["hash"].to_numpy(), size)
        word, inverse = np.unique(at, return_inverse=True)
        held = np.zeros(len(word), dtype=np.uint64)
        np.bitwise_or.at(held, inverse, mask)
        yield pd.DataFrame({"word": word, "mask": held.astype(np.int64)})


def seed_filter(item_seeds: DataFrame, most_words: int = FILTER_WORDS):
    """The broadcast filter of the hashes of ``item_seeds(hash)``: four bits are set for each of them.

    It is put together by the tasks, word by word; its size has a fixed bound, and the driver holds it and nothing else.
    With more seeds than it has room for it passes over fewer; the join behind it is exact.
    """
    size = 1
    wanted = min(most_words, item_seeds.count())
    while size < wanted:
        size *= 2
    filled = item_seeds.select("hash").mapInPandas(partial(_filter_words, size), "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    held = np.zeros(size, dtype=np.uint64)
    rows = filled.toPandas()  # at most ``size`` rows
    held[rows["word"].to_numpy(dtype=np.int64)] = rows["mask"].to_numpy(dtype=np.int64).astype(np.uint64)
    return item_seeds.sparkSession.sparkContext.broadcast(held)


def _hits(held, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, wording, pos, hash): documents with seeds that pass the filter, with those seeds."""
    known = held.value
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            texts = [words(t) for t in part.column(1).to_pylist()]
            row, pos, key = seeds(texts)
            at, mask = _marks(key, len(known))
            hit = np.flatnonzero((known[at] & mask) == mask)
            hit = hit[np.argsort(row[hit], kind="stable")]
            docs, starts = np.unique(row[hit], return_index=True)
            ends = pa.array(np.append(starts, len(hit)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(docs, pa.int64())),
                    pa.array([" ".join(texts[d]) for d in docs], pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(pos[hit], pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(key[hit], pa.int64())),
                ],
                ["doc_id", "wording", "pos", "hash"],
            )


def stretch(doc: list[str], item: list[str], diagonal: int, common: frozenset[str] = frozenset()) -> int:
    """Words of the longest stretch of ``item`` that ``doc`` holds along ``diagonal`` (document less item position).

    A misspelt word (one slip, four letters or more) counts as the same. A changed word is let pass if at
    least ``CHANGE_GAP`` same words lie between it and the next changed one, as long as changed words are
    at most ``CHANGE_SHARE`` of the stretch and fewer than its same words not in ``common``: two passages of
    one mould agree in its common words and differ in what is told.
    """
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    changed = [
        i for i in range(lo, hi) if (a := item[i]) != (b := doc[i + diagonal]) and not (len(a) > 3 and a[0].isalpha() and slip(a, b))
    ]
    telling = [0]
    other = set(changed)
    for i in range(lo, hi):
        telling.append(telling[-1] + (i not in other and item[i] not in common))
    best = 0
    marks = [lo - 1, *changed, hi]
    for s in range(len(marks) - 1):
        # from the word after a change on, over further changes as long as they lie far enough apart
        e = s + 1
        while True:
            size, inside = marks[e] - marks[s] - 1, e - s - 1
            if not inside or (
                inside <= CHANGE_SHARE * size and telling[marks[e] - lo] - telling[marks[s] + 1 - lo] > inside
            ):
                best = max(best, size)
            if e + 1 >= len(marks) or marks[e] >= hi:
                break
            if inside and marks[e] - marks[e - 1] - 1 < CHANGE_GAP:
                break
            e += 1
            if marks[e] - marks[e - 1] == 1:
                break
    return best


def _wordings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"item_id": batch["item_id"], "wording": [" ".join(words(t)) for t in batch["text"]]})


def common_words(items: DataFrame) -> frozenset[str]:
    """Words in more than two percent of the different wordings of ``items(wording)`` (in more than four of them, if that is more).

    At most fifty times the words of a mean wording are common, however many items there are.
    """
    texts = items.select("wording").distinct()
    most = max(4, texts.count() // 50)
    counts = texts.select(F.explode(F.array_distinct(F.split("wording", " "))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return frozenset(r.w for r in counts.where(F.col("n") > most).select("w").toLocalIterator())


def _verify(common: frozenset[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        docs, found, sizes = [], [], []
        for doc_id, wording, candidates in zip(batch["doc_id"], batch["wording"], batch["candidates"], strict=True):
            doc = wording.split(" ")
            for c in candidates:
                item, longest = c["wording"].split(" "), 0
                need = max(LEAST_WORDS, len(item) * LEAST_SHARE)
                for diagonal in c["diagonals"]:
                    longest = max(longest, stretch(doc, item, diagonal, common))
                    if longest >= need:
                        docs.append(doc_id)
                        found.append(c["item_id"])
                        sizes.append(longest)
                        break
        yield pd.DataFrame({"doc_id": docs, "item_id": found, "n_words": sizes})


def leaked(documents: DataFrame, items: DataFrame, filter_words: int = FILTER_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words) of every document that holds an item, or an unbroken stretch of at least
    twelve words and a third of its words, with the words of the first such stretch that is found.

    ``documents(doc_id, text)`` and ``items(item_id, text)``; both ids unique. Items with the same text count
    each. Null, empty and wordless texts hold nothing and stand nowhere; rows without an id are left out. Texts are compared
    whole. Documents are read once, whatever the number of items: what is broadcast to them is a filter of a fixed
    size; the seeds that pass it meet those of the items in a join, and so do the items' words.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    wanted = cut(wanted.mapInPandas(_wordings, "item_id bigint, wording string").where("wording != ''"))
    item_seeds = wanted.mapInPandas(_item_seeds, "item_id bigint, item_pos int, hash bigint")
    held = seed_filter(item_seeds, filter_words)
    shape = "doc_id bigint, wording string, pos array<int>, hash array<bigint>"
    hits = cut(docs.mapInArrow(partial(_hits, held), shape))
    candidates = (
        hits.select("doc_id", F.inline(F.arrays_zip("pos", "hash")))
        .join(item_seeds, "hash")
        .groupBy("doc_id", "item_id")
        .agg(F.sort_array(F.collect_set(F.col("pos") - F.col("item_pos"))).alias("diagonals"))
        .join(wanted, "item_id")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("item_id", "wording", "diagonals")).alias("candidates"))
    )
    rows = hits.select("doc_id", "wording").join(candidates, "doc_id")
    return rows.mapInPandas(partial(_verify, common_words(wanted)), "doc_id bigint, item_id bigint, n_words int")
