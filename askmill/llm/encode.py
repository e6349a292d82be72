"""Token ids of every text by a public byte-level BPE tokenizer.

Texts up to ``leaf`` characters are encoded where they lie. Longer ones are cut into leaves that are
spread over the cluster and encoded in parallel; the ids of a text then grow together pairwise, as a
tree. At a join the two sides were encoded without knowledge of each other, so a window around it is
encoded again and grows until its ends agree with both sides.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
#: Split pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 4096
FIRST_WINDOW = 16


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a rank file; loaded once in each Python worker."""
    import tiktoken
    from pyspark import SparkFiles

    if not os.path.exists(path):  # a machine that has no such folder has the file that came with the job
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def _bounds(enc, ids: list[int]) -> list[int]:
    """Byte offsets at which the tokens begin, and the end."""
    out, at = [0], 0
    for t in ids:
        at += len(enc.decode_single_token_bytes(t))
        out.append(at)
    return out


#: Between a letter and a character that is none, a digit and a character that is none, or a character that is no blank and a
#: blank, the split pattern always cuts, whatever surrounds them: none of its pieces holds such a pair.
_BORDER = r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=[^\s\x1c-\x1f\x85])(?=[ \t\n\r])"
_ONE_CLASS = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
_BLANKS = r"[ \t\n\r]+"


def _characters(data: bytes) -> tuple[int, str]:
    """Whole characters of ``data``, which may begin and end within one, and the bytes before them."""
    skip = 0
    while skip < len(data) and data[skip] & 0xC0 == 0x80:
        skip += 1
    return skip, data[skip:].decode("utf-8", errors="ignore")


def _borders(data: bytes) -> list[int]:
    """Byte offsets within ``data`` at which every text that holds it is cut."""
    import regex

    skip, text = _characters(data)
    out, chars, at = [], 0, skip
    for m in regex.finditer(_BORDER, text):
        if 0 < m.start() < len(text):
            at += len(text[chars : m.start()].encode("utf-8"))
            chars = m.start()
            out.append(at)
    return out


def join_ids(enc, left: list[int], right: list[int]) -> list[int]:
    """The ids of the concatenation of two texts from the ids of each.

    The window takes ``w`` tokens of either side. Where both parts hold a border at which the split
    pattern cuts in any surroundings, the text between these borders is encoded again: outside of it
    each side's ids hold. Within one unsplit piece (a run of one kind of character) the window's ids
    are accepted if they agree with a side in the token at each end, since a sequence of which every two
    neighbours are merged as they would be alone is the encoding of the piece. Otherwise ``w`` doubles;
    at the latest both texts are encoded again as a whole.
    """
    if not left or not right:
        return left or right
    w = FIRST_WINDOW
    while w < max(len(left), len(right)):
        a, b = left[-w:], right[:w]
        got = _between_borders(enc, a, b, len(a) == len(left), len(b) == len(right)) or _within_piece(enc, a, b, right[w : w + 1])
        if got:
            return left[: len(left) - len(a)] + got + right[len(b) :]
        w *= 2
    return enc.encode_ordinary(enc.decode_bytes(left + right).decode("utf-8"))


def _between_borders(enc, a: list[int], b: list[int], whole_a: bool, whole_b: bool) -> list[int] | None:
    da, db = enc.decode_bytes(a), enc.decode_bytes(b)
    before = [0] if whole_a else _borders(da)[-1:]
    after = [len(db)] if whole_b else _borders(db)[:1]
    if not before or not after:
        return None
    start, end = before[0], after[0]
    middle = (da[start:] + db[:end]).decode("utf-8")
    return a[: _bounds(enc, a).index(start)] + enc.encode_ordinary(middle) + b[_bounds(enc, b).index(end) :]


def _within_piece(enc, a: list[int], b: list[int], behind: list[int]) -> list[int] | None:
    """A run of blanks is one piece but for its last blank, so that the window must end where it goes on, or with the text."""
    import regex

    data = enc.decode_bytes(a) + enc.decode_bytes(b)
    text = _characters(data)[1]
    blank = regex.fullmatch(_BLANKS, text) and (not behind or regex.fullmatch(_BLANKS, enc.decode_bytes(behind).decode("utf-8", errors="replace")))
    if not blank and not regex.fullmatch(_ONE_CLASS, text):
        return None
    ids = enc._encode_single_piece(data)
    return ids if ids[0] == a[0] and ids[-1] == b[-1] else None


def _encode_texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = pa.array([enc.encode_ordinary(t) if t else [] for t in texts], pa.list_(pa.int32()))
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*names, "ids"])

    return run


def _cut_leaves(leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                parts = [text[i : i + leaf] for i in range(0, len(text), leaf)]
                for k in range(0, len(parts), 256):
                    some = parts[k : k + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc.as_py()] * len(some), pa.int64()), pa.array(range(k, k + len(some)), pa.int32()), pa.array(some)],
                        ["doc_id", "node", "text"],
                    )

    return run


def _join_pairs(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            pairs = batch.column(2).to_pylist()
            ids = [join_ids(enc, p[0]["ids"], p[1]["ids"]) if len(p) > 1 else p[0]["ids"] for p in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "node", "ids"])

    return run


def token_ids(documents: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids) of every row of ``documents(doc_id, text)``, without special tokens.

    An empty and a null text have the empty list. Strings that look like special tokens are ordinary
    text. Equal texts under several ids each get their row; doc_id must be unique. Of longer texts only
    the ids move between the levels of the tree, never a text; each level halves their number, and a
    task holds the two halves of one text at a time.
    """
    path = path or rank_file()
    documents.sparkSession.sparkContext.addFile(path)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > leaf
    short = docs.where(~long).mapInArrow(_encode_texts(path), "doc_id bigint, ids array<int>")
    longest = docs.where(long).agg(F.max(F.length("text"))).first()[0]
    if longest is None:
        return short
    nodes = (
        docs.where(long)
        .mapInArrow(_cut_leaves(leaf), "doc_id bigint, node int, text string")
        .repartition("doc_id", "node")
        .mapInArrow(_encode_texts(path), "doc_id bigint, node int, ids array<int>")
    )
    for _ in range((-(-longest // leaf) - 1).bit_length()):
        nodes = (
            nodes.withColumn("parent", F.floor(F.col("node") / 2).cast("int"))
            .groupBy("doc_id", F.col("parent").alias("node"))
            .agg(F.array_sort(F.collect_list(F.struct("node", "ids"))).alias("halves"))
            .mapInArrow(_join_pairs(path), "doc_id bigint, node int, ids array<int>")
        )
    return short.unionByName(nodes.select("doc_id", "ids"))
