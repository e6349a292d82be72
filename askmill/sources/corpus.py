"""Corpora of pages as JSON lines, plain, compressed or within nested archives."""

from __future__ import annotations

import bz2
import os
import re
import tarfile
from functools import reduce

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from askmill.functions.text import canonical_title, joined_text

_LINE = "source string, line long, value string"


_CHUNK = 1 << 20


def _decompressed(chunks):
    """Compressed chunks, possibly of several streams in a row, as plain ones."""
    stream = bz2.BZ2Decompressor()
    for chunk in chunks:
        while chunk:
            if stream.eof:
                stream = bz2.BZ2Decompressor()
            yield stream.decompress(chunk)
            chunk = stream.unused_data


def _lines(chunks):
    rest = b""
    for chunk in chunks:
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["paths"].split("\n") if p]

    def partitions(self):
        # a compressed archive can't be entered in the middle: one partition for each
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive):
        files, path = FileSystem.from_uri(partition.path if "://" in partition.path else os.path.abspath(partition.path))
        with files.open_input_stream(path, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as archive:
            for member in archive:
                if not member.isfile():
                    continue
                chunks = iter(lambda stream=archive.extractfile(member): stream.read(_CHUNK), b"")
                if member.name.endswith(".bz2"):
                    chunks = _decompressed(chunks)
                for number, line in enumerate(_lines(chunks), start=1):
                    text = line.decode("utf-8").rstrip("\r")
                    if text.strip():
                        yield member.name, number, text


class ArchiveLines(DataSource):
    """Lines of the members of tar archives; members may be compressed themselves."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return _LINE

    def reader(self, schema) -> DataSourceReader:
        return _ArchiveReader(self.options)


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, line, value) of text files, lines counted from 1 in each file.

    A file may be read in several blocks: lines are numbered within each and shifted by the counts of the blocks before.
    """
    rows = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )
    blocks = rows.groupBy("source", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    blocks = blocks.select("source", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(blocks, ["source", "block"]).select("source", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def corpus_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source, line, value) of JSON-lines files, plain or compressed, and of tar archives of such files; both may be mixed.

    Blank lines are left out but counted.
    """
    archives = [p for p in paths if re.search(r"\.tar(\.\w+)?$|\.tgz$", p)]
    plain = [p for p in paths if p not in archives]
    parts = []
    if archives:
        spark.dataSource.register(ArchiveLines)
        parts.append(spark.read.format("archive_lines").option("paths", "\n".join(archives)).load())
    if plain:
        parts.append(numbered_lines(spark, plain).where(F.trim("value") != ""))
    return reduce(DataFrame.unionByName, parts)


def documents_of(lines: DataFrame) -> DataFrame:
    """(source, line, wiki_id, document_id, title, text, problem) of JSON lines.

    ``document_id`` is the canonical title. ``problem`` is null, or not_json, no_title or empty_text.
    """
    v = F.try_parse_json("value")
    title = F.try_variant_get(v, "$.title", "string")
    rows = lines.select(
        "source", "line",
        F.try_variant_get(v, "$.id", "string").alias("wiki_id"),
        canonical_title(title).alias("document_id"),
        title.alias("title"),
        joined_text(F.try_variant_get(v, "$.text", "variant")).alias("text"),
        v.isNull().alias("broken"),
    )
    problem = (
        F.when(F.col("broken"), "not_json")
        .when(F.coalesce(F.trim("title"), F.lit("")) == "", "no_title")
        .when(F.coalesce("text", F.lit("")) == "", "empty_text")
    )
    return rows.withColumn("problem", problem).drop("broken")


def kept_and_quarantined(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents without a problem, and the rest for the record."""
    return documents.where("problem IS NULL").drop("problem"), documents.where("problem IS NOT NULL")


def repeated_ids(documents: DataFrame) -> DataFrame:
    """(document_id, n) of canonical titles that stand for several documents."""
    return documents.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1")


def log_fields(lines: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """(source, line, names...): the groups of a pattern in each line of a text log that has it as a whole, in the lines' order."""
    found = lines.where(F.col("value").rlike(pattern))
    return found.select("source", "line", *(F.regexp_extract("value", pattern, k + 1).alias(n) for k, n in enumerate(names)))


#: The lines of a run's log.
PROGRESS_LINE = r"^progress=.* examples=\d+/\d+ example_id=(\S+) status=complete "
ENVIRONMENT_LINE = r"^environment_ok torch=(\S+) transformers=(\S+) gpu=(.+)$"
MODEL_LINE = r"^stage=model_ready model=(\S+) load_seconds=([0-9.]+) parameters=(\d+)$"
