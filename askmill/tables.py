"""Access to the driver's tables and the few session helpers that operators share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Only where the setting is absent and everything runs in one process (tests, a laptop) a fresh local folder is
    used; on a cluster, whose machines don't share it, that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[.*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="askmill-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and cut its lineage.

    Unlike a local checkpoint the result outlives lost executors.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own in the shared checkpoint folder.

    For loops: a plan that is read back from files carries neither the lineage nor the size estimates of
    the rounds before, which would otherwise multiply from round to round.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_stored(df: DataFrame) -> None:
    """Removes the files of a ``stored`` table that nothing reads any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, parent)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any file system that the cluster reads."""
    at, files = _path(spark, path)
    files.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _path(spark, path)
    return files.exists(at)


def rename(spark: SparkSession, path: str, new: str) -> None:
    at, files = _path(spark, path)
    if not files.rename(at, _path(spark, new)[0]):
        raise OSError(f"{path} can't be renamed to {new}")


def read_json(spark: SparkSession, path: str):
    """A small driver-side JSON file, or None if there is none or it is cut off."""
    if not exists(spark, path):
        return None
    text = "\n".join(r.value for r in spark.read.text(path).collect())  # one small object
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return None


def write_json(spark: SparkSession, path: str, payload: dict) -> None:
    """A small driver-side JSON file with sorted keys, put in place by one rename."""
    at, files = _path(spark, path)
    beside = _path(spark, f"{path}.{uuid.uuid4().hex}")[0]
    out = files.create(beside, True)
    out.write(bytearray(json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=2).encode() + b"\n"))
    out.close()
    files.delete(at, False)
    rename(spark, beside.toString(), path)
