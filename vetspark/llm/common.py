"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables, by a path that only Spark has to reach."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local master, as in tests, gets a folder of this machine; on a cluster that is an error,
    as executors would write to their own disks and later reads would miss those files.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if (had := spark.sparkContext.getCheckpointDir()) is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        had = spark.sparkContext.getCheckpointDir()
    return had


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, label: str = "step", *done: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread, never a recomputation.
    ``done`` are earlier results of this function that nothing reads any more once ``df`` is written; their files go then.
    The other files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    at, files = _at(spark, path)
    files.deleteOnExit(at)
    schema = df.schema
    df.write.parquet(path)
    for old in done:
        at, files = _at(spark, old.vetspark_path)
        files.delete(at, True)
    out = spark.read.schema(schema).parquet(path)
    out.vetspark_path = path
    return out


def in_fixed_order(df: DataFrame, label: str) -> DataFrame:
    """``df`` if its tasks read their rows straight from files, in an order that a task run again meets too; else ``df`` written and read back.

    Behind a shuffle, rows come in the order in which they arrive.
    """
    return materialise(df, label) if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def is_held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hidden(name: str, *frames: DataFrame) -> str:
    """A column name for intermediate results, whatever the columns of ``frames``."""
    taken = {c.lower() for df in frames for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def tokenizer_file(name: str) -> str:
    """Default place of a public tokenizer's file on the driver."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` (never null), where ``right`` has each key once.

    A hash of the keys joins along, so that a ``right`` that comes grouped by
    the keys is dealt out anew and Spark can split the large partitions of a hot key.
    """
    k = hidden("k", left, right)
    h = F.xxhash64(*keys)
    return left.withColumn(k, h).join(right.withColumn(k, h), [*keys, k], how).drop(k)
