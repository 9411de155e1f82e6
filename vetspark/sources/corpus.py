"""A corpus of text files, such as Markdown documents, and what is wrong in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.conformance import document_conformance, missing_documents
from .shared import file_system


def _relative(spark: SparkSession, path: Column, root: str) -> Column:
    """A file's path below ``root``; paths come with their scheme and escaped, as Spark's file metadata has them."""
    at, files = file_system(spark, root)
    plain = lambda x: F.regexp_replace(F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    base = plain(F.lit(files.makeQualified(at).toUri().toString()))
    return F.ltrim(F.substr(plain(path), F.length(base) + 1), F.lit("/"))


def read_documents(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, text): every file below ``root`` whose name matches, whole, by its path below it.

    Folders of any depth are read, one document to a row; no files give no rows.  Spark's scans leave out files without a byte, here and
    in :func:`read_paths`, so that an empty document counts as missing.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return files.select(_relative(spark, F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("text"))


def read_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path): every file below ``root``, of any kind; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(_relative(spark, F.col("path"), root).alias("path"))


def corpus_findings(
    documents: DataFrame, files: DataFrame, conform: Sequence[str] | None = None, scan: Sequence[str] | None = None, headings: Sequence[str] = (),
    reference: str = r"`([\w/.-]+\.md)`", **limits,
) -> DataFrame:
    """(path, kind, finding) for a corpus (path, text), from one look at every text.

    ``error``: what :func:`.document_conformance` finds in the documents ``conform`` (all if none); ``limits`` go there.
    ``dangling``: a back-quoted path with a slash, in the documents ``scan`` (all if none), that ``files`` (path) lacks, once for each document.
    ``warning``: a document of ``scan`` that isn't there; the others are scanned all the same.
    """
    in_ = lambda names: F.lit(True) if names is None else F.col("path").isin(*names)
    checked = document_conformance(documents.select("path", "text"), "text", None, headings=headings, **limits)
    none = F.array().cast("array<string>")
    named = F.array_distinct(F.regexp_extract_all("text", F.lit(reference), F.lit(1)))
    kinds = [("error", F.when(in_(conform), F.col("errors"))), ("reference", F.when(in_(scan), named))]
    as_ = lambda kind: lambda f: F.struct(F.lit(kind).alias("kind"), f.alias("finding"))
    said = F.concat(*[F.transform(F.coalesce(x, none), as_(k)) for k, x in kinds])
    found = checked.select("path", F.inline(said)).filter((F.col("kind") == "error") | F.col("finding").contains("/"))
    targets = files.select(F.col("path").alias("target")).distinct()
    open_ = found.join(targets, (F.col("finding") == F.col("target")) & (F.col("kind") == "reference"), "left_anti")
    out = open_.select("path", F.when(F.col("kind") == "reference", "dangling").otherwise("error").alias("kind"), "finding")
    if not scan:
        return out
    wanted = documents.sparkSession.createDataFrame([(s,) for s in scan], "name string")
    absent = missing_documents(wanted, documents.select(F.col("path").alias("name")))
    return out.unionByName(absent.select(F.col("name").alias("path"), F.lit("warning").alias("kind"), F.col("warning").alias("finding")))
