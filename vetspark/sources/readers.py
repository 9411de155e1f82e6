"""Scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import best_per_group


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def candidate_scan(df: DataFrame, source: str, order: Sequence[Column], n: int = 20) -> DataFrame:
    """The first ``n`` hits of every source; Spark cuts each task's groups before it shuffles them."""
    return best_per_group(df, [source], order, n)


def batch_bounds(batch: DataFrame, start: str, kind: str = "timestamp_ntz") -> tuple[Column | None, Column | None]:
    """The first and last start of a batch as literals of type ``kind``; both null if no row has a start.

    One aggregate over that column alone; two values come to the driver.
    """
    at = F.col(f"`{start}`").cast(kind)
    exact = (lambda x: F.unix_micros(x)) if kind == "timestamp" else (lambda x: x.cast("string"))
    lo, hi = batch.agg(exact(F.min(at)), exact(F.max(at))).first()
    if lo is None:
        return None, None
    literal = (lambda x: F.timestamp_micros(F.lit(x))) if kind == "timestamp" else (lambda x: F.lit(x).cast(kind))
    return literal(lo), literal(hi)


def existing_scan(df: DataFrame, start: str, lo: str | Column | None, hi: str | Column | None, minutes: int = 30) -> DataFrame:
    """Existing events from ``minutes`` before ``lo`` to ``minutes`` after ``hi``, both included: literals, so that the scan skips row groups.

    Null bounds, of a batch without starts, give no rows.
    """
    if lo is None or hi is None:
        return df.filter(F.lit(False))
    margin = F.expr(f"interval {minutes} minutes")
    lo_, hi_ = (F.lit(x).cast("timestamp_ntz") if isinstance(x, str) else x for x in (lo, hi))
    return df.filter((F.col(start) >= lo_ - margin) & (F.col(start) <= hi_ + margin))


def existing_for(batch: DataFrame, existing: DataFrame, start: str, existing_start: str, minutes: int = 30) -> DataFrame:
    """The existing events that a batch can match: from ``minutes`` before its first start to ``minutes`` after its last.

    Runs in two steps: the batch's bounds first, then a scan with them as literals, which reach the files' statistics.
    """
    bounds = batch_bounds(batch, start, existing.schema[existing_start].dataType.simpleString())
    return existing_scan(existing, existing_start, *bounds, minutes=minutes)


CASE = "id bigint, prompt string, expected_output string, assertions array<string>, files array<string>"


def case_source(spark: SparkSession, path: str, field: str = "evals") -> DataFrame:
    """Cases of a JSON document that holds an array of them, one row each."""
    doc = spark.read.schema(f"{field} array<struct<{', '.join(c.replace(' ', ':', 1) for c in CASE.split(', '))}>>").option("multiLine", True).json(path)
    return doc.select(F.explode(field).alias("c")).select("c.*")


def raw_case_source(spark: SparkSession, path: str, field: str = "evals") -> DataFrame:
    """The same as (pos, raw): each case as JSON text, whatever its types."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.try_variant_get("v", f"$.{field}", "array<variant>")
    return doc.select(F.posexplode(items).alias("pos", "item")).select("pos", F.to_json("item").alias("raw"))
