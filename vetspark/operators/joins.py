"""Joins that a hot key doesn't hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fresh


def join_grouped(df: DataFrame, grouped: DataFrame, key: Column, grouped_key: str, how: str = "left") -> DataFrame:
    """Join with a table that has each key once, and comes grouped by it; ``grouped_key`` goes.

    A hash of the key joins along.  A side that an aggregate has dealt out by the key isn't dealt out by both, so that Spark deals
    out both sides for the join, and can split the partition that a hot key fills; without the hash it can't.  Null keys match nothing.
    """
    left, right, own = fresh(df, "hash", "hash_of", "key")
    keyed = df.withColumns({own: key, left: F.xxhash64(key)})
    found = grouped.withColumn(right, F.xxhash64(grouped_key))
    return keyed.join(found, (F.col(own) == F.col(grouped_key)) & (F.col(left) == F.col(right)), how).drop(own, left, right, grouped_key)
