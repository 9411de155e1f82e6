"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, skew_join


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every linked node: root is the smallest node that it reaches.

    Alternates two star steps: every node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones.  Links stay as many or get fewer;
    the rounds grow with the logarithm of a component's size.  Each round is
    written to the shared folder.  Null ends, loops and repeated links change nothing; no links give no rows.
    """
    u, v = F.col(f"`{a}`"), F.col(f"`{b}`")
    e = materialise(links.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = skew_join(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, last = materialise(large, "large-star"), e
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = skew_join(large, least, ["u"]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star", large, last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
