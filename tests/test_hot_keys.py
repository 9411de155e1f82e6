"""Tables of which one key holds most rows: joins that split it, links in chunks, rows decided in one pass."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from vetspark.operators import checks as C
from vetspark.operators import entities as D
from vetspark.operators import reconcile as R
from vetspark.operators import urls as U

#: A cluster in small: nothing is broadcast, partitions of some kB count as large.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def small(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, tmp_path, n=60_000):
    """Rows of which four fifths are on one host."""
    path = str(tmp_path / "rows")
    i = F.col("id")
    host = F.when(i % 5 > 0, "hot.example.net").otherwise(F.concat(F.lit("h"), i, F.lit(".example.org")))
    spark.range(0, n, 1, 8).select(i, host.alias("host"), F.concat(F.lit("Team "), host).alias("team"), F.sha2(i.cast("string"), 256).alias("filler")).write.parquet(path)
    return spark.read.parquet(path)


JOINS = {
    "domains": lambda spark, df: C.match_domains(df, spark.createDataFrame([("example.net", 1), ("example.org", 2)], "domain string, tier int")),
    "platforms": lambda spark, df: C.platform_rule(df, {"example.net": True}),
    "probes": lambda spark, df: U.probe_verdict(df, df.select("host", F.lit(200).alias("http_status")).distinct(), on="host"),
    "aliases": lambda spark, df: D.normalise(df, "team", df.select(F.col("team").alias("alias"), F.col("host").alias("canonical")).distinct()),
}


@pytest.mark.parametrize("name", list(JOINS))
def test_a_hot_host_is_split(spark, tmp_path, name):
    df = hot(spark, tmp_path)
    with small(spark):
        out = JOINS[name](spark, df)
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == df.count() and "skew=true" in plan
    assert {c for c in out.columns if c.startswith("__")} == set()


def test_null_keys_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a.de", 6)], "id long, host string, __hash long")
    out = C.match_domains(df, spark.createDataFrame([("de", 1)], "domain string, tier int"))
    assert out.columns == ["id", "host", "__hash", "matched"] and {(r.id, r.matched and r.matched.tier) for r in out.collect()} == {(1, None), (2, 1)}


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_links_of_a_large_entity_come_in_chunks(spark, size):
    i = F.col("id")
    df = spark.range(0, 3000, 1, 6).select(F.when(i % 10 > 0, "big").otherwise(F.concat(F.lit("g"), i % 70)).alias("game"), (i % 3).cast("int").alias("tier"), F.lit("s").alias("source"), F.concat(F.lit("u"), i % 1500).alias("url"))
    df = df.unionByName(df.limit(0)).unionByName(spark.createDataFrame([("big", None, "s", None), ("big", None, "s", None)], df.schema))
    with small(spark):
        got = R.merge_links(df, ["game"], size=size).collect()
    links = {}
    for r in sorted(got, key=lambda r: (r.game, r.chunk)):
        assert 0 < len(r.links) <= size
        links.setdefault(r.game, []).extend((x.tier, x.source, x.url) for x in r.links)
    want = {}
    for g, t, s, u in {tuple(r) for r in df.collect()}:
        want.setdefault(g, []).append((t, s, u))
    least = lambda x: ((x[0] is not None, x[0] or 0), x[1], (x[2] is not None, x[2] or ""))
    assert links == {g: sorted(x, key=least) for g, x in want.items()} and {(r.game, r.n_links) for r in got} == {(g, len(x)) for g, x in want.items()}
    assert R.merge_links(df.limit(0), ["game"]).count() == 0


def test_rows_are_decided_and_counted_in_one_pass(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame([(1, None, False), (2, "bad", True), (3, None, None), (4, "worse", False), (5, None, True)], "id long, why string, again boolean").write.parquet(source)
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.read.parquet(source).mapInArrow(read, "id long, why string, again boolean")
    stages = {"first": F.col("why") == "bad", "second": F.col("why").isNotNull()}
    accepted, rejected, summary = R.write_decided(df, str(tmp_path / "out"), F.col("why"), F.col("again"), stages)
    assert {r.id for r in accepted.collect()} == {1, 3} and {(r.id, r.reason) for r in rejected.collect()} == {(2, "bad"), (4, "worse")}
    assert summary.first().asDict() == {"found": 5, "rejected": 2, "duplicates": 1, "created": 2, "rejected_first": 1, "rejected_second": 1, "message": None}
    assert reads.value == 5  # one pass for both parts and all counts
    same = R.run_summary(spark.read.parquet(source), F.col("why").isNotNull(), F.col("again"), stages=stages)
    assert same.first().asDict() == summary.first().asDict()
    none, _, empty = R.write_decided(df.filter("id > 9"), str(tmp_path / "out"), F.col("why"), F.col("again"))
    assert none.count() == 0 and empty.first().message == "no streams found"
    all_bad = R.write_decided(df.filter("why is not null"), str(tmp_path / "out"), F.col("why"), F.col("again"))[2]
    assert all_bad.first().message == "found 2 candidates, none passed"
    with pytest.raises(ValueError, match="reason"):
        R.write_decided(df.withColumn("Reason", F.lit(1)), str(tmp_path / "out"), F.col("why"), F.col("again"))
