"""Events of a stream against the same events as one batch, however they are cut."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vetspark.operators import reconcile as R
from vetspark.streaming.dedupe import PROVIDER, first_events

T0 = dt.datetime(2026, 6, 26, 12)
EVENT = "event_id string, pair_key string, start_ts timestamp_ntz"
#: Two starts long after all others let the watermark go past those.
END = [("end", "z", T0 + dt.timedelta(days=9)), ("more", "z", T0 + dt.timedelta(days=9, minutes=1))]


def run(spark, tmp_path, name, batches, scheduled=None):
    source, out = str(tmp_path / f"{name}-in"), str(tmp_path / f"{name}-out")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{source}/{k:03d}")
    old = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(source)
        q = first_events(stream, scheduled).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], old)
    return sorted((r.event_id or "", r.pair_key or "", str(r.start_ts)) for r in spark.read.schema(EVENT).parquet(out).collect() if r.pair_key != "z")


def batch(spark, rows, scheduled):
    old = scheduled.select(F.col("event_id").alias("o"), F.col("start_ts").alias("s"), F.col("pair_key").alias("p"))
    kept = R.new_in_batch(R.new_only(spark.createDataFrame(rows, EVENT), old, "event_id", "o", "start_ts", "s", "pair_key", "p"))
    return sorted((r.event_id or "", r.pair_key or "", str(r.start_ts)) for r in kept.collect())


@pytest.mark.parametrize("cuts", [[], [7, 8, 40]])
def test_any_cut_gives_the_events_of_the_batch(spark, tmp_path, cuts):
    r = random.Random(4)
    rows = [(f"e{i:02d}", r.choice("ab"), T0 + dt.timedelta(minutes=i * 4 + r.randrange(-25, 25), microseconds=r.choice((0, 0, 1)))) for i in range(50)]
    rows += [("x1", "a", T0), ("x2", "a", T0), ("n1", None, T0), ("n1", None, T0), ("n2", " ", T0), (None, "b", T0 + dt.timedelta(minutes=50)), ("u", "a", None)]
    odd, timed = rows[50:], rows[:50]
    cut = [0, *cuts, 50]
    batches = [timed[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    batches[0] = odd + batches[0]
    scheduled = spark.createDataFrame([("o1", "a", T0 + dt.timedelta(minutes=100)), ("o2", None, T0), ("o3", "b", None)], EVENT)
    assert run(spark, tmp_path, "s", [*batches, END[:1], END[1:]], scheduled) == batch(spark, rows, scheduled)
