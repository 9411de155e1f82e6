"""The event store and its commit log, bounds from a batch, and chains of events that pointers double along."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vetspark.operators import reconcile as R
from vetspark.plans.vetting import vet_and_reconcile
from vetspark.sources import readers, store

T0 = dt.datetime(2026, 6, 26, 12)
EVENT = "event_id string, pair_key string, start_ts timestamp_ntz, note string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def frame(spark, rows):
    return spark.createDataFrame([(*r, None)[:4] for r in rows], EVENT)


# what a store must not take twice: ids, no ids, no pairs, no starts, blanks
MIXED = [("1", "a|b", at(0)), (None, "a|b", at(5)), (None, None, at(0), "x"), (None, None, at(0), "x"), (None, None, at(0), "y"), (None, None, None), ("2", None, None), ("3", " ", at(0)), (None, "a|c", at(0)), (None, "a|c", at(31))]


def rows_of(df):
    return sorted(((r.event_id, r.pair_key, r.start_ts, r.note) for r in df.collect()), key=repr)


def test_a_rerun_adds_nothing(spark, tmp_path):
    path = str(tmp_path)
    assert store.append_events(frame(spark, MIXED), path) == 8
    once = rows_of(store.stored_events(spark, path))
    assert once == sorted([("1", "a|b", at(0), None), (None, None, at(0), "x"), (None, None, at(0), "y"), (None, None, None, None), ("2", None, None, None), ("3", " ", at(0), None), (None, "a|c", at(0), None), (None, "a|c", at(31), None)], key=repr)
    assert store.append_events(frame(spark, MIXED), path) == 0 and rows_of(store.stored_events(spark, path)) == once
    assert len(store.commits(spark, path)) == 1  # nothing new, no entry


@pytest.mark.parametrize("step", ["publish", "_stage", "new_in_batch"])
def test_a_killed_run_leaves_nothing_visible(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path)
    store.append_events(frame(spark, [("0", "z", at(0))]), path)
    real = getattr(store, step)

    def killed(*a, **k):
        if step != "new_in_batch":
            real(*a, **k) if step == "_stage" else None
        raise KeyboardInterrupt

    monkeypatch.setattr(store, step, killed)
    with pytest.raises(KeyboardInterrupt):
        store.append_events(frame(spark, MIXED), path)
    monkeypatch.undo()
    assert store.stored_events(spark, path).count() == 1
    assert store.append_events(frame(spark, MIXED), path) == 8 and store.append_events(frame(spark, MIXED), path) == 0
    assert store.stored_events(spark, path).count() == 9
    gone = store.sweep(spark, path)
    assert any(g.startswith("stage/") for g in gone) and store.stored_events(spark, path).count() == 9


def test_a_writer_that_loses_the_race_sees_what_the_other_added(spark, tmp_path, monkeypatch):
    path, real, turns = str(tmp_path), store.publish, []

    def late(spark_, path_, commit):
        if not turns:
            turns.append(1)
            assert store.append_events(frame(spark, [("1", "a|b", at(0))]), path) == 1
        return real(spark_, path_, commit)

    monkeypatch.setattr(store, "publish", late)
    assert store.append_events(frame(spark, [("1", "x", at(0)), ("2", "a|b", at(30)), ("3", "a|b", at(31))]), path) == 1
    assert {r.event_id for r in store.stored_events(spark, path).collect()} == {"1", "3"}
    assert [c.version for c in store.commits(spark, path)] == [1, 2] and not real(spark, path, store.Commit(2, "other"))


def test_compaction_and_sweep(spark, tmp_path):
    path = str(tmp_path)
    for k in range(3):
        assert store.append_events(frame(spark, [(str(k), "a|b", at(60 * k)), (None, None, at(k))]), path) == 2
    before = rows_of(store.stored_events(spark, path))
    batch = store.compact(spark, path)
    assert store.live_batches(store.commits(spark, path)) == [batch] and rows_of(store.stored_events(spark, path)) == before
    assert len(store.sweep(spark, path)) == 6 and rows_of(store.stored_events(spark, path)) == before
    assert store.append_events(frame(spark, [("1", "q", at(0)), (None, None, at(1)), ("9", "a|b", at(151))]), path) == 1
    assert store.compact(spark, path) and store.compact(spark, path) is None


def test_no_store_and_no_rows(spark, tmp_path):
    path = str(tmp_path / "none")
    assert store.stored_events(spark, path) is None and store.compact(spark, path) is None and store.sweep(spark, path) == []
    assert store.append_events(frame(spark, []), path) == 0 and store.stored_events(spark, path) is None


def scans(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line]


def test_only_the_days_around_a_batch_are_read(spark, tmp_path):
    path = str(tmp_path)
    store.append_events(frame(spark, [(str(d), f"p{d}", at(1440 * d)) for d in range(20)]), path)
    near = store.stored_events(spark, path, frame(spark, [("x", "p5", at(1440 * 5 + 10)), ("y", None, None)]))
    assert [r.event_id for r in near.collect()] == ["5"]
    (scan,) = scans(near)
    assert "GreaterThanOrEqual(start_ts,2026-07-01T11:40)" in scan and "event_day" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    read = near._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()
    assert read == 1


def test_bounds_come_from_the_batch(spark, tmp_path):
    e = spark.createDataFrame([(i, at(i)) for i in range(-100, 200)], "event_id long, ts timestamp_ntz")
    e.write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    batch = spark.createDataFrame([(1, at(10)), (2, at(40)), (3, None)], "cand_id long, start timestamp_ntz")
    near = readers.existing_for(batch, stored, "start", "ts")
    assert sorted(r.event_id for r in near.collect()) == [*range(-20, 71)]
    assert "GreaterThanOrEqual(ts,2026-06-26T11:40), LessThanOrEqual(ts,2026-06-26T13:10)" in scans(near)[0]
    assert readers.existing_for(batch.filter("start is null"), stored, "start", "ts").count() == 0
    assert readers.existing_for(batch.limit(0), stored, "start", "ts").count() == 0
    zoned = stored.withColumn("ts", F.col("ts").cast("timestamp"))
    assert readers.existing_for(batch, zoned, "start", "ts").count() == 91


def test_reconciling_reads_what_the_candidates_can_match(spark, tmp_path):
    frame(spark, [(str(i), "a|b" if i % 2 else "a|c", at(60 * i)) for i in range(50)]).drop("note").write.parquet(str(tmp_path / "e"))
    existing = spark.read.parquet(str(tmp_path / "e"))
    c = spark.createDataFrame([(1, "a|b", at(61), "CREATE", [], None), (2, "a|b", at(121), "CREATE", [], None)], "cand_id long, pair_key string, start_ts timestamp_ntz, decision string, reasons array<string>, reason string")
    out = vet_and_reconcile(c, existing, c.select("start_ts"))
    assert {r.cand_id: r.matched_event for r in out.collect()} == {1: "1", 2: None}
    assert all("LessThanOrEqual(start_ts,2026-06-26T14:31)" in s for s in scans(out))


# ------------------------------------------------------------- chains


def greedy(times, width):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] > width:
            kept.append(t)
    return kept


@pytest.mark.parametrize("spread", [40, 200, 5000])
def test_chains_equal_brute_force(spark, spread):
    r, width = random.Random(spread), 30 * 60_000_000
    own = {k: {r.randrange(spread * 60) * 1_000_000 + r.choice((0, 0, 1)) for _ in range(120)} | {0, width, width + 1} for k in "abc"}
    own["d"], own["e"] = {5}, {-width, 0, width, 2 * width + 1}
    df = spark.createDataFrame([(k, t) for k, ts in own.items() for t in ts], "k string, t long")
    assert sorted(tuple(x) for x in R.chain_picks(df).collect()) == [(k, t) for k in sorted(own) for t in greedy(own[k], width)]


def test_one_pair_of_many_events(spark):
    n, width = 200_000, 30 * 60_000_000
    df = spark.range(n).select(F.lit("a|b").alias("pair_key"), (F.col("id") * 7 + F.pmod(F.xxhash64("id"), F.lit(5))).alias("s")).withColumn("start_ts", F.timestamp_micros(F.col("s") * 1_000_000).cast("timestamp_ntz"))
    df = df.withColumn("event_id", F.concat(F.lit("e"), F.monotonically_increasing_id().cast("string")))
    times = [r.s * 1_000_000 for r in df.select("s").collect()]
    found = R.new_in_batch(df, "event_id", "start_ts", "pair_key")
    assert sorted(r.s * 1_000_000 for r in found.select("s").collect()) == greedy(times, width)
    plan = R.chain_links(df.select(F.col("pair_key").alias("k"), (F.col("s") * 1_000_000).alias("t")).distinct())._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ArrayAggregate" not in plan


def test_no_links_where_no_chain_goes_on(spark):
    minute, width = 60_000_000, 30 * 60_000_000
    lone = [("a", 100 * width * i + x) for i in range(50) for x in (0, minute)]  # every first point stays, what follows in its half hour goes
    links = lambda of: sorted(tuple(r) for r in R.chain_links(spark.createDataFrame(of, "k string, t long")).collect())
    assert links(lone) == []
    chain = [("b", x * minute) for x in (10, 20, 35, 41, 50, 75, 140)]  # 10 leads to 41, 41 to 75, and 140 is a head; 20 is out of reach
    assert links([*lone, *chain, *chain]) == [("b", 10 * minute, 41 * minute), ("b", 35 * minute, 75 * minute), ("b", 41 * minute, 75 * minute)]
    picks = R.chain_picks(spark.createDataFrame([*lone, *chain, *chain], "k string, t long"))
    assert sorted(tuple(r) for r in picks.collect()) == [("a", 100 * width * i) for i in range(50)] + [("b", x * minute) for x in (10, 41, 75, 140)]


def test_whole_rows_are_compared_where_an_id_repeats(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [("1", "a", at(0), "x"), ("2", "a", at(40), "y"), (None, "b", at(0), "z")]
    once = R.new_in_batch(frame(spark, rows))
    assert rows_of(once) == sorted(rows, key=repr) and "min_by" not in plan(once) and "to_json" not in plan(once)
    twice = R.new_in_batch(frame(spark, [*rows, ("1", "c", at(5), "w"), ("2", "a", at(40), "b"), (None, "b", at(0), "z")]))
    assert rows_of(twice) == sorted([rows[0], ("2", "a", at(40), "b"), rows[2]], key=repr) and "min_by" in plan(twice)


def test_of_numbered_events_at_one_instant_the_lowest_stays(spark, tmp_path):
    path = str(tmp_path)
    e = spark.createDataFrame([(10, 1, at(0)), (9, 1, at(0)), (100, 1, at(0)), (11, 1, at(29))], "event_id long, pair_key long, start_ts timestamp_ntz")
    assert store.append_events(e, path) == 1
    assert [r.event_id for r in store.stored_events(spark, path).collect()] == [9]


@pytest.mark.parametrize("widths", [1, 2, 4])
def test_close_pairs_of_any_bucket_width(spark, widths):
    r = random.Random(widths)
    left, right = ([(i, r.choice("ab"), at(r.randrange(-600, 600))) for i in range(n)] for n in (120, 90))
    c, e = (spark.createDataFrame(x, "i long, k string, t timestamp_ntz") for x in (left, right))
    found = R.close_pairs(c, e, "i", "i", "t", "t", "k", "k", widths=widths)
    want = sorted((i, j, abs((t - u) // dt.timedelta(microseconds=1))) for i, k, t in left for j, m, u in right if k == m and abs(t - u) <= dt.timedelta(minutes=30))
    assert sorted(tuple(x) for x in found.collect()) == want
