"""A store of events with a commit log, to which nothing is added twice.

``<path>/data/batch=<id>/event_day=<day>`` holds events, ``<path>/keys/batch=<id>/slot=<n>`` their keys, and ``<path>/log/<version>.json`` one entry
per commit.  A batch is staged under its own id and becomes visible, data and keys, by the one rename that puts its
entry into the log; what a killed run has staged is never read.  A version can be taken once, so of two writers one starts over
and sees what the other has added.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import event_key, fresh
from ..operators.reconcile import new_in_batch, new_only
from .readers import batch_bounds, existing_scan
from .shared import file_system, written

#: Key files are dealt out to so many folders, so that a small batch meets few of them.
SLOTS = 64
DAY, KEY, SLOT, BATCH = "event_day", "event_key", "slot", "batch"


@dataclass(frozen=True)
class Commit:
    version: int
    batch: str
    replaces: tuple[str, ...] = ()


def commits(spark: SparkSession, path: str) -> list[Commit]:
    """The log's entries in order; none if there is no store."""
    at, files = file_system(spark, f"{path}/log")
    if not files.exists(at):
        return []
    names = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().endswith(".json")]
    rows = [r.value for r in spark.read.text([str(n.toString()) for n in names], wholetext=True).collect()] if names else []
    found = [Commit(d["version"], d["batch"], tuple(d["replaces"])) for d in map(json.loads, rows)]
    return sorted(found, key=lambda c: c.version)


def live_batches(log: Iterable[Commit]) -> list[str]:
    """Batches that are committed and haven't been replaced."""
    log = [*log]
    gone = {b for c in log for b in c.replaces}
    return [c.batch for c in log if c.batch not in gone]


def publish(spark: SparkSession, path: str, commit: Commit) -> bool:
    """Put an entry into the log; false if its version is taken."""
    jvm = spark.sparkContext._jvm
    draft, files = file_system(spark, f"{path}/log/.{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(json.dumps({"version": commit.version, "batch": commit.batch, "replaces": [*commit.replaces]}).encode())
    out.close()
    entry, _ = file_system(spark, f"{path}/log/{commit.version:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(draft, entry, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))  # fails where the entry is there
    except Py4JJavaError as e:
        files.delete(draft, False)
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        return False
    return True


def _read(spark: SparkSession, path: str, kind: str, batches: list[str]) -> DataFrame | None:
    there = [f"{path}/{kind}/{BATCH}={b}" for b in batches]
    there = [p for p in there if (f := file_system(spark, p))[1].exists(f[0])]
    return spark.read.option("basePath", f"{path}/{kind}").option("mergeSchema", True).parquet(*there) if there else None


def stored_events(spark: SparkSession, path: str, around: DataFrame | None = None, start: str = "start_ts", minutes: int = 30) -> DataFrame | None:
    """Committed events, with event_key, event_day and batch; null if there are none.

    ``around``: only those that start at most ``minutes`` before the first or after the last start of these events.  Their days
    and starts are literals in the scan, so that other days' files aren't opened and other row groups are skipped.
    """
    stored = _read(spark, path, "data", live_batches(commits(spark, path)))
    if stored is None or around is None:
        return stored
    bounds = batch_bounds(around, start, stored.schema[start].dataType.simpleString())
    found = existing_scan(stored, start, *bounds, minutes=minutes)
    if bounds[0] is None:
        return found
    margin = F.expr(f"interval {minutes} minutes")
    return found.filter(F.col(DAY).between(F.to_date(bounds[0] - margin), F.to_date(bounds[1] + margin)))


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")


def _stage(events: DataFrame, path: str, batch: str, start: str) -> int:
    """Write a batch's events and keys, over what an earlier try has left."""
    data = f"{path}/data/{BATCH}={batch}"
    days = events.withColumn(DAY, F.to_date(F.col(start)))
    days.repartition(F.col(DAY), F.pmod(F.xxhash64(KEY), F.lit(8))).sortWithinPartitions(start).write.mode("overwrite").partitionBy(DAY).parquet(data)
    staged = events.sparkSession.read.schema(days.schema).parquet(data)
    staged.select(KEY, _slot(F.col(KEY)).alias(SLOT)).repartition(SLOT).write.mode("overwrite").partitionBy(SLOT).parquet(f"{path}/keys/{BATCH}={batch}")
    return staged.count()


def append_events(events: DataFrame, path: str, minutes: int = 30, event_id: str = "event_id", start: str = "start_ts", pair: str = "pair_key", batch: str | None = None, marks: Mapping[str, str] | None = None) -> int:
    """Add the events that the store doesn't have; returns how many.

    An event is there already if its key is: its id, or for events without id the hash of its content; or if a stored
    event of the same pair starts at most ``minutes`` from it.  Of the batch's own events those go that :func:`new_in_batch` drops.
    Running a batch again adds nothing, whether the first run ended or was killed at any point.  Only the days around the batch and the key
    folders that its keys fall into are read.

    The batch is written to the store's ``stage`` folder first, so that it is worked out once.  ``batch`` names it; a new name if none.  ``marks`` are
    columns with one value each that aren't content.
    """
    spark, batch = events.sparkSession, batch or uuid.uuid4().hex
    stage = f"{path}/stage/{batch}"
    (drop,) = fresh(events, "key")
    keyed = events.withColumn(KEY, event_key(events, event_id)).withColumns({c: F.lit(v) for c, v in (marks or {}).items()})
    columns = keyed.columns
    keyed.write.mode("overwrite").parquet(stage)
    keyed = spark.read.schema(keyed.schema).parquet(stage)
    slots = None
    while True:
        log = commits(spark, path)
        unknown = keyed.select(*dict.fromkeys((KEY, event_id, start, pair)))
        keys = _read(spark, path, "keys", live_batches(log))
        if keys is not None:
            slots = slots or [r[0] for r in keyed.select(_slot(F.col(KEY))).distinct().collect()]  # SLOTS numbers at most
            known = keys.filter(F.col(SLOT).isin(slots)).select(F.col(KEY).alias(drop))
            unknown = written(unknown.join(known, (F.xxhash64(KEY) == F.xxhash64(drop)) & (F.col(KEY) == F.col(drop)), "left_anti"), "unknown")
            if not unknown.limit(1).count():
                n = 0
                break
        near = stored_events(spark, path, unknown, start, minutes)
        if near is not None:
            unknown = new_only(unknown, near.select(F.col(KEY).alias(drop), F.col(start).alias("b"), F.col(pair).alias("k2")), KEY, drop, start, "b", pair, "k2", minutes, widths=4)
        added = new_in_batch(keyed, event_id, start, pair, minutes, own=KEY, among=unknown).select(*columns)
        n = _stage(added, path, batch, start)
        if not n or publish(spark, path, Commit(max((c.version for c in log), default=0) + 1, batch)):
            break
    at, files = file_system(spark, stage)
    files.delete(at, True)
    return n


def compact(spark: SparkSession, path: str, start: str = "start_ts") -> str | None:
    """Rewrite all committed batches as one, which replaces them in the log; its name, null if there is less than two.

    Readers that began before go on with the old files, which stay until :func:`sweep`.
    """
    while True:
        log = commits(spark, path)
        old = live_batches(log)
        if len(old) < 2:
            return None
        batch = uuid.uuid4().hex
        _stage(_read(spark, path, "data", old).drop(DAY, BATCH), path, batch, start)
        if publish(spark, path, Commit(log[-1].version + 1, batch, tuple(old))):
            return batch


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Delete the files of batches that aren't in use: replaced ones, and what killed runs have staged.  No writer may be at work."""
    kept, gone = {f"{BATCH}={b}" for b in live_batches(commits(spark, path))}, []
    for kind in ("data", "keys", "stage"):
        at, files = file_system(spark, f"{path}/{kind}")
        for s in files.listStatus(at) if files.exists(at) else ():
            if s.getPath().getName() not in kept:
                files.delete(s.getPath(), True)
                gone.append(f"{kind}/{s.getPath().getName()}")
    return sorted(gone)
