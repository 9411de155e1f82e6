"""Sinks that a second run doesn't double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import append_events


def event_sink(events: DataFrame, path: str, run_date: str, minutes: int = 30) -> int:
    """Add events, marked with ``run_date``, to the store at ``path``; returns how many.

    What the store has is left out by :func:`.store.append_events`: the same id, the same content where there is no id, the same pair within ``minutes``.
    ``run_date`` is no part of an event's content.  Needs event_id, pair_key, start_ts; :func:`.store.stored_events` reads.
    """
    return append_events(events, path, minutes, marks={"run_date": run_date})


def log_sink(log: DataFrame, path: str, run_date: str) -> None:
    """Write the validation log of a run; running it again replaces that run's part."""
    log.withColumn("run_date", F.lit(run_date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)
