"""Vetting a stream of candidates: the batch functions over each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import event_sink


def deliver(stream: DataFrame, to_events: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, run_date: str, once: bool = True) -> StreamingQuery:
    """Vet each micro-batch with ``to_events`` and append what is new to ``path``.

    ``to_events`` gives event_id, pair_key, start_ts and more.  The sink compares with
    what is stored, so a batch that runs again after a failure adds nothing.
    """

    def write(batch: DataFrame, _: int) -> None:
        event_sink(to_events(batch), path, run_date)

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
