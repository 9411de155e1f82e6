"""Which events of an unbounded stream are new, by state that is kept for each pair."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.columns import event_key, fresh

#: The session setting that transformWithState asks for, and its value.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FirstOfEach(StatefulProcessor):
    """A pair's events in the order of their starts: one passes if none that passed or is scheduled starts at most ``width`` microseconds from it.

    Events wait, by their start, until the watermark says that no earlier one can come; a timer stands at the end of each millisecond that has
    one.  State of a pair: what waits, the last start that passed, and the scheduled starts from ``width`` before the watermark on.
    """

    def __init__(self, schema: StructType, at: str, rank: str, width: int) -> None:
        self.schema, self.at, self.rank, self.width = schema, at, rank, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", self.schema)
        self.scheduled = handle.getMapState("scheduled", "at long", "there boolean")
        self.last = handle.getValueState("last", "at long")

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:  # noqa: N802, N803
        self.scheduled.updateValue((initialState["scheduled_at"],), (True,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        for row in rows:
            at = (row[self.at],)
            if not self.waiting.containsKey(at) or tuple(self.waiting.getValue(at))[self.schema.names.index(self.rank)] > row[self.rank]:
                self.waiting.updateValue(at, tuple(row[c] for c in self.schema.names))
            self.handle.registerTimer(at[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs() * 1000
        due = sorted(at for (at,) in self.waiting.keys() if at < end)
        scheduled = sorted(at for (at,) in self.scheduled.keys())
        last = self.last.get()[0] if self.last.exists() else None
        for at in due:
            row = tuple(self.waiting.getValue((at,)))
            self.waiting.removeKey((at,))
            if (last is None or at - last > self.width) and not any(abs(at - s) <= self.width for s in scheduled):
                last = at
                yield Row(*self.schema.names)(*row)
        if last is not None:
            self.last.update((last,))
        for s in scheduled:
            if s < end - 2 * self.width:
                self.scheduled.removeKey((s,))

    def close(self) -> None:
        pass


def first_events(stream: DataFrame, scheduled: DataFrame | None = None, late: str = "1 hour", minutes: int = 30, event_id: str = "event_id", start: str = "start_ts", pair: str = "pair_key") -> DataFrame:
    """The events of a stream that :func:`.reconcile.new_only` and :func:`.reconcile.new_in_batch` leave of all of them, however they are cut into micro-batches.

    A plain deduplication by time can't say that: which event passes depends on the one that passed before, in the order of starts, not of
    arrival.  So events wait until the stream's watermark, ``late`` behind the latest start, has gone past them, and pass in order.  Events that
    come later than that are dropped, as ever; what is newer than the watermark when a stream ends waits for its next run.

    ``scheduled``: pairs and starts that are there already, the state of the first run.  Rows that repeat an id are taken to be one event sent
    again.  Events without start, or with a null or blank pair, go by their key alone; so that the state of those ends, they are told apart within the
    watermark only, and a row without start for as long as the stream lives.  Append mode; the session needs :data:`PROVIDER`.
    """
    own, at, zone = fresh(stream, "key", "at", "moment")
    micros = F.unix_micros(F.col(start).cast("timestamp_ntz").cast("timestamp"))
    keyed = stream.withColumns({own: event_key(stream, event_id), at: micros, zone: F.col(start).cast("timestamp")})
    filled = F.coalesce((F.trim(F.col(pair).cast("string")) != "") & F.col(start).isNotNull(), F.lit(False))
    timed = keyed.filter(filled).withWatermark(zone, late)
    schema = timed.drop(zone).schema
    known = None if scheduled is None else scheduled.filter(F.col(start).isNotNull() & F.col(pair).isNotNull()).select(pair, micros.alias("scheduled_at")).groupBy(pair)
    processor = FirstOfEach(schema, at, own, minutes * 60_000_000)
    passed = timed.select(*schema.names, zone).groupBy(pair).transformWithState(processor, schema, "Append", "EventTime", initialState=known)
    rest = keyed.filter(~filled).dropDuplicates([own])
    return passed.select(*stream.columns).unionByName(rest.select(*stream.columns))
