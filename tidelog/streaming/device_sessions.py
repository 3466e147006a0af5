"""Sessions per device on a stream, by the same rules as the batch operator (`sessions.smart_sessions`), with state per device.

Rows wait in the device's state until the watermark has passed them, so rows that come out of order within the delay are taken in order.
A session is emitted once, when it is closed: by the row that opens the next one, or when the watermark is more than the gap past its last row. A device that is
silent for ``keep_days`` of event time loses its state; its numbers then start again at 1. Rows later than the delay are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import SESSION_GAP_MINUTES, SMART_CONTEXT_CHANGES, SMART_GAP_MINUTES
from ..operators.sessions import CONTEXT

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEN = ("req_ts", "event_id", "session_id", *CONTEXT)
ROW = "req_ts long, event_id long, session_id string, " + ", ".join(f"{c} string" for c in CONTEXT)
PENDING = "rows string"  # up to CHUNK rows as one JSON text: the state store then moves one value for many rows
CHUNK = 5000
OPEN = f"{ROW}, number long, start_ts long, requests long, is_open boolean"
RESULT = "device_id string, session_no long, start_ts long, end_ts long, requests long"


def opens(row: tuple, last: tuple, gap: int) -> bool:
    """Whether the row starts a session after the device's last row; both are in the order of SEEN."""
    pause = row[0] - last[0]
    changed = sum((a if a is not None else "__x__") != (b if b is not None else "__x__") for a, b in zip(row[3:], last[3:], strict=True))
    other = (row[2] if row[2] is not None else "__x__") != (last[2] if last[2] is not None else "__x__")
    return pause > gap or other or (pause > SMART_GAP_MINUTES * 60 and changed >= SMART_CONTEXT_CHANGES)


class DeviceSessions(StatefulProcessor):
    def __init__(self, gap_minutes: int, keep_days: int):
        self.gap, self.keep = gap_minutes * 60, keep_days * 86_400

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.last = handle.getValueState("last", OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows, first = iter(rows), None
        while fresh := [r[-len(SEEN) :] for r in islice(rows, CHUNK)]:  # the last columns of the input are those of SEEN
            self.pending.appendValue((json.dumps(fresh),))
            low = min(r[0] for r in fresh)
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((r for text in self.pending.get() for r in json.loads(text[0])), key=lambda r: (r[0], r[1]))
        due = [r for r in waiting if r[0] * 1000 <= now]
        later = waiting[len(due) :]
        state = tuple(self.last.get()) if self.last.exists() else None
        out = []
        width = len(SEEN)
        for row in due:
            if state is not None and row[0] < state[0]:
                continue  # later than the delay
            last, rest = (state[:width], state[width:]) if state else (None, None)
            if last is None or opens(row, last, self.gap):
                if rest and rest[3]:
                    out.append(self.closed(key, last, rest))
                state = (*row, (rest[0] if rest else 0) + 1, row[0], 1, True)
            else:
                state = (*row, rest[0], rest[1], rest[2] + 1, True)
        if state is not None and state[-1] and (state[0] + self.gap) * 1000 < now:
            out.append(self.closed(key, state[:width], state[width:]))
            state = (*state[:-1], False)
        if due:
            if later:
                self.pending.put([(json.dumps(later[at : at + CHUNK]),) for at in range(0, len(later), CHUNK)])
            else:
                self.pending.clear()
        if state is not None and not state[-1] and not later and (state[0] + self.keep) * 1000 < now:
            self.last.clear()
        elif state is not None:
            self.last.update(state)
            self.handle.registerTimer((state[0] + (self.gap if state[-1] else self.keep)) * 1000 + 1)
        if later:
            self.handle.registerTimer(later[0][0] * 1000)
        return iter(out)

    def closed(self, key, last: tuple, rest: tuple) -> Row:
        return Row(device_id=key[0], session_no=rest[0], start_ts=rest[1], end_ts=last[0], requests=rest[2])

    def close(self) -> None:
        pass


def stream_session(spark: SparkSession) -> SparkSession:
    """A session with the state store that per-key state needs; it shares everything else with the given one."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    return own


def device_sessions(stream: DataFrame, delay: str = "2 hours", gap_minutes: int = SESSION_GAP_MINUTES, keep_days: int = 30) -> DataFrame:
    """Closed sessions of behaviour events with event_time: device_id, session_no, start_ts, end_ts, requests. ``stream`` must come from `stream_session`."""
    rows = stream.select("device_id", "event_time", "req_ts", F.col("event_id").cast("long").alias("event_id"), *[F.col(c).cast("string").alias(c) for c in ("session_id", *CONTEXT)])
    return rows.withWatermark("event_time", delay).groupBy("device_id").transformWithState(DeviceSessions(gap_minutes, keep_days), RESULT, "Append", "EventTime")
