"""Stateful sessions of a stream against the batch operator."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidelog.operators import sessions
from tidelog.streaming import device_sessions, jobs

COLS = "event_id long, req_ts long, device_id string, session_id string, channel_name string, cliIP string, asn string, platform string"


def events(seed, n=240):
    rng, t, out = random.Random(seed), 10_000, []
    for i in range(n):
        t += rng.choice([0, 5, 60, 300, 700, 1500])
        out.append((i, t, rng.choice(["d1", "d2", "d3"]), rng.choice(["s1", "s1", "s1", None, "s2"]), rng.choice("ab"), rng.choice(["i1", "i2"]), rng.choice(["1", None]), "p"))
    return out


def batch_sessions(spark, rows, until):
    """Sessions of the rows up to the watermark that it has closed."""
    df = sessions.smart_sessions(spark.createDataFrame([r for r in rows if r[1] <= until], COLS), tie=["event_id"])
    per = df.groupBy("device_id", "session_no").agg(F.min("req_ts").alias("a"), F.max("req_ts").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    last = {}
    for r in per:
        last[r.device_id] = max(last.get(r.device_id, 0), r.session_no)
    return sorted(tuple(r) for r in per if r.session_no < last[r.device_id] or r.b + 1200 < until)


def stream_rows(spark, own, folder, out):
    stream = jobs.with_event_time(own.readStream.schema(own.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("reqTimeSec", F.col("req_ts").cast("string")).drop("req_ts"))
    jobs.run_to_end(jobs.to_table(device_sessions.device_sessions(stream, "6 hours"), f"{out}/rows", f"{out}/state"))
    return sorted(tuple(r) for r in spark.read.parquet(f"{out}/rows").select("device_id", "session_no", "start_ts", "end_ts", "requests").collect())


@pytest.mark.parametrize("mixed", [False, True])
def test_closed_sessions_equal_the_batch(spark, tmp_path, mixed):
    rows, own = events(4), device_sessions.stream_session(spark)
    parts = [rows[i : i + 80] for i in range(0, 240, 80)]
    if mixed:  # out of order within the delay, and across files
        parts = [rows[:80], rows[80:160], rows[160:]]
        parts[0], parts[1] = parts[0][:75] + parts[1][:5], parts[0][75:] + parts[1][5:]
        random.Random(1).shuffle(parts[0])
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for part in parts:  # one run per file, from the checkpoint
        spark.createDataFrame(part, COLS).coalesce(1).write.mode("append").parquet(folder)
        seen += part
        until = max(r[1] for r in seen) - 6 * 3600
        assert stream_rows(spark, own, folder, out) == batch_sessions(spark, seen if not mixed else rows, until)


def test_rule():
    last = (1000, 1, "s", "a", "i", "x", "p")
    assert not device_sessions.opens((2200, 2, "s", "b", "j", "x", "p")[:2] + last[2:], last, 1200)
    assert device_sessions.opens((2201, 2) + last[2:], last, 1200)
    assert device_sessions.opens((1001, 2, None) + last[3:], last, 1200)
    assert device_sessions.opens((1481, 2, "s", "b", "j", "x", "p"), last, 1200) and not device_sessions.opens((1480, 2, "s", "b", "j", "x", "p"), last, 1200)
    assert not device_sessions.opens((1481, 2, "s", "b", "i", "x", "p"), last, 1200)


class Values:
    """A list state that counts what is written to it."""

    def __init__(self):
        self.held, self.written = [], 0

    def appendValue(self, value):
        self.appendList([value])

    def appendList(self, values):
        self.held += values
        self.written += len(values)

    def put(self, values):
        self.clear()
        self.appendList(values)

    def get(self):
        return iter(self.held)

    def clear(self):
        self.held = []


class One(Values):
    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[0]

    def update(self, value):
        self.held = [value]


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now * 1000

    def registerTimer(self, at):
        pass


def test_waiting_rows_share_state_values():
    names = ("device_id", "event_time", *device_sessions.SEEN)
    row = Row(*names)
    rows = [row("d", None, 1000 + 10 * i, i, "s", "b", None, "x", "p") for i in range(12_000)]
    op = device_sessions.DeviceSessions(20, 30)
    op.pending, op.last, op.handle = Values(), One(), Clock(0)
    assert list(op.handleInputRows(("d",), iter(rows), None)) == []
    assert op.pending.written <= 3  # one value held one row before
    half = 1000 + 10 * 6000
    assert list(op.handleExpiredTimer(("d",), Clock(half), None)) == [] and op.pending.written <= 6
    done = list(op.handleExpiredTimer(("d",), Clock(10_000_000), None))
    assert [tuple(r) for r in done] == [("d", 1, 1000, 1000 + 10 * 11_999, 12_000)]
    assert not op.pending.held
