"""Hot-key slicing must equal the plain window; session rules at their limits."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.operators import audience, diagnostics, sessions, users, watch
from tidelog.operators.ordered import Ordered
from tidelog.operators.ranking import exact_percentiles


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns most rows; bursts, ties and long quiet times included."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 40)}"
        ts = rng.choice([rng.randint(0, 4000), rng.randint(50_000, 50_100), 777])
        rows.append((i, key, ts, rng.choice(["a", "b", None]), rng.choice(["c1", "c2"]), rng.randint(0, 1)))
    return spark.createDataFrame(rows, "event_id long, device_id string, req_ts long, session_id string, channel_name string, flag int").repartition(5)


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, a.select(*cols).collect()), key=key) == sorted(map(tuple, b.select(*cols).collect()), key=key)


@pytest.mark.parametrize("hot_rows,seconds", [(50, 60), (10, 7), (1, 1), (10_000, 60)])
def test_neighbours_last_known_running_sum(skewed, hot_rows, seconds):
    w = Window.partitionBy("device_id").orderBy("req_ts", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select(
        "*", F.lag("req_ts").over(w).alias("prev_req_ts"), F.lag("session_id").over(w).alias("prev_session_id"),
        F.lead("channel_name").over(w).alias("next_channel_name"),
        F.last("session_id", ignorenulls=True).over(before).alias("known"),
        F.sum("flag").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("total"))
    step = Ordered.by(skewed, ["device_id"], ["req_ts", "event_id"], hot_rows=hot_rows, slice_seconds=seconds)
    got = step.neighbours(lag=["req_ts", "session_id"], lead=["channel_name"]).last_known("session_id", "known").running_sum("flag", "total").rows()
    same(got, want)


def test_operators_agree_with_and_without_slices(skewed):
    cut = {"hot_rows": 20, "slice_seconds": 30}
    events = skewed.withColumn("platform", F.lit("p")).withColumn("content_label", F.col("channel_name"))
    same(sessions.smart_sessions(events, tie=["event_id"], **cut), sessions.smart_sessions(events, tie=["event_id"]))
    same(sessions.gap_sessions(events, ["device_id"], tie=["event_id"], **cut), sessions.gap_sessions(events, ["device_id"], tie=["event_id"]))
    same(watch.gap_watch(events, ["device_id"], tie=["event_id"], **cut), watch.gap_watch(events, ["device_id"], tie=["event_id"]))
    known = events.where("session_id is not null")
    same(audience.sequenced(known, "channel_name", **cut), audience.sequenced(known, "channel_name"))
    viewers = events.select(F.col("device_id").alias("viewer_id"), "session_id", "req_ts").distinct()
    same(sessions.viewer_timelines(viewers, **cut), sessions.viewer_timelines(viewers))
    same(diagnostics.gap_profile(events, ["device_id"], **cut), diagnostics.gap_profile(events, ["device_id"]))
    starts = sessions.smart_sessions(events, tie=["event_id"])
    same(users.content_switches(starts, **cut), users.content_switches(starts))


@pytest.mark.parametrize("hot_rows,seconds", [(50, 60), (1, 1), (10_000, 60)])
def test_one_step_for_all(skewed, hot_rows, seconds):
    w = Window.partitionBy("device_id").orderBy("req_ts", "event_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select(
        "*", F.lag("session_id").over(w).alias("prev_session_id"), F.lead("session_id").over(w).alias("next_session_id"), F.lead("flag").over(w).alias("next_flag"),
        F.last("session_id", ignorenulls=True).over(before).alias("known"), F.sum("flag").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("total"))
    step = Ordered.by(skewed, ["device_id"], ["req_ts", "event_id"], hot_rows=hot_rows, slice_seconds=seconds)
    same(step.step(lag=["session_id"], lead=["session_id", "flag"], known={"session_id": "known"}, running={"flag": "total"}).rows(), want)


def test_sessions_with_watch_equal_two_passes(skewed):
    events = skewed.withColumn("platform", F.lit("p"))
    for cut in ({}, {"hot_rows": 20, "slice_seconds": 30}):
        same(sessions.smart_sessions(events, tie=["event_id"], watch_cap=60, **cut), watch.gap_watch(sessions.smart_sessions(events, tie=["event_id"]), ["device_id"], tie=["event_id"]))


def test_hot_plans_stay_small(skewed):
    viewers = skewed.select(F.col("device_id").alias("viewer_id"), "session_id", "req_ts").distinct()
    df = sessions.viewer_timelines(viewers, hot_rows=20, slice_seconds=30)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # both steps with their carry rows; shuffles that are used again are listed once
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 14
    cold = sessions.viewer_timelines(viewers)
    cold.collect()
    plan = cold._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Scan ExistingRDD") <= 2 and "Union" not in plan


def test_hot_key_is_spread_over_window_partitions(skewed):
    step = Ordered.by(skewed, ["device_id"], ["req_ts", "event_id"], hot_rows=100, slice_seconds=60)
    per = step.df.groupBy("device_id", "_slice").count().groupBy("device_id").agg(F.count("*").alias("parts"), F.max("count").alias("largest"))
    got = {r.device_id: r for r in per.collect()}
    hot_total = skewed.where("device_id = 'hot'").count()
    assert got["hot"].parts > 50 and got["hot"].largest < hot_total / 2
    assert all(r.parts == 1 for k, r in got.items() if k != "hot")


def build(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, device_id string, req_ts long, session_id string, channel_name string, cliIP string, asn string, platform string")


def numbers(spark, rows):
    df = sessions.smart_sessions(build(spark, rows), tie=["event_id"])
    return [r.session_no for r in df.orderBy("event_id").collect()]


def test_smart_session_limits(spark):
    a = ("s", "c", "ip", "n", "p")
    two = ("s", "c2", "ip2", "n", "p")
    oneoff = ("s", "c2", "ip", "n", "p")
    assert numbers(spark, [("d", 0, *a), ("d", 1200, *a), ("d", 2401, *a)]) == [1, 1, 2]
    assert numbers(spark, [("d", 0, *a), ("d", 480, *two), ("d", 961, *a)]) == [1, 1, 2]
    assert numbers(spark, [("d", 0, *a), ("d", 481, *oneoff)]) == [1, 1]
    assert numbers(spark, [("d", 0, *a), ("d", 0, "t", *a[1:])]) == [1, 2]
    assert numbers(spark, [("d", 0, None, *a[1:]), ("d", 5, None, *a[1:]), ("d", 9, "s", *a[1:])]) == [1, 1, 2]


def test_viewer_split_only_on_new_known_session(spark):
    rows = [(i, s) for i, s in enumerate([None, None, "s1", None, "s1", None, "s2"])]
    df = spark.createDataFrame([("v", i * 10, s) for i, s in rows], "viewer_id string, req_ts long, session_id string")
    got = sessions.viewer_timelines(df).orderBy("req_ts").collect()
    assert [r.timeline_no for r in got] == [1, 1, 1, 1, 1, 1, 2]
    assert [r.watch_sec for r in got] == [10, 10, 10, 10, 10, None, None]


def test_exact_percentiles(spark):
    rng = random.Random(5)
    values = [rng.choice([0, 1, 5, rng.randint(0, 10**7)]) for _ in range(2001)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(6)
    points = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}
    got = exact_percentiles(df, "v", points).first()
    import numpy as np

    for name, q in points.items():
        assert abs(got[name] - float(np.quantile(values, q))) < 1e-6


def test_invariants(spark, skewed):
    rows = skewed.select("device_id", "req_ts").distinct()
    capped = watch.gap_watch(rows, ["device_id"], 60).agg(F.sum("watch_sec")).first()[0]
    span = rows.groupBy("device_id").agg((F.max("req_ts") - F.min("req_ts")).alias("w")).agg(F.sum("w")).first()[0]
    assert 0 < capped <= span


def test_percentiles_keep_fractions(spark):
    df = spark.createDataFrame([(0.4,), (0.6,), (0.9,), (None,), (float("nan"),)], "v double")
    assert exact_percentiles(df, "v", {"p50": 0.5, "p100": 1.0}).first().asDict() == {"p50": 0.6, "p100": 0.9}


def test_dimension_rows_are_taken_whole(spark):
    from tidelog.operators.dimensions import with_asn, with_geo

    rows = spark.createDataFrame([("AS1", "1.1.1.1")], "asn string, cliIP string")
    dim = spark.createDataFrame([("AS1", "b", "A"), ("as1", "a", "Z")], "asn string, org string, country string")
    assert [(r.org, r.country) for r in with_asn(rows, dim).collect()] == [("a", "Z")]
    geo = spark.createDataFrame([("1.1.1.1", "b", "A"), ("1.1.1.1", "a", None)], "cliIP string, country string, city string")
    assert [(r.country, r.city) for r in with_geo(rows, geo).collect()] == [("a", "")]


def test_shares_are_of_all_rows_and_an_empty_day_fails(spark):
    from tidelog.operators.health import health_checks
    from tidelog.operators.ranking import value_counts

    df = spark.createDataFrame([(v,) for v in "aaabbc"], "v string")
    assert [(r.value, r.pct) for r in value_counts(df, "v", 1).collect()] == [("a", 50.0)]
    empty = spark.createDataFrame([], "reqTimeSec string, reqPath string, cliIP string, statusCode string, UA string, req_ts long")
    got = {r.check_name: r.status for r in health_checks(empty, ["reqPath"]).collect()}
    assert got["row_count"] == got["timestamp_range"] == "FAIL"
