"""Stored bitmaps, sketches and histograms against plain counts over the raw rows."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.operators import bitmaps, diagnostics, histogram, sketches
from tidelog.plans import q_merge
from tidelog.session import run_folder

DAYS = [dt.date(2024, 1, 29) + dt.timedelta(days=i) for i in range(8)]


def summary_rows(seed, days=DAYS, n=600):
    rng = random.Random(seed)
    return [(rng.choice(days), rng.choice(["IN", "AE", None]), rng.choice(["a", "b"]), f"s{rng.randrange(90)}", rng.choice([f"d{rng.randrange(40)}", None]), rng.choice("xyz"), rng.randrange(1, 5)) for _ in range(n)]


SCHEMA = "event_date date, country string, channel_name string, session_id string, device_id string, city string, requests long"


def plain(rows, key):
    out = {}
    for r in rows:
        got = out.setdefault(key(r), [0, set(), set()])
        got[0] += r[6]
        got[1].add(r[3])
        if r[4] is not None:
            got[2].add(r[4])
    return {k: (v[0], len(v[1]), len(v[2])) for k, v in out.items()}


@pytest.fixture(scope="module")
def stored(spark):
    rows = summary_rows(1)
    folder = run_folder(spark, "distincts")
    df = spark.createDataFrame(rows, SCHEMA)
    for part in (F.col("event_date") < F.lit(DAYS[3]), F.col("event_date") >= F.lit(DAYS[3])):
        bitmaps.add_days(df.where(part), folder, ["country", "channel_name"])
    return rows, folder


def test_any_range_counts_each_value_once(spark, stored):
    rows, folder = stored
    fields = ["sessions", "devices"]
    month = lambda r: (r[0].replace(day=1), r[1])
    got = bitmaps.report(spark, folder, {"month": F.trunc("event_date", "month"), "country": F.col("country")}, fields).collect()
    assert {(r["month"], r["country"]): (r["requests"], r["sessions"], r["devices"]) for r in got} == plain(rows, month)
    two = F.col("event_date").between(F.lit(DAYS[2]), F.lit(DAYS[5]))
    got = bitmaps.report(spark, folder, {}, fields, two).first()
    assert tuple(got) == plain([r for r in rows if DAYS[2] <= r[0] <= DAYS[5]], lambda r: 0)[0]
    got = {r["event_date"]: (r["sessions"], r["devices"]) for r in bitmaps.trailing(spark, folder, 3, fields).collect()}
    for d in DAYS:
        assert got[d] == plain([r for r in rows if d - dt.timedelta(days=2) <= r[0] <= d], lambda r: 0)[0][1:]


def test_day_is_replaced_and_numbers_stay(spark):
    folder = run_folder(spark, "distincts")
    old, new = summary_rows(2), summary_rows(3, DAYS[:1], 80)
    bitmaps.add_days(spark.createDataFrame(old, SCHEMA), folder, ["country"])
    before = {(r["field"], r["value"]): r["n"] for r in spark.read.parquet(f"{folder}/values").collect()}
    bitmaps.add_days(spark.createDataFrame(new, SCHEMA), folder, ["country"])
    after = {(r["field"], r["value"]): r["n"] for r in spark.read.parquet(f"{folder}/values").collect()}
    assert before.items() <= after.items() and len(set(after.values())) == len(after)
    rows = [r for r in old if r[0] != DAYS[0]] + new
    assert tuple(bitmaps.report(spark, folder, {}, ["sessions", "devices"]).first()) == plain(rows, lambda r: 0)[0]


def test_range_reads_only_its_days(spark, stored):
    _, folder = stored
    df = bitmaps.report(spark, folder, {}, ["devices"], F.col("event_date") == F.lit(DAYS[0]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(event_date") == 2 and "values" not in re.findall(r"Location: .*", plan)


def test_sketches_merge(spark):
    rows = summary_rows(4, n=3000)
    df = spark.createDataFrame(rows, SCHEMA)
    folder = run_folder(spark, "sketches")
    sketches.daily_sketches(df, ["event_date"], {"sessions": "session_id", "devices": "device_id"}, {"requests": "requests"}).write.parquet(folder)
    kept = spark.read.parquet(folder)
    one = sketches.merged(kept, [])
    assert tuple(sketches.estimates(one, [], ["sessions", "devices"]).first()) == (3000, 90, 40)
    got = sketches.quantiles(one, [], "requests", {"p50": 0.5, "p100": 1.0}).first()
    assert got["p50"] in (2, 3) and got["p100"] == 4
    early, late = kept.where(F.col("event_date") < F.lit(DAYS[4])), kept.where(F.col("event_date") >= F.lit(DAYS[4]))
    ids = [{r[4] for r in rows if r[4] and (r[0] < DAYS[4]) == e} for e in (True, False)]
    got = sketches.overlap(early, late, "devices").first()
    assert tuple(got)[:5] == (len(ids[0]), len(ids[1]), len(ids[0] & ids[1]), len(ids[0] - ids[1]), len(ids[1] - ids[0]))
    empty = sketches.estimates(sketches.merged(kept.where("false"), []), [], ["devices"]).first()
    assert empty["devices"] == 0 and sketches.merged(kept.where("false"), ["event_date"]).count() == 0


def test_sketch_error_is_bounded(spark):
    df = spark.range(400_000).select((F.col("id") % 4).cast("int").alias("day"), F.col("id").cast("string").alias("v"), F.col("id").alias("x"))
    one = sketches.merged(sketches.daily_sketches(df, ["day"], {"v": "v"}, {"x": "x"}), [])
    assert abs(sketches.estimates(one, [], ["v"]).first()["v"] / 400_000 - 1) < 0.03
    assert abs(sketches.quantiles(one, [], "x", {"p": 0.9}).first()["p"] / 360_000 - 1) < 0.03


@pytest.mark.parametrize("width", [1, 7, 65_536])
def test_histogram_percentiles(spark, width):
    rng = np.random.default_rng(width)
    rows = [("a", int(v)) for v in rng.integers(-50, 400, 501)] + [("b", 3)] * 40 + [("b", 9)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    points = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r["g"]: r for r in histogram.profile(histogram.counted(df, "v", ["g"]), ["g"], points, {"total": ("sum", F.col("v") * F.col("n")), "top": ("max", F.col("v"))}, width=width).collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        v = [x for k, x in rows if k == g]
        assert [got[g][p] for p in points] == pytest.approx(np.quantile(v, list(points.values())).tolist()) and got[g]["total"] == sum(v) and got[g]["top"] == max(v) and got[g]["rows"] == len(v)
    whole = histogram.profile(histogram.counted(df.where("g = 'a'"), "v", []), [], points, width=width).first()
    assert [whole[p] for p in points] == [got["a"][p] for p in points]
    floats = spark.createDataFrame([(0.5,), (0.25,), (float("nan"),), (None,), (8.0,)], "v double")
    assert histogram.profile(histogram.counted(floats, "v", []), [], {"m": 0.5}, width=width).first()["m"] == 0.5


def test_two_grains_take_one_scan(spark):
    df = spark.range(200).select((F.col("id") * 7 % 90).alias("req_ts"), F.concat(F.lit("d"), F.col("id") % 3).alias("device_id"), F.concat(F.lit("s"), F.col("id") % 5).alias("session_id"))
    made = []
    write = histogram.staged
    histogram.staged = lambda f, name: (made.append(f), write(f, name))[1]
    try:
        out = diagnostics.device_vs_session(df)
    finally:
        histogram.staged = write
    made[0].collect()
    plan = made[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    final = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") <= 2  # the rows, and the count of hot keys that adaptive execution reuses
    assert len(re.findall(r"\bExchange hashpartitioning", final)) <= 8 and "SinglePartition" not in final and "Window" not in final
    single = diagnostics.gap_profile(df, ["device_id", "session_id"]).first()
    both = {r["grain"]: r for r in out.collect()}
    assert all(both["device+session"][c] == single[c] for c in single.asDict())


def test_stored_days_derive_the_summary_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(n):
        seen.add(1)
        return n

    rows = [(dt.date(2023, 12, 31 - i % 2) + dt.timedelta(days=i % 4), "IN", "r", "a", "Other", f"s{i % 7}", f"d{i % 5}", "c", 1) for i in range(40)]
    names = "event_date date, country string, region string, channel_name string, device_type string, session_id string, device_id string, city string, requests long"
    df = spark.createDataFrame(rows, names).withColumn("requests", counted.asNondeterministic()("requests"))
    monkeypatch.setattr(q_merge, "_summary", lambda spark, d: df)
    folder = q_merge._days(spark, None)
    assert seen.value == 40
    assert tuple(bitmaps.report(spark, folder, {}, ["sessions", "devices"]).first()) == (40, 7, 5)
