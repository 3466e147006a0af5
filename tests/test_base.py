"""The stored behaviour base: neighbours equal plain windows, no shuffle by its key, hot sessions in files of their own; agent patterns."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.operators import agents, audience, base

COLS = "event_id long, req_ts long, device_id string, session_id string, content_label string, channel_name string, day_part string"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(4000), "d0" if i % 2 else f"d{rng.randrange(1, 9)}", "s0" if i % 2 else f"s{rng.randrange(3)}", rng.choice("uvw"), rng.choice("ab"), "Night") for i in range(1200)]
    return spark.createDataFrame(rows, COLS)


def plain(events):
    w = Window.partitionBy("device_id", "session_id").orderBy("req_ts", "event_id")
    cols = [F.lead("req_ts").over(w).alias("next_req_ts")] + [f(e).over(w).alias(f"{n}_{e}") for e in base.ENTITIES for n, f in (("prev", F.lag), ("next", F.lead))]
    return events.select("*", *cols)


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(df.select(*cols).collect(), key=str)


def shuffles(df, key):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if all(k in x for k in key)]


def test_no_shuffle_by_the_bucket_key(spark, events):
    stored = base.read_base(spark, base.write_base(events, buckets=6))
    assert rows_of(stored) == rows_of(plain(events))
    paths = audience.session_paths(stored)
    assert not shuffles(paths, ["device_id", "session_id"])
    assert rows_of(paths) == rows_of(audience.session_paths(plain(events)))
    for part in audience.bundle(stored, 20, 1, 1).values():
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\((device_id#\d+, session_id#\d+|session_id#\d+, device_id#\d+),", plan) and "Window [lead" not in plan and "Window [lag" not in plan


def test_hot_session_has_files_of_its_own(spark, events):
    name = base.write_base(events, buckets=4, hot_rows=300, slice_seconds=500)
    assert spark.table(name).where("is_hot").count() == 600
    stored = base.read_base(spark, name)
    assert rows_of(stored) == rows_of(plain(events))
    hot = spark.table(name).where("is_hot").select(F.input_file_name().alias("f")).distinct().count()
    assert hot > 1
    assert rows_of(audience.session_paths(stored)) == rows_of(audience.session_paths(plain(events)))


def test_empty_base(spark, events):
    stored = base.read_base(spark, base.write_base(events.where("false")))
    assert stored.count() == 0 and audience.session_paths(stored).count() == 0


def test_agents(spark):
    texts = [
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.1 Safari/537.36 Edg/120.0.2",
        "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605 (KHTML, like Gecko) Version/17.2 Mobile Safari/604.1",
        "Dalvik/2.1.0 (Linux; U; Android 11; BRAVIA 4K VH2 Build/RTT2)", "ExoPlayerLib/2.18.1 (Linux;Android 9) AFTSSS", "Googlebot/2.1", "", None, None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "ua string")
    got = {r["ua"]: tuple(r)[1:] for r in agents.parsed(df, "ua").collect()}
    assert got == {
        texts[0]: ("PC", None, "Windows", "10.0", "Edge", "120.0.2", False), texts[1]: ("iPhone", None, "iOS", "17_2", "Safari", "17.2", False),
        texts[2]: ("Sony Bravia", "bravia 4k", "Android", "11", "Dalvik", "2.1.0", False), texts[3]: ("Amazon Fire TV", "aftsss", "Android", "9", "ExoPlayer", "2.18.1", False),
        texts[4]: ("Other", None, "Other", None, "Other", None, True), "": ("Other", None, "Other", None, "Other", None, False),
    }
    rows = agents.with_agent(df, "ua")
    assert rows.count() == 8 and rows.where("device = 'Missing'").count() == 2
    assert agents.shares(df, "ua").agg(F.sum("requests")).first()[0] == 8
