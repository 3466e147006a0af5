"""Hand-written edge tables for the column functions."""

import random
import re
import urllib.parse

from pyspark.sql import functions as F

from tidelog.functions import bands, channels, clock, devices, querystring as qs, text
from tidelog.model import epoch_seconds
from tidelog.operators import filters, watch


def values(spark, rows, schema, *cols):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def one(spark, rows, col, schema="c string"):
    return [r[0] for r in values(spark, rows, schema, col)]


QS = [None, "", "m=1", "?device_id=a", "device_id=&x=1", "device_id=a&device_id=b", "device_id=%zz", "device_id=a+b", "device_id=%2520", "xdevice_id=q", "device_id= a "]


def test_query_string_dialects(spark):
    assert one(spark, QS, qs.qs_value("c", "device_id")) == [None, None, None, None, None, "a", "%zz", "a+b", "%2520", None, " a "]
    assert one(spark, QS, qs.qs_trimmed("c", "device_id")) == [None, None, None, "a", None, "a", "%zz", "a+b", "%2520", None, "a"]
    strict = one(spark, QS, qs.qs_has_key("c", "device_id", False))
    assert strict == [False, False, False, False, True, True, True, True, True, False, True]
    assert one(spark, QS, qs.qs_has_key("c", "device_id"))[3] is True
    assert one(spark, QS, qs.qs_mentions("c", "device_id"))[9] is True
    present = one(spark, QS, qs.qs_present("c", "device_id"))
    assert present == [v is not None for v in one(spark, QS, qs.qs_value("c", "device_id"))]


def test_query_string_map_equals_parse_qsl(spark):
    rows = ["", "a=1&b=2", "a=1&a=2", "m", "a=&b", "x=%20y+z", "k%20=v", "&&a=1", "a=b=c", "t=%E0%A4%B9", "p=%zz%20"]
    got = one(spark, rows, qs.qs_map("c"))
    assert got == [dict(urllib.parse.parse_qsl(r, keep_blank_values=True)) for r in rows]


def test_device_aliases(spark):
    rows = ["DEVICE_ID=a&uid=b", "uid=b&did=c", "subscriber_id=s", "deviceid=z", "q=1", "device_id=&did=x"]
    assert one(spark, rows, qs.device_id_any_alias("c")) == ["a", "c", "s", "z", None, "x"]


def test_decode(spark):
    rows = ["a+b", "a%20b", "%zz", "%2520", None, "100%", "a%2Bb"]
    assert one(spark, rows, text.decode_form("c")) == ["a b", "a b", "%zz", "%20", None, "100%", "a+b"]
    assert one(spark, rows, text.decode_uri("c")) == ["a+b", "a b", "%zz", "%20", None, "100%", "a+b"]
    assert one(spark, ["a%20b", "a%2520b", "a+b"], text.unescape_spaces("c")) == ["a b", "a b", "a+b"]


def test_cleaning(spark):
    rows = [None, "", " ", "-", "^", " x "]
    assert one(spark, rows, text.clean_location("c")) == ["Unknown"] * 5 + ["x"]
    assert one(spark, rows, text.is_filled("c")) == [False] * 5 + [True]
    assert one(spark, rows, text.sentinel_to_null("c")) == [None, "", " ", None, None, " x "]
    assert one(spark, ["AS123", "123.0", "as 9", "-", None, "nan", "ASx"], bands.normalize_asn("c")) == ["123", "123", "9", "", "", "", ""]


TOKENS = set(channels.PLATFORM_TOKENS)


def pure_twin(raw, platform, device):
    """Independent row-wise statement of the channel rule, used as the test's oracle."""
    if raw is None or raw.strip().lower() in ("", "nan", "none", "null", "(null)"):
        return "unknown"

    def token(v):
        return re.sub("[^a-z0-9]+", "", (v or "").strip().lower())

    allowed = set(TOKENS)
    for t in (token(platform), token(device)):
        if t:
            allowed.add(t)
            if t.endswith("tv") and len(t) > 2:
                allowed.add(t[:-2])
    name = re.sub(r"\s+", " ", re.sub(r"\s*_\s*", "_", raw.strip())).strip()
    while "_" in name and token(name[name.rindex("_") + 1:]) in allowed:
        name = name[: name.rindex("_")].strip("_ ").strip()
    return (name or "unknown").lower()


def test_channel_pure(spark):
    fixed = [("IndiaTV", "", ""), ("indiatv_Android", "", ""), ("India TV _ firetv", "", ""), ("A_B_tv_android", "", ""), ("_tv", "", ""), ("tv", "", ""),
             (None, "", ""), ("(null)", "", ""), ("X_BRAVIA", "", "BRAVIA"), ("News_Roku TV", "Roku TV", ""), ("a__b_", "", ""), ("News_Fire-TV", None, None)]
    rng = random.Random(7)
    parts = ["News", "tv", "Android", "x y", "", " ", "BRAVIA 4K", "web", "id", "roku", "24x7", "Fire-TV", "lgtv", "cloud"]
    more = [("_".join(rng.choice(parts) for _ in range(rng.randint(1, 5))), rng.choice(["", None, "cloud tv", "web"]), rng.choice(["", "BRAVIA 4K", None])) for _ in range(600)]
    rows = fixed + more
    got = [r[0] for r in values(spark, rows, "r string, p string, d string", channels.channel_pure("r", "p", "d"))]
    assert got == [pure_twin(*r) for r in rows]


def test_other_channel_forms(spark):
    rows = ["Aaj_Android", "Aaj _ web", "Aaj_id", "Aaj  Tak"]
    assert one(spark, rows, channels.channel_folded("c")) == ["aaj", "aaj", "aaj", "aaj  tak"]
    assert one(spark, rows, channels.channel_suffix("c")) == ["Android", "web", "", ""]
    assert one(spark, rows, channels.channel_early("c")) == ["Aaj", "Aaj", "Aaj_id", "Aaj Tak"]
    assert one(spark, ["channel=Aaj_Android", "channel=Aaj_id", "x=1"], channels.channel_report("c")) == ["Aaj", "Aaj_id", "Unknown"]
    assert one(spark, ["vglive-sk-12/a.ts", "folder/a.ts", "plain", "", None], channels.stream_key("c")) == ["vglive-sk-12", "folder", "plain", "__unknown_stream__", "__unknown_stream__"]


def test_bands(spark):
    paths = ["a/720p/s1.ts", "main.m3u8", "main_3.m3u8", "480p/x.mp4", "x", None]
    assert one(spark, paths, bands.quality("c")) == ["segment", "master", "variant_3", "480p", "unknown", "unknown"]
    assert one(spark, ["200", "304", "404", "503", "x", None], bands.status_class("c")) == ["2xx", "3xx", "4xx", "5xx", "other", "other"]
    assert one(spark, ["999999", "1000000", "3000000", "8000000", None], bands.throughput_band("c")) == ["very_low", "low", "medium", "high", "high"]
    bins = one(spark, [1, 2, 5, 6, 100, 101], bands.count_bin("c", bands.SESSION_BINS, "100+"), "c int")
    assert bins == ["1", "2-5", "2-5", "6-10", "51-100", "100+"]


def test_devices(spark):
    uas = ["Mozilla (iPhone; CPU iPhone OS 17 like Mac OS X)", "x tv y", "televisions", "Android", "BRAVIA", None, "Macintosh"]
    assert one(spark, uas, devices.device_type("c", F.lit(""))) == ["iPhone", "Smart TV", "Other", "Android", "Smart TV", "Other", "Mac"]
    tags = ["Dalvik AFTMM", "Dalvik BRAVIA", "AppleCoreMedia Apple TV", "MyApp/1.2 ExoPlayer", "curl/8", "", "-", "hls2disk", None]
    assert one(spark, tags, devices.platform_tag("c")) == ["Amazon Fire TV", "Sony BRAVIA", "Apple TV", "App: MyApp", "Tool: curl", "Null/Invalid", "Null/Invalid", "Service: hls2disk", "Null/Invalid"]
    codes = spark.createDataFrame([(1, "AFTSS"), (2, "AFTZZ"), (3, "BRAVIA%204K%20GB"), (4, "MiTV-Q"), (5, "thing"), (6, None)], "i int, code string")
    got = {r.i: r.device_model for r in devices.with_device_name(codes, "code").collect()}
    assert got == {1: "Amazon Fire TV Stick (2nd Gen / Lite)", 2: "Amazon Fire TV device (code: AFTZZ)", 3: "Sony Bravia 4K GB series", 4: "Xiaomi Mi TV (MiTV-Q)", 5: "thing", 6: None}


def test_epoch_units_and_days(spark):
    same = ["1775031224", "1775031224.0", "1775031224000", "1775031224000000", "1775031224000000000", "junk", "-5"]
    got = one(spark, same, clock.epoch_any_unit("c"))
    assert got[:5] == [1775031224.0] * 5 and got[5:] == [None, -5.0]
    assert one(spark, ["177.9", "-0.5", "x", None], epoch_seconds("c")) == [177, -1, None, None]
    assert one(spark, [0, 86399, 66599, 66600, -1], clock.day_id("c", 19800), "c long") == [0, 1, 0, 1, 0]
    assert [str(v) for v in one(spark, [0, 1704067199], clock.zone_date("c", "America/New_York"), "c long")] == ["1969-12-31", "2023-12-31"]
    assert one(spark, [0, 3661, 86399], clock.hhmmss("c"), "c long") == ["00:00:00", "01:01:01", "23:59:59"]
    hours = [h * 3600 for h in (0, 4, 5, 11, 12, 16, 17, 21, 22)]
    assert one(spark, hours, clock.daypart("c"), "c long") == ["Night", "Night", "Morning", "Morning", "Afternoon", "Afternoon", "Evening", "Evening", "Night"]


def test_zone_date_range_is_an_epoch_range(spark):
    df = spark.range(1704000000, 1704400000, 977).withColumnRenamed("id", "req_ts")
    for zone in ("UTC", "IST", "-03:30", "Asia/Kolkata"):
        got = df.where(filters.date_between("2024-01-01", "2024-01-02", zone=zone)).count()
        day = clock.zone_date("req_ts", zone)
        assert got == df.where(day.between(F.lit("2024-01-01").cast("date"), F.lit("2024-01-02").cast("date"))).count() > 0


def test_timeline_key_all_subsets(spark):
    rows = [tuple(v if bits >> k & 1 else None for k, v in enumerate(("D", "S", "I", "U"))) for bits in range(16)]
    got = [r[0] for r in values(spark, rows, "d string, s string, i2 string, u string", watch.timeline_key(F.col("d"), F.col("s"), F.col("i2"), F.col("u"), F.lit("K")))]

    def want(d, s, i, u):
        if d:
            return f"id|device:{d}|sid:{s}|stream:K" if s else f"id|device:{d}|no_sid|stream:K"
        if s and i and u:
            return "id|sid:S|viewer:I|U|stream:K"
        if i and u:
            return "noid|I|U|stream:K"
        return f"noid|{i or u}|stream:K" if i or u else None

    assert got == [want(*r) for r in rows]
