"""Day health checks as rows of (check_name, status, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import inventory
from .ranking import one_row

CRITICAL_COLUMNS = ("reqTimeSec", "reqPath", "cliIP", "statusCode", "UA")


def health_checks(
    df: DataFrame, expected: list[str], types: dict[str, str] | None = None, critical: tuple[str, ...] = CRITICAL_COLUMNS,
    ts: str = "req_ts", few_rows: int = 1000,
) -> DataFrame:
    """OK / WARN / FAIL per check; all data checks come from one aggregate."""
    have = dict(df.dtypes)
    crit = [c for c in critical if c in have]
    one = one_row(
        df.agg(
            F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"),
            F.count_if(F.col("reqPath").contains(".ts")).alias("seg"), F.count_if(F.col("reqPath").contains(".m3u8")).alias("pl"),
            *[F.count_if(F.col(c).isNull()).alias(f"nul_{c}") for c in crit]),
        df.agg(F.count_distinct("cliIP").alias("ips")),
    )
    missing = sorted(set(expected) - set(have))
    extra = sorted(set(have) - set(expected))
    wrong = sorted(f"{c}: expected {t}, got {have[c]}" for c, t in (types or {}).items() if c in have and have[c] != t)
    worst = F.greatest(*[F.try_divide(F.col(f"nul_{c}") * 100.0, F.col("n")) for c in crit], F.lit(0.0))
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    checks = [
        ("row_count", F.when(F.col("n") == 0, "FAIL").when(F.col("n") < few_rows, "WARN").otherwise("OK"), say(text("n"), " rows")),
        ("schema_columns", F.lit("FAIL" if missing else "OK"), F.lit(f"missing: {missing}" if missing else f"{len(expected)} expected columns present")),
        ("extra_columns", F.lit("WARN" if extra else "OK"), F.lit(f"{len(extra)} extra columns")),
        ("column_types", F.lit("WARN" if wrong else "OK"), F.lit("; ".join(wrong) if wrong else "types as expected")),
        ("null_rates", F.when(worst > 10, "WARN").otherwise("OK"), say("worst null rate ", F.round(worst, 1).cast("string"), "%")),
        ("timestamp_range", F.when(F.col("lo").isNull(), "FAIL").otherwise("OK"), say(text("lo"), " to ", text("hi"))),
        ("request_types", F.lit("OK"), say("segments=", text("seg"), " playlists=", text("pl"), " other=", (F.col("n") - F.col("seg") - F.col("pl")).cast("string"))),
        ("unique_viewers", F.when(F.col("ips") == 0, "WARN").otherwise("OK"), say(text("ips"), " IPs")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), s.alias("status"), d.alias("detail")) for n, s, d in checks])
    return one.select(F.inline(rows))


def folder_checks(spark: SparkSession, path: str, first: str, last: str, small_bytes: int = 1024) -> DataFrame:
    """OK / WARN / FAIL on a lake by year, month and day before its rows are read: files, tiny files, folders that are no day, days that are missing or outside the range.

    One listing of the files, no content; the listing has one row per file. Spark's sources pass over files without a byte, so a day that holds nothing else is missing.
    """
    files = inventory.list_files(spark, path).select("path", "length")
    part = lambda k: F.regexp_extract("path", rf"/{k}=([^/]*)/", 1)
    day = F.try_to_date(F.concat_ws("-", part("year"), part("month"), part("day")), "yyyy-MM-dd")
    files = files.withColumn("day", day)
    one = files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_if(F.col("length") < small_bytes).alias("small"), F.count_if(F.col("day").isNull()).alias("odd"))
    wanted = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    days = files.where(F.col("day").isNotNull()).groupBy("day").agg(F.count(F.lit(1)).alias("n")).join(wanted.withColumn("w", F.lit(1)), "day", "full")
    per = days.agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("outside"),
        F.min(F.when(F.col("n").isNull(), F.col("day"))).alias("first_missing"))
    text = lambda c: F.col(c).cast("string")
    bad = lambda c, level: F.when(F.col(c) > 0, level).otherwise("OK")
    checks = [
        ("files", F.when(F.col("files") == 0, "FAIL").otherwise("OK"), F.concat(text("files"), F.lit(" files"))),
        ("small_files", bad("small", "WARN"), F.concat(text("small"), F.lit(f" files under {small_bytes} bytes"))),
        ("partition_folders", bad("odd", "FAIL"), F.concat(text("odd"), F.lit(" files outside a day folder"))),
        ("days_present", bad("missing", "FAIL"), F.concat(text("missing"), F.lit(" days missing"), F.coalesce(F.concat(F.lit(", first "), text("first_missing")), F.lit("")))),
        ("days_in_range", bad("outside", "WARN"), F.concat(text("outside"), F.lit(" days outside the range"))),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), s.alias("status"), d.alias("detail")) for n, s, d in checks])
    return one_row(one, per).select(F.inline(rows))
