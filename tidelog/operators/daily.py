"""Daily quality and volume tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.channels import stream_key
from ..functions.querystring import qs_has_key, qs_mentions, qs_trimmed, qs_value, querystring_class
from ..functions.text import blank_to_null
from ..model import COLS, IST_OFFSET_SECONDS, ColMap, typed
from .ranking import percent


def distincts_by(df: DataFrame, key: str, columns: dict[str, str], exact: bool = True) -> DataFrame:
    """Distinct counts of many columns per key.

    Exact: each row gives one (key, field, value) triple per field; triples are made distinct
    before the count, so a hot day or a hot value is spread over the cluster and the per-key
    step sees one row per field and task. Approximate: one mergeable sketch per column (about 1%).
    """
    if not exact:
        sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(14)))
        return df.groupBy(key).agg(*[sketch(c).alias(n) for n, c in columns.items()])
    triples = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("value")) for n, c in columns.items()])
    long = df.select(key, F.inline(triples)).where(F.col("value").isNotNull()).distinct()
    per = long.groupBy(key, "field").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("field") == n, F.col("n"))), F.lit(0)).alias(n) for n in columns])


def _merge(facts: DataFrame, distincts: DataFrame, key: str, names: list[str]) -> DataFrame:
    out = facts.join(distincts, key, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def daily_ids(logs: DataFrame, cols: ColMap = COLS, exact: bool = True) -> DataFrame:
    """UTC days: rows, ID presence (value, blank key, absent key) and distinct counts."""
    df = typed(logs, cols).select(
        clock.day_date("req_ts").alias("utc_date"), "req_ts",
        blank_to_null(cols.ip).alias("ip"), blank_to_null(cols.ua).alias("ua"), blank_to_null(cols.asn).alias("asn_value"),
        qs_trimmed(cols.qs, "device_id").alias("device_id"), qs_trimmed(cols.qs, "session_id").alias("session_id"),
        qs_has_key(cols.qs, "device_id").alias("dk"), qs_has_key(cols.qs, "session_id").alias("sk"),
    )
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows"), F.min("req_ts").alias("min_ts"), F.max("req_ts").alias("max_ts")]
    for name, c, k in (("device", F.col("device_id"), F.col("dk")), ("session", F.col("session_id"), F.col("sk"))):
        aggs += [
            F.count(c).alias(f"{name}_rows"), F.count_if(c.isNull()).alias(f"{name}_missing"),
            F.count_if(k & c.isNull()).alias(f"{name}_blank"), F.count_if(~k).alias(f"{name}_key_absent"),
        ]
    fields = {"distinct_ip": "ip", "distinct_ua": "ua", "distinct_devices": "device_id", "distinct_sessions": "session_id", "distinct_asn": "asn_value"}
    return _merge(df.groupBy("utc_date").agg(*aggs), distincts_by(df, "utc_date", fields, exact), "utc_date", list(fields))


def day_availability(logs: DataFrame, cols: ColMap = COLS, offset: int = 0) -> DataFrame:
    """Rows, first and last time of each day with a note on partial days."""
    df = typed(logs, cols).groupBy(clock.day_date("req_ts", offset).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("req_ts").alias("first_ts"), F.max("req_ts").alias("last_ts"))
    df = df.withColumns({
        "available_from": clock.hhmmss(clock.second_of_day("first_ts", offset)),
        "available_to": clock.hhmmss(clock.second_of_day("last_ts", offset)),
    })
    return df.withColumn("note", clock.partial_day_note("available_from", "available_to"))


QUALITY_DISTINCTS = {
    "distinct_ip": "ip", "distinct_ua": "ua", "distinct_devices": "device_id", "distinct_sessions": "session_id",
    "distinct_channels": "channel", "distinct_categories": "category_name", "distinct_titles": "content_title",
    "distinct_platforms": "platform", "distinct_streams": "stream", "distinct_paths": "path", "distinct_status": "status",
}
PERCENTS = {
    "device_rows": "pct_device", "session_rows": "pct_session", "empty_qs_rows": "pct_empty_qs", "m_only_rows": "pct_m_only",
    "rich_rows": "pct_rich", "misc_rows": "pct_misc", "channel_rows": "pct_channel", "category_rows": "pct_category",
    "title_rows": "pct_title", "platform_rows": "pct_platform", "m3u8_rows": "pct_m3u8", "ts_rows": "pct_ts",
}


def daily_quality(
    logs: DataFrame, cols: ColMap = COLS, exact: bool = True, where: Column | None = None, offset: int = IST_OFFSET_SECONDS
) -> DataFrame:
    """IST days: more than 30 row counters, distinct counts, percentages and a partial-day note."""
    df = typed(logs, cols)
    if where is not None:
        df = df.where(where)
    df = df.select(
        clock.day_date("req_ts", offset).alias("ist_date"), "req_ts",
        blank_to_null(cols.ip).alias("ip"), blank_to_null(cols.ua).alias("ua"), blank_to_null(cols.path).alias("path"),
        F.col(cols.status).cast("string").try_cast("long").alias("status"), stream_key(blank_to_null(cols.path)).alias("stream"),
        *[qs_trimmed(cols.qs, k).alias(k) for k in ("device_id", "session_id", "channel", "category_name", "content_title", "platform")],
        qs_has_key(cols.qs, "device_id").alias("dk"), qs_has_key(cols.qs, "session_id").alias("sk"),
        querystring_class(cols.qs).alias("qs_class"),
    )
    low = F.lower(F.coalesce("path", F.lit("")))
    cls = lambda v: F.count_if(F.col("qs_class") == v)
    dev, sid = F.col("device_id"), F.col("session_id")
    facts = df.groupBy("ist_date").agg(
        F.count(F.lit(1)).alias("rows"), F.min("req_ts").alias("min_ts"), F.max("req_ts").alias("max_ts"),
        F.count("ip").alias("ip_rows"), F.count("ua").alias("ua_rows"),
        F.count(dev).alias("device_rows"), F.count_if(dev.isNull()).alias("device_missing"),
        F.count_if(F.col("dk") & dev.isNull()).alias("device_blank"), F.count_if(~F.col("dk")).alias("device_key_absent"),
        F.count(sid).alias("session_rows"), F.count_if(sid.isNull()).alias("session_missing"),
        F.count_if(F.col("sk") & sid.isNull()).alias("session_blank"), F.count_if(~F.col("sk")).alias("session_key_absent"),
        F.count_if(dev.isNotNull() & sid.isNotNull()).alias("both_rows"),
        cls("empty_queryStr").alias("empty_qs_rows"), cls("m_only").alias("m_only_rows"),
        cls("rich_metadata").alias("rich_rows"), cls("misc_queryStr").alias("misc_rows"),
        F.count("channel").alias("channel_rows"), F.count("category_name").alias("category_rows"),
        F.count("content_title").alias("title_rows"), F.count("platform").alias("platform_rows"),
        F.count_if(low.contains(".m3u8")).alias("m3u8_rows"), F.count_if(low.contains(".ts")).alias("ts_rows"),
    )
    out = _merge(facts, distincts_by(df, "ist_date", QUALITY_DISTINCTS, exact), "ist_date", list(QUALITY_DISTINCTS))
    out = out.withColumns({
        "available_from": clock.hhmmss(clock.second_of_day("min_ts", offset)),
        "available_to": clock.hhmmss(clock.second_of_day("max_ts", offset)),
        **{name: percent(F.col(c), F.col("rows")) for c, name in PERCENTS.items()},
    })
    return out.drop("min_ts", "max_ts").withColumn("note", clock.partial_day_note("available_from", "available_to"))


def lake_overview(lake: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Per partition day (year, month, day): rows, ID counters (loose LIKE test), bytes and distincts."""
    df = lake.select(
        F.make_date(*[F.col(c).cast("int") for c in ("year", "month", "day")]).alias("utc_date"),
        F.col(cols.ip).alias("ip"), F.to_json(F.struct(F.col(cols.ip).alias("i"), F.col(cols.ua).alias("u"))).alias("ipua"),
        F.col("totalBytes").try_cast("long").alias("b"),
        qs_mentions(cols.qs, "session_id").alias("sk"), qs_mentions(cols.qs, "device_id").alias("dk"),
        qs_value(cols.qs, "session_id").alias("sid"), qs_value(cols.qs, "device_id").alias("dev"),
    )
    facts = df.groupBy("utc_date").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count("ip").alias("ip_rows"), F.sum("b").alias("total_bytes"),
        *[c for n, k, v in (("sess", F.col("sk"), F.col("sid")), ("dev", F.col("dk"), F.col("dev"))) for c in (
            F.count_if(k & v.isNotNull()).alias(f"{n}_nonblank"), F.count_if(k & v.isNull()).alias(f"{n}_blank"),
            F.count_if(~k).alias(f"{n}_missing"))],
    )
    fields = {"distinct_ip": "ip", "distinct_ipua": "ipua", "distinct_sess": "sid", "distinct_dev": "dev"}
    return _merge(facts, distincts_by(df, "utc_date", fields), "utc_date", list(fields))
