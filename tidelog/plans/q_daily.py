"""Daily tables, matrices and trends (AGG-11..20, AGG-60..62, AGG-65, WIN-9, WIN-10)."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import channels, clock
from ..functions.querystring import qs_mentions, qs_value
from ..functions.text import label_blank
from ..model import typed
from ..operators import daily, filters, matrix
from ..session import run_folder
from ..sources import sinks
from ..sources.lake import read_lake
from .q_functions import CLASS_SQL
from .registry import STREAM_ID, TOKENS, day, logs, on_logs, query, table, written_lake, x, xt

_NOID = TOKENS.replace("|id|", "|")
REPORT = f"TRIM(regexp_replace(url_decode(COALESCE({x('channel')}, {x('channel_name')}, 'Unknown')), '_({_NOID})$', '', 'i'))"
DAYS = matrix.days_between("2024-01-01", "2024-01-05")

_D0 = f"""d0 AS (SELECT {day()} AS utc_date, {day(offset=19800)} AS ist_date, req_ts, NULLIF(TRIM(cliIP), '') AS ip, NULLIF(TRIM(UA), '') AS ua, NULLIF(TRIM(asn), '') AS asn_value,
 NULLIF(TRIM(reqPath), '') AS path, TRY_CAST(statusCode AS BIGINT) AS status, COALESCE({STREAM_ID}, NULLIF(regexp_extract(reqPath, '^([^/]+)/', 1), ''), NULLIF(reqPath, ''), '__unknown_stream__') AS stream,
 {', '.join(f"{xt(k)} AS {k}" for k in ('device_id', 'session_id', 'channel', 'category_name', 'content_title', 'platform'))},
 regexp_matches(COALESCE(queryStr, ''), '(^|[?&])device_id=') AS dk, regexp_matches(COALESCE(queryStr, ''), '(^|[?&])session_id=') AS sk, {CLASS_SQL} AS qs_class FROM t)"""
_DEV = """COUNT(device_id) AS device_rows, COUNT(*) - COUNT(device_id) AS device_missing, COUNT(*) FILTER (WHERE dk AND device_id IS NULL) AS device_blank,
 COUNT(*) FILTER (WHERE NOT dk) AS device_key_absent, COUNT(session_id) AS session_rows, COUNT(*) - COUNT(session_id) AS session_missing,
 COUNT(*) FILTER (WHERE sk AND session_id IS NULL) AS session_blank, COUNT(*) FILTER (WHERE NOT sk) AS session_key_absent"""


@query("agg_11_daily_ids_utc", on_logs(f"""SELECT utc_date, COUNT(*) AS rows, MIN(req_ts) AS min_ts, MAX(req_ts) AS max_ts, {_DEV}, COUNT(DISTINCT ip) AS distinct_ip, COUNT(DISTINCT ua) AS distinct_ua,
 COUNT(DISTINCT device_id) AS distinct_devices, COUNT(DISTINCT session_id) AS distinct_sessions, COUNT(DISTINCT asn_value) AS distinct_asn FROM d0 GROUP BY 1""", _D0))
def _(spark, d):
    return daily.daily_ids(logs(spark, d))


def _hms(e, off):
    return f"strftime(make_timestamp((({e}) + {off}) * 1000000), '%H:%M:%S')"


_QUALITY = f"""SELECT *, {', '.join(f"ROUND(100.0 * {c} / rows, 2) AS {n}" for c, n in daily.PERCENTS.items())},
 CASE WHEN available_from > '00:05:00' OR available_to < '23:55:00' THEN 'Partial data: ' || available_from || ' → ' || available_to ELSE 'Full/near-full day' END AS note FROM (
 SELECT ist_date, COUNT(*) AS rows, COUNT(ip) AS ip_rows, COUNT(ua) AS ua_rows, {_DEV}, COUNT(*) FILTER (WHERE device_id IS NOT NULL AND session_id IS NOT NULL) AS both_rows,
 COUNT(*) FILTER (WHERE qs_class = 'empty_queryStr') AS empty_qs_rows, COUNT(*) FILTER (WHERE qs_class = 'm_only') AS m_only_rows, COUNT(*) FILTER (WHERE qs_class = 'rich_metadata') AS rich_rows,
 COUNT(*) FILTER (WHERE qs_class = 'misc_queryStr') AS misc_rows, COUNT(channel) AS channel_rows, COUNT(category_name) AS category_rows, COUNT(content_title) AS title_rows, COUNT(platform) AS platform_rows,
 COUNT(*) FILTER (WHERE lower(path) LIKE '%.m3u8%') AS m3u8_rows, COUNT(*) FILTER (WHERE lower(path) LIKE '%.ts%') AS ts_rows,
 {', '.join(f"COUNT(DISTINCT {c}) AS {n}" for n, c in daily.QUALITY_DISTINCTS.items())},
 {_hms('MIN(req_ts)', 19800)} AS available_from, {_hms('MAX(req_ts)', 19800)} AS available_to FROM {{src}} GROUP BY 1)"""


@query("agg_12_daily_quality_ist", on_logs(_QUALITY.format(src="d0"), _D0))
def _(spark, d):
    return daily.daily_quality(logs(spark, d))


@query("agg_12_daily_quality_status_200", on_logs(_QUALITY.format(src="d0 WHERE status = 200"), _D0))
def _(spark, d):
    return daily.daily_quality(logs(spark, d), where=filters.only_status(200))


@query("agg_13_daily_quality_approx")
def _(spark, d):
    return daily.daily_quality(logs(spark, d), exact=False)


@query("agg_13_daily_quality_table", on_logs(_QUALITY.format(src="d0"), _D0))
def _(spark, d):
    f = run_folder(spark, "quality")
    report = daily.daily_quality(logs(spark, d))
    sinks.append_new_dates(report, f, "ist_date")
    return sinks.read_report(spark, f, "ist_date").select(*report.columns)


@query("agg_14_day_availability", on_logs(f"""SELECT *, CASE WHEN available_from > '00:05:00' OR available_to < '23:55:00' THEN 'Partial data: ' || available_from || ' → ' || available_to ELSE 'Full/near-full day' END AS note
 FROM (SELECT {day()} AS day, COUNT(*) AS rows, MIN(req_ts) AS first_ts, MAX(req_ts) AS last_ts, {_hms('MIN(req_ts)', 0)} AS available_from, {_hms('MAX(req_ts)', 0)} AS available_to FROM t GROUP BY 1)"""))
def _(spark, d):
    return daily.day_availability(logs(spark, d))


def lake(spark, d):
    """Rows of a written lake; its partition columns are text."""
    root = written_lake(spark, d)
    text = T.StructType([T.StructField(c, T.StringType()) for c in ("year", "month", "day")])
    return read_lake(spark, root, partitions=text)


@query("agg_15_lake_overview", on_logs(f"""SELECT {day()} AS utc_date, COUNT(*) AS total_rows, COUNT(cliIP) AS ip_rows, CAST(SUM(CAST(totalBytes AS BIGINT)) AS BIGINT) AS total_bytes,
 COUNT(*) FILTER (WHERE queryStr LIKE '%session_id=%' AND {x('session_id')} IS NOT NULL) AS sess_nonblank, COUNT(*) FILTER (WHERE queryStr LIKE '%session_id=%' AND {x('session_id')} IS NULL) AS sess_blank,
 COUNT(*) FILTER (WHERE queryStr IS NULL OR queryStr NOT LIKE '%session_id=%') AS sess_missing,
 COUNT(*) FILTER (WHERE queryStr LIKE '%device_id=%' AND {x('device_id')} IS NOT NULL) AS dev_nonblank, COUNT(*) FILTER (WHERE queryStr LIKE '%device_id=%' AND {x('device_id')} IS NULL) AS dev_blank,
 COUNT(*) FILTER (WHERE queryStr IS NULL OR queryStr NOT LIKE '%device_id=%') AS dev_missing, COUNT(DISTINCT cliIP) AS distinct_ip, COUNT(DISTINCT (cliIP, UA)) AS distinct_ipua,
 COUNT(DISTINCT {x('session_id')}) AS distinct_sess, COUNT(DISTINCT {x('device_id')}) AS distinct_dev FROM t GROUP BY 1"""))
def _(spark, d):
    return daily.lake_overview(lake(spark, d))


@query("inv_5_rows_per_day_partition", on_logs(f"SELECT strftime({day()}, '%Y') AS year, strftime({day()}, '%m') AS month, strftime({day()}, '%d') AS day, COUNT(*) AS rows FROM t GROUP BY 1, 2, 3"))
def _(spark, d):
    from ..sources.inventory import rows_per_partition

    return rows_per_partition(lake(spark, d))


@query("inv_6_partition_date_check", on_logs(f"""SELECT {day()} AS partition_date, COUNT(*) AS rows, CAST(0 AS BIGINT) AS utc_mismatch, COUNT(*) FILTER (WHERE {day()} <> {day(offset=19800)}) AS ist_mismatch FROM t GROUP BY 1"""))
def _(spark, d):
    from ..sources.inventory import partition_date_check

    return partition_date_check(lake(spark, d))


@query("src_6_latest_days", on_logs(f"SELECT DISTINCT strftime({day()}, '%Y') AS year, strftime({day()}, '%m') AS month, strftime({day()}, '%d') AS day FROM t ORDER BY 1 DESC, 2 DESC, 3 DESC LIMIT 2"))
def _(spark, d):
    from ..sources.lake import latest_days

    return latest_days(lake(spark, d), 2)


@query("agg_16_channel_platform", on_logs(f"""SELECT *, ROUND(100.0 * requests / SUM(requests) OVER (), 2) AS pct FROM (SELECT {REPORT} AS channel, COALESCE({x('platform')}, 'Unknown') AS platform, COUNT(*) AS requests,
 COUNT(DISTINCT {x('device_id')}) AS devices, COUNT(DISTINCT {x('session_id')}) AS sessions FROM logs WHERE queryStr LIKE '%channel=%' GROUP BY 1, 2)"""))
def _(spark, d):
    return matrix.channel_platform(logs(spark, d))


@query("agg_17_detailed_cube", on_logs(f"""SELECT *, ROUND(100.0 * requests / SUM(requests) OVER (PARTITION BY utc_date), 2) AS pct_of_day FROM (SELECT {day()} AS utc_date, state, UA AS ua, {REPORT} AS channel,
 COALESCE({x('platform')}, 'Unknown') AS platform, COALESCE({x('device')}, 'Unknown') AS device, COUNT(*) AS requests, COUNT(DISTINCT {x('device_id')}) AS unique_devices,
 COUNT(DISTINCT {x('session_id')}) AS unique_sessions FROM t WHERE queryStr LIKE '%channel=%' AND state <> '' GROUP BY 1, 2, 3, 4, 5, 6)"""))
def _(spark, d):
    return matrix.detailed_cube(logs(spark, d))


def _matrix_sql(value, src, date, n, days=DAYS):
    cols = ", ".join(f"CAST(COUNT(*) FILTER (WHERE dt = DATE '{c}') AS BIGINT) AS d_{c.replace('-', '_')}" for c in days)
    return f"SELECT value, COUNT(*) AS total, {cols} FROM (SELECT {value} AS value, {date} AS dt FROM {src}) GROUP BY 1 ORDER BY total DESC, value LIMIT {n}"


@query("agg_18_value_day_matrix", on_logs(_matrix_sql("COALESCE(NULLIF(TRIM(state), ''), '(blank/null)')", "t", day(), 5)))
def _(spark, d):
    return matrix.value_day_matrix(typed(logs(spark, d)), label_blank("state"), clock.day_date("req_ts"), DAYS, 5)


@query("agg_18_channel_day_matrix", on_logs(_matrix_sql(REPORT, "t WHERE queryStr LIKE '%channel=%'", day(), 50)))
def _(spark, d):
    df = typed(logs(spark, d)).where(qs_mentions("queryStr", "channel"))
    return matrix.value_day_matrix(df, channels.channel_report("queryStr"), clock.day_date("req_ts"), DAYS, 50)


@query("agg_18_rowwise_counts", on_logs(f"""SELECT value, day, COUNT(*) AS row_count FROM (SELECT city AS value, CAST({day()} AS VARCHAR) AS day FROM t)
 WHERE value IN (SELECT city FROM t GROUP BY 1 ORDER BY COUNT(*) DESC, city LIMIT 4) GROUP BY 1, 2"""))
def _(spark, d):
    return matrix.values_by_day(typed(logs(spark, d)), F.col("city"), clock.day_date("req_ts"), 4)


def _key_modes_sql(key, n, modes):
    joins, names = "", ""
    for i, (name, c) in enumerate(modes.items()):
        joins += f""" LEFT JOIN (SELECT k, v FROM (SELECT {key} AS k, {c} AS v, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY COUNT(*) DESC, {c}) AS rn FROM t
 WHERE {key} IS NOT NULL AND ({c}) IS NOT NULL GROUP BY 1, 2) WHERE rn = 1) j{i} ON j{i}.k = m.value"""
        names += f", j{i}.v AS {name}"
    return f"SELECT m.*{names} FROM ({_matrix_sql(key, f't WHERE {key} IS NOT NULL', day(), n)}) m{joins}"


@query("agg_19_ip_matrix", on_logs(_key_modes_sql("cliIP", 20, {"mode_state": "state", "mode_channel": f"CASE WHEN queryStr LIKE '%channel=%' THEN {REPORT} END"})))
def _(spark, d):
    modes = {"mode_state": F.col("state"), "mode_channel": F.when(qs_mentions("queryStr", "channel"), channels.channel_report("queryStr"))}
    return matrix.key_matrix_with_modes(logs(spark, d), F.col("cliIP"), DAYS, 20, modes)


@query("agg_20_device_matrix", on_logs(_key_modes_sql(x("device"), 20, {"mode_state": "NULLIF(TRIM(state), '')"})))
def _(spark, d):
    from ..functions.text import blank_to_null

    return matrix.key_matrix_with_modes(logs(spark, d), qs_value("queryStr", "device"), DAYS, 20, {"mode_state": blank_to_null("state")})


@query("win_9_top_channels_by_state", on_logs(f"""SELECT state, channel, requests, rank FROM (SELECT state, {REPORT} AS channel, COUNT(*) AS requests, ROW_NUMBER() OVER (PARTITION BY state ORDER BY COUNT(*) DESC, {REPORT}) AS rank
 FROM logs WHERE TRIM(state) <> '' AND queryStr LIKE '%channel=%' GROUP BY 1, 2) WHERE rank <= 200"""))
def _(spark, d):
    return matrix.top_channels_by_state(logs(spark, d), 200)


@query("win_10_billing_region_pairs", on_logs("""SELECT billingRegion, country, serverCountry, requests, rn FROM (SELECT billingRegion, country, serverCountry, COUNT(*) AS requests,
 ROW_NUMBER() OVER (PARTITION BY billingRegion ORDER BY COUNT(*) DESC, country, serverCountry) AS rn FROM logs GROUP BY 1, 2, 3) WHERE rn <= 50"""))
def _(spark, d):
    return matrix.billing_pairs(logs(spark, d), 50)


@query("agg_45_billing_region_country", on_logs("SELECT billingRegion, country, serverCountry, COUNT(*) AS requests FROM logs GROUP BY 1, 2, 3"))
def _(spark, d):
    return matrix.billing_counts(logs(spark, d))


_BUCKET = """SELECT c.bucket, COALESCE(n, 0) AS requests FROM (SELECT unnest(generate_series(a, b, {s})) AS bucket FROM (SELECT MIN(req_ts - req_ts % {s}) AS a, MAX(req_ts - req_ts % {s}) AS b FROM t)) c
 LEFT JOIN (SELECT req_ts - req_ts % {s} AS bucket, COUNT(*) AS n FROM t GROUP BY 1) p ON c.bucket = p.bucket"""


@query("agg_60_minute_counts", on_logs(_BUCKET.format(s=60)))
def _(spark, d):
    return matrix.calendar_counts(typed(logs(spark, d)), 60)


@query("agg_60_quarter_hour_counts", on_logs(_BUCKET.format(s=900)))
def _(spark, d):
    return matrix.calendar_counts(typed(logs(spark, d)), 900)


@query("agg_61_trend", on_logs(f"""SELECT {day()} AS date, COUNT(*) AS requests, COUNT(DISTINCT {x('device_id')}) AS devices, COUNT(DISTINCT {x('session_id')}) AS sessions FROM t
 WHERE {day()} >= (SELECT MAX({day()}) FROM t) - 90 GROUP BY 1"""))
def _(spark, d):
    return matrix.trend(logs(spark, d), 90)


@query("agg_61_top_channels", on_logs(f"SELECT {REPORT} AS value, COUNT(*) AS requests FROM t WHERE queryStr LIKE '%channel=%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def _(spark, d):
    rows = logs(spark, d).where(qs_mentions("queryStr", "channel"))
    return matrix.top_by(rows, channels.channel_report("queryStr"), 10)


@query("agg_61_top_states", on_logs("SELECT TRIM(state) AS value, COUNT(*) AS requests FROM t WHERE TRIM(state) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def _(spark, d):
    state = F.trim("state")
    return matrix.top_by(logs(spark, d).where(state != ""), state, 10)


@query("agg_61_top_devices", on_logs(f"SELECT {x('device')} AS value, COUNT(*) AS requests FROM t WHERE {x('device')} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def _(spark, d):
    c = qs_value("queryStr", "device")
    return matrix.top_by(logs(spark, d).where(c.isNotNull()), c, 10)


@query("agg_62_activity_by_ist_date", on_logs(f"SELECT {day(offset=19800)} AS date, COUNT(*) AS requests FROM t GROUP BY 1"))
def _(spark, d):
    return matrix.activity_by_date(typed(logs(spark, d)), 19800)


@query("agg_62_activity_by_ist_hour", on_logs("SELECT CAST(((req_ts + 19800) % 86400) // 3600 AS INTEGER) AS hour, COUNT(*) AS requests FROM t GROUP BY 1"))
def _(spark, d):
    return matrix.activity_by_hour(typed(logs(spark, d)), 19800)


@query("agg_65_activity_pattern", on_logs(f"SELECT {day()} AS date, CAST((req_ts % 86400) // 900 * 15 AS INTEGER) AS minute_of_day, COUNT(*) AS requests FROM t GROUP BY 1, 2"))
def _(spark, d):
    return matrix.activity_pattern(typed(logs(spark, d)), 15)


@query("agg_18_orders_priority_by_year", """SELECT value, COUNT(*) AS total, """ + ", ".join(
    f"CAST(COUNT(*) FILTER (WHERE y = {y}) AS BIGINT) AS d_{y}" for y in range(1992, 2000)) + " FROM (SELECT o_orderpriority AS value, EXTRACT(year FROM o_orderdate) AS y FROM orders) GROUP BY 1")
def _(spark, d):
    return matrix.value_day_matrix(table(spark, d, "orders"), F.col("o_orderpriority"), F.year("o_orderdate"), [str(y) for y in range(1992, 2000)], 10)
