"""Identity without IDs and device maps (AGG-31..38, AGG-29, AGG-30, AGG-59)."""



from pyspark.sql import functions as F

from ..operators import dimensions, identity, summary
from .q_functions import EST_SQL
from .q_sets import GEO_SQL, geo
from .registry import CHANNEL_RAW, DEVICE_TYPE_SQL, TOKENS, TV_WIDE, day, logs, on_logs, query, x

_I = f"""i AS (SELECT cliIP, req_ts, reqPath, NULLIF(TRIM({x('device_id')}), '') AS device_id, NULLIF(TRIM({x('session_id')}), '') AS session_id,
 regexp_matches(COALESCE(queryStr, ''), '(^|&)device_id=') AS dk, regexp_matches(COALESCE(queryStr, ''), '(^|&)session_id=') AS sk,
 {x('platform')} AS platform, country, state, city FROM t WHERE cliIP IS NOT NULL AND TRIM(cliIP) <> '')"""
_IPS = """ips AS (SELECT cliIP, COUNT(*) AS rows, COUNT(device_id) AS rows_with_device_id, COUNT(session_id) AS rows_with_session_id, COUNT(DISTINCT device_id) AS distinct_device_id,
 COUNT(DISTINCT session_id) AS distinct_session_id, MIN(req_ts) AS first_req_ts, MAX(req_ts) AS last_req_ts FROM i GROUP BY 1)"""


def _rows(spark, d):
    return identity.id_events(logs(spark, d))


@query("agg_36_id_audit", on_logs("""SELECT (SELECT COUNT(*) FROM t) AS total_rows, o.*, m.*, ROUND(100.0 * cliip_missing_both / distinct_cliip, 2) AS pct_cliip_missing_both,
 ROUND(100.0 * rows_on_missing_both / rows_with_cliip, 2) AS pct_rows_missing_both, ROUND(100.0 * rows_with_device_id / rows_with_cliip, 2) AS pct_device_filled,
 ROUND(100.0 * rows_with_session_id / rows_with_cliip, 2) AS pct_session_filled, ROUND(100.0 * rows_with_both / rows_with_cliip, 2) AS pct_both_filled FROM (
 SELECT COUNT(*) AS rows_with_cliip, COUNT(device_id) AS rows_with_device_id, COUNT(*) - COUNT(device_id) AS rows_without_device_id, COUNT(session_id) AS rows_with_session_id,
 COUNT(*) - COUNT(session_id) AS rows_without_session_id, COUNT(*) FILTER (WHERE device_id IS NOT NULL AND session_id IS NOT NULL) AS rows_with_both,
 COUNT(*) FILTER (WHERE dk AND device_id IS NULL) AS device_key_blank, COUNT(*) FILTER (WHERE sk AND session_id IS NULL) AS session_key_blank,
 COUNT(*) FILTER (WHERE NOT dk) AS device_key_absent, COUNT(*) FILTER (WHERE NOT sk) AS session_key_absent, COUNT(DISTINCT device_id) AS distinct_device_id,
 COUNT(DISTINCT session_id) AS distinct_session_id FROM i) o, (
 SELECT COUNT(*) AS distinct_cliip, COUNT(*) FILTER (WHERE rows_with_device_id = 0 AND rows_with_session_id = 0) AS cliip_missing_both,
 CAST(COALESCE(SUM(rows) FILTER (WHERE rows_with_device_id = 0 AND rows_with_session_id = 0), 0) AS BIGINT) AS rows_on_missing_both,
 COUNT(*) FILTER (WHERE rows_with_device_id > 0 OR rows_with_session_id > 0) AS cliip_with_id,
 CAST(COALESCE(SUM(rows) FILTER (WHERE rows_with_device_id > 0 OR rows_with_session_id > 0), 0) AS BIGINT) AS rows_on_cliip_with_id FROM ips) m""", _I, _IPS))
def _(spark, d):
    return identity.id_audit(logs(spark, d))


@query("agg_36_ip_summary", on_logs("SELECT * FROM ips", _I, _IPS))
def _(spark, d):
    return identity.ip_summary(_rows(spark, d))


@query("agg_36_device_rows_with_ip", on_logs("SELECT device_id, COUNT(*) AS rows, COUNT(DISTINCT cliIP) AS distinct_cliip FROM i WHERE device_id IS NOT NULL GROUP BY 1", _I))
def _(spark, d):
    return identity.device_rows_with_ip(logs(spark, d))


@query("agg_37_missing_ip_list", on_logs("SELECT * FROM ips WHERE rows_with_device_id = 0 AND rows_with_session_id = 0", _I, _IPS))
def _(spark, d):
    return identity.missing_ip_list(_rows(spark, d))


@query("agg_37_missing_ip_bins", on_logs("""SELECT CASE WHEN rows <= 1 THEN '1' WHEN rows <= 5 THEN '2-5' WHEN rows <= 20 THEN '6-20' WHEN rows <= 100 THEN '21-100' WHEN rows <= 1000 THEN '101-1K'
 WHEN rows <= 10000 THEN '1K-10K' ELSE '10K+' END AS rows_per_ip, COUNT(*) AS ip_count FROM ips WHERE rows_with_device_id = 0 AND rows_with_session_id = 0 GROUP BY 1""", _I, _IPS))
def _(spark, d):
    return identity.missing_ip_bins(_rows(spark, d))


def _map_sql(key, other, cnt, top, wt, pct):
    return f"""SELECT a.{key}, rows, {cnt}, first_seen, last_seen, {top}, {wt}, ROUND(100.0 * {wt} / rows, 2) AS {pct} FROM (SELECT {key}, COUNT(*) AS rows, COUNT(DISTINCT {other}) AS {cnt},
 MIN(req_ts) AS first_seen, MAX(req_ts) AS last_seen FROM i WHERE device_id IS NOT NULL GROUP BY 1) a LEFT JOIN (SELECT {key}, {other} AS {top}, n AS {wt} FROM (SELECT {key}, {other}, COUNT(*) AS n,
 ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY COUNT(*) DESC, {other}) AS rn FROM i WHERE device_id IS NOT NULL GROUP BY 1, 2) WHERE rn = 1) b ON a.{key} = b.{key}"""


@query("agg_38_ip_to_device", on_logs(_map_sql("cliIP", "device_id", "distinct_devices", "top_device_id", "device_rows", "top_device_row_pct"), _I))
def _(spark, d):
    return identity.ip_to_device(_rows(spark, d))


@query("agg_38_device_to_ip", on_logs(_map_sql("device_id", "cliIP", "distinct_ips", "top_cliip", "ip_rows", "top_ip_row_pct"), _I))
def _(spark, d):
    return identity.device_to_ip(_rows(spark, d))


@query("agg_38_device_count_bands", on_logs("""SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '20+' END AS devices, COUNT(*) AS ips FROM (
 SELECT cliIP, COUNT(DISTINCT device_id) AS n FROM i WHERE device_id IS NOT NULL GROUP BY 1) GROUP BY 1""", _I))
def _(spark, d):
    return identity.device_count_bands(_rows(spark, d))


_P = """p0 AS (SELECT cliIP, device_id, platform, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY cliIP, device_id ORDER BY COUNT(*) DESC, platform) AS rn FROM i
 WHERE device_id IS NOT NULL AND platform IS NOT NULL GROUP BY 1, 2, 3),
 pairs AS (SELECT a.*, COALESCE(p0.platform, '') AS platform FROM (SELECT cliIP, device_id, COUNT(*) AS requests, COUNT(DISTINCT session_id) AS sessions,
 COUNT(DISTINCT reqPath) AS unique_paths FROM i WHERE device_id IS NOT NULL GROUP BY 1, 2) a LEFT JOIN p0 ON a.cliIP = p0.cliIP AND a.device_id = p0.device_id AND p0.rn = 1)"""


@query("agg_31_ip_device_pairs", on_logs("SELECT * FROM pairs", _I, _P))
def _(spark, d):
    return identity.ip_device_pairs(_rows(spark, d))


@query("agg_31_top_paths_per_device", on_logs("""SELECT device_id, reqPath, requests, sessions, rn FROM (SELECT device_id, reqPath, COUNT(*) AS requests, COUNT(DISTINCT session_id) AS sessions,
 ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY COUNT(*) DESC, reqPath) AS rn FROM i WHERE device_id IS NOT NULL AND reqPath IS NOT NULL GROUP BY 1, 2) WHERE rn <= 5""", _I))
def _(spark, d):
    return identity.top_paths_per_device(_rows(spark, d), 5)


_GP = "gp AS (SELECT pairs.*, COALESCE(g.country, '') AS country, COALESCE(g.region, '') AS region, COALESCE(g.isp, '') AS isp FROM pairs LEFT JOIN geo g ON pairs.cliIP = g.cliIP)"


def _geo_pairs(spark, d):
    return dimensions.with_geo(identity.ip_device_pairs(_rows(spark, d)), geo(spark, d))


@query("agg_31_region_devices", on_logs("""SELECT country, region, COUNT(DISTINCT device_id) AS unique_devices, CAST(SUM(requests) AS BIGINT) AS total_requests, COUNT(DISTINCT cliIP) AS unique_ips FROM gp GROUP BY 1, 2""", _I, _P, GEO_SQL, _GP))
def _(spark, d):
    return identity.region_devices(_geo_pairs(spark, d), ["country", "region"])


@query("agg_31_region_isps", on_logs("""SELECT country, region, isp, COUNT(DISTINCT device_id) AS unique_devices, CAST(SUM(requests) AS BIGINT) AS total_requests, COUNT(DISTINCT cliIP) AS unique_ips
 FROM gp WHERE isp <> '' GROUP BY 1, 2, 3""", _I, _P, GEO_SQL, _GP))
def _(spark, d):
    return identity.region_devices(_geo_pairs(spark, d), ["country", "region", "isp"])


@query("agg_31_ip_device_paths", on_logs("""SELECT cliIP, device_id, reqPath, COUNT(*) AS requests, COUNT(DISTINCT session_id) AS sessions FROM i WHERE device_id IS NOT NULL GROUP BY 1, 2, 3""", _I))
def _(spark, d):
    return identity.ip_device_paths(_rows(spark, d))


@query("agg_32_multi_device_ips", on_logs("""SELECT cliIP, COUNT(DISTINCT device_id) AS n_devices, COUNT(*) AS total_requests, array_to_string(list_slice(list_sort(list(DISTINCT device_id)), 1, 10), ', ') AS device_list
 FROM i WHERE device_id IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT device_id) > 1""", _I))
def _(spark, d):
    return identity.multi_device_ips(_rows(spark, d), 10)


@query("agg_33_platforms_by_country", on_logs("""SELECT * FROM pc WHERE country IN (SELECT country FROM pc GROUP BY 1 ORDER BY SUM(unique_devices) DESC, country LIMIT 10)""", _I, _P, GEO_SQL, _GP,
    "pc AS (SELECT country, platform, COUNT(DISTINCT device_id) AS unique_devices FROM gp WHERE country <> '' AND platform <> '' GROUP BY 1, 2)"))
def _(spark, d):
    return identity.platforms_by_country(_geo_pairs(spark, d), 10)


_SD = """sd AS (SELECT device_id, COUNT(DISTINCT session_id) AS session_count, COUNT(*) AS total_events FROM i WHERE device_id IS NOT NULL AND session_id IS NOT NULL GROUP BY 1)"""


@query("agg_34_sessions_per_device", on_logs("""SELECT sd.*, p.platform AS top_platform FROM sd LEFT JOIN (SELECT device_id, platform, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY COUNT(*) DESC, platform) AS rn
 FROM i WHERE device_id IS NOT NULL AND session_id IS NOT NULL AND platform IS NOT NULL GROUP BY 1, 2) p ON sd.device_id = p.device_id AND p.rn = 1""", _I, _SD))
def _(spark, d):
    return identity.sessions_per_device(_rows(spark, d))


@query("agg_34_session_bins", on_logs("""SELECT CASE WHEN session_count <= 1 THEN '1' WHEN session_count <= 5 THEN '2-5' WHEN session_count <= 10 THEN '6-10' WHEN session_count <= 25 THEN '11-25'
 WHEN session_count <= 50 THEN '26-50' WHEN session_count <= 100 THEN '51-100' ELSE '100+' END AS sessions_per_device, COUNT(*) AS device_count FROM sd GROUP BY 1""", _I, _SD))
def _(spark, d):
    return identity.sessions_per_device_bins(identity.sessions_per_device(_rows(spark, d), extra=()))


@query("agg_35_multi_device_sessions", on_logs("SELECT session_id, COUNT(DISTINCT device_id) AS n_devices FROM i WHERE device_id IS NOT NULL AND session_id IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT device_id) > 1", _I))
def _(spark, d):
    return identity.multi_links(_rows(spark, d), "session_id", "device_id", "n_devices")


@query("agg_35_multi_session_devices", on_logs("SELECT device_id, COUNT(DISTINCT session_id) AS n_sessions FROM i WHERE device_id IS NOT NULL AND session_id IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT session_id) > 1", _I))
def _(spark, d):
    return identity.multi_links(_rows(spark, d), "device_id", "session_id", "n_sessions")


@query("agg_35_session_device_map", on_logs("SELECT session_id, device_id, COUNT(*) AS event_count FROM i WHERE device_id IS NOT NULL AND session_id IS NOT NULL GROUP BY 1, 2", _I))
def _(spark, d):
    return identity.session_device_map(_rows(spark, d))


# the same reports where addresses and sessions do collide: by network (three octets) and by address and hour
_NET, _IP_HOUR = r"regexp_extract(cliIP, '^([0-9]+[.][0-9]+[.][0-9]+)', 1)", "concat(cliIP, '@', CAST(CAST(FLOOR(req_ts / 3600) AS BIGINT) AS {text}))"
_INET = f"inet AS (SELECT * REPLACE ({_NET} AS cliIP, concat({_NET}, '#', right(session_id, 1)) AS session_id) FROM i)"
_IHOUR = f"ihour AS (SELECT * REPLACE ({_IP_HOUR.format(text='VARCHAR')} AS cliIP) FROM i)"


def _networks(spark, d):
    return _rows(spark, d).withColumns({"cliIP": F.expr(_NET), "session_id": F.expr(f"concat({_NET}, '#', right(session_id, 1))")})


@query("agg_32_multi_device_networks", on_logs("""SELECT cliIP, COUNT(DISTINCT device_id) AS n_devices, COUNT(*) AS total_requests, array_to_string(list_slice(list_sort(list(DISTINCT device_id)), 1, 10), ', ') AS device_list
 FROM inet WHERE device_id IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT device_id) > 1""", _I, _INET))
def _(spark, d):
    return identity.multi_device_ips(_networks(spark, d), 10)


@query("agg_35_multi_device_rooms", on_logs("SELECT session_id, COUNT(DISTINCT device_id) AS n_devices FROM inet WHERE device_id IS NOT NULL AND session_id IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT device_id) > 1", _I, _INET))
def _(spark, d):
    return identity.multi_links(_networks(spark, d), "session_id", "device_id", "n_devices")


_HOURS = _IPS.replace("ips AS", "hours AS").replace("FROM i GROUP", "FROM ihour GROUP")


@query("agg_37_missing_ip_hours", on_logs("SELECT * FROM hours WHERE rows_with_device_id = 0 AND rows_with_session_id = 0", _I, _IHOUR, _HOURS))
def _(spark, d):
    return identity.missing_ip_list(_rows(spark, d).withColumn("cliIP", F.expr(_IP_HOUR.format(text="STRING"))))


@query("agg_37_missing_ip_hour_bins", on_logs("""SELECT CASE WHEN rows <= 1 THEN '1' WHEN rows <= 5 THEN '2-5' WHEN rows <= 20 THEN '6-20' WHEN rows <= 100 THEN '21-100' ELSE '101-1K' END AS rows_per_ip,
 COUNT(*) AS ip_count FROM hours WHERE rows_with_device_id = 0 AND rows_with_session_id = 0 GROUP BY 1""", _I, _IHOUR, _HOURS))
def _(spark, d):
    return identity.missing_ip_bins(_rows(spark, d).withColumn("cliIP", F.expr(_IP_HOUR.format(text="STRING"))))


# summary table
_LOC = "COALESCE(NULLIF(NULLIF(NULLIF(TRIM({}), ''), '-'), '^'), 'Unknown')"
_DD = f"""est AS ({EST_SQL.replace('SELECT event_id, dev', 'SELECT *, dev', 1)}),
 dd0 AS (SELECT {day()} AS event_date, {_LOC.format('country')} AS country, {_LOC.format('state')} AS region, {_LOC.format('city')} AS city,
 url_decode(replace({CHANNEL_RAW}, '+', ' ')) AS raw_channel, url_decode(COALESCE({x('platform')}, '')) AS platform, url_decode(COALESCE({x('device')}, '')) AS device_name,
 {DEVICE_TYPE_SQL.format(p=x('platform'), tv=TV_WIDE)} AS device_type, device_id, session_id, device_id_source, session_id_source FROM est),
 dd AS (SELECT event_date, country, region, city, lower(regexp_replace(raw_channel, '(_({TOKENS}))+$', '', 'i')) AS channel_name, raw_channel, platform, device_name, device_type,
 device_id, session_id, device_id_source, session_id_source, COUNT(*) AS requests FROM dd0 GROUP BY ALL)"""


def _summary(spark, d):
    return summary.device_day(logs(spark, d))


@query("agg_29_device_day", on_logs("SELECT * FROM dd", _DD))
def _(spark, d):
    return _summary(spark, d)


def _register_rollup(name):
    keys, distinct = summary.ROLLUPS[name]
    cols = ", ".join(f"COUNT(DISTINCT {c}) AS {n}" for n, c in distinct.items())
    sql = f"SELECT {', '.join(keys)}, CAST(SUM(requests) AS BIGINT) AS requests, {cols} FROM dd GROUP BY {', '.join(keys)}"

    @query(f"agg_29_{name}", on_logs(sql, _DD))
    def _(spark, d):
        return summary.named_rollup(_summary(spark, d), name)


for _name in summary.ROLLUPS:
    _register_rollup(_name)


def _grains_sql():
    keys = list(dict.fromkeys(k for ks, _ in summary.GRAINS.values() for k in ks))
    names = {n: c for _, f in summary.GRAINS.values() for n, c in f.items()}
    one = lambda g, ks, f: f"""SELECT '{g}' AS grain, {', '.join(k if k in ks else f'NULL AS {k}' for k in keys)}, CAST(SUM(requests) AS BIGINT) AS requests,
 {', '.join(f'COUNT(DISTINCT {c}) AS {n}' if n in f else f'NULL AS {n}' for n, c in names.items())} FROM dd GROUP BY {', '.join(ks)}"""  # noqa: E731
    return " UNION ALL ".join(one(g, ks, f) for g, (ks, f) in summary.GRAINS.items())


@query("agg_29_all_rollups", on_logs(_grains_sql(), _DD))
def _(spark, d):
    return summary.all_rollups(_summary(spark, d))


@query("agg_30_available_dates", on_logs("""SELECT MIN(event_date) AS min_date, MAX(event_date) AS max_date, COUNT(*) AS summary_rows, COUNT(DISTINCT event_date) AS active_days,
 CAST(SUM(requests) AS BIGINT) AS raw_requests FROM dd""", _DD))
def _(spark, d):
    return summary.available_dates(_summary(spark, d))


@query("agg_30_summary_kpis", on_logs("""SELECT CAST(SUM(requests) AS BIGINT) AS requests, COUNT(DISTINCT session_id) AS sessions, COUNT(DISTINCT device_id) AS devices, COUNT(DISTINCT country) AS countries,
 COUNT(DISTINCT channel_name) AS channels, ROUND(100.0 * SUM(CASE WHEN device_id_source = 'estimated_cliIP_UA' THEN requests ELSE 0 END) / SUM(requests), 2) AS estimated_request_pct FROM dd""", _DD))
def _(spark, d):
    return summary.kpis(_summary(spark, d))


@query("agg_59_reconcile", on_logs(f"""SELECT COALESCE(a.event_date, b.event_date) AS event_date, COALESCE(raw_rows, 0) AS raw_rows, COALESCE(s, 0) AS summary_requests, COALESCE(s, 0) - COALESCE(raw_rows, 0) AS diff FROM
 (SELECT {day()} AS event_date, COUNT(*) AS raw_rows FROM t GROUP BY 1) a FULL JOIN (SELECT event_date, CAST(SUM(requests) AS BIGINT) AS s FROM dd GROUP BY 1) b ON a.event_date = b.event_date""", _DD))
def _(spark, d):
    return summary.reconcile(_summary(spark, d), logs(spark, d))
