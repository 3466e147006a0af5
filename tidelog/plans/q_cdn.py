"""CDN health, comparison, location (AGG-28, AGG-39..41, AGG-46..57, AGG-63, AGG-64, BHV-8, BHV-9, UDF-2)."""

from pyspark.sql import functions as F

from ..model import typed
from ..operators import agents, cdn, compare, events, location, users
from .q_functions import BRAND_SQL, BTYPE_SQL, TAG_SQL
from .q_sets import GEO_SQL, geo
from .registry import TOKENS, day, logs, on_behaviour, on_logs, query, table, values, x

_R = f"""r AS (SELECT *, cacheStatus = '1' AS hit, regexp_matches(statusCode, '^[45]') AS err, {TAG_SQL} AS tag, NULLIF(regexp_extract(UA, 'Android (\\d+)', 1), '') AS android,
 req_ts - req_ts % 3600 AS hour_ts, TRY_CAST(statusCode AS BIGINT) AS st, CAST(throughput AS DOUBLE) AS tp, CAST(totalBytes AS DOUBLE) AS tb, CAST(timeToFirstByte AS DOUBLE) AS ttfb,
 COALESCE(cliIP, 'NA') || '|' || COALESCE(UA, 'NA') AS pseudo_user FROM t)"""


def _r(spark, d):
    return cdn.cdn_rows(logs(spark, d))


def _u(spark, d):
    return users.with_pseudo_user(typed(logs(spark, d)))


@query("agg_46_cdn_kpis", on_logs("""SELECT COUNT(*) AS requests, ROUND(100.0 * COUNT(*) FILTER (WHERE hit) / COUNT(*), 2) AS hit_pct, ROUND(100.0 * COUNT(*) FILTER (WHERE err) / COUNT(*), 2) AS error_pct,
 ROUND(AVG(tp), 2) AS avg_throughput, ROUND(SUM(tb) / 1e12, 6) AS terabytes, COUNT(DISTINCT COALESCE(UA, '')) AS unique_uas FROM r""", _R))
def _(spark, d):
    return cdn.kpis(_r(spark, d))


@query("agg_46_volume_kpis", on_logs("""SELECT COUNT(*) AS requests, CAST(SUM(tb) AS BIGINT) AS bytes, ROUND(100.0 * COUNT(*) FILTER (WHERE err) / COUNT(*), 2) AS error_pct, MIN(req_ts) AS first_ts, MAX(req_ts) AS last_ts,
 COUNT(DISTINCT reqHost) AS hosts, COUNT(DISTINCT reqPath) AS paths, COUNT(DISTINCT state) AS states, COUNT(DISTINCT cliIP) AS ips FROM r""", _R))
def _(spark, d):
    return cdn.volume_kpis(_r(spark, d))


@query("agg_47_hourly_series", on_logs("""SELECT hour_ts, COUNT(*) AS requests, CAST(SUM(tb) AS BIGINT) AS bytes, ROUND(AVG(tp), 2) AS avg_throughput, ROUND(100.0 * COUNT(*) FILTER (WHERE hit) / COUNT(*), 2) AS hit_pct,
 ROUND(100.0 * COUNT(*) FILTER (WHERE err) / COUNT(*), 2) AS error_pct, ROUND(AVG(ttfb), 2) AS avg_ttfb FROM r GROUP BY 1""", _R))
def _(spark, d):
    return cdn.hourly(_r(spark, d))


def _register_breakdown(column):
    @query(f"agg_48_breakdown_{column.lower()}", on_logs(f"SELECT {column} AS value, COUNT(*) AS requests FROM t GROUP BY 1"))
    def _(spark, d):
        return cdn.breakdown(typed(logs(spark, d)), column)


for _c in ("statusCode", "reqHost", "country", "cacheStatus"):
    _register_breakdown(_c)


@query("agg_49_anomaly_flags", on_logs("""SELECT 'null_or_invalid_ua' AS flag, COUNT(*) FILTER (WHERE tag = 'Null/Invalid') AS count FROM r UNION ALL SELECT 'hls2disk', COUNT(*) FILTER (WHERE tag = 'Service: hls2disk') FROM r
 UNION ALL SELECT 'ffmpeg', COUNT(*) FILTER (WHERE tag = 'Tool: FFmpeg') FROM r UNION ALL SELECT 'palo_alto_scanner', COUNT(*) FILTER (WHERE tag = 'Scanner: Palo Alto') FROM r
 UNION ALL SELECT 'new_android', COUNT(*) FILTER (WHERE TRY_CAST(android AS DOUBLE) >= 16) FROM r
 UNION ALL SELECT 'high_error_hours', COUNT(*) FROM (SELECT hour_ts FROM r GROUP BY 1 HAVING AVG(CASE WHEN err THEN 1 ELSE 0 END) > 0.1)""", _R))
def _(spark, d):
    return cdn.anomalies(_r(spark, d))


@query("agg_50_global_summary", on_logs("""SELECT COUNT(*) AS total_requests, CAST(SUM(tb) AS BIGINT) AS total_bytes, ROUND(AVG(tb), 6) AS avg_bytes, ROUND(AVG(tp), 6) AS avg_throughput, median(tp) AS median_throughput,
 COUNT(*) FILTER (WHERE st >= 400) AS error_requests, ROUND(100.0 * COUNT(*) FILTER (WHERE st >= 400) / COUNT(*), 2) AS error_rate_pct, ROUND(100.0 * COUNT(*) FILTER (WHERE contains(upper(cacheStatus), 'HIT')) / COUNT(*), 2) AS cache_hit_pct,
 ROUND(AVG(ttfb), 6) AS avg_ttfb, ROUND(AVG(CAST(downloadTime AS DOUBLE)), 6) AS avg_download_time, COUNT(DISTINCT pseudo_user) AS pseudo_users, COUNT(DISTINCT reqPath) AS unique_paths FROM r""", _R))
def _(spark, d):
    return cdn.global_summary(_u(spark, d))


@query("agg_51_top_states", on_logs("SELECT state, COUNT(*) AS requests FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", _R))
def _(spark, d):
    return cdn.top_states(_u(spark, d), 5)


@query("agg_51_top_paths", on_logs("""SELECT reqPath, COUNT(*) AS hits, CAST(SUM(tb) AS BIGINT) AS total_bytes, ROUND(AVG(tp), 2) AS avg_throughput, COUNT(*) FILTER (WHERE st >= 400) AS errors FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""", _R))
def _(spark, d):
    return cdn.top_paths(_u(spark, d), 50)


@query("agg_51_status_breakdown", on_logs("""SELECT statusCode, CASE WHEN st < 400 THEN 'success' WHEN st < 500 THEN 'client_error' ELSE 'server_error' END AS status_class, COUNT(*) AS count FROM r GROUP BY 1, 2""", _R))
def _(spark, d):
    return cdn.status_breakdown(_u(spark, d))


@query("agg_51_top_error_paths", on_logs("SELECT statusCode, reqPath, COUNT(*) AS count FROM r WHERE st >= 400 GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50", _R))
def _(spark, d):
    return cdn.top_error_paths(_u(spark, d), 50)


@query("agg_51_top_users", on_logs("""SELECT pseudo_user, COUNT(*) AS requests, COUNT(DISTINCT reqPath) AS unique_paths, CAST(SUM(tb) AS BIGINT) AS total_bytes, COUNT(*) FILTER (WHERE st >= 400) AS errors FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""", _R))
def _(spark, d):
    return cdn.top_users(_u(spark, d), 50)


@query("agg_52_bot_like_users", on_logs("""SELECT pseudo_user, COUNT(*) AS requests, COUNT(DISTINCT reqPath) AS unique_paths, COUNT(DISTINCT reqHost) AS unique_hosts, ROUND(COUNT(*) / CAST(COUNT(DISTINCT reqPath) AS DOUBLE), 4) AS request_path_ratio
 FROM r GROUP BY 1 HAVING COUNT(*) >= 20 AND COUNT(*) / CAST(COUNT(DISTINCT reqPath) AS DOUBLE) >= 1.2""", _R))
def _(spark, d):
    return cdn.bot_like(_u(spark, d), 20, 1.2)


@query("agg_53_repeated_requests", on_logs("""SELECT pseudo_user, statusCode, req_ts - req_ts % 600 AS time_bucket, COUNT(*) AS count FROM r GROUP BY 1, 2, 3 HAVING COUNT(*) > 1""", _R))
def _(spark, d):
    return cdn.repeated_requests(_u(spark, d), ["pseudo_user", "statusCode"], 600)


def _mode_sql(c, name):
    return f"""LEFT JOIN (SELECT pseudo_user, {c} AS {name}, ROW_NUMBER() OVER (PARTITION BY pseudo_user ORDER BY COUNT(*) DESC, {c}) AS rn FROM r WHERE {c} IS NOT NULL GROUP BY 1, 2) {name} ON {name}.pseudo_user = a.pseudo_user AND {name}.rn = 1"""


@query("agg_54_user_summary", on_logs(f"""SELECT a.*, top_cache_status, top_state, top_country FROM (SELECT pseudo_user, COUNT(*) AS requests, MIN(req_ts) AS first_seen, MAX(req_ts) AS last_seen, COUNT(DISTINCT reqPath) AS unique_paths,
 COUNT(*) FILTER (WHERE st >= 400) AS errors, CAST(SUM(tb) AS BIGINT) AS total_bytes, ROUND(AVG(tp), 2) AS avg_throughput, ROUND(AVG(ttfb), 2) AS avg_ttfb FROM r GROUP BY 1) a
 {_mode_sql('cacheStatus', 'top_cache_status')} {_mode_sql('state', 'top_state')} {_mode_sql('country', 'top_country')}""", _R))
def _(spark, d):
    return users.user_summary(_u(spark, d))


_ONE = "10.0.6.6|Mozilla/5.0 (Windows NT 10.0)"


@query("agg_54_user_timeline", on_logs(f"""SELECT req_ts, event_id, reqHost, reqPath, queryStr, statusCode, cacheStatus, totalBytes, throughput, timeToFirstByte, city, state, country, asn FROM r WHERE pseudo_user = '{_ONE}'
 ORDER BY req_ts, event_id LIMIT 5000""", _R))
def _(spark, d):
    return users.user_timeline(_u(spark, d), _ONE, 5000)


@query("agg_55_qoe_bands", on_logs("""SELECT CASE WHEN tp < 1000000 THEN 'very_low' WHEN tp < 3000000 THEN 'low' WHEN tp < 8000000 THEN 'medium' ELSE 'high' END AS throughput_band, COUNT(*) AS requests, ROUND(AVG(ttfb), 2) AS avg_ttfb FROM r GROUP BY 1""", _R))
def _(spark, d):
    return cdn.qoe_bands(_u(spark, d))


@query("agg_55_state_qoe", on_logs("""SELECT state, COUNT(*) AS requests, ROUND(AVG(tp), 2) AS avg_throughput, ROUND(AVG(ttfb), 2) AS avg_ttfb, COUNT(*) FILTER (WHERE st >= 400) AS errors FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""", _R))
def _(spark, d):
    return cdn.state_qoe(_u(spark, d), 30)


_A = f"""a0 AS (SELECT COALESCE(UA, '') AS ua, COUNT(*) AS volume FROM logs GROUP BY 1),
 ag AS (SELECT ua, volume, {BRAND_SQL} AS brand, {BTYPE_SQL} AS brand_type, CASE WHEN contains(u, 'android') THEN 'Android' WHEN regexp_matches(u, 'iphone|ipad|applecoremedia') THEN 'iOS' WHEN contains(u, 'windows') THEN 'Windows'
 WHEN regexp_matches(u, 'mac os|macintosh') THEN 'Mac OS X' WHEN contains(u, 'tizen') THEN 'Tizen' WHEN regexp_matches(u, 'webos|web0s') THEN 'webOS' WHEN contains(u, 'linux') THEN 'Linux' ELSE 'Unknown' END AS os,
 regexp_matches(u, 'bot|crawl|spider|slurp|curl|wget|python-requests|scanner') AS is_bot FROM (SELECT *, lower(ua) AS u FROM a0))"""


@query("udf_2_agent_classes", on_logs("SELECT * FROM ag", _A))
def _(spark, d):
    return cdn.agents(logs(spark, d))


_PATTERNS = "patterns(place, kind, keyword, label, version) AS " + values(tuple((i, *row) for i, row in enumerate(agents.PATTERNS)))


def _agent_part(kind):
    return f"""SELECT UA, arg_min(label, place) AS {kind}, NULLIF(CASE WHEN arg_min(version, place) <> '' THEN regexp_extract(lower(UA), arg_min(version, place), 1) END, '') AS {kind}_version
 FROM (SELECT DISTINCT UA FROM logs WHERE UA IS NOT NULL), patterns WHERE kind = '{kind}' AND contains(lower(UA), keyword) GROUP BY UA"""


_AGENTS = f"""agents AS (SELECT UA, {', '.join(f"coalesce({k}, 'Other') AS {k}, {k}_version" for k in agents.KINDS)}, regexp_matches(lower(UA), 'bot|crawl|spider|slurp|curl|wget|python-requests|scanner') AS is_bot
 FROM (SELECT DISTINCT UA FROM logs WHERE UA IS NOT NULL) {' '.join(f'LEFT JOIN ({_agent_part(k)}) USING (UA)' for k in agents.KINDS)})"""


@query("udf_2_agent_versions", on_logs("SELECT * FROM agents", _PATTERNS, _AGENTS))
def _(spark, d):
    return agents.parsed(logs(spark, d), "UA")


@query("udf_2_system_shares", on_logs("""SELECT coalesce(device, 'Missing') AS device, coalesce(os, 'Missing') AS os, os_version, coalesce(browser, 'Missing') AS browser, coalesce(is_bot, false) AS is_bot, COUNT(*) AS requests,
 COUNT(DISTINCT logs.UA) AS agents FROM logs LEFT JOIN agents ON logs.UA = agents.UA GROUP BY 1, 2, 3, 4, 5""", _PATTERNS, _AGENTS))
def _(spark, d):
    return agents.shares(logs(spark, d), "UA")


@query("agg_56_agent_report", on_logs("""SELECT v AS total_volume, n AS agents, brands, ROUND(l[1] / v, 4) AS top_brand_share, ROUND(list_sum(l[1:3]) / v, 4) AS top3_share, ROUND(list_sum(l[1:10]) / v, 4) AS top10_share,
 ROUND(ctv / v, 4) AS ctv_share, ROUND(mob / v, 4) AS mobile_share, ROUND(desk / v, 4) AS desktop_share, ROUND(o / v, 4) AS top_os_share, ROUND(bot / v, 4) AS bot_share, ROUND(unk / v, 4) AS unknown_share,
 CASE WHEN l[1] / v > 0.5 THEN 'extreme dependency' WHEN l[1] / v > 0.35 THEN 'high dependency' END AS dependency_flag, list_sum(l[1:3]) / v > 0.7 AS concentrated, bot / v > 0.05 AS high_bot_traffic, unk / v > 0.05 AS data_quality_issue
 FROM (SELECT CAST(SUM(volume) AS BIGINT) AS v, COUNT(*) AS n, COALESCE(SUM(volume) FILTER (WHERE brand_type = 'Connected TV'), 0)::DOUBLE AS ctv, COALESCE(SUM(volume) FILTER (WHERE brand_type = 'Mobile / Tablet'), 0)::DOUBLE AS mob,
 COALESCE(SUM(volume) FILTER (WHERE brand_type = 'Desktop'), 0)::DOUBLE AS desk, COALESCE(SUM(volume) FILTER (WHERE is_bot), 0)::DOUBLE AS bot, COALESCE(SUM(volume) FILTER (WHERE brand IN ('Unknown', 'Missing / Null')), 0)::DOUBLE AS unk FROM ag),
 (SELECT COUNT(*) AS brands, list(s ORDER BY s DESC) AS l FROM (SELECT brand, SUM(volume)::DOUBLE AS s FROM ag GROUP BY 1)), (SELECT MAX(s) AS o FROM (SELECT SUM(volume)::DOUBLE AS s FROM ag GROUP BY os))""", _A))
def _(spark, d):
    return cdn.agent_report(cdn.agents(logs(spark, d)))


@query("agg_57_asn_share", on_logs("""SELECT asn, COUNT(*) AS requests, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS pct FROM (SELECT regexp_replace(regexp_replace(upper(TRIM(asn)), '^AS', ''), '\\.0$', '') AS asn FROM logs)
 WHERE asn NOT IN ('', 'NAN', 'NONE', 'NULL', '(NULL)', '-', '^', '0') GROUP BY 1"""))
def _(spark, d):
    return cdn.asn_share(logs(spark, d))


@query("agg_63_top_hosts", on_logs("SELECT reqHost AS value, COUNT(*) AS requests, CAST(SUM(tb) AS BIGINT) AS bytes FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", _R))
def _(spark, d):
    return cdn.top_volume(typed(logs(spark, d)), "reqHost", 10)


@query("agg_63_top_paths", on_logs("SELECT reqPath AS value, COUNT(*) AS requests, CAST(SUM(tb) AS BIGINT) AS bytes FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", _R))
def _(spark, d):
    return cdn.top_volume(typed(logs(spark, d)), "reqPath", 25)


@query("agg_64_user_ip_asn", on_logs(f"""SELECT p.*, COALESCE(g.country, '') AS country, COALESCE(g.region, '') AS region, COALESCE(g.isp, '') AS isp, g.lat FROM (SELECT {x('device_id')} AS device_id, cliIP, asn, COUNT(*) AS requests FROM t
 WHERE {x('device_id')} IS NOT NULL GROUP BY 1, 2, 3) p LEFT JOIN geo g ON p.cliIP = g.cliIP""", GEO_SQL))
def _(spark, d):
    return cdn.user_ip_asn(events.device_rows(logs(spark, d)), "device_id", geo(spark, d))


# comparison
_DIMS = ["cliIP", "UA", "asn", "state", "city", "country"]


@query("agg_39_range_summary", on_logs("SELECT COUNT(*) AS rows, MIN(req_ts) AS min_ts, MAX(req_ts) AS max_ts, " + ", ".join(f"COUNT(DISTINCT {c}) AS distinct_{c}" for c in _DIMS) + " FROM t WHERE req_ts BETWEEN 1704100000 AND 1704300000"))
def _(spark, d):
    return compare.range_summary(typed(logs(spark, d)).where(F.col("req_ts").between(1704100000, 1704300000)), _DIMS)


@query("agg_40_top_dimension", on_logs("SELECT COALESCE(NULLIF(TRIM(state), ''), '(blank/null)') AS value, COUNT(*) AS rows, COUNT(DISTINCT cliIP) AS distinct_cliIP FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def _(spark, d):
    return compare.top_dimension(typed(logs(spark, d)), "state", 5, "cliIP")


@query("agg_40_top_asn", on_logs("SELECT regexp_replace(lower(TRIM(asn)), '^as', '') AS asn_key, COUNT(*) AS rows FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"))
def _(spark, d):
    return compare.top_asn(typed(logs(spark, d)), 5)


@query("agg_40_pair_counts", on_logs("""SELECT COALESCE(NULLIF(TRIM(UA), ''), '(blank/null)') AS UA, COALESCE(NULLIF(TRIM(state), ''), '(blank/null)') AS state, COUNT(*) AS rows FROM t GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25"""))
def _(spark, d):
    return compare.pair_counts(typed(logs(spark, d)), "UA", "state", 25)


_CB = "COALESCE(NULLIF(TRIM({0}), ''), '(blank/null)') AS {0}"


@query("agg_41_cross_counts", on_logs(f"SELECT {', '.join(_CB.format(c) for c in ('UA', 'asn', 'state', 'city', 'country'))}, COUNT(*) AS rows, COUNT(DISTINCT cliIP) AS distinct_ip FROM t GROUP BY 1, 2, 3, 4, 5"))
def _(spark, d):
    return compare.cross_counts(typed(logs(spark, d)), ["UA", "asn", "state", "city", "country"])


@query("bhv_9_compare_ranges", on_logs("""SELECT value, a, b, b - a AS delta, ROUND(100.0 * (b - a) / NULLIF(a, 0), 2) AS pct_change FROM (SELECT COALESCE(NULLIF(TRIM(state), ''), '(blank/null)') AS value,
 COUNT(*) FILTER (WHERE req_ts < 1704240000) AS a, COUNT(*) FILTER (WHERE req_ts >= 1704240000) AS b FROM t GROUP BY 1)"""))
def _(spark, d):
    from ..functions.text import label_blank

    ts = F.col("req_ts")
    return compare.compare_ranges(typed(logs(spark, d)), ts < 1704240000, ts >= 1704240000, label_blank("state"))


@query("bhv_9_compare_orders_by_year", """SELECT COALESCE(x.p, y.p) AS o_orderpriority, COALESCE(x.n, 0) AS a, COALESCE(y.n, 0) AS b, COALESCE(y.n, 0) - COALESCE(x.n, 0) AS delta,
 ROUND(100.0 * (COALESCE(y.n, 0) - COALESCE(x.n, 0)) / NULLIF(COALESCE(x.n, 0), 0), 2) AS pct_change FROM (SELECT o_orderpriority AS p, COUNT(*) AS n FROM orders WHERE EXTRACT(year FROM o_orderdate) = 1995 GROUP BY 1) x
 FULL JOIN (SELECT o_orderpriority AS p, COUNT(*) AS n FROM orders WHERE EXTRACT(year FROM o_orderdate) = 1996 GROUP BY 1) y ON x.p = y.p""")
def _(spark, d):
    o = table(spark, d, "orders")
    per = lambda y: o.where(F.year("o_orderdate") == y).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return compare.compare_frames(per(1995), per(1996), ["o_orderpriority"], "n")


# location
_DEC = "url_decode(replace(COALESCE({}, ''), '+', ' '))"
_L = f"""l0 AS (SELECT COALESCE(NULLIF(NULLIF(NULLIF(TRIM(country), ''), '-'), '^'), 'Unknown') AS country, COALESCE(NULLIF(NULLIF(NULLIF(TRIM(state), ''), '-'), '^'), 'Unknown') AS region,
 COALESCE(NULLIF(NULLIF(NULLIF(TRIM(city), ''), '-'), '^'), 'Unknown') AS city, {_DEC.format('channel_name_raw')} AS raw_channel, {_DEC.format('platform')} AS platform, {_DEC.format('device_name')} AS device_name,
 device_type, session_id, device_id FROM b),
 lb AS (SELECT country, region, city, raw_channel, lower(regexp_replace(raw_channel, '(_({TOKENS}))+$', '', 'i')) AS channel_name, platform, device_name, device_type, session_id, device_id, COUNT(*) AS requests FROM l0 GROUP BY ALL)"""


def _base(spark, d):
    return location.location_base(events.location_events(logs(spark, d)))


@query("bhv_8_location_base", on_behaviour("SELECT * FROM lb", _L))
def _(spark, d):
    return _base(spark, d)


def _register_rollup(name):
    keys, distinct = location.ROLLUPS[name]
    where = "WHERE upper(country) IN ('IN', 'IND', 'INDIA')" if name == "india_state" else ""
    shown = ["region AS state_region"] if name == "india_state" else keys
    sql = f"""SELECT {', '.join(shown)}, CAST(SUM(requests) AS BIGINT) AS requests, {', '.join(f'COUNT(DISTINCT {c}) AS {n}' for n, c in distinct.items())}
 FROM lb {where} GROUP BY {', '.join(keys)}"""

    @query(f"agg_28_location_{name}", on_behaviour(sql, _L))
    def _(spark, d):
        return location.location_rollup(_base(spark, d), name)


for _n in location.ROLLUPS:
    _register_rollup(_n)
