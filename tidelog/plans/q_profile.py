"""Profiling (AGG-1..10, AGG-58, FIL-3 counts)."""

from pyspark.sql import functions as F

from ..model import typed
from ..operators import health, profile, ranking
from ..operators.filters import matches
from .registry import LOG_COLUMNS, day, logs, on_logs, query, table, written_lake, x


@query("agg_1_value_counts", on_logs("""SELECT COALESCE(NULLIF(state, ''), '(blank)') AS value, COUNT(*) AS count, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS pct
 FROM logs GROUP BY 1"""))
def _(spark, d):
    return ranking.value_counts(logs(spark, d), "state")


@query("agg_1_value_counts_with_other", """WITH c AS (SELECT CAST(l_shipdate AS DATE) AS value, COUNT(*) AS count FROM lineitem GROUP BY 1),
 r AS (SELECT CAST(value AS VARCHAR) AS value, count, ROW_NUMBER() OVER (ORDER BY count DESC, CAST(value AS VARCHAR)) AS rn FROM c),
 f AS (SELECT CASE WHEN rn <= 25 THEN value ELSE 'Other' END AS value, CAST(SUM(count) AS BIGINT) AS count FROM r GROUP BY 1)
 SELECT value, count, ROUND(100.0 * count / SUM(count) OVER (), 2) AS pct FROM f""")
def _(spark, d):
    return ranking.value_counts(table(spark, d, "lineitem"), F.col("l_shipdate").cast("date"), 25, other=True)


@query("agg_1_value_counts_top", """SELECT o_orderpriority AS value, COUNT(*) AS count, ROUND(100.0 * COUNT(*) / (SELECT COUNT(*) FROM orders), 2) AS pct
 FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def _(spark, d):
    return ranking.value_counts(table(spark, d, "orders"), "o_orderpriority", 3)


_TEXT_COLS = [c for c in LOG_COLUMNS if c != "event_id"]
_EMPTY = "COUNT(*) FILTER (WHERE {c} IS NOT NULL AND TRIM(CAST({c} AS VARCHAR)) NOT IN ('', '-', '^'))"


def _completeness_sql(src, cols):
    return "SELECT column_name, f AS filled_rows, n - f AS empty_rows, n AS total_rows, ROUND(100.0 * f / n, 2) AS filled_pct, ROUND(100.0 * (n - f) / n, 2) AS empty_pct FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {_EMPTY.format(c=c)} AS f, COUNT(*) AS n FROM {src}" for c in cols) + ")"


@query("agg_2_completeness", on_logs(_completeness_sql("logs", _TEXT_COLS)))
def _(spark, d):
    return profile.completeness(logs(spark, d), _TEXT_COLS)


_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("agg_2_completeness_lineitem", _completeness_sql("lineitem", _LI))
def _(spark, d):
    return profile.completeness(table(spark, d, "lineitem"), _LI)


@query("agg_3_filtered_row_count", "SELECT COUNT(*) AS rows FROM lineitem WHERE l_returnflag IN ('R') AND l_linestatus IN ('F')")
def _(spark, d):
    return table(spark, d, "lineitem").where(matches({"l_returnflag": ["R"], "l_linestatus": ["F"]})).agg(F.count(F.lit(1)).alias("rows"))


@query("agg_4_column_stats", on_logs("SELECT COUNT(*) AS rows, COUNT(queryStr) AS filled, COUNT(DISTINCT queryStr) AS distinct_values FROM t WHERE req_ts BETWEEN 1704120000 AND 1704250000"))
def _(spark, d):
    return profile.column_stats(typed(logs(spark, d)).where(F.col("req_ts").between(1704120000, 1704250000)), "queryStr")


_FIELDS = ["cliIP", "UA", "reqPath", "statusCode", "asn", "country", "state", "city", "reqHost"]
_KEYS = ["device_id", "session_id", "channel", "platform", "device", "content_title"]


@query("agg_5_distinct_counts", on_logs(" UNION ALL ".join(
    [f"SELECT '{c}' AS field, COUNT(DISTINCT {c}) AS distinct_values FROM logs" for c in _FIELDS]
    + [f"SELECT 'qs.{k}', COUNT(DISTINCT {x(k)}) FROM logs" for k in _KEYS])))
def _(spark, d):
    cols = {c: F.col(c) for c in _FIELDS}
    return profile.distinct_counts(logs(spark, d), {**cols, **profile.qs_fields(_KEYS)})


@query("agg_6_exact_distinct", "SELECT COUNT(DISTINCT l_orderkey) AS l_orderkey, COUNT(DISTINCT l_partkey) AS l_partkey, COUNT(DISTINCT l_suppkey) AS l_suppkey FROM lineitem")
def _(spark, d):
    return profile.distinct_exact_or_approx(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"])


@query("agg_6_approx_distinct")
def _(spark, d):
    return profile.distinct_exact_or_approx(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"], exact=False)


@query("agg_7_distinct_tuples", on_logs("SELECT COUNT(*) AS distinct_tuples FROM (SELECT DISTINCT cliIP, UA FROM logs)"))
def _(spark, d):
    return profile.distinct_tuples(logs(spark, d), ["cliIP", "UA"])


@query("agg_8_top_values", on_logs("""SELECT state AS value, COUNT(*) AS rows, ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS pct FROM logs
 WHERE state IS NOT NULL AND TRIM(state) <> '' GROUP BY 1 ORDER BY rows DESC, value LIMIT 4"""))
def _(spark, d):
    return profile.top_values(logs(spark, d), "state", 4)


_KV = """kv AS (SELECT url_decode(replace(split_part(p, '=', 1), '+', ' ')) AS key,
 CASE WHEN contains(p, '=') THEN url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' ')) ELSE '' END AS value
 FROM (SELECT unnest(string_split(queryStr, '&')) AS p FROM logs WHERE queryStr IS NOT NULL) WHERE p <> '')"""


@query("agg_9_key_stats", on_logs("SELECT key, COUNT(DISTINCT value) AS distinct_values, COUNT(*) AS filled_rows FROM kv GROUP BY 1", _KV))
def _(spark, d):
    return profile.key_stats(logs(spark, d))


@query("agg_9_key_value_counts", on_logs("SELECT key, value, COUNT(*) AS rows FROM kv GROUP BY 1, 2", _KV))
def _(spark, d):
    return profile.key_values(logs(spark, d))


@query("agg_9_key_fill", on_logs("""SELECT key, CAST(COUNT(*) FILTER (WHERE value <> '') AS BIGINT) AS filled,
 ROUND(100.0 * COUNT(*) FILTER (WHERE value <> '') / (SELECT COUNT(*) FROM logs WHERE queryStr IS NOT NULL), 2) AS fill_pct FROM kv GROUP BY 1""", _KV))
def _(spark, d):
    return profile.key_fill(logs(spark, d))


_PK = """kv AS (SELECT split_part(p, '=', 1) AS key, CASE WHEN contains(p, '=') THEN url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' ')) ELSE '' END AS value
 FROM (SELECT unnest(string_split(substr(url, strpos(url, '?') + 1), '&')) AS p FROM pages WHERE contains(url, '?')) WHERE p <> '')"""


@query("agg_9_url_key_stats", f"WITH {_PK} SELECT key, COUNT(DISTINCT value) AS distinct_values, COUNT(*) AS filled_rows FROM kv GROUP BY 1")
def _(spark, d):
    pages = table(spark, d, "pages").where(F.col("url").contains("?"))
    return profile.key_stats(pages.select(F.regexp_replace("url", r"^[^?]*\?", "").alias("queryStr")))


@query("agg_58_health_checks", on_logs("""SELECT 'row_count' AS check_name, CASE WHEN COUNT(*) = 0 THEN 'FAIL' WHEN COUNT(*) < 1000 THEN 'WARN' ELSE 'OK' END AS status, COUNT(*) || ' rows' AS detail FROM t
 UNION ALL SELECT 'schema_columns', 'OK', '19 expected columns present'
 UNION ALL SELECT 'extra_columns', 'WARN', '1 extra columns'
 UNION ALL SELECT 'column_types', 'OK', 'types as expected'
 UNION ALL SELECT 'null_rates', CASE WHEN m > 10 THEN 'WARN' ELSE 'OK' END, 'worst null rate ' || CAST(ROUND(m, 1) AS VARCHAR) || '%' FROM (
  SELECT greatest(100.0 * COUNT(*) FILTER (WHERE UA IS NULL) / COUNT(*), 100.0 * COUNT(*) FILTER (WHERE cliIP IS NULL) / COUNT(*)) AS m FROM t)
 UNION ALL SELECT 'timestamp_range', 'OK', MIN(req_ts) || ' to ' || MAX(req_ts) FROM t
 UNION ALL SELECT 'request_types', 'OK', 'segments=' || COUNT(*) FILTER (WHERE contains(reqPath, '.ts')) || ' playlists=' || COUNT(*) FILTER (WHERE contains(reqPath, '.m3u8'))
  || ' other=' || COUNT(*) FILTER (WHERE NOT contains(reqPath, '.ts') AND NOT contains(reqPath, '.m3u8')) FROM t
 UNION ALL SELECT 'unique_viewers', 'OK', COUNT(DISTINCT cliIP) || ' IPs' FROM t"""))
def _(spark, d):
    return health.health_checks(typed(logs(spark, d)), list(LOG_COLUMNS), {"req_ts": "bigint", "event_id": "bigint"})


@query("agg_58_folder_checks", on_logs(f"""SELECT check_name, status, detail FROM (SELECT COUNT(DISTINCT {day()}) AS days, COUNT(DISTINCT {day()}) FILTER (WHERE {day()} > DATE '2024-01-03') AS late FROM t),
 LATERAL (VALUES ('partition_folders', 'OK', '0 files outside a day folder'),
  ('days_present', 'FAIL', (3 + 1 - (days - late)) || ' days missing, first 2023-12-31'), ('days_in_range', CASE WHEN late > 0 THEN 'WARN' ELSE 'OK' END, late || ' days outside the range')) AS v(check_name, status, detail)"""))
def _(spark, d):
    checks = health.folder_checks(spark, written_lake(spark, d), "2023-12-31", "2024-01-03")
    return checks.where(~F.col("check_name").isin("files", "small_files"))  # how many files there are is the writer's choice
