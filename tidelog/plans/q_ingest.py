"""Ingest and inventory (ING-1..8, ING-10, ING-11, INV-1..4, INV-7, FIL-12, UDF-4, UDF-5)."""

from pyspark.sql import functions as F


from ..functions.querystring import qs_pairs
from ..model import typed

from ..sources import inventory, lake, raw_json
from .registry import LOG_COLUMNS, day, logs, on_logs, query, table, written_lake

TEXT = [c for c in LOG_COLUMNS if c != "event_id"]


def lines(spark, d):
    """Every request row as a JSON line, as a log file would hold it."""
    return logs(spark, d).select(F.to_json(F.struct("event_id", *TEXT)).alias("value"))


def broken_lines(spark, d):
    """Log lines plus the raw texts of all documents, which are no JSON objects."""
    docs = table(spark, d, "documents").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value"))
    return lines(spark, d).unionByName(docs)


_NULLS = ", ".join(f"CASE WHEN {c} NOT IN ('-', '^') THEN {c} END AS {c}" for c in TEXT)


@query("ing_1_json_lines_to_text_rows", on_logs(f"SELECT CAST(event_id AS VARCHAR) AS event_id, {_NULLS} FROM logs"))
def _(spark, d):
    return raw_json.rows_as_text(raw_json.parse(lines(spark, d)), ["event_id", *TEXT])


@query("ing_2_error_rows", """SELECT TIMESTAMP '2024-01-06 00:00:00' AS logged_at, 'b1' AS batch, 'parse' AS stage, CAST(NULL AS VARCHAR) AS file, 'JSON' AS error, TRIM(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS value FROM documents
 WHERE TRIM(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) <> ''""")
def _(spark, d):
    at = F.lit("2024-01-06 00:00:00").cast("timestamp_ntz")
    return raw_json.error_rows(raw_json.parse(broken_lines(spark, d)), "b1", at).withColumn("value", F.trim("value"))


@query("ing_3_column_discovery", on_logs(" UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT({c}) AS rows FROM logs" for c in ["event_id", *TEXT])))
def _(spark, d):
    return raw_json.discover_columns(raw_json.parse(lines(spark, d)))


@query("ing_4_projected_ingest", on_logs("SELECT reqTimeSec, CASE WHEN asn NOT IN ('-', '^') THEN asn END AS asn, queryStr, CAST(NULL AS VARCHAR) AS not_there FROM logs"))
def _(spark, d):
    return raw_json.rows_as_text(raw_json.parse(lines(spark, d)), ["reqTimeSec", "asn", "queryStr", "not_there"])


_FILLED = "COUNT(*) FILTER (WHERE TRIM(CAST({c} AS VARCHAR)) NOT IN ('', '-', '^'))"


@query("ing_5_raw_profile", on_logs(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, COUNT({c}) AS present, {_FILLED.format(c=c)} AS filled, {f'COUNT({c})' if c != 'event_id' else 'CAST(0 AS BIGINT)'} AS n_str,
 {f'COUNT({c})' if c == 'event_id' else 'CAST(0 AS BIGINT)'} AS n_int, CAST(0 AS BIGINT) AS n_float, CAST(0 AS BIGINT) AS n_bool, CAST(0 AS BIGINT) AS n_dict, CAST(0 AS BIGINT) AS n_list, CAST(0 AS BIGINT) AS n_null FROM logs"""
    for c in ["event_id", *TEXT])))
def _(spark, d):
    return raw_json.profile(raw_json.parse(lines(spark, d)))


@query("ing_5_line_counts", on_logs("""SELECT COUNT(*) + (SELECT COUNT(*) FROM documents WHERE TRIM(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) <> '') AS total_rows, COUNT(*) AS valid_rows,
 (SELECT COUNT(*) FROM documents WHERE TRIM(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) <> '') AS invalid_json_rows, CAST(0 AS BIGINT) AS nondict_rows FROM logs"""))
def _(spark, d):
    return raw_json.profile_lines(raw_json.parse(broken_lines(spark, d)))


@query("ing_6_present_filled", on_logs(" UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT({c}) AS present, {_FILLED.format(c=c)} AS filled FROM logs" for c in ["event_id", *TEXT])))
def _(spark, d):
    return raw_json.present_filled(raw_json.parse(lines(spark, d)))


@query("ing_6_event_props", """SELECT 'k' AS column_name, COUNT(*) AS present, COUNT(*) AS filled FROM events WHERE props IS NOT NULL""")
def _(spark, d):
    return raw_json.present_filled(raw_json.parse(table(spark, d, "events").select(F.col("props").alias("value"))))


@query("ing_7_typed_rows", on_logs("""SELECT DISTINCT CAST(reqTimeSec AS DOUBLE) AS reqTimeSec, url_decode(queryStr) AS queryStr, url_decode(UA) AS UA, CAST(statusCode AS BIGINT) AS statusCode, TRY_CAST(asn AS BIGINT) AS asn,
 CASE WHEN country <> '^' THEN country END AS country, CAST(totalBytes AS BIGINT) AS totalBytes, CAST(throughput AS DOUBLE) AS throughput, epoch_us(make_timestamp(CAST(reqTimeSec AS BIGINT) * 1000000)) // 1000000 AS req_epoch FROM logs"""))
def _(spark, d):
    raw = logs(spark, d).select("reqTimeSec", "queryStr", "UA", "statusCode", "asn", "country", "totalBytes", "throughput")
    return raw_json.typed_rows(raw).withColumn("req_epoch", F.unix_seconds("reqTime")).drop("reqTime")


@query("ing_8_derived_rows", on_logs(r"""SELECT event_id, make_timestamp((req_ts + 19800) * 1000000) AS timestamp, CAST(make_timestamp((req_ts + 19800) * 1000000) AS DATE) AS date, CAST(((req_ts + 19800) % 86400) // 3600 AS INTEGER) AS hour,
 CAST(((req_ts + 19800) % 3600) // 60 AS INTEGER) AS minute, contains(reqPath, '.ts') AS is_segment, contains(reqPath, '.m3u8') AS is_playlist, CAST(statusCode AS BIGINT) >= 400 AS is_error, cacheStatus = '1' AS cache_hit,
 CASE WHEN contains(reqPath, '720p') THEN '720p' ELSE 'Auto/Unknown' END AS quality, replace(reqHost, '-live.akamaized.net', '') AS channel, NULLIF(regexp_extract(UA, 'Android[%20\s]+(\d+)', 1), '') AS android_ver FROM t"""))
def _(spark, d):
    return raw_json.derived_rows(logs(spark, d), tenant_suffix="-live").select(
        "event_id", "timestamp", "date", "hour", "minute", "is_segment", "is_playlist", "is_error", "cache_hit", "quality", "channel", "android_ver")


@query("ing_10_lake_columns", on_logs(f"""SELECT event_id, make_timestamp(req_ts * 1000000) AS req_time_utc, make_timestamp((req_ts + 19800) * 1000000) AS req_time_ist, {day(offset=19800)} AS log_date FROM t"""))
def _(spark, d):
    return lake.with_lake_columns(logs(spark, d)).select("event_id", "req_time_utc", "req_time_ist", "log_date")


@query("ing_11_partition_text", on_logs(f"SELECT event_id, strftime({day()}, '%Y') AS year, strftime({day()}, '%m') AS month, strftime({day()}, '%d') AS day FROM t"))
def _(spark, d):
    return lake.with_partition_text(logs(spark, d)).select("event_id", "year", "month", "day")


@query("fil_12_partition_days", on_logs(f"SELECT event_id FROM t WHERE {day()} BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'"))
def _(spark, d):
    return lake.read_lake(spark, written_lake(spark, d), lake.lake_days("2024-01-02", "2024-01-03")).select("event_id")


@query("inv_1_file_inventory", """SELECT 'lineitem.parquet' AS file, COUNT(*) AS rows FROM lineitem""")
def _(spark, d):
    return inventory.file_inventory(table(spark, d, "lineitem")).select(F.element_at(F.split("file_path", "/"), -1).alias("file"), "rows")


@query("inv_2_inventory_diff", """SELECT 'orders.parquet' AS file, 'missing' AS state UNION ALL SELECT 'lineitem.parquet', 'unchanged' UNION ALL SELECT 'customer.parquet', 'new'""")
def _(spark, d):
    inv = lambda n: inventory.file_inventory(table(spark, d, n))
    diff = inventory.inventory_diff(inv("orders").unionByName(inv("lineitem")), inv("lineitem").unionByName(inv("customer")))
    return diff.select(F.element_at(F.split("file_path", "/"), -1).alias("file"), "state")


@query("inv_2_inventory_states", """SELECT 'orders/' || o_orderkey AS file_path, CASE WHEN o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 7 = 0 THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state
 FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 7 <> 0""")
def _(spark, d):
    key = F.col("o_orderkey")
    files = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("orders/"), key).alias("file_path"), F.round(F.col("o_totalprice") * 100).cast("long").alias("file_size"), F.col("o_orderdate").alias("file_modification_time"))
    now = files.withColumn("file_size", F.col("file_size") + (key % 3 == 0).cast("long"))
    return inventory.inventory_diff(files.where(key % 5 != 0), now.where(key % 7 != 0))


@query("inv_3_schema_drift", """WITH f AS (SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents',
 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')) SELECT column_name AS "column", COUNT(DISTINCT table_name) AS files_with, 14 - COUNT(DISTINCT table_name) AS files_without FROM f GROUP BY 1""")
def _(spark, d):
    drift = inventory.schema_drift(inventory.footers(inventory.list_files(spark, d)))
    return drift.select("column", "files_with", "files_without")


@query("inv_4_time_range", on_logs("""SELECT 'json' AS source, COUNT(*) AS rows, MIN(req_ts) AS min_ts, MAX(req_ts) AS max_ts FROM t UNION ALL SELECT 'parquet', COUNT(*), MIN(req_ts), MAX(req_ts) FROM t
 UNION ALL SELECT 'all', 2 * COUNT(*), MIN(req_ts), MAX(req_ts) FROM t"""))
def _(spark, d):
    parsed = raw_json.rows_as_text(raw_json.parse(lines(spark, d)), ["reqTimeSec"])
    return inventory.time_range({"json": typed(parsed), "parquet": typed(logs(spark, d))})


@query("inv_7_files_starting_on", on_logs(f"""SELECT file, req_ts, utc_match, ist_match FROM (SELECT reqHost AS file, min_by(req_ts, event_id) AS req_ts, {day('min_by(req_ts, event_id)')} = DATE '2024-01-01' AS utc_match,
 {day('min_by(req_ts, event_id)', 19800)} = DATE '2024-01-01' AS ist_match FROM t GROUP BY 1) WHERE utc_match OR ist_match"""))
def _(spark, d):
    df = logs(spark, d).withColumn("file_path", F.col("reqHost"))
    return inventory.files_starting_on(df, "2024-01-01", "event_id").withColumnRenamed("file_path", "file")


@query("udf_4_pairs", on_logs("""SELECT event_id, split_part(p, '=', 1) AS key, CASE WHEN contains(p, '=') THEN url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' ')) ELSE '' END AS value
 FROM (SELECT event_id, unnest(string_split(queryStr, '&')) AS p FROM logs WHERE queryStr IS NOT NULL) WHERE p <> ''"""))
def _(spark, d):
    return logs(spark, d).select("event_id", F.inline(qs_pairs("queryStr")))


@query("udf_5_read_only_sql", on_logs("SELECT statusCode, COUNT(*) AS n FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def _(spark, d):
    from ..sources.adhoc import read_only_sql

    return read_only_sql(logs(spark, d), "SELECT statusCode, COUNT(*) AS n FROM rows GROUP BY 1 ORDER BY 2 DESC, 1", 10)
