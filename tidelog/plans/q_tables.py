"""Readers, sinks and incremental jobs that write and read back tables (ING-9, ING-12, SRC-1..5, SNK-1..3, STR-1..6, SET-9, BHV-7)."""

from pyspark.sql import functions as F

from ..functions import clock
from ..model import typed
from ..operators import events, matrix
from ..session import run_folder
from ..functions.querystring import qs_value
from ..sources import inventory, lake, sinks
from ..sources.published import Published
from ..streaming import jobs
from .registry import LOG_COLUMNS, day, logs, on_behaviour, on_logs, query, spread, table, written_lake, x

TEXT = [c for c in LOG_COLUMNS if c != "event_id"]
_IST = day(offset=19800)
#: Bytes of Parquet whose rows make one file of lines.
LINES_FROM = 4 << 20
#: Bytes of Parquet that make one part of a file.
PART_FROM = 16 << 20


def _copy(spark, source, target):
    """Copy a folder's gzip text files under new names: a task per file, and a file per task."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "1")  # files that cannot be split are then never packed together
    own.read.text(source).write.option("compression", "gzip").text(target)


def _table_bytes(spark, d, *names):
    """Bytes of the files of these tables, from their listing."""
    return sum(inventory.list_files(spark, f"{d}/{n}.parquet", "*").agg(F.sum("length")).first()[0] or 0 for n in names)


def _stage_lines(spark, d, folder, files=8):
    """Log lines as gzip JSON files, one folder per run."""
    rows = logs(spark, d).select(F.to_json(F.struct("event_id", *TEXT)).alias("value"))
    docs = table(spark, d, "documents").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value"))
    rows.unionByName(docs).repartition(files).write.option("compression", "gzip").text(folder)


@query("str_1_stream_ingest", on_logs(f"""SELECT CAST(event_id AS VARCHAR) AS event_id, reqTimeSec, queryStr, CASE WHEN asn NOT IN ('-', '^') THEN asn END AS asn FROM logs"""))
def _(spark, d):
    f = run_folder(spark, "ingest")
    _stage_lines(spark, d, f"{f}/in")
    run = lambda: jobs.run_to_end(jobs.ingest_new_files(
        spark, f"{f}/in", f"{f}/rows", f"{f}/bad", f"{f}/state", ["event_id", "reqTimeSec", "queryStr", "asn"], files_per_batch=3))
    run()
    run()  # a second run finds no new file and adds nothing
    return spark.read.parquet(f"{f}/rows").select("event_id", "reqTimeSec", "queryStr", "asn")


@query("str_2_stream_error_rows", """SELECT 'parse' AS stage, 'JSON' AS error, COUNT(*) AS rows FROM documents WHERE TRIM(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) <> ''""")
def _(spark, d):
    f = run_folder(spark, "ingest")
    # a task reads a file: their number follows the bytes, so that a file stays as large
    _stage_lines(spark, d, f"{f}/in", max(8, -(-_table_bytes(spark, d, "events", "documents") // LINES_FROM)))
    jobs.run_to_end(jobs.ingest_new_files(spark, f"{f}/in", f"{f}/rows", f"{f}/bad", f"{f}/state", ["event_id"]))
    return spark.read.parquet(f"{f}/bad").groupBy("stage", "error").agg(F.count(F.lit(1)).alias("rows"))


@query("str_3_stream_dedup", "SELECT DISTINCT l_quantity, l_discount, l_returnflag, l_linestatus FROM lineitem")
def _(spark, d):
    f = run_folder(spark, "dedup")
    keys = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
    stream = jobs.stream_table(spark, d, "lineitem.parquet").select(*keys, F.col("l_shipdate").cast("timestamp").alias("event_time"))
    once = jobs.deduplicated(stream, keys, "event_time", "20000 days").select(*keys)
    jobs.run_to_end(jobs.to_table(once, f"{f}/rows", f"{f}/state"))
    return spark.read.parquet(f"{f}/rows")


@query("str_3_stream_full_rows", "SELECT DISTINCT * FROM lineitem")
def _(spark, d):
    f = run_folder(spark, "dedup")
    rows = table(spark, d, "lineitem")
    stream = jobs.stream_table(spark, d, "lineitem.parquet").withColumn("event_time", F.col("l_shipdate").cast("timestamp"))
    # copies share their time, so a bounded delay finds them
    once = jobs.deduplicated(stream, rows.columns, "event_time", "7 days").select(*rows.columns)
    jobs.run_to_end(jobs.to_table(once, f"{f}/rows", f"{f}/state"))
    return spark.read.parquet(f"{f}/rows")


def _event_stream(spark, d):
    """The request log as a stream over the events file."""
    from .registry import _SHIFT, _SPARK_MICROS

    epoch = _SHIFT.format(micros=_SPARK_MICROS)
    raw = jobs.stream_table(spark, d, "events.parquet")
    return jobs.with_event_time(raw.selectExpr(*[f"{e.replace('{epoch}', epoch)} AS {n}" for n, e in LOG_COLUMNS.items()]))


@query("str_4_report_of_touched_dates", on_logs(f"SELECT {day()} AS date, COUNT(*) AS requests FROM t GROUP BY 1"))
def _(spark, d):
    f = run_folder(spark, "report")
    stream = _event_stream(spark, d).withColumn("date", clock.day_date("req_ts"))
    build = lambda rows: rows.groupBy("date").agg(F.count(F.lit(1)).alias("requests"))
    jobs.run_to_end(jobs.report_new_rows(stream, f"{f}/lake", f"{f}/report", f"{f}/state", "date", build))
    return spark.read.parquet(f"{f}/report").select("date", "requests")


@query("str_5_summary_refresh", on_logs(f"SELECT {day()} AS event_date, COUNT(*) AS requests FROM t GROUP BY 1"))
def _(spark, d):
    f = run_folder(spark, "summary")
    rows = logs(spark, d)
    moved = lambda days: rows.withColumn("reqTimeSec", (F.col("reqTimeSec").cast("long") + 86400 * days).cast("string"))
    third = lambda df, i: df.where(F.col("event_id") % 3 == i)
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{f}/in/part={name}")
    meta = [F.col(f"_metadata.{n}").alias(n) for n in ("file_path", "file_size", "file_modification_time")]
    refresh = lambda: jobs.refresh_summary(spark, spark.read.parquet(f"{f}/in").select("*", *meta), f"{f}/tables")
    put(third(rows, 0).unionByName(third(rows, 2)), "untouched")
    put(third(moved(40), 1), "replaced")
    put(third(moved(80), 2), "deleted")
    refresh()
    put(third(rows, 1), "replaced")
    sinks.drop_dates(spark, f"{f}/in", "part", ["deleted"])
    refresh()
    refresh()  # nothing is stale now
    return Published(spark, f"{f}/tables").read("summary").groupBy("event_date").agg(F.sum("requests").alias("requests"))


@query("snk_3_published_dates", on_logs(f"SELECT {day()} AS date, COUNT(*) * CASE WHEN {day()} = DATE '2024-01-02' THEN 10 ELSE 1 END AS requests FROM t WHERE {day()} <> DATE '2024-01-03' GROUP BY {day()}"))
def _(spark, d):
    store = Published(spark, run_folder(spark, "published"))
    report = matrix.activity_by_date(typed(logs(spark, d)))
    store.replace(report, "report", "date")
    again = report.where(F.col("date") == F.lit("2024-01-02").cast("date")).withColumn("requests", F.col("requests") * 10)
    store.stage(again.withColumn("requests", F.lit(-1)), "report", "date")  # a job that died before its commit leaves no trace
    store.commit({"report": {**store.stage(again, "report", "date"), "date=2024-01-03": None}})
    return store.read("report").select("date", "requests")


@query("str_3_content_ledger", on_logs("SELECT CAST(event_id AS VARCHAR) AS event_id, reqTimeSec FROM logs"))
def _(spark, d):
    f = run_folder(spark, "ledger")
    lines = logs(spark, d).select(F.to_json(F.struct("event_id", *TEXT)).alias("value"))
    # as many files as the bytes call for: the batches of three then grow with the log, not with the cluster's number of partitions
    lines.hint("rebalance").write.option("compression", "gzip").text(f"{f}/in/first")
    run = lambda: jobs.run_to_end(jobs.ingest_new_files(
        spark, f"{f}/in", f"{f}/rows", f"{f}/bad", f"{f}/state", ["event_id", "reqTimeSec"], files_per_batch=3, ledger=f"{f}/ledger"))
    run()
    _copy(spark, f"{f}/in/first", f"{f}/in/renamed")
    run()  # files under new names add nothing
    return spark.read.parquet(f"{f}/rows").select("event_id", "reqTimeSec")


@query("str_6_stream_hourly_counts", on_logs("""SELECT req_ts - req_ts % 3600 AS hour_ts, COUNT(*) AS requests, CAST(SUM(CAST(totalBytes AS BIGINT)) AS BIGINT) AS bytes,
 COUNT(*) FILTER (WHERE CAST(statusCode AS BIGINT) >= 400) AS errors FROM t GROUP BY 1"""))
def _(spark, d):
    f = run_folder(spark, "hourly")
    jobs.run_to_end(jobs.to_table(jobs.hourly_counts(_event_stream(spark, d)), f"{f}/rows", f"{f}/state", "complete"))
    return spark.read.parquet(f"{f}/rows")


@query("str_6_stream_sessions", on_logs("""SELECT pseudo_user, MIN(req_ts) AS session_start, MAX(req_ts) AS session_end, COUNT(*) AS requests FROM (
 SELECT *, SUM(nw) OVER (PARTITION BY pseudo_user ORDER BY req_ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
 SELECT *, CASE WHEN req_ts - LAG(req_ts) OVER (PARTITION BY pseudo_user ORDER BY req_ts, event_id) <= 1800 THEN 0 ELSE 1 END AS nw FROM (
 SELECT *, COALESCE(cliIP, 'NA') || '|' || COALESCE(UA, 'NA') AS pseudo_user FROM t))) GROUP BY pseudo_user, s"""))
def _(spark, d):
    f = run_folder(spark, "sessions")
    jobs.run_to_end(jobs.to_table(jobs.user_sessions(_event_stream(spark, d)), f"{f}/rows", f"{f}/state", "complete"))
    return spark.read.parquet(f"{f}/rows")


# windows that the watermark, two hours behind the newest row, has closed
@query("str_6_closed_hours", on_logs("""SELECT req_ts - req_ts % 3600 AS hour_ts, COUNT(*) AS requests, CAST(SUM(CAST(totalBytes AS BIGINT)) AS BIGINT) AS bytes,
 COUNT(*) FILTER (WHERE CAST(statusCode AS BIGINT) >= 400) AS errors FROM t GROUP BY 1 HAVING req_ts - req_ts % 3600 + 3600 <= (SELECT MAX(req_ts) - 7200 FROM t)"""))
def _(spark, d):
    f = run_folder(spark, "hourly")
    jobs.run_to_end(jobs.to_table(jobs.hourly_counts(_event_stream(spark, d)), f"{f}/rows", f"{f}/state"))
    return spark.read.parquet(f"{f}/rows")


@query("str_6_closed_sessions", on_logs("""SELECT pseudo_user, MIN(req_ts) AS session_start, MAX(req_ts) AS session_end, COUNT(*) AS requests FROM (
 SELECT *, SUM(nw) OVER (PARTITION BY pseudo_user ORDER BY req_ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
 SELECT *, CASE WHEN req_ts - LAG(req_ts) OVER (PARTITION BY pseudo_user ORDER BY req_ts, event_id) <= 1800 THEN 0 ELSE 1 END AS nw FROM (
 SELECT *, COALESCE(cliIP, 'NA') || '|' || COALESCE(UA, 'NA') AS pseudo_user FROM t))) GROUP BY pseudo_user, s HAVING MAX(req_ts) + 1800 <= (SELECT MAX(req_ts) - 7200 FROM t)"""))
def _(spark, d):
    f = run_folder(spark, "sessions")
    jobs.run_to_end(jobs.to_table(jobs.user_sessions(_event_stream(spark, d)), f"{f}/rows", f"{f}/state"))
    return spark.read.parquet(f"{f}/rows")


@query("ing_9_merge_files", "SELECT * FROM orders")
def _(spark, d):
    f = run_folder(spark, "merge")
    spread(table(spark, d, "orders")).write.parquet(f"{f}/many")
    lake.merge_files(spark, f"{f}/many", f"{f}/few")
    return lake.read_flat(spark, f"{f}/few")


@query("ing_12_optimize", "SELECT DISTINCT * FROM lineitem")
def _(spark, d):
    f = run_folder(spark, "optimize")
    lake.optimize(table(spark, d, "lineitem"), "l_shipdate", f"{f}/out")
    return spark.read.parquet(f"{f}/out")


@query("src_1_flat_scan_with_drift", """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""")
def _(spark, d):
    f = run_folder(spark, "flat")
    table(spark, d, "customer").selectExpr("c_custkey id", "c_name name", "c_mktsegment segment").write.parquet(f"{f}/a")
    table(spark, d, "supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal balance").write.parquet(f"{f}/b")
    return lake.read_flat(spark, f).select("id", "name", "segment", "balance")


@query("src_2_lake_scan", on_logs(f"SELECT event_id, cliIP FROM t WHERE {day()} BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'"))
def _(spark, d):
    f = run_folder(spark, "lake")
    lake.build_day_lake(logs(spark, d), f)
    return lake.read_lake(spark, f, lake.lake_days("2024-01-02", "2024-01-03")).select("event_id", "cliIP")


@query("src_3_lake_and_flat", on_logs("SELECT event_id, cliIP, NULL::VARCHAR AS c_name FROM t UNION ALL SELECT c_custkey, NULL, c_name FROM customer"))
def _(spark, d):
    f = run_folder(spark, "mixed")
    lake.build_day_lake(logs(spark, d), f"{f}/lake")
    table(spark, d, "customer").selectExpr("c_custkey event_id", "c_name").write.parquet(f"{f}/flat")
    return lake.read_any(spark, f"{f}/lake", f"{f}/flat").select("event_id", "cliIP", "c_name")


@query("src_5_csv_source", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    f = run_folder(spark, "csv")
    sinks.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), f)
    return lake.read_csv(spark, f)


@query("snk_1_parquet_codec", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    f = run_folder(spark, "codec")
    sinks.write_parquet(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), f, codec="gzip")
    return spark.read.parquet(f)


@query("snk_2_csv_export", "SELECT o_orderpriority, CAST(COUNT(*) AS VARCHAR) AS n FROM orders GROUP BY 1")
def _(spark, d):
    f = run_folder(spark, "export")
    sinks.write_csv(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), f)
    return lake.read_csv(spark, f)


@query("snk_3_append_new_dates", on_logs(f"SELECT {day()} AS date, COUNT(*) AS requests FROM t GROUP BY 1"))
def _(spark, d):
    f = run_folder(spark, "append")
    report = matrix.activity_by_date(typed(logs(spark, d)))
    sinks.append_new_dates(report.where(F.col("date") <= F.lit("2024-01-02").cast("date")), f, "date")
    sinks.append_new_dates(report, f, "date")
    return sinks.read_report(spark, f, "date").select("date", "requests")


@query("snk_3_replace_dates", on_logs(f"SELECT {day()} AS date, COUNT(*) * CASE WHEN {day()} = DATE '2024-01-02' THEN 10 ELSE 1 END AS requests FROM t GROUP BY {day()}"))
def _(spark, d):
    f = run_folder(spark, "replace")
    report = matrix.activity_by_date(typed(logs(spark, d)))
    sinks.replace_dates(report, f, "date")
    again = report.where(F.col("date") == F.lit("2024-01-02").cast("date")).withColumn("requests", F.col("requests") * 10)
    sinks.replace_dates(again, f, "date")
    return spark.read.parquet(f).select("date", "requests")


@query("ing_10_lake_by_ist_date", on_logs(f"SELECT {_IST} AS log_date, COUNT(*) AS rows FROM t GROUP BY 1"))
def _(spark, d):
    f = run_folder(spark, "ist")
    lake.build_lake(logs(spark, d), f)
    return lake.read_lake(spark, f).groupBy("log_date").agg(F.count(F.lit(1)).alias("rows"))


@query("set_9_identical_files", "SELECT 2 AS copies, COUNT(*) AS files FROM (SELECT 1 FROM range(2))")
def _(spark, d):
    f = run_folder(spark, "same")
    orders = table(spark, d, "orders")
    # a file is a folder of parts; one task writes a part of both copies, as a footer lists its encodings in an order that differs between processes
    parts = max(1, -(-_table_bytes(spark, d, "orders") // PART_FROM))
    twice = orders.repartition(parts, *orders.columns).select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("copy"))
    twice.sortWithinPartitions("copy", *orders.columns).write.partitionBy("copy").parquet(f)
    if orders.isEmpty():  # then no task has a row to write a file for
        for name in ("a", "b"):
            orders.write.parquet(f"{f}/copy={name}")
    table(spark, d, "customer").write.parquet(f"{f}/c")
    return inventory.identical_files(spark, f, "*.parquet", part_folders=True).groupBy(F.col("copies").cast("int").alias("copies")).agg(F.count(F.lit(1)).alias("files"))


# look-ups, footers and remote stores
def _lookup_lake(spark, d):
    f = run_folder(spark, "lookup")
    rows = typed(logs(spark, d)).withColumns({"day": clock.day_date("req_ts"), **{k: qs_value("queryStr", k) for k in ("device_id", "session_id")}})
    lake.write_lookup(rows, f, "day", "device_id", ["session_id"], values=5000)
    return f


@query("bhv_1_point_lookup", on_logs(f"SELECT event_id, req_ts, {x('session_id')} AS session_id FROM t WHERE {x('device_id')} = 'd7'"))
def _(spark, d):
    return spark.read.parquet(_lookup_lake(spark, d)).where("device_id = 'd7'").select("event_id", "req_ts", "session_id")


@query("fil_13_session_lookup", on_logs(f"SELECT event_id, req_ts, {x('device_id')} AS device_id FROM t WHERE {x('session_id')} = 's11-2'"))
def _(spark, d):
    return spark.read.parquet(_lookup_lake(spark, d)).where("session_id = 's11-2'").select("event_id", "req_ts", "device_id")


@query("inv_5_rows_per_day_from_footers", on_logs(f"SELECT {day()} AS day, COUNT(*) AS rows, MIN(req_ts) AS min_req_ts, MAX(req_ts) AS max_req_ts FROM t GROUP BY 1"))
def _(spark, d):
    return lake.footer_stats(spark, _lookup_lake(spark, d), ["day"], "req_ts")


@query("inv_4_time_range_from_footers", on_logs("SELECT COUNT(*) AS rows, MIN(req_ts) AS min_req_ts, MAX(req_ts) AS max_req_ts FROM t"))
def _(spark, d):
    return lake.footer_stats(spark, _lookup_lake(spark, d), column="req_ts")


@query("inv_1_columns_per_file", "SELECT 2 AS files, array_to_string(list_sort(['c_custkey', 'c_name', 'c_nationkey']), ',') AS columns, COUNT(*) AS rows FROM customer UNION ALL SELECT 1, 's_acctbal,s_suppkey', COUNT(*) FROM supplier")
def _(spark, d):
    f = run_folder(spark, "drift")
    halves = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    for i in range(2):
        halves.where(F.col("c_custkey") % 2 == i).coalesce(1).write.parquet(f"{f}/c{i}")
    table(spark, d, "supplier").select("s_suppkey", "s_acctbal").coalesce(1).write.parquet(f"{f}/s")
    per = inventory.file_columns(spark, f)
    return per.groupBy(F.array_join("columns", ",").alias("columns")).agg(F.count(F.lit(1)).cast("int").alias("files"), F.sum("rows").alias("rows"))


@query("inv_7_real_files_starting_on", on_logs(f"""SELECT name, {day('ts')} = DATE '2024-01-02' AS utc_match, {day('ts', 19800)} = DATE '2024-01-02' AS ist_match FROM (
 SELECT reqHost AS name, arg_min(req_ts, event_id) AS ts FROM t GROUP BY 1) WHERE {day('ts')} = DATE '2024-01-02' OR {day('ts', 19800)} = DATE '2024-01-02'"""))
def _(spark, d):
    f = run_folder(spark, "hosts")
    # a host's file is a folder of parts in order, so that many tasks write and read it
    logs(spark, d).repartitionByRange("reqHost", "event_id").sortWithinPartitions("reqHost", "event_id").write.partitionBy("reqHost").parquet(f)
    hit = inventory.files_starting_on(inventory.as_part_folders(inventory.scanned_files(spark.read.parquet(f))), "2024-01-02", "file_row")
    return hit.select(F.regexp_extract("file_path", "reqHost=([^/]+)/", 1).alias("name"), "utc_match", "ist_match")


@query("src_4_object_store", on_logs(f"SELECT event_id, cliIP FROM t WHERE {day()} BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'"))
def _(spark, d):
    # a scheme that only Hadoop's readers know, mapped to the written lake: no store is reachable here, the reader's options are the same
    f = written_lake(spark, d)
    mount = f"store{f.rsplit('-', 1)[-1]}"
    target = f if ":" in f else f"file://{f}"
    options = {f"fs.viewfs.mounttable.{mount}.link./lake": target}
    return lake.read_object_store(spark, f"viewfs://{mount}/lake", "http://store.invalid", options=options, where=lake.lake_days("2024-01-02", "2024-01-03")).select("event_id", "cliIP")


@query("bhv_7_materialised_slice", on_behaviour("""SELECT device_type, COUNT(*) AS requests, COUNT(DISTINCT session_id) AS sessions FROM b GROUP BY 1"""))
def _(spark, d):
    f = run_folder(spark, "slice")
    events.behaviour_events(logs(spark, d)).write.partitionBy("event_date").parquet(f)
    return spark.read.parquet(f).groupBy("device_type").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("session_id").alias("sessions"))
