"""Filters and projections (FIL-1..17)."""

from pyspark.sql import functions as F

from ..functions import clock
from ..functions.devices import FAMILIES, device_family
from ..functions.querystring import qs_value
from ..model import typed
from ..operators import filters
from .registry import day, logs, on_logs, query, table, x

_HAS = lambda group: " AND ".join(f"contains(lower(UA), '{p}')" for p in group)
FAMILY_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(map(_HAS, groups))} THEN '{label}'" for label, groups in FAMILIES) + " ELSE 'Other' END"


@query("fil_1_multi_column_filter", """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
 WHERE CAST(l_returnflag AS VARCHAR) IN ('A', 'R') AND CAST(l_linenumber AS VARCHAR) IN ('1', '3')""")
def _(spark, d):
    df = table(spark, d, "lineitem")
    return filters.select_rows(df, ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"],
                               {"l_returnflag": ["A", "R"], "l_linenumber": [1, 3]})


@query("fil_2_dual_filter", """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
 WHERE (o_orderstatus IN ('F') OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND CAST(o_custkey AS VARCHAR) NOT IN ('')""")
def _(spark, d):
    df = table(spark, d, "orders")
    return df.where(filters.matches({}, {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"]})).select(
        "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("fil_3_projected_select", on_logs("SELECT event_id, cliIP, reqPath FROM logs WHERE statusCode IN ('404', '503')"))
def _(spark, d):
    return filters.select_rows(logs(spark, d), ["event_id", "cliIP", "reqPath", "no_such_column"], {"statusCode": ["404", "503"]})


@query("fil_4_select_with_provenance", """SELECT c_custkey, c_mktsegment, 'customer.parquet' AS source_file FROM customer WHERE c_mktsegment IN ('BUILDING')""")
def _(spark, d):
    df = table(spark, d, "customer").select("*", F.col("_metadata.file_name").alias("source_file"))
    return filters.select_rows(df, ["c_custkey", "c_mktsegment", "source_file", "absent"], {"c_mktsegment": ["BUILDING"]})


@query("fil_5_epoch_range", on_logs("SELECT event_id, req_ts FROM t WHERE req_ts BETWEEN 1704120000 AND 1704250000"))
def _(spark, d):
    return typed(logs(spark, d)).where(filters.epoch_between(1704120000, 1704250000)).select("event_id", "req_ts")


@query("fil_6_zone_date_range", on_logs(f"""SELECT event_id, {day(offset=19800)} AS ist_date, {day()} AS utc_date, {day(offset=-12600)} AS west_date FROM t
 WHERE {day(offset=19800)} BETWEEN DATE '2024-01-02' AND DATE '2024-01-03'"""))
def _(spark, d):
    df = typed(logs(spark, d)).where(filters.date_between("2024-01-02", "2024-01-03", zone="IST"))
    return df.select("event_id", clock.zone_date("req_ts", "IST").alias("ist_date"), clock.zone_date("req_ts", "UTC").alias("utc_date"),
                     clock.zone_date("req_ts", "-03:30").alias("west_date"))


@query("fil_7_only_status_200", on_logs("SELECT event_id, statusCode FROM logs WHERE TRY_CAST(statusCode AS BIGINT) = 200"))
def _(spark, d):
    return logs(spark, d).where(filters.only_status(200)).select("event_id", "statusCode")


@query("fil_8_platform_equals", on_logs(f"SELECT event_id, {x('platform')} AS platform FROM logs WHERE lower({x('platform')}) = lower('Android_TV')"))
def _(spark, d):
    df = logs(spark, d).select("event_id", qs_value("queryStr", "platform").alias("platform"))
    return df.where(filters.equals_ignore_case("platform", "Android_TV"))


@query("fil_9_faceted_filter", on_logs(f"""SELECT event_id FROM t WHERE req_ts >= 1704067200 AND req_ts <= 1704400000
 AND reqHost IN ('app0-live.akamaized.net', 'app1-live.akamaized.net') AND state IN ('state0', 'state1', 'state2')
 AND TRY_CAST(statusCode AS BIGINT) BETWEEN 200 AND 299 AND regexp_extract(reqPath, '([0-9]{{3,4}}p)', 1) IN ('720p')
 AND {FAMILY_SQL} IN ('Android Mobile', 'iOS', 'Windows') AND reqPath ILIKE '%SEG%'"""))
def _(spark, d):
    cond = filters.facets(
        start=1704067200, end=1704400000, hosts=["app0-live.akamaized.net", "app1-live.akamaized.net"],
        states=["state0", "state1", "state2"], status_classes=["2xx"], renditions=["720p"],
        device_family=device_family("UA"), device_families=["Android Mobile", "iOS", "Windows"], path_contains=" SEG ")
    return typed(logs(spark, d)).where(cond).select("event_id")


@query("fil_10_facets_with_path_pattern", on_logs(r"""SELECT event_id, reqPath FROM t WHERE country IN ('IN') AND TRY_CAST(statusCode AS BIGINT) IN (200, 404)
 AND cacheStatus IN ('1') AND regexp_matches(reqPath, 'seg[0-9]+\.ts$')"""))
def _(spark, d):
    cond = filters.facets(countries=["IN"], status_codes=[200, 404], cache_status=["1"], path_regex=r"seg[0-9]+\.ts$")
    return typed(logs(spark, d)).where(cond).select("event_id", "reqPath")


@query("fil_11_last_days", on_logs(f"""SELECT event_id, {day()} AS event_date FROM t WHERE state ILIKE '%state1%' AND queryStr ILIKE '%view%'
 AND {day()} >= (SELECT MAX({day()}) FROM t) - 2"""))
def _(spark, d):
    df = typed(logs(spark, d)).withColumn("event_date", clock.day_date("req_ts"))
    df = filters.last_days(df, "event_date", 2)
    return df.where(F.col("state").ilike("%state1%") & F.col("queryStr").ilike("%view%")).select("event_id", "event_date")


@query("fil_13_key_substring", """SELECT c_custkey, c_name FROM customer WHERE contains(CAST(c_custkey AS VARCHAR), '12')""")
def _(spark, d):
    return table(spark, d, "customer").where(filters.contains_text("c_custkey", "12")).select("c_custkey", "c_name")


@query("fil_15_keyword_search", on_logs(f"""SELECT event_id, url_decode(replace({x('content_title')}, '+', ' ')) AS content_title_decoded FROM logs
 WHERE contains(queryStr, 'BRAVIA')"""))
def _(spark, d):
    return filters.keyword_rows(logs(spark, d), "queryStr", "BRAVIA", "content_title").select("event_id", "content_title_decoded")


@query("fil_16_sparse_distinct", on_logs("SELECT DISTINCT asn AS value FROM logs WHERE asn IS NOT NULL AND asn NOT IN ('', '-', '^')"))
def _(spark, d):
    return filters.distinct_filled(logs(spark, d), "asn")


@query("fil_17_rows_of_picked_values", """SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _(spark, d):
    picked = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return filters.rows_of(table(spark, d, "orders"), picked, ["o_custkey"])
