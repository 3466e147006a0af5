"""Set operations, top-k and joins (SET-1..8, TOP-1..3, JOIN-1..11, WIN-16, WIN-17)."""

from pyspark.sql import functions as F

from ..functions import clock
from ..model import typed
from ..operators import dimensions, ranking, sets, users
from .registry import day, logs, on_behaviour, on_logs, query, table

_PART = ["l_partkey", "l_quantity", "l_returnflag"]


def _li(spark, d, flag=None):
    df = table(spark, d, "lineitem")
    return df if flag is None else df.where(F.col("l_returnflag") == flag)


@query("set_1_exact_dedup", "SELECT DISTINCT * FROM lineitem")
def _(spark, d):
    return sets.exact_dedup(table(spark, d, "lineitem"))


@query("set_1_dedup_counts", """SELECT COUNT(*) AS rows_before, (SELECT COUNT(*) FROM (SELECT DISTINCT l_partkey, l_quantity, l_returnflag FROM lineitem)) AS rows_after,
 COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT l_partkey, l_quantity, l_returnflag FROM lineitem)) AS removed FROM lineitem""")
def _(spark, d):
    return sets.dedup_counts(_li(spark, d).select(*_PART))


# the whole table, and the returned lines once more
_TWICE = "u AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'R')"


def _twice(spark, d):
    li = table(spark, d, "lineitem")
    return li.unionByName(li.where("l_returnflag = 'R'"))


@query("set_1_full_row_counts", f"WITH {_TWICE}, o AS (SELECT DISTINCT * FROM u) SELECT (SELECT COUNT(*) FROM u) AS rows_before, COUNT(*) AS rows_after, (SELECT COUNT(*) FROM u) - COUNT(*) AS removed FROM o")
def _(spark, d):
    return sets.dedup_counts(_twice(spark, d))


@query("set_5_full_row_groups", f"WITH {_TWICE} SELECT *, COUNT(*) AS count FROM u GROUP BY ALL HAVING COUNT(*) > 1")
def _(spark, d):
    return sets.duplicate_groups(_twice(spark, d))


@query("set_1_document_dedup", "SELECT COUNT(*) AS rows_before, COUNT(DISTINCT text) AS rows_after, COUNT(*) - COUNT(DISTINCT text) AS removed FROM documents")
def _(spark, d):
    return sets.dedup_counts(table(spark, d, "documents").select("text"))


@query("set_2_subtract_master", "SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'N' EXCEPT SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    return sets.new_rows(_li(spark, d, "N"), _li(spark, d, "R").select("l_partkey", "l_quantity"))


@query("set_3_common_rows", "SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def _(spark, d):
    return sets.common_rows(_li(spark, d, "A"), _li(spark, d, "R").select("l_partkey", "l_quantity"))


@query("set_3_overlap_counts", """WITH a AS (SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R')
 SELECT (SELECT COUNT(*) FROM a) AS rows1, (SELECT COUNT(*) FROM b) AS rows2, c AS common, (SELECT COUNT(*) FROM a) + (SELECT COUNT(*) FROM b) - 2 * c AS unmatched
 FROM (SELECT COUNT(*) AS c FROM (SELECT * FROM a INTERSECT SELECT * FROM b))""")
def _(spark, d):
    cols = ["l_partkey", "l_quantity"]
    return sets.overlap_counts(_li(spark, d, "A").select(*cols), _li(spark, d, "R").select(*cols))


@query("set_4_all_pairs_overlap", """WITH s AS (SELECT DISTINCT source, text FROM documents)
 SELECT a.source AS source_a, b.source AS source_b, COUNT(*) AS common_rows FROM s a JOIN s b ON a.text = b.text AND a.source < b.source GROUP BY 1, 2""")
def _(spark, d):
    return sets.all_pairs_overlap(table(spark, d, "documents"), "source", ["text"])


@query("set_4_all_pairs_overlap_lineitem", """WITH s AS (SELECT DISTINCT l_shipdate, l_partkey, EXTRACT(year FROM l_shipdate) AS y FROM lineitem), p AS (SELECT DISTINCT CAST(y AS VARCHAR) AS y, l_partkey FROM s)
 SELECT a.y AS source_a, b.y AS source_b, COUNT(*) AS common_rows FROM p a JOIN p b ON a.l_partkey = b.l_partkey AND a.y < b.y GROUP BY 1, 2""")
def _(spark, d):
    return sets.all_pairs_overlap(_li(spark, d).withColumn("y", F.year("l_shipdate")), "y", ["l_partkey"])


@query("set_5_duplicate_groups", "SELECT l_partkey, l_quantity, l_returnflag, COUNT(*) AS count FROM lineitem GROUP BY ALL HAVING COUNT(*) > 1")
def _(spark, d):
    return sets.duplicate_groups(_li(spark, d).select(*_PART))


@query("set_5_duplicate_summary", """SELECT COUNT(*) AS duplicate_groups, CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS extra_rows FROM (
 SELECT COUNT(*) AS n FROM documents GROUP BY text HAVING COUNT(*) > 1)""")
def _(spark, d):
    return sets.duplicate_summary(table(spark, d, "documents"), ["text"])


@query("set_6_union_by_name", """SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer
 UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier""")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return sets.union_sources(a, b)


@query("set_7_distinct_columns", on_logs(f"SELECT DISTINCT cliIP, UA, state FROM t WHERE {day()} = DATE '2024-01-02'"))
def _(spark, d):
    df = typed(logs(spark, d)).where(clock.day_date("req_ts") == F.lit("2024-01-02").cast("date"))
    return sets.distinct_columns(df, ["cliIP", "UA", "state"])


@query("set_8_filter_options", on_behaviour("""SELECT DISTINCT 'platform' AS field, platform AS value FROM b UNION ALL SELECT DISTINCT 'device_id', device_id FROM b
 UNION ALL SELECT DISTINCT 'device_type', device_type FROM b"""))
def _(spark, d):
    from ..operators.events import behaviour_events

    ev = behaviour_events(logs(spark, d))
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("platform", "device_id", "device_type")])
    return ev.select(F.inline(fields)).where(F.col("value").isNotNull()).distinct()


@query("top_1_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("top_2_top_per_group", """SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def _(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.top_per_group(df, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("top_3_latest_rows", on_logs("SELECT event_id, req_ts, reqPath FROM t ORDER BY req_ts DESC, event_id DESC LIMIT 200"))
def _(spark, d):
    return users.latest_rows(typed(logs(spark, d)).select("event_id", "req_ts", "reqPath"), 200)


@query("win_16_share_of_total_and_group", """SELECT o_orderpriority, o_orderstatus, n, ROUND(100.0 * n / SUM(n) OVER (), 2) AS pct_total,
 ROUND(100.0 * n / SUM(n) OVER (PARTITION BY o_orderpriority), 2) AS pct_group FROM (SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2)""")
def _(spark, d):
    per = ranking.counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", name="n")
    return ranking.with_group_share(ranking.with_share(per, "n", "pct_total"), ["o_orderpriority"], "n", "pct_group")


@query("win_17_mode_per_key", """SELECT l_suppkey, l_shipmode AS top_flag, n FROM (SELECT l_suppkey, l_returnflag AS l_shipmode, COUNT(*) AS n,
 ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY COUNT(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1""")
def _(spark, d):
    return ranking.modes(_li(spark, d), ["l_suppkey"], "l_returnflag", "top_flag", "n")


# joins
@query("join_1_unique_left_join", "SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    dim = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return dimensions.unique_left_join(table(spark, d, "customer"), dim, ["c_nationkey"]).select("c_custkey", "n_name", "n_regionkey")


@query("join_1_duplicate_map_keys", "SELECT s_nationkey, COUNT(*) AS count FROM supplier GROUP BY 1 HAVING COUNT(*) > 1")
def _(spark, d):
    return dimensions.duplicate_keys(table(spark, d, "supplier"), ["s_nationkey"])


@query("join_2_top_values_join", """SELECT l_shipdate, l_suppkey, COUNT(*) AS row_count FROM lineitem WHERE l_suppkey IN (
 SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY COUNT(*) DESC, l_suppkey LIMIT 5) GROUP BY 1, 2""")
def _(spark, d):
    li = _li(spark, d)
    top = ranking.counts(li, "l_suppkey").orderBy(F.desc("count"), "l_suppkey").limit(5)
    return li.join(F.broadcast(top.select("l_suppkey")), "l_suppkey", "left_semi").groupBy("l_shipdate", "l_suppkey").agg(F.count(F.lit(1)).alias("row_count"))


@query("join_3_semi_join_entities", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY SUM(o_totalprice) DESC, o_custkey LIMIT 20)""")
def _(spark, d):
    o = table(spark, d, "orders")
    top = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).orderBy(F.desc("s"), "o_custkey").limit(20)
    return o.join(F.broadcast(top.select("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("join_4_full_outer_compare", """SELECT COALESCE(x.p, y.p) AS p, COALESCE(x.n, 0) AS a, COALESCE(y.n, 0) AS b, COALESCE(y.n, 0) - COALESCE(x.n, 0) AS delta,
 ROUND(100.0 * (COALESCE(y.n, 0) - COALESCE(x.n, 0)) / NULLIF(COALESCE(x.n, 0), 0), 2) AS pct_change FROM
 (SELECT l_partkey AS p, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) x FULL JOIN (SELECT l_partkey AS p, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) y ON x.p = y.p""")
def _(spark, d):
    per = lambda f: ranking.counts(_li(spark, d, f), F.col("l_partkey").alias("p"), name="n")
    return dimensions.full_compare(per("A"), per("R"), ["p"], "n")


@query("join_6_asn_dimension", on_logs("""SELECT event_id, regexp_replace(lower(TRIM(asn)), '^as', '') AS asn_key, n.n_name AS as_name FROM logs LEFT JOIN nation n
 ON regexp_replace(lower(TRIM(asn)), '^as', '') = CAST(100 + n.n_nationkey AS VARCHAR)"""))
def _(spark, d):
    dim = table(spark, d, "nation").select(F.concat(F.lit("AS"), (F.col("n_nationkey") + 100).cast("string")).alias("asn"), F.col("n_name").alias("as_name"))
    return dimensions.with_asn(logs(spark, d), dim).select("event_id", "asn_key", "as_name")


GEO_SQL = """geo AS (SELECT '10.0.' || CAST(c_custkey % 16 AS VARCHAR) || '.' || CAST(c_custkey % 50 AS VARCHAR) AS cliIP, MIN(n_name) AS country,
 MIN(c_mktsegment) AS region, MIN(r_name) AS isp, CAST(MIN(c_nationkey) AS DOUBLE) AS lat FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE c_acctbal > 0 GROUP BY 1)"""


def geo(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    ip = F.concat(F.lit("10.0."), (F.col("c_custkey") % 16).cast("string"), F.lit("."), (F.col("c_custkey") % 50).cast("string"))
    return j.groupBy(ip.alias("cliIP")).agg(F.min("n_name").alias("country"), F.min("c_mktsegment").alias("region"),
                                            F.min("r_name").alias("isp"), F.min("c_nationkey").cast("double").alias("lat"))


@query("join_7_geo_enrichment", on_logs("""SELECT event_id, l.cliIP, COALESCE(g.country, '') AS country, COALESCE(g.region, '') AS region, COALESCE(g.isp, '') AS isp, g.lat
 FROM logs l LEFT JOIN geo g ON l.cliIP = g.cliIP""", GEO_SQL))
def _(spark, d):
    return dimensions.with_geo(logs(spark, d), geo(spark, d)).select("event_id", "cliIP", "country", "region", "isp", "lat")


@query("join_8_one_row_summary", """SELECT (SELECT COUNT(*) FROM orders) AS orders, (SELECT COUNT(*) FROM lineitem) AS lines, (SELECT COUNT(*) FROM customer) AS customers""")
def _(spark, d):
    n = lambda t, name: table(spark, d, t).agg(F.count(F.lit(1)).alias(name))
    return ranking.one_row(n("orders", "orders"), n("lineitem", "lines"), n("customer", "customers"))


@query("join_9_best_match", """SELECT l_partkey, l_suppkey AS best_supplier, n AS lines FROM (SELECT l_partkey, l_suppkey, COUNT(*) AS n,
 ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY COUNT(*) DESC, l_suppkey) AS rn FROM lineitem GROUP BY 1, 2) WHERE rn = 1""")
def _(spark, d):
    return dimensions.best_match(_li(spark, d), "l_partkey", "l_suppkey", F.count(F.lit(1)), "best_supplier", "lines")


@query("join_10_anti_join_loaded_dates", """SELECT l_shipdate, COUNT(*) AS rows FROM lineitem WHERE l_shipdate NOT IN (SELECT o_orderdate FROM orders) GROUP BY 1""")
def _(spark, d):
    loaded = table(spark, d, "orders").select(F.col("o_orderdate").alias("l_shipdate")).distinct()
    return _li(spark, d).join(loaded, "l_shipdate", "left_anti").groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("rows"))


@query("join_11_id_overlap", """WITH a AS (SELECT DISTINCT c_custkey AS id FROM customer), b AS (SELECT DISTINCT o_custkey AS id FROM orders)
 SELECT (SELECT COUNT(*) FROM a) AS ids_a, (SELECT COUNT(*) FROM b) AS ids_b, COUNT(*) AS common,
 ROUND(100.0 * COUNT(*) / ((SELECT COUNT(*) FROM a) + (SELECT COUNT(*) FROM b)), 2) AS pct_of_sum FROM a JOIN b ON a.id = b.id""")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return sets.id_overlap(a, table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")
