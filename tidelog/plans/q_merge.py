"""Counts and quantiles that merge: stored bitmaps, HLL, Theta and KLL sketches (AGG-6, AGG-13, AGG-29, AGG-30, AGG-39, AGG-43, AGG-50, JOIN-11)."""

from pyspark.sql import functions as F

from ..functions import clock
from ..functions.querystring import qs_value
from ..model import typed
from ..operators import bitmaps, diagnostics, sketches
from ..operators.cdn import num
from ..session import run_folder, staged
from .q_cdn import _DIMS
from .q_identity import _DD, _summary
from .q_watch import _C, _clean
from .registry import day, logs, on_logs, query, table, x

_KEYS = ["country", "region", "channel_name", "device_type"]


def _days(spark, d):
    """Folder of the stored days of the device-day summary; the first day is added apart from the others, so the dictionary grows once."""
    folder = run_folder(spark, "distincts")
    summary = staged(_summary(spark, d), "device-days")  # both additions read it, each for its values and its requests
    first = F.col("event_date") <= F.lit("2024-01-01").cast("date")
    bitmaps.add_days(summary.where(first), folder, _KEYS)
    bitmaps.add_days(summary.where(~first), folder, _KEYS)
    return folder


def _exact(by, where="true"):
    names = ", ".join(by)
    return f"""SELECT {''.join(f'{e} AS {n}, ' for n, e in by.items())}CAST(SUM(requests) AS BIGINT) AS requests, COUNT(DISTINCT session_id) AS sessions, COUNT(DISTINCT device_id) AS devices,
 COUNT(DISTINCT channel_name) AS channels, COUNT(DISTINCT city) AS cities FROM dd WHERE {where} {f'GROUP BY {names}' if by else ''}"""


_ALL = ["sessions", "devices", "channels", "cities"]
# name -> (output column -> expression that both engines read, filter on the day)
_RANGES = {
    "agg_30_weekly_countries": ({"week": "CAST(date_trunc('week', event_date) AS DATE)", "country": "country"}, "true"),
    "agg_30_monthly_device_types": ({"month": "CAST(date_trunc('month', event_date) AS DATE)", "device_type": "device_type"}, "true"),
    "agg_30_range_regions": ({"country": "country", "region": "region"}, "event_date BETWEEN DATE '2024-01-02' AND DATE '2024-01-04'"),
    "agg_30_range_kpis": ({}, "event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-03'"),
    "agg_29_range_channels": ({"channel_name": "channel_name"}, "true"),
}


def _register_range(name, by, where):
    @query(name, on_logs(_exact(by, where), _DD))
    def _(spark, d):
        return bitmaps.report(spark, _days(spark, d), {n: F.expr(e) for n, e in by.items()}, _ALL, F.expr(where))


for _name, _spec in _RANGES.items():
    _register_range(_name, *_spec)


@query("agg_30_trailing_three_days", on_logs("""SELECT a.event_date, COUNT(DISTINCT b.session_id) AS sessions, COUNT(DISTINCT b.device_id) AS devices
 FROM (SELECT DISTINCT event_date FROM dd) a JOIN dd b ON b.event_date BETWEEN a.event_date - 2 AND a.event_date GROUP BY 1""", _DD))
def _(spark, d):
    return bitmaps.trailing(spark, _days(spark, d), 3, ["sessions", "devices"])


# sketches: stored per day, merged, then held against exact counts
_BOUND = 0.03
_OK = lambda names: ", ".join(f"true AS {n}_ok" for n in names)


def _stored(df, name):
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@query("agg_6_stored_sketches", f"SELECT COUNT(DISTINCT l_orderkey) AS l_orderkey, COUNT(DISTINCT l_partkey) AS l_partkey, COUNT(DISTINCT l_suppkey) AS l_suppkey, {_OK(('l_orderkey', 'l_partkey', 'l_suppkey'))} FROM lineitem")
def _(spark, d):
    names = ["l_orderkey", "l_partkey", "l_suppkey"]
    rows = table(spark, d, "lineitem")
    kept = _stored(sketches.daily_sketches(rows, ["l_returnflag", "l_linestatus"], {n: n for n in names}), "sketches")
    exact = rows.agg(*[F.count_distinct(n).alias(n) for n in names])
    return sketches.within(sketches.estimates(sketches.merged(kept, []), [], names), exact, [], names, _BOUND)


_MONTH_FIELDS = {"ips": "cliIP", "agents": "UA", "paths": "reqPath", "devices": "device_id", "sessions": "session_id"}
_MONTH_SQL = f"SELECT CAST(date_trunc('month', {day()}) AS DATE) AS month, " + ", ".join(
    f"COUNT(DISTINCT {x(c) if c.endswith('_id') else c}) AS {n}, true AS {n}_ok" for n, c in _MONTH_FIELDS.items()) + " FROM t GROUP BY 1"


@query("agg_13_monthly_from_day_sketches", on_logs(_MONTH_SQL))
def _(spark, d):
    rows = typed(logs(spark, d)).withColumns({k: qs_value("queryStr", k) for k in ("device_id", "session_id")}).withColumn("utc_date", clock.day_date("req_ts"))
    month = F.date_trunc("month", "utc_date").cast("date").alias("month")
    names = list(_MONTH_FIELDS)
    kept = _stored(sketches.daily_sketches(rows, ["utc_date"], _MONTH_FIELDS), "sketches")
    exact = rows.groupBy(month).agg(*[F.count_distinct(c).alias(n) for n, c in _MONTH_FIELDS.items()])
    return sketches.within(sketches.estimates(sketches.merged(kept, [month]), ["month"], names), exact, ["month"], names, _BOUND)


@query("agg_39_range_from_hour_sketches", on_logs("SELECT " + ", ".join(f"COUNT(DISTINCT {c}) AS {c}, true AS {c}_ok" for c in _DIMS) + " FROM t WHERE req_ts BETWEEN 1704099600 AND 1704301199"))
def _(spark, d):
    rows = typed(logs(spark, d)).withColumn("hour_ts", clock.hour_start("req_ts"))
    kept = _stored(sketches.daily_sketches(rows, ["hour_ts"], {c: c for c in _DIMS}), "sketches")
    inside = F.col("hour_ts").between(1704099600, 1704297600)
    exact = rows.where(inside).agg(*[F.count_distinct(c).alias(c) for c in _DIMS])
    return sketches.within(sketches.estimates(sketches.merged(kept.where(inside), []), [], _DIMS), exact, [], _DIMS, _BOUND)


@query("join_11_overlap_of_stored_days", on_logs(f"""SELECT ids_a, ids_b, common, ids_a - common AS only_a, ids_b - common AS only_b, {_OK(('ids_a', 'ids_b', 'common', 'only_a', 'only_b'))} FROM (
 SELECT COUNT(*) FILTER (WHERE a) AS ids_a, COUNT(*) FILTER (WHERE b) AS ids_b, COUNT(*) FILTER (WHERE a AND b) AS common
 FROM (SELECT {x('device_id')} AS id, bool_or({day()} <= DATE '2024-01-02') AS a, bool_or({day()} > DATE '2024-01-02') AS b FROM t GROUP BY 1) WHERE id IS NOT NULL)"""))
def _(spark, d):
    rows = typed(logs(spark, d)).select(clock.day_date("req_ts").alias("day"), qs_value("queryStr", "device_id").alias("device_id"))
    kept = _stored(sketches.daily_sketches(rows, ["day"], {"devices": "device_id"}), "sketches")
    early = F.col("day") <= F.lit("2024-01-02").cast("date")
    names = ["ids_a", "ids_b", "common", "only_a", "only_b"]
    per = rows.where(F.col("device_id").isNotNull()).groupBy("device_id").agg(F.max(early).alias("a"), F.max(~early).alias("b"))
    count = lambda c, n: F.count_if(c).alias(n)
    a, b = F.col("a"), F.col("b")
    exact = per.agg(count(a, "ids_a"), count(b, "ids_b"), count(a & b, "common"), count(a & ~b, "only_a"), count(b & ~a, "only_b"))
    return sketches.within(sketches.overlap(kept.where(early), kept.where(~early), "devices"), exact, [], names, _BOUND)


# quantiles: the share of rows at or below the sketch's quantile is within the rank bound of the wanted share
_RANK = 0.02
_POINTS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def _rank_ok(rows, column, quantiles):
    """Whether each quantile lies between the exact quantiles _RANK below and above its point; ``quantiles`` is one row."""
    below = rows.crossJoin(F.broadcast(quantiles)).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(column) < F.col(p)).alias(f"{p}_lt") for p in _POINTS], *[F.count_if(F.col(column) <= F.col(p)).alias(f"{p}_le") for p in _POINTS])
    n = F.col("rows")
    return below.select("rows", *[((F.col(f"{p}_lt") <= n * (q + _RANK)) & (F.col(f"{p}_le") >= n * (q - _RANK))).alias(f"{p}_ok") for p, q in _POINTS.items()])


@query("agg_43_gap_quantiles_from_day_sketches", on_logs(f"SELECT COUNT(*) AS rows, {_OK(_POINTS)} FROM (SELECT LEAD(req_ts) OVER (PARTITION BY device_id ORDER BY req_ts) AS nt FROM cd) WHERE nt IS NOT NULL", _C))
def _(spark, d):
    kept = _stored(diagnostics.daily_gap_sketches(_clean(spark, d)), "sketches")
    return _rank_ok(diagnostics.device_gaps(_clean(spark, d)), "gap", sketches.quantiles(sketches.merged(kept, []), [], "gap", _POINTS))


@query("agg_50_throughput_quantiles_from_day_sketches", on_logs(f"SELECT COUNT(*) AS rows, {_OK(_POINTS)} FROM t WHERE TRY_CAST(throughput AS DOUBLE) IS NOT NULL"))
def _(spark, d):
    rows = typed(logs(spark, d)).select(clock.day_date("req_ts").alias("day"), num("throughput").cast("long").alias("throughput")).where(F.col("throughput").isNotNull())
    kept = _stored(sketches.daily_sketches(rows, ["day"], {}, {"throughput": "throughput"}), "sketches")
    return _rank_ok(rows, "throughput", sketches.quantiles(sketches.merged(kept, []), [], "throughput", _POINTS))
