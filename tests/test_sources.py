"""Raw JSON, lakes, inventories, sinks, joins that must refuse."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tidelog.operators import dimensions, sets
from tidelog.plans import load, q_tables
from tidelog.plans.registry import QUERIES
from tidelog.sources import adhoc, inventory, lake, raw_json, sinks

load()

LINES = [
    '{"a": 1, "b": {"x": [1, true]}, "c": true, "d": 1775031224.205, "e": null, "f": "true", "g": "-"}',
    '{"a": "^", "g": "v"}', '{"a": ', "[1, 2]", "junk", "", "   ", '2024-01-01 [node] {"a": "p"}', '{"a": 1} tail', '{"a": 1, "a": 2}', "{}",
]


@pytest.fixture()
def parsed(spark, tmp_path):
    with gzip.open(tmp_path / "one.gz", "wt") as f:
        f.write("\n".join(LINES) + "\n")
    return raw_json.parse(raw_json.read_lines(spark, str(tmp_path)))


def test_tolerant_parse(parsed):
    rows = raw_json.rows_as_text(parsed, ["a", "b", "c", "d", "e", "f", "g"], keep_source=True).collect()
    got = sorted((tuple(r)[1:] for r in rows), key=repr)
    want = sorted([
        ("1", '{"x":[1,true]}', "True", "1775031224.205", None, "true", None), (None, None, None, None, None, None, "v"),
        ("p", None, None, None, None, None, None), ("2", None, None, None, None, None, None), (None,) * 7], key=repr)
    assert got == want
    assert all(r._src_file.endswith("one.gz") for r in rows)


def test_errors_and_profile(parsed):
    errors = sorted((r.error, r.value) for r in raw_json.error_rows(parsed, "b").collect())
    assert errors == [("JSON", "junk"), ("JSON", '{"a": '), ("JSON", '{"a": 1} tail'), ("Not a JSON object", "[1, 2]")]
    counts = raw_json.profile_lines(parsed).first()
    assert (counts.total_rows, counts.valid_rows, counts.invalid_json_rows, counts.nondict_rows) == (9, 5, 3, 1)
    prof = {r.column_name: r for r in raw_json.profile(parsed).collect()}
    assert (prof["g"].present, prof["g"].filled) == (2, 1)
    assert (prof["c"].n_bool, prof["d"].n_float, prof["b"].n_dict, prof["e"].n_null) == (1, 1, 1, 1)
    assert {r.column_name for r in raw_json.blank_columns(raw_json.profile(parsed)).collect()} == {"e"}
    assert {r.column_name for r in raw_json.discover_columns(parsed).collect()} == set("abcdefg")


def test_typed_rows(spark):
    raw = spark.createDataFrame([("1775031224.205", "200", "a%20b", "-"), ("1775031224.205", "200", "a%20b", "-"), ("x", "4xx", "^", "n")], "reqTimeSec string, statusCode string, UA string, other string")
    rows = raw_json.typed_rows(raw).orderBy("UA").collect()
    assert len(rows) == 2
    assert (rows[1].UA, rows[1].statusCode, rows[1].other, rows[1].reqTime.microsecond) == ("a b", 200, None, 205000)
    assert (rows[0].reqTimeSec, rows[0].statusCode, rows[0].UA, rows[0].reqTime) == (None, None, None, None)


def request_rows(spark, n=500):
    return spark.range(n).select(F.col("id").alias("event_id"), (F.lit(1704067200) + F.col("id") * 600).cast("string").alias("reqTimeSec"), F.lit("x").alias("cliIP"))


def test_lake_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "lake")
    lake.build_day_lake(request_rows(spark), path)
    assert lake.partition_columns(spark, path) == ["year", "month", "day"]
    assert sorted(os.listdir(f"{path}/year=2024/month=01"))[0] == "day=01"
    part = lake.read_lake(spark, path, lake.lake_days("2024-01-02", "2024-01-02"))
    assert part.count() == 144
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    # writing the same days again replaces them
    lake.build_day_lake(request_rows(spark, 200), path)
    assert lake.read_lake(spark, path).count() == 500 - 288 + 200
    check = inventory.partition_date_check(lake.read_lake(spark, path)).agg(F.sum("utc_mismatch"), F.sum("ist_mismatch")).first()
    assert check[0] == 0 and check[1] > 0


def test_inventory(spark, tmp_path):
    path = str(tmp_path / "t")
    request_rows(spark, 100).repartition(3).write.parquet(path)
    inventory.file_inventory(spark.read.parquet(path)).write.parquet(str(tmp_path / "snapshot"))
    old = spark.read.parquet(str(tmp_path / "snapshot"))
    assert old.agg(F.sum("rows")).first()[0] == 100
    request_rows(spark, 50).coalesce(1).write.mode("append").parquet(path)
    states = inventory.inventory_diff(old, inventory.file_inventory(spark.read.parquet(path))).groupBy("state").count()
    assert {r.state: r["count"] for r in states.collect()} == {"unchanged": 3, "new": 1}
    request_rows(spark, 5).drop("cliIP").coalesce(1).write.mode("append").parquet(path)
    drift = inventory.schema_drift(inventory.footers(inventory.list_files(spark, path)))
    assert {r.column: (r.files_with, r.files_without) for r in drift.collect()} == {"event_id": (5, 0), "reqTimeSec": (5, 0), "cliIP": (4, 1)}


def test_report_sinks(spark, tmp_path):
    path = str(tmp_path / "r")
    rep = lambda *rows: spark.createDataFrame(list(rows), "date string, n int")
    sinks.append_new_dates(rep(("2024-01-01", 1)), path, "date")
    sinks.append_new_dates(rep(("2024-01-01", 9), ("2024-01-02", 2)), path, "date")
    got = lambda: [(str(r.date), r.n) for r in sinks.read_report(spark, path, "date").collect()]
    assert got() == [("2024-01-01", 1), ("2024-01-02", 2)]
    sinks.replace_dates(rep(("2024-01-02", 7), ("2024-01-03", 3)), path, "date")
    assert got() == [("2024-01-01", 1), ("2024-01-02", 7), ("2024-01-03", 3)]


def test_map_join_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    good = spark.createDataFrame([(1, "a")], "k int, v string")
    assert sorted(dimensions.unique_left_join(df, good, ["k"]).collect()) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="not unique"):
        dimensions.unique_left_join(df, good.unionByName(good), ["k"]).collect()


def test_adhoc_is_read_only(spark):
    df = spark.range(5)
    assert adhoc.read_only_sql(df, "select count(*) n from rows;").first().n == 5
    for bad in ("drop table x", "select 1; drop table x", "insert into x select 1"):
        with pytest.raises(ValueError):
            adhoc.read_only_sql(df, bad)


def test_all_pairs_overlap_counts_distinct_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 1), ("a", 2), ("b", 2), ("c", 3)], "s string, v int")
    got = {(r.source_a, r.source_b): r.common_rows for r in sets.all_pairs_overlap(df, "s", ["v"]).collect()}
    assert got == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    once = sets.exact_dedup(df)
    assert once.count() == sets.exact_dedup(once).count() == 2
    assert tuple(sets.dedup_counts(df).first()) == (3, 2, 1)


def test_identical_files(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name, body in (("a", b"same"), ("b", b"same"), ("c", b"diff"), ("d", b"longer")):
        (tmp_path / "f" / name).write_bytes(body)
    rows = inventory.identical_files(spark, str(tmp_path / "f")).collect()
    assert sorted(r.path[-1] for r in rows) == ["a", "b"] and {r.copies for r in rows} == {2}


def test_identical_folders_of_parts(spark, tmp_path):
    """A folder is a file: equal parts in the same order, and no part more."""
    for name, bodies in {"a": ["1x", "2"], "b": ["1x", "2"], "swapped": ["2", "1x"], "more": ["1x", "2", "2"], "less": ["1x"], "other": ["1x", "longer"], "deep/a": ["1x", "2"]}.items():
        (tmp_path / "f" / name).mkdir(parents=True)
        for i, body in enumerate(bodies):
            (tmp_path / "f" / name / f"part-{i:05d}-{name[:1]}").write_text(body)
    rows = inventory.identical_files(spark, str(tmp_path / "f"), part_folders=True).collect()
    assert sorted(r.path.split("/f/")[1] for r in rows) == ["a/", "b/", "deep/a/"] and {r.copies for r in rows} == {3}


def test_identical_files_compares_whole_orders(spark, tmp_path, monkeypatch):
    """Every row and every column is in the two files, priorities that are NULL and keys that repeat included; the parts are small."""
    orders = [(i % 40, i % 7, None if i % 5 == 0 else f"{i % 5}-p", float(i)) for i in range(400)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").repartition(3).write.parquet(str(tmp_path / "d" / "orders.parquet"))
    spark.range(30).selectExpr("id AS c_custkey", "'x' AS c_name").write.parquet(str(tmp_path / "d" / "customer.parquet"))
    monkeypatch.setattr(q_tables, "run_folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(q_tables, "PART_FROM", 1000)
    assert [tuple(r) for r in QUERIES["set_9_identical_files"](spark, str(tmp_path / "d")).collect()] == [(2, 2)]
    names = lambda copy: sorted(p.name for p in (tmp_path / "same" / f"copy={copy}").glob("*.parquet"))
    assert names("a") == names("b") and len(names("a")) > 2  # by one write: footers of two processes differ
    for name in ("a", "b"):
        got = spark.read.parquet(str(tmp_path / "same" / f"copy={name}"))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(orders, key=repr)
        assert got.columns == ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"]


def test_identical_files_of_empty_orders(spark, tmp_path):
    spark.createDataFrame([], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(3).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    assert [tuple(r) for r in QUERIES["set_9_identical_files"](spark, str(tmp_path)).collect()] == [(2, 2)]


def test_lookup_lake_has_filters_and_reads_little(spark, tmp_path):
    path = str(tmp_path / "lookup")
    rows = spark.range(0, 60_000, 1, 4).select(
        F.lit("2024-01-01").alias("day"), F.concat(F.lit("d"), F.xxhash64("id") % 700).alias("device_id"), F.concat(F.lit("s"), F.xxhash64("id") % 6000).alias("session_id"), F.col("id").alias("v"))
    lake.write_lookup(rows, path, "day", "device_id", ["session_id"], values=700, block_bytes=16_384)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    kept, groups = 0, 0
    for f in spark.read.parquet(path).inputFiles():
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf))
        for block in reader.getFooter().getBlocks():
            groups += 1
            kept += sum(1 for c in block.getColumns() if c.getPath().toDotString() == "session_id" and c.getBloomFilterOffset() > 0)
        reader.close()
    assert groups > 20 and kept == groups

    def scanned(condition):
        df = spark.read.parquet(path).where(condition)
        n = df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        node = leaves.apply(0)
        plan = node.executedPlan().collectLeaves().apply(0) if "QueryStage" in node.getClass().getName() else node
        return len(n), plan.metrics().apply("numOutputRows").value()

    some = spark.read.parquet(path).first()
    n, read = scanned(F.col("device_id") == some["device_id"])
    assert n == rows.where(F.col("device_id") == some["device_id"]).count() and read < 0.05 * 60_000
    n, read = scanned(F.col("session_id") == some["session_id"])
    assert n == rows.where(F.col("session_id") == some["session_id"]).count() and read < 0.5 * 60_000
    assert scanned(F.col("device_id") == "d-none")[1] <= 0.05 * 60_000


def test_footer_stats_read_no_rows(spark, tmp_path):
    path = str(tmp_path / "lake")
    spark.range(100).selectExpr("id % 3 AS day", "id AS req_ts").write.partitionBy("day").parquet(path)
    df = lake.footer_stats(spark, path, ["day"], "req_ts")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(req_ts), MAX(req_ts)]" in plan and "PushedGroupBy: [day]" in plan
    assert sorted(map(tuple, df.collect())) == [(0, 34, 0, 99), (1, 33, 1, 97), (2, 33, 2, 98)]
    assert tuple(lake.footer_stats(spark, path, column="req_ts").first()) == (100, 0, 99)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # set for that read only


def test_object_store_by_another_scheme(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 2 AS day").write.partitionBy("day").parquet(str(tmp_path / "lake"))
    options = {"fs.viewfs.mounttable.elsewhere.link./lake": f"file://{tmp_path}/lake"}
    df = lake.read_object_store(spark, "viewfs://elsewhere/lake", "http://store.invalid", options=options, where=F.col("day") == 1)
    assert sorted(r.id for r in df.collect()) == [1, 3, 5, 7, 9]
    assert spark._jsc.hadoopConfiguration().get("fs.s3a.endpoint") is None  # options of one read stay with it
    with pytest.raises(Exception):
        lake.read_object_store(spark, "viewfs://unmounted/lake").count()


def test_columns_per_file(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "x")], "a long, b string").coalesce(1).write.parquet(str(tmp_path / "t" / "one"))
    spark.createDataFrame([(3,)], "a long").coalesce(1).write.parquet(str(tmp_path / "t" / "two"))
    got = sorted((r.rows, r.columns, r.filled) for r in inventory.file_columns(spark, str(tmp_path / "t")).collect())
    assert got == [(1, ["a"], 1), (2, ["a", "b"], 2)]


def test_all_rollups_in_one_pass(spark):
    from tidelog.operators import summary

    rows = [("2024-01-01", "IN", r, c, ch, t, f"d{i % 5}", f"s{i % 7}", i + 1) for i, (r, c, ch, t) in enumerate([("r1", "c1", "x", "tv"), ("r1", "c2", "y", "tv"), ("r2", "c1", "x", None), (None, "c1", "x", "web")] * 3)]
    df = spark.createDataFrame(rows, "event_date string, country string, region string, city string, channel_name string, device_type string, device_id string, session_id string, requests long")
    got = summary.all_rollups(df)
    for name, (keys, fields) in summary.GRAINS.items():
        cols = [*keys, "requests", *fields]
        assert sorted(map(str, got.where(F.col("grain") == name).select(*cols).collect())) == sorted(map(str, summary.named_rollup(df, name).select(*cols).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_folder_checks(spark, tmp_path):
    from tidelog.operators import health

    root = tmp_path / "lake"
    for day, name, content in (("year=2024/month=01/day=01", "a.parquet", b"x" * 2000), ("year=2024/month=01/day=03", "b.parquet", b""), ("year=2024/month=01/day=05", "c.parquet", b"x"), ("year=2024/month=13/day=01", "d.parquet", b"x" * 2000), ("loose", "e.parquet", b"x" * 2000)):
        (root / day).mkdir(parents=True)
        (root / day / name).write_bytes(content)
    got = {r.check_name: (r.status, r.detail) for r in health.folder_checks(spark, str(root), "2024-01-01", "2024-01-04").collect()}
    assert got == {
        "files": ("OK", "4 files"), "small_files": ("WARN", "1 files under 1024 bytes"), "partition_folders": ("FAIL", "2 files outside a day folder"),
        "days_present": ("FAIL", "3 days missing, first 2024-01-02"), "days_in_range": ("WARN", "1 days outside the range"),
    }


def test_merge_files_packs_whole_files_without_a_shuffle(spark, tmp_path):
    many, few = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(0, 6000, 1, 6).withColumn("from_file", F.spark_partition_id()).write.parquet(many)
    size = max(os.path.getsize(f"{many}/{n}") for n in os.listdir(many) if n.endswith(".parquet"))
    assert lake.merge_files(spark, many, few, 2 * size + 100) == 3
    got = spark.read.parquet(few)
    assert got.count() == got.select("id").distinct().count() == 6000
    per = got.groupBy("from_file").agg(F.count_distinct(F.col("_metadata.file_path")).alias("n"))
    assert [r.n for r in per.collect()] == [1] * 6  # no file's rows were dealt over tasks
    assert lake.merge_files(spark, many, few) == 1 and spark.read.parquet(few).count() == 6000


def test_first_record_of_files_in_parts(spark, tmp_path):
    path = str(tmp_path / "hosts")
    at = lambda i: F.lit(1704067200) + F.col("id") * i
    a = spark.range(4000).select("id", F.lit("a").alias("host"), at(60).cast("string").alias("reqTimeSec"))
    b = spark.range(4000, 8000).select("id", F.lit("b").alias("host"), at(-60).cast("string").alias("reqTimeSec"))
    a.unionByName(b).repartitionByRange(8, "host", "id").sortWithinPartitions("host", "id").write.partitionBy("host").parquet(path)
    files = inventory.scanned_files(spark.read.parquet(path))
    assert files.select("file_path").distinct().count() >= 8
    for date, name in (("2024-01-01", "a"), ("2023-12-29", "b")):  # day of the first record by id, which is the least time of a and the greatest of b
        hit = inventory.files_starting_on(inventory.as_part_folders(files), date, "file_row").collect()
        assert [r.file_path.split("/")[-2] for r in hit] == [f"host={name}"] and hit[0].utc_match
