"""Incremental jobs: new files only, replay-safe sinks, stream results equal to batch."""

import gzip
import json
import shutil

import pytest
from pyspark.sql import functions as F

from tidelog.plans import load, q_tables
from tidelog.plans.registry import QUERIES
from tidelog.sources import raw_json
from tidelog.sources.published import Published
from tidelog.streaming import jobs

load()


def write_lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_ingest_takes_only_new_files(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    run = lambda: jobs.run_to_end(jobs.ingest_new_files(
        spark, str(src), f"{out}/rows", f"{out}/bad", f"{out}/state", ["a"], files_per_batch=1))
    write_lines(src, "1.json", [{"a": 1}, "broken", {"a": 2}])
    run()
    write_lines(src, "2.json", [{"a": 3}])
    run()
    run()
    assert sorted(r.a for r in spark.read.parquet(f"{out}/rows").collect()) == ["1", "2", "3"]
    bad = spark.read.parquet(f"{out}/bad").collect()
    assert [r.value for r in bad] == ["broken"] and bad[0].file.endswith("1.json")


def test_ingest_stores_parsed_lines_instead_of_caching_them(spark, tmp_path, monkeypatch):
    """Cached variants fill the executors' memory; what is stored instead holds none, and goes with its batch."""
    src, out = tmp_path / "in", tmp_path / "out"
    cached, stored = [], []
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda df, *a: cached.append(df) or df)
    outcomes = raw_json.outcomes
    monkeypatch.setattr(raw_json, "outcomes", lambda *a: stored.append(outcomes(*a)) or stored[-1])
    write_lines(src, "1.json", ['{"a": 1, "a": 7}', "broken", {"a": [1, {"b": 2}]}, '"text"', {"b": 1}, "", {"a": True}, {"a": "-"}])
    jobs.run_to_end(jobs.ingest_new_files(spark, str(src), f"{out}/rows", f"{out}/bad", f"{out}/state", ["a"], files_per_batch=1))
    assert not cached and [t for _, t in stored[0].dtypes if t in ("variant", "map<string,string>")] == []
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert sorted(str(r.a) for r in rows) == ["7", "None", "None", "True", '[1,{"b":2}]'] and {r._src_file.rsplit("/", 1)[1] for r in rows} == {"1.json"}
    bad = sorted((r.error, r.value, r.stage, r.file.rsplit("/", 1)[1]) for r in spark.read.parquet(f"{out}/bad").collect())
    assert bad == [("JSON", "broken", "parse", "1.json"), ("Not a JSON object", '"text"', "parse", "1.json")]
    assert sorted(f.name for f in out.iterdir()) == ["bad", "rows", "state"]


def test_error_rows_read_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """Eight files, of any size, were read by a task each; now their number grows with the bytes of both tables."""
    spark.range(500).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id % 20 AS user_id", "'play' AS event_type", "CAST(id AS DOUBLE) AS value").write.parquet(str(tmp_path / "d" / "events.parquet"))
    texts = [("some words\nand more",), (" ",), (None,), ("{broken}",)] * 50
    spark.createDataFrame(texts, "text string").write.parquet(str(tmp_path / "d" / "documents.parquet"))
    monkeypatch.setattr(q_tables, "run_folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(q_tables, "LINES_FROM", 1000)
    rows = QUERIES["str_2_stream_error_rows"](spark, str(tmp_path / "d")).collect()
    assert [tuple(r) for r in rows] == [("parse", "JSON", 100)]
    assert len([f for f in (tmp_path / "ingest" / "in").iterdir() if f.name.endswith(".gz")]) > 8


def requests(spark, rows):
    df = spark.createDataFrame(rows, "reqTimeSec string, cliIP string, UA string, statusCode string, totalBytes string")
    return df


def test_windows_and_sessions_in_append_mode(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(str(t), "i", "u", "200", "5") for t in (0, 100, 1900, 3701, 3800, 9000)]
    # a far later row closes every window before it
    for i, part in enumerate((rows[:3], rows[3:], [("100000000", "z", "z", "200", "1")])):
        requests(spark, part).coalesce(1).write.mode("append").parquet(str(src))
    batch = spark.read.parquet(str(src))
    stream = lambda: jobs.with_event_time(jobs.stream_table(spark, str(src)))
    jobs.run_to_end(jobs.to_table(jobs.hourly_counts(stream(), "1 day"), str(tmp_path / "h"), str(tmp_path / "hs")))
    hours = {r.hour_ts: r.requests for r in spark.read.parquet(str(tmp_path / "h")).collect()}
    assert hours == {0: 3, 3600: 2, 7200: 1}
    assert sum(hours.values()) == batch.count() - 1
    jobs.run_to_end(jobs.to_table(jobs.user_sessions(stream(), delay="1 day"), str(tmp_path / "s"), str(tmp_path / "ss")))
    got = sorted((r.session_start, r.session_end, r.requests) for r in spark.read.parquet(str(tmp_path / "s")).collect())
    assert got == [(0, 1900, 3), (3701, 3800, 2), (9000, 9000, 1)]


def test_dedup_within_watermark(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 0), ("a", 0), ("b", 10)], "k string, t long").coalesce(1).write.parquet(src)
    spark.createDataFrame([("a", 20), ("c", 30)], "k string, t long").coalesce(1).write.mode("append").parquet(src)
    stream = jobs.stream_table(spark, src).withColumn("event_time", F.timestamp_seconds("t"))
    once = jobs.deduplicated(stream, ["k"], "event_time", "1 hour").select("k")
    jobs.run_to_end(jobs.to_table(once, str(tmp_path / "o"), str(tmp_path / "s")))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b", "c"]


def with_files(df):
    meta = [F.col(f"_metadata.{n}").alias(n) for n in ("file_path", "file_size", "file_modification_time")]
    names = {"state": "s", "country": "IN", "city": "c", "asn": "AS1", "queryStr": "device_id=d", "reqPath": "p/x.ts"}
    return df.select("*", *meta).withColumns({k: F.lit(v) for k, v in names.items()})


def test_summary_refresh_touches_only_changed_dates(spark, tmp_path):
    src, root = (str(tmp_path / n) for n in ("in", "tables"))
    requests(spark, [("10", "i", "u", "200", "1"), ("86410", "i", "u", "200", "1")]).coalesce(1).write.parquet(src)
    run = lambda: sorted(str(r.event_date) for r in jobs.refresh_summary(spark, with_files(spark.read.parquet(src)), root).collect())
    summed = lambda: {str(r.event_date): r.n for r in Published(spark, root).read("summary").groupBy("event_date").agg(F.sum("requests").alias("n")).collect()}
    assert run() == ["1970-01-01", "1970-01-02"]
    assert run() == []
    requests(spark, [("86500", "i", "u", "200", "1")]).coalesce(1).write.mode("append").parquet(src)
    assert run() == ["1970-01-02"]
    assert summed() == {"1970-01-01": 1, "1970-01-02": 2}


def test_refresh_that_dies_changes_nothing_and_is_repeated(spark, tmp_path, monkeypatch):
    src, root = (str(tmp_path / n) for n in ("in", "tables"))
    day = lambda t: requests(spark, [(str(t), "i", "u", "200", "1")])
    day(10).write.parquet(f"{src}/a")
    day(86410).write.parquet(f"{src}/b")
    run = lambda: sorted(str(r.event_date) for r in jobs.refresh_summary(spark, with_files(spark.read.option("recursiveFileLookup", True).parquet(src)), root).collect())
    run()
    before = sorted(map(tuple, Published(spark, root).read("summary").collect()))
    shutil.rmtree(f"{src}/b")  # a date loses its only file
    day(20).write.parquet(f"{src}/c")
    for step in ("stage", "_swap"):
        with monkeypatch.context() as m:
            m.setattr(Published, step, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                run()
        assert sorted(map(tuple, Published(spark, root).read("summary").collect())) == before
    assert run() == ["1970-01-01", "1970-01-02"]  # the lost date is still known
    left = Published(spark, root).read("summary").groupBy("event_date").agg(F.sum("requests").alias("n")).collect()
    assert [(str(r.event_date), r.n) for r in left] == [("1970-01-01", 2)]


def test_published_partitions_and_vacuum(spark, tmp_path):
    store = Published(spark, str(tmp_path / "t"))
    assert store.read("r") is None
    rows = lambda *r: spark.createDataFrame(list(r), "day string, v long")
    store.replace(rows(("a", 1), ("b", 2), ("c", 3)), "r", "day")
    old = store.read("r")
    store.commit({"r": {**store.stage(rows(("b", 20)), "r", "day"), "day=c": None}, "s": store.stage(rows(("x", 9)), "s")})
    assert sorted(map(tuple, store.read("r").select("day", "v").collect())) == [("a", 1), ("b", 20)]
    assert sorted(map(tuple, old.select("day", "v").collect())) == [("a", 1), ("b", 2), ("c", 3)]  # a reader of the old state is not disturbed
    assert store.read("s").first()["v"] == 9
    store.stage(rows(("z", 5)), "r", "day")
    assert store.vacuum() == 0 and store.vacuum(older_than_ms=-1) == 3
    assert sorted(map(tuple, store.read("r").select("day", "v").collect())) == [("a", 1), ("b", 20)] and store.read("s").count() == 1


def test_ledger_skips_known_content(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    run = lambda state: jobs.run_to_end(jobs.ingest_new_files(
        spark, str(src), f"{out}/{state}/rows", f"{out}/{state}/bad", f"{out}/{state}/state", ["a"], files_per_batch=2, ledger=f"{out}/ledger"))
    got = lambda state: sorted(r.a for r in spark.read.parquet(f"{out}/{state}/rows").collect())
    write_lines(src, "1.json", [{"a": 1}, {"a": 2}])
    write_lines(src, "2.json", [{"a": 1}, {"a": 2}])  # twins in one batch
    write_lines(src, "3.json", [{"a": 1}, {"a": 1}])  # equal lines cancel in no fold
    run("x")
    assert got("x") == ["1", "1", "1", "2"]
    write_lines(src, "4.json", [{"a": 2}, {"a": 1}])
    write_lines(src, "5.json", [{"a": 5}])
    (src / "6.json.gz").write_bytes(gzip.compress((src / "1.json").read_bytes()))
    run("x")
    assert got("x") == ["1", "1", "1", "2", "5"]
    write_lines(src, "7.json", [{"a": 7}])
    run("y")  # a fresh checkpoint sees every file again, the ledger only one new content
    assert got("y") == ["7"]
    assert spark.read.parquet(f"{out}/ledger").count() == 4


def test_replayed_batch_decides_as_before(spark, tmp_path):
    lines = spark.createDataFrame([("f1", "a"), ("f1", "b"), ("f2", "c")], "_src_file string, value string")
    rows, seen = jobs._unseen(lines, str(tmp_path / "ledger"), "run", 0)
    assert rows.count() == 3
    seen.write.partitionBy("run", "batch").parquet(str(tmp_path / "ledger"))
    again, _ = jobs._unseen(lines, str(tmp_path / "ledger"), "run", 0)
    later, _ = jobs._unseen(lines, str(tmp_path / "ledger"), "run", 1)
    assert again.count() == 3 and later.count() == 0


def test_report_rebuilds_touched_dates(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame(list(r), "date string, v long").coalesce(1)
    build = lambda df: df.groupBy("date").agg(F.sum("v").alias("v"))

    def run():
        stream = jobs.stream_table(spark, src)
        jobs.run_to_end(jobs.report_new_rows(stream, str(tmp_path / "l"), str(tmp_path / "r"), str(tmp_path / "s"), "date", build))
        return {str(r.date): r.v for r in spark.read.parquet(str(tmp_path / "r")).collect()}

    rows(("2024-01-01", 1), ("2024-01-02", 2)).write.parquet(src)
    assert run() == {"2024-01-01": 1, "2024-01-02": 2}
    rows(("2024-01-02", 5)).write.mode("append").parquet(src)
    assert run() == {"2024-01-01": 1, "2024-01-02": 7}


def test_ledger_batches_follow_the_bytes(spark, tmp_path, monkeypatch):
    """Batches of three files: their number must come from the log's size, not from the number of shuffle partitions."""
    spark.range(3000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id % 20 AS user_id", "'play' AS event_type", "CAST(id AS DOUBLE) AS value").write.parquet(str(tmp_path / "d" / "events.parquet"))
    monkeypatch.setattr(q_tables, "run_folder", lambda spark, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        rows = QUERIES["str_3_content_ledger"](spark, str(tmp_path / "d"))
        assert rows.count() == rows.select("event_id").distinct().count() == 3000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    names = lambda at: [f for f in (tmp_path / "ledger" / "in" / at).iterdir() if f.name.endswith(".gz")]
    assert len(names("first")) == len(names("renamed")) < 8  # 24 before
    assert not {f.name for f in names("first")} & {f.name for f in names("renamed")}
    assert spark.read.parquet(str(tmp_path / "ledger" / "ledger")).count() == len(names("first"))
