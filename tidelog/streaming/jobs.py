"""Incremental jobs: file-stream ingest, deduplication, windowed counts, report upkeep.

All of them restart from their checkpoint: a file is processed once, a failed batch is
replayed, and sinks write per batch id or replace whole dates, so a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import clock
from ..model import COLS, ColMap, typed
from ..operators import summary
from ..operators.users import with_pseudo_user
from ..sources import raw_json
from ..session import staged
from ..sources.published import Published
from ..sources.sinks import drop_folder, existing, replace_dates, write_parquet

SUMMARY_VERSION = 1
MAX_AGE_DAYS = 7


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()


def content_digests(lines: DataFrame, file: str = "_src_file") -> DataFrame:
    """(file, digest, lines) per file: its number of lines and two order-free folds of their 64-bit hashes, all in Spark.

    A copy under another name, or packed anew, has the same digest; a file of any size is folded map-side. Equal lines in another order count as the same content.
    """
    h = F.xxhash64("value")
    per = lines.groupBy(file).agg(
        F.count(F.lit(1)).alias("lines"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("x"), F.sum(F.xxhash64(h, F.lit(2)).cast("decimal(38,0)")).alias("s"))
    return per.select(file, F.concat_ws(":", F.col("lines").cast("string"), F.hex("x"), F.col("s").cast("string")).alias("digest"), "lines")


def _unseen(lines: DataFrame, ledger: str, run: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Lines of files whose content neither the ledger nor an earlier name in this batch holds, and the ledger rows of those files.

    Ledger rows of this very batch do not count, so a replay decides as the first try did. The files of a batch are at most ``files_per_batch``.
    """
    spark = lines.sparkSession
    found = staged(content_digests(lines), "digests")
    first = found.groupBy("digest").agg(F.min("_src_file").alias("_src_file"), F.first("lines").alias("lines"))
    known = existing(spark, ledger)
    if known is not None:
        known = known.where(~((F.col("run") == run) & (F.col("batch") == batch_id))).select("digest")
        first = first.join(known.distinct(), "digest", "left_anti")
    first = staged(first, "unseen")
    rows = first.select("digest", F.col("_src_file").alias("file"), "lines", F.lit(run).alias("run"), F.lit(batch_id).cast("long").alias("batch"))
    return lines.join(F.broadcast(first.select("_src_file")), "_src_file", "left_semi"), rows


def ingest_new_files(
    spark: SparkSession, source: str, table: str, errors: str, checkpoint: str, columns: list[str], files_per_batch: int = 2000, ledger: str | None = None
) -> StreamingQuery:
    """Process files not seen before: good rows to ``table``, bad lines to ``errors``.

    Both sinks are partitioned by batch id and overwrite only that partition, so a batch
    replayed after a failure does not duplicate rows. With ``ledger``, a table of content digests, a file
    whose content was processed before, under whatever name, adds nothing; the ledger is written last.
    While a batch runs, its parsed lines are stored beside the checkpoint, in a folder named after it.
    """
    held = f"{checkpoint.rstrip('/')}-parsed"
    lines = (
        spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(source)
        .select("value", F.col("_metadata.file_path").alias("_src_file"))
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        # one task per unsplittable file reads; the parse runs on an even spread, in as many tasks as the batch's bytes call for
        own = batch.sparkSession
        seen = None
        if ledger is not None:
            run = own.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
            batch, seen = _unseen(batch, ledger, run, batch_id)
        parsed = raw_json.outcomes(raw_json.parse(raw_json.spread(batch)), columns)
        try:
            # two sinks read it: a stored table takes no memory, where cached variants, in column buffers of 20 MB and more, end an executor
            write_parquet(parsed, held)
            parsed = own.read.schema(parsed.schema).parquet(held)
            sinks = [
                (raw_json.rows_as_text(parsed, columns, keep_source=True).withColumn("batch", F.lit(batch_id)), table, ["batch"]),
                (raw_json.error_rows(parsed, str(batch_id)).withColumn("batch", F.lit(batch_id)), errors, ["batch"]),
            ]
            if seen is not None:
                sinks.append((seen, ledger, ["run", "batch"]))
            for df, path, by in sinks:
                df.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
        finally:
            drop_folder(own, held)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_table(spark: SparkSession, folder: str, pattern: str = "*.parquet", like: DataFrame | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is that of the files present now."""
    schema = like.schema if like is not None else spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def with_event_time(df: DataFrame, cols: ColMap = COLS) -> DataFrame:
    return typed(df, cols).withColumn("event_time", F.timestamp_seconds("req_ts"))


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Drop rows whose key was already seen within the delay; state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def hourly_counts(stream: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Requests, bytes and errors per hour."""
    return (
        stream.withWatermark("event_time", delay).groupBy(F.window("event_time", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.sum(F.col("totalBytes").try_cast("long")).alias("bytes"),
             F.count_if(F.col("statusCode").try_cast("long") >= 400).alias("errors"))
        .select(F.unix_seconds("w.start").alias("hour_ts"), "requests", "bytes", "errors")
    )


def user_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Gap sessions per pseudo user. Rows later than the delay are dropped, which a batch run never does."""
    return (
        with_pseudo_user(stream).withWatermark("event_time", delay)
        .groupBy("pseudo_user", F.session_window("event_time", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.min("req_ts").alias("session_start"), F.max("req_ts").alias("session_end"))
        .select("pseudo_user", "session_start", "session_end", "requests")
    )


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet until its input is used up.

    ``append`` emits closed windows only and keeps bounded state. ``complete`` rewrites the
    whole result table each batch; use it for results that are small, such as hours.
    """
    out = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return out.outputMode("append").format("parquet").option("path", path).start()
    return out.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()


def report_new_rows(
    stream: DataFrame, lake_path: str, report_path: str, checkpoint: str, date: str, build
) -> StreamingQuery:
    """Append stream rows to a lake and rebuild the report of the dates they touch.

    ``build`` maps lake rows to report rows with column ``date``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch", F.lit(batch_id))
        rows.write.partitionBy(date, "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(lake_path)
        touched = batch.select(date).distinct()
        lake = spark.read.parquet(lake_path)
        replace_dates(build(lake.join(touched, date, "left_semi")), report_path, date)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FILE_KEYS = ["file_path", "file_size", "file_modification_time"]


def valid_snapshot(snapshot: DataFrame, params: str, now: Column) -> DataFrame:
    """Rows (file, date) of the snapshot built with these parameters, this version and within the age limit."""
    return snapshot.where(
        (F.col("version") == SUMMARY_VERSION) & (F.col("params") == params)
        & (F.col("built_at") >= now - F.expr(f"INTERVAL {MAX_AGE_DAYS} DAYS")))


def refresh_summary(spark: SparkSession, logs: DataFrame, root: str, cols: ColMap = COLS, params: str = "") -> DataFrame:
    """Bring the device-day summary up to date; only the dates of new, changed, deleted or too old files are recomputed.

    ``logs`` must keep file metadata in columns file_path, file_size, file_modification_time. Tables "summary" and "snapshot" below ``root`` change in one
    step (`Published`), so a run that dies in between leaves both as they were, and the next run knows the same stale files. The snapshot holds one row
    per (file, date) with the time its file was last summarised, so the dates that a file held before count as well, and a date
    that no file holds any more leaves the summary. Returns the recomputed dates.
    """
    store = Published(spark, root)
    now = spark.range(1).select(F.current_timestamp()).first()[0]
    dated = typed(logs, cols).withColumn("event_date", clock.day_date("req_ts"))
    files = logs.select(*FILE_KEYS).distinct()
    old = store.read("snapshot")
    if old is None:
        stale, kept, gone = files, None, None
    else:
        kept = valid_snapshot(old, params, F.lit(now)).join(files, FILE_KEYS, "left_semi")
        # the lists are as long as the list of files; AQE picks the joins by their size
        stale = files.join(kept.select(*FILE_KEYS).distinct(), FILE_KEYS, "left_anti")
        gone = old.join(kept.select(*FILE_KEYS).distinct(), FILE_KEYS, "left_anti").select("event_date")
    held = stale.join(dated.select(*FILE_KEYS, "event_date").distinct(), FILE_KEYS, "left")
    fresh = held.select(*FILE_KEYS, "event_date", F.lit(SUMMARY_VERSION).alias("version"), F.lit(params).alias("params"), F.lit(now).alias("built_at"))
    following = staged(fresh if kept is None else fresh.unionByName(kept), "snapshot")
    dates = following.where(F.col("built_at") == F.lit(now)).select("event_date")
    dates = staged((dates if gone is None else dates.unionByName(gone)).where(F.col("event_date").isNotNull()).distinct(), "dates")
    todo = dated.join(dates, "event_date", "left_semi").drop("event_date", "req_ts")
    parts: dict = dict(store.stage(summary.device_day(todo, cols), "summary", "event_date"))
    # one row per calendar day at most
    for row in dates.join(following.select("event_date").distinct(), "event_date", "left_anti").collect():
        parts[f"event_date={row[0]}"] = None
    store.commit({"summary": parts, "snapshot": store.stage(following, "snapshot")})
    return dates
