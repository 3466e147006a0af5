"""File and partition inventories."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..model import COLS, IST_OFFSET_SECONDS, ColMap, typed
from ..operators.ranking import counts


def file_inventory(df: DataFrame) -> DataFrame:
    """Rows, size and modification time per file of a scanned frame."""
    meta = [F.col(f"_metadata.{n}").alias(n) for n in ("file_path", "file_size", "file_modification_time")]
    return df.select(*meta).groupBy("file_path", "file_size", "file_modification_time").agg(F.count(F.lit(1)).alias("rows"))


def scanned_files(df: DataFrame) -> DataFrame:
    """df with file_path and file_row, the place of a row in its Parquet file, from the scan's own metadata."""
    return df.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("file_row"))


def _folder_and_part(path: str) -> tuple[Column, Column]:
    part = F.substring_index(path, "/", -1)
    return F.left(path, F.length(path) - F.length(part)), part


def as_part_folders(scanned: DataFrame) -> DataFrame:
    """`scanned_files` with every folder seen as one file: file_path is the folder with a slash, file_row the place by part name and then row.

    Spark numbers the parts of a sorted write in their order, by five digits, so this holds for up to 100,000 parts of a folder.
    """
    folder, part = _folder_and_part("file_path")
    return scanned.withColumns({"file_path": folder, "file_row": F.struct(part.alias("part"), F.col("file_row").alias("row"))})


def file_columns(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(file_path, file_size, file_modification_time, rows, columns, filled) per file: rows and the names of the columns that hold a value, by one scan of the merged schema.

    Files that lack a column and files where it is NULL throughout look alike here; `footers` tells them apart.
    """
    df = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(path)
    meta = [F.col(f"_metadata.{n}").alias(f"_{n}") for n in ("file_path", "file_size", "file_modification_time")]
    per = df.select("*", *meta).groupBy("_file_path", "_file_size", "_file_modification_time").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    names = F.filter(F.array(*[F.when(F.col(f"`{c}`") > 0, F.lit(c)) for c in df.columns]), lambda x: x.isNotNull())
    return per.select(
        F.col("_file_path").alias("file_path"), F.col("_file_size").alias("file_size"), F.col("_file_modification_time").alias("file_modification_time"),
        F.col("_rows").alias("rows"), F.array_sort(names).alias("columns"), F.size(names).alias("filled"))


def inventory_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, changed, unchanged or missing per file, from two inventories."""
    side = lambda df, s: df.select("file_path", F.struct("file_size", "file_modification_time").alias(s))
    j = side(old, "o").join(side(new, "n"), "file_path", "full")
    state = (
        F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "missing")
        .when(F.col("o") == F.col("n"), "unchanged").otherwise("changed")
    )
    return j.select("file_path", state.alias("state"))


def list_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """File listing as a frame, without reading file contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime")


def _open(path: str):
    """Open a listed path on whatever file system its URI names."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def footers(files: DataFrame) -> DataFrame:
    """(path, rows, column, type) read from Parquet footers, the files spread over the cluster.

    Needs a file system that the executors see under the listed paths.
    """

    def read(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch["path"]:
                with _open(path) as f:
                    meta = pq.ParquetFile(f)
                    rows += [(path, meta.metadata.num_rows, c.name, str(c.type)) for c in meta.schema_arrow]
            yield pd.DataFrame(rows, columns=["path", "rows", "column", "type"])

    return files.select("path").mapInPandas(read, "path string, rows long, column string, type string")


def schema_drift(footer_rows: DataFrame) -> DataFrame:
    """Per column: files that have it, files that lack it, the first type and the number of types."""
    total = footer_rows.agg(F.count_distinct("path")).scalar()
    per = footer_rows.groupBy("column").agg(
        F.count_distinct("path").alias("files_with"), F.min(F.struct("path", "type"))["type"].alias("first_type"),
        F.count_distinct("type").alias("types"))
    return per.withColumn("files_without", total - F.col("files_with"))


def time_range(frames: dict[str, DataFrame], ts: str = "req_ts") -> DataFrame:
    """Rows, minimum and maximum time per source kind and overall."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts")).withColumn("source", F.lit(n)) for n, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = out.agg(F.sum("rows").alias("rows"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts")).withColumn("source", F.lit("all"))
    return out.unionByName(total)


def rows_per_partition(lake: DataFrame) -> DataFrame:
    return counts(lake, "year", "month", "day", name="rows")


def partition_date_check(lake: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Rows whose partition date differs from the event date in UTC and in IST."""
    df = typed(lake, cols).withColumn("partition_date", F.make_date(*[F.col(c).cast("int") for c in ("year", "month", "day")]))
    p = F.col("partition_date")
    return df.groupBy("partition_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(p != clock.day_date("req_ts")).alias("utc_mismatch"),
        F.count_if(p != clock.day_date("req_ts", IST_OFFSET_SECONDS)).alias("ist_mismatch"))


def files_starting_on(df: DataFrame, date: str, position: str, cols: ColMap = COLS) -> DataFrame:
    """Files whose first record falls on a date, in UTC and in IST. ``position`` orders rows in a file; `scanned_files` gives it for a scan."""
    first = df.groupBy("file_path").agg(F.min(F.struct(position, cols.ts))[cols.ts].alias(cols.ts))
    first = typed(first, cols)
    target = F.lit(date).cast("date")
    hit = first.select("file_path", "req_ts", (clock.day_date("req_ts") == target).alias("utc_match"),
                       (clock.day_date("req_ts", IST_OFFSET_SECONDS) == target).alias("ist_match"))
    return hit.where("utc_match or ist_match")


def identical_files(spark: SparkSession, path: str, pattern: str = "*", part_folders: bool = False) -> DataFrame:
    """Groups of byte-identical files: only files whose size occurs more than once are read and hashed. The listing has one row per file.

    With ``part_folders`` every folder is seen as one file: path is the folder with a slash, its content the parts in order of name, and folders are identical
    if they have as many parts and these are byte-identical one by one. A task holds a part, not the whole.
    """
    listing = list_files(spark, path, pattern)
    same_size = [r[0] for r in listing.groupBy("length").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("length").collect()]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    hashed = files.where(F.col("length").isin(same_size)).select("path", F.sha2("content", 256).alias("sha256"))
    if part_folders:
        folder, part = _folder_and_part("path")
        parts = listing.groupBy(folder.alias("path")).agg(F.count(F.lit(1)).alias("parts"))
        ordered = F.array_sort(F.collect_list(F.struct(part.alias("part"), "sha256")))["sha256"]
        held = hashed.groupBy(folder.alias("path")).agg(ordered.alias("hashes"))
        # a folder with a part of a size that occurs once is like no other
        hashed = held.join(parts, "path").where(F.size("hashes") == F.col("parts")).select("path", F.sha2(F.array_join("hashes", ""), 256).alias("sha256"))
    group = hashed.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return hashed.join(group, "sha256")
