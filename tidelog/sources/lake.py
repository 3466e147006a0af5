"""Table readers and lake writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import clock
from ..model import COLS, IST_OFFSET_SECONDS, ColMap, typed
from ..operators.sets import union_sources


def read_flat(spark: SparkSession, *paths: str, merge: bool = True) -> DataFrame:
    """Flat set of Parquet files at any depth. ``merge`` unites drifting schemas, which opens every footer. Partition folders are not read as columns."""
    return spark.read.option("mergeSchema", merge).option("recursiveFileLookup", True).parquet(*paths)


def read_lake(
    spark: SparkSession, root: str, where: Column | None = None, merge: bool = False, partitions: StructType | None = None, options: dict[str, str] | None = None
) -> DataFrame:
    """Hive-partitioned lake; predicates on partition columns prune folders before any of their files is opened.

    ``merge`` unites the schemas of all files first, which opens every footer; without it one file gives the schema.
    ``partitions`` fixes the types of partition columns, which are otherwise inferred ('01' becomes the number 1).
    ``options`` reach the file system of this read alone, on the driver and in the tasks.
    """
    reader = spark.read.options(**(options or {})).option("basePath", root).option("mergeSchema", merge)
    df = reader.parquet(root)
    if partitions is not None:
        given = set(partitions.names)
        df = reader.schema(StructType([f for f in df.schema if f.name not in given] + partitions.fields)).parquet(root)
    return df if where is None else df.where(where)


def lake_days(first: str, last: str) -> Column:
    """Predicate on year, month and day columns for a date range; text or number columns alike."""
    day = F.make_date(*[F.col(c).cast("int") for c in ("year", "month", "day")])
    years = F.col("year").cast("int").between(int(first[:4]), int(last[:4]))
    return years & day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Partition columns found in the folder names below ``path``; empty for a flat set."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names, folder = [], jvm.org.apache.hadoop.fs.Path(path)
    while True:
        subs = [s.getPath() for s in fs.listStatus(folder) if s.isDirectory() and "=" in s.getPath().getName()]
        if not subs:
            return names
        names.append(subs[0].getName().split("=", 1)[0])
        folder = subs[0]


def read_any(spark: SparkSession, *paths: str) -> DataFrame:
    """Lakes and flat sets together: each is read in its own way, then all are united by name."""
    frames = [read_lake(spark, p) if partition_columns(spark, p) else read_flat(spark, p) for p in paths]
    return union_sources(*frames)


def read_object_store(
    spark: SparkSession, root: str, endpoint: str | None = None, path_style: bool = True, options: dict[str, str] | None = None, where: Column | None = None
) -> DataFrame:
    """Lake on a remote store, by any Hadoop scheme; credentials come from the cluster's own configuration.

    Endpoint and addressing are options of this read (S3-compatible stores), so two reads may use two stores; ``options`` holds what other schemes need.
    """
    own = {} if endpoint is None else {"fs.s3a.endpoint": endpoint, "fs.s3a.path.style.access": str(path_style).lower()}
    return read_lake(spark, root, where, options={**own, **(options or {})})


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV with a header; every column stays text, as in the raw table."""
    return spark.read.option("header", True).option("inferSchema", False).csv(list(paths))


def latest_days(df: DataFrame, n: int) -> DataFrame:
    """Newest n day partitions; only partition columns are read."""
    cols = ["year", "month", "day"]
    return df.select(*cols).distinct().orderBy(*[F.desc(c) for c in cols]).limit(n)


def with_lake_columns(logs: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Add req_time_utc, req_time_ist and log_date (IST); rows without a numeric time are dropped."""
    df = typed(logs, cols)
    at = lambda off: F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("req_ts") + off)
    return df.withColumns({
        "req_time_utc": at(0), "req_time_ist": at(IST_OFFSET_SECONDS), "log_date": clock.day_date("req_ts", IST_OFFSET_SECONDS),
    })


def with_partition_text(logs: DataFrame, cols: ColMap = COLS, offset: int = 0) -> DataFrame:
    """Add zero-padded year, month and day text columns."""
    day = clock.day_date("req_ts", offset)
    return typed(logs, cols).withColumns({n: F.date_format(day, f) for n, f in (("year", "yyyy"), ("month", "MM"), ("day", "dd"))})


def write_partitioned(
    df: DataFrame, path: str, by: list[str], sort: list[str] = (), rows_per_file: int = 5_000_000, replace: bool = True,
    codec: str = "zstd",
) -> None:
    """Write a lake partitioned by ``by``.

    Rows are rebalanced by partition value: adaptive execution splits a day that holds a third of all rows over many
    tasks of the advisory size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``) and merges small days. ``replace``
    overwrites just the partitions present in ``df``; otherwise files are appended.
    """
    out = df.hint("rebalance", *by).sortWithinPartitions(*by, *sort)
    writer = out.write.partitionBy(*by).option("compression", codec).option("maxRecordsPerFile", rows_per_file)
    if replace:
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode("append").parquet(path)


def build_lake(logs: DataFrame, path: str, cols: ColMap = COLS) -> None:
    """Lake by IST date."""
    write_partitioned(with_lake_columns(logs, cols), path, ["log_date"], ["req_ts"])


def build_day_lake(logs: DataFrame, path: str, cols: ColMap = COLS, replace: bool = True) -> None:
    """Lake by year, month and day text."""
    write_partitioned(with_partition_text(logs, cols).drop("req_ts"), path, ["year", "month", "day"], [cols.ts], replace=replace)


def write_lookup(df: DataFrame, path: str, by: str, key: str, also: list[str] = (), values: int = 1_000_000, block_bytes: int = 64 * 1024 * 1024, codec: str = "zstd") -> None:
    """Lake by ``by`` for point look-ups: rows lie in order of ``key`` within a file, and ``key`` and the columns in ``also`` have Bloom filters per row group.

    A look-up by key opens the row groups whose range holds it; one by another column those whose filter does. ``values`` is the expected number of
    distinct values in a row group and sets the filters' size.
    """
    writer = df.hint("rebalance", by).sortWithinPartitions(by, key).write.partitionBy(by).option("compression", codec).option("parquet.block.size", block_bytes)
    for c in (key, *also):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", values)
    for c in also:  # the writer leaves a filter out where a dictionary holds all values, which high-cardinality ids gain nothing from
        writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
    writer.mode("overwrite").parquet(path)


def footer_stats(spark: SparkSession, path: str, by: list[str] = (), column: str | None = None) -> DataFrame:
    """Rows, and minimum and maximum of a number or date column, per partition, from Parquet footers alone: no data page is read.

    The columnar source with aggregate pushdown is set for this read only, in a session of its own that shares everything else.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    aggs = [F.count(F.lit(1)).alias("rows")] + ([F.min(column).alias(f"min_{column}"), F.max(column).alias(f"max_{column}")] if column else [])
    rows = own.read.parquet(path)
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def optimize(df: DataFrame, time: str, path: str, partitions: int | None = None, block_bytes: int = 256 * 1024 * 1024) -> None:
    """Distinct rows in time order with large row groups, so time filters skip row groups."""
    out = df.distinct()
    out = out.repartitionByRange(time) if partitions is None else out.repartitionByRange(partitions, time)
    out.sortWithinPartitions(time).write.option("parquet.block.size", block_bytes).option("compression", "zstd").mode("overwrite").parquet(path)


def merge_files(spark: SparkSession, source: str, target: str, target_bytes: int = 512 * 1024 * 1024) -> int:
    """Rewrite many small files as few of at most about ``target_bytes``; returns the number of output partitions.

    The scan packs whole files into tasks up to that size, and cuts larger ones between row groups; no row is shuffled, so a task reads no more than it would write.
    """
    own = spark.newSession()
    for name, value in {"maxPartitionBytes": target_bytes, "openCostInBytes": 0, "minPartitionNum": 1}.items():
        own.conf.set(f"spark.sql.files.{name}", str(value))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    rows = read_flat(own, source)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return rows.rdd.getNumPartitions()
