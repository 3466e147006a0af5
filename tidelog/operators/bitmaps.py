"""Exact distinct counts over any range of days, from stored daily bitmaps.

Values (device ids, session ids, channel names, ...) get numbers once, in a dictionary table that only grows. A day's
table holds, per key, field and bucket of 32,768 numbers, one bitmap of the numbers met. Days, places or channels merge by OR, so
a week, a month or a country counts each value once without the raw rows being read again. Sums of daily distincts cannot do that.

Nothing is numbered in one task: numbers are dense within a writing task and leave gaps between tasks, which cost no space because
empty buckets have no row. A bitmap row is 4 KiB before compression, so keys should hold many values or be few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from ..sources import sinks

DAY = "event_date"
BUCKET = 32_768
#: Output name of a distinct count -> column of the summary.
FIELDS = {"sessions": "session_id", "devices": "device_id", "channels": "channel_name", "cities": "city"}


def long_values(rows: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """Distinct (keys, field, value) with a value, fields named by their output names."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).cast("string").alias("value")) for n, c in fields.items()])
    return rows.select(*keys, F.inline(each)).where(F.col("value").isNotNull()).distinct()


def numbered(values: DataFrame, first: int = 0) -> DataFrame:
    """(field, value, n) of distinct (field, value); numbers start at ``first``.

    Each task numbers its rows in (field, value) order, so a field's bits share buckets. The numbers depend on the
    run: write the result before anything else reads it.
    """
    ordered = values.select("field", "value").repartitionByRange("field", "value").sortWithinPartitions("field", "value")
    return ordered.withColumn("n", F.monotonically_increasing_id() + F.lit(first))


def extend_dictionary(values: DataFrame, path: str) -> DataFrame:
    """The dictionary at ``path`` after the (field, value) pairs it lacks were appended. Old numbers never change."""
    spark = values.sparkSession
    old = sinks.existing(spark, path)
    pairs = values.select("field", "value").distinct()
    if old is None:
        numbered(pairs).write.parquet(path)
    else:
        top = old.agg(F.max("n")).first()[0]
        start = 0 if top is None else (top // BUCKET + 1) * BUCKET
        numbered(pairs.join(old, ["field", "value"], "left_anti"), start).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def bitmaps(long: DataFrame, dictionary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, bucket, bits) from (keys, field, value)."""
    rows = long.join(dictionary, ["field", "value"])
    return rows.groupBy(*keys, "field", F.bitmap_bucket_number("n").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))


def merged(bits: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Bitmaps of coarser keys."""
    return bits.groupBy(*keys, "field", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distincts(bits: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Distinct values per key: one column per field, 0 where a key has none. ``keys`` may be coarser than those of ``bits``."""
    one = merged(bits, keys).select(*keys, "field", F.bitmap_count("bits").alias("n"))
    return one.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("field") == f, F.col("n"))), F.lit(0)).alias(f) for f in fields])


def add_days(summary: DataFrame, folder: str, keys: list[str], fields: dict[str, str] = FIELDS) -> None:
    """Store the days of a device-day summary: dictionary, bitmaps and requests below ``folder``. A day that is there already is replaced whole."""
    grain = [DAY, *keys]
    long = staged(long_values(summary, grain, fields), "day-values")
    dictionary = extend_dictionary(long, f"{folder}/values")
    sinks.replace_dates(bitmaps(long, dictionary, grain), f"{folder}/bits", DAY)
    requests = summary.groupBy(*grain).agg(F.sum("requests").alias("requests"))
    sinks.replace_dates(requests, f"{folder}/requests", DAY)


def report(spark: SparkSession, folder: str, by: dict[str, Column], fields: list[str], where: Column | None = None) -> DataFrame:
    """Requests and exact distincts per ``by`` (name -> expression over the day and the stored keys), read from the stored days alone.

    ``where`` on the day prunes partitions. An empty ``by`` gives one row of totals.
    """
    def part(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/{name}")
        rows = rows if where is None else rows.where(where)
        return rows.select("*", *[c.alias(f"_by_{n}") for n, c in by.items()])

    names = [f"_by_{n}" for n in by]
    totals = part("requests").groupBy(*names).agg(F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"))
    counted = distincts(part("bits"), names, fields)
    out = totals.join(counted, [totals[n].eqNullSafe(counted[n]) for n in names] or F.lit(True), "left")
    return out.select(*[totals[n].alias(n.removeprefix("_by_")) for n in names], "requests", *[F.coalesce(F.col(f), F.lit(0)).alias(f) for f in fields])


def trailing(spark: SparkSession, folder: str, days: int, fields: list[str]) -> DataFrame:
    """Per stored day: distinct values of the ``days`` days that end with it. Each bitmap is sent to the days that it counts for, at most ``days`` times."""
    bits = spark.read.parquet(f"{folder}/bits").groupBy(DAY, "field", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    there = spark.read.parquet(f"{folder}/requests").select(DAY).distinct()
    ahead = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add(DAY, i))).alias("until")
    spreads = bits.select(ahead, "field", "bucket", "bits").join(there.withColumnRenamed(DAY, "until"), "until", "left_semi")
    return distincts(spreads, ["until"], fields).withColumnRenamed("until", DAY)
