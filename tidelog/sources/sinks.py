"""Report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", codec).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV folder with a header per part file."""
    df.write.mode(mode).option("header", True).csv(path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_new_dates(report: DataFrame, path: str, date: str) -> DataFrame:
    """Add only the dates not yet in the report table, each written whole or not at all; returns what was selected."""
    old = existing(report.sparkSession, path)
    new = report if old is None else report.join(old.select(date).distinct(), date, "left_anti")
    replace_dates(new, path, date)
    return new


def replace_dates(report: DataFrame, path: str, date: str) -> None:
    """Replace just the dates present in ``report``; other dates stay as they are."""
    report.write.partitionBy(date).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_dates(spark: SparkSession, path: str, date: str, values: list) -> None:
    """Remove the partitions of the given dates."""
    for v in values:
        drop_folder(spark, f"{path}/{date}={v}")


def read_report(spark: SparkSession, path: str, date: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.col(date))
