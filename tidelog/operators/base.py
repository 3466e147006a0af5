"""The behaviour base that all sections share: events with their neighbours, ordered once and stored in buckets.

Windows by device and session run once, at writing. The table is bucketed by device and session and sorted by time, so a section that
groups or orders by them later shuffles nothing by that key. Sessions of more than ``hot_rows`` events would make one bucket too large: their rows
go to a partition of their own, whose files are read without buckets, so that they are dealt over many tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_folder
from ..sources import sinks
from .ordered import HOT_ROWS, Ordered

SESSION = ["device_id", "session_id"]
ENTITIES = ["content_label", "channel_name"]


def write_base(events: DataFrame, name: str | None = None, buckets: int | None = None, tie: list[str] = ("event_id",), hot_rows: int = HOT_ROWS, **tuning) -> str:
    """Store events with next_req_ts, and next_ and prev_ of each entity, as a bucketed table; returns its name. The files lie below the shared folder."""
    spark = events.sparkSession
    name = name or f"behaviour_{uuid.uuid4().hex[:12]}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = Ordered.by(events, SESSION, ["req_ts", *tie], hot_rows=hot_rows, **tuning).neighbours(lag=ENTITIES, lead=["req_ts", *ENTITIES])
    hot = F.coalesce("_hot", F.lit(False))
    # one task per bucket for the plain rows, a task per slice for hot ones: few files, none of them huge
    place = F.when(hot, F.xxhash64(*SESSION, "_slice")).otherwise(F.pmod(F.hash(*SESSION), F.lit(buckets)).cast("long"))
    rows = step.df.withColumn("is_hot", hot).repartition(buckets, place).drop("_hot", "_slice")
    path = run_folder(spark, name)
    rows.write.partitionBy("is_hot").bucketBy(buckets, *SESSION).sortBy("req_ts").option("path", path).format("parquet").saveAsTable(name)
    return name


def read_base(spark, name: str) -> DataFrame:
    """The stored events. Where a hot session exists its rows are added from their own files, and later grouping shuffles as usual."""
    table = spark.table(name)
    plain = table.where(~F.col("is_hot")).drop("is_hot")
    folder = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
    hot = sinks.existing(spark, f"{folder}/is_hot=true")
    return plain if hot is None else plain.unionByName(hot.select(*plain.columns))
