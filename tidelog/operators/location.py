"""Location behaviour rollups over one compact base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDIA = ("IN", "IND", "INDIA")
_IDS = {"sessions": "session_id", "devices": "device_id"}
ROLLUPS = {
    "relation": (["country", "region", "city", "channel_name", "device_type"], _IDS),
    "country": (["country"], {**_IDS, "regions": "region", "cities": "city", "channels": "channel_name", "device_types": "device_type"}),
    "city": (["country", "region", "city"], {**_IDS, "channels": "channel_name", "device_types": "device_type"}),
    "device_type": (["device_type"], {**_IDS, "countries": "country", "regions": "region", "cities": "city", "channels": "channel_name"}),
    "india_state": (["region"], {**_IDS, "cities": "city", "channels": "channel_name", "device_types": "device_type"}),
}


def location_base(events: DataFrame) -> DataFrame:
    """Requests at the grain of place, channel, device type, session and device."""
    return events.groupBy(
        "country", "region", "city", "raw_channel", "channel_name", "platform", "device_name", "device_type", "session_id", "device_id"
    ).agg(F.count(F.lit(1)).alias("requests"))


def location_rollup(base: DataFrame, name: str) -> DataFrame:
    """A named rollup; the base is already small, so its distinct counts are cheap."""
    keys, distinct = ROLLUPS[name]
    if name == "india_state":
        base = base.where(F.upper("country").isin(*INDIA))
    out = base.groupBy(*keys).agg(F.sum("requests").alias("requests"), *[F.count_distinct(c).alias(n) for n, c in distinct.items()])
    return out.withColumnRenamed("region", "state_region") if name == "india_state" else out
