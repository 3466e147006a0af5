"""Column roles, fixed values and the typed event layer shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------
NULL_SENTINELS = ("-", "^")
NULL_WORDS = ("", "nan", "none", "null", "(null)")
IST_OFFSET_SECONDS = 19800
WATCH_GAP_CAP_SECONDS = 60
SESSION_GAP_MINUTES = 20
SMART_GAP_MINUTES = 8
SMART_CONTEXT_CHANGES = 2
INACTIVITY_MINUTES = 30


@dataclass(frozen=True)
class ColMap:
    """Logical role -> physical column name, so operators stay name-agnostic."""

    ts: str = "reqTimeSec"
    qs: str = "queryStr"
    path: str = "reqPath"
    ua: str = "UA"
    ip: str = "cliIP"
    asn: str = "asn"
    status: str = "statusCode"
    country: str = "country"
    region: str = "state"
    city: str = "city"


COLS = ColMap()


def as_text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def epoch_seconds(c: Column | str) -> Column:
    """Text epoch (maybe with decimals) -> whole seconds, floor; NULL when not a number.

    Spark's direct cast of '177.9' to BIGINT is NULL, so the text goes through
    DOUBLE once and the fraction is floored.
    """
    return F.floor(as_text(c).try_cast("double")).cast("long")


def typed(df: DataFrame, cols: ColMap = COLS) -> DataFrame:
    """Add ``req_ts`` (LONG seconds) and drop rows without a usable time."""
    return df.withColumn("req_ts", epoch_seconds(cols.ts)).where(F.col("req_ts").isNotNull())


def columns_or_null(df: DataFrame, names: list[str]) -> list[Column]:
    """Select list tolerant of missing columns: absent ones become NULL text."""
    have = set(df.columns)
    return [F.col(n) if n in have else F.lit(None).cast("string").alias(n) for n in names]
