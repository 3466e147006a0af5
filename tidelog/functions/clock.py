"""Epoch, day and daypart expressions. None of them depends on the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import IST_OFFSET_SECONDS, as_text

# ---- fixed values: first and last hour of each band ---------------------
DAYPARTS = {
    "Default": ([("Morning", 5, 11), ("Afternoon", 12, 16), ("Evening", 17, 21)], "Night"),
    "TV Style": ([("Morning", 5, 9), ("Daytime", 10, 16), ("Evening", 17, 21)], "Late Night"),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_any_unit(c: Column | str) -> Column:
    """Epoch text in s, ms, us or ns (by magnitude) -> seconds as DOUBLE."""
    x = as_text(c).try_cast("double")
    a = F.abs(x)
    return F.when(a >= 1e17, x / 1e9).when(a >= 1e14, x / 1e6).when(a >= 1e11, x / 1e3).otherwise(x)


def day_id(ts: Column | str, offset: int = 0) -> Column:
    """Days since 1970 in a fixed-offset zone, by integer arithmetic."""
    return F.floor((_col(ts) + F.lit(offset)) / F.lit(86400)).cast("long")


def day_date(ts: Column | str, offset: int = 0) -> Column:
    return F.date_from_unix_date(day_id(ts, offset).cast("int"))


def zone_date(ts: Column | str, zone: str = "UTC", offset: int | None = None) -> Column:
    """Date in a named zone; IST, UTC and +-hh:mm run on integers, others on the zone table."""
    if offset is None:
        offset = {"UTC": 0, "IST": IST_OFFSET_SECONDS, "Asia/Kolkata": IST_OFFSET_SECONDS}.get(zone)
    if offset is None and zone[:1] in "+-":
        hours, minutes = zone[1:].split(":")
        offset = (int(hours) * 3600 + int(minutes) * 60) * (-1 if zone[0] == "-" else 1)
    if offset is not None:
        return day_date(ts, offset)
    micros_in_zone = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(secs=_col(ts)))
    return micros_in_zone.cast("date")


def second_of_day(ts: Column | str, offset: int = 0) -> Column:
    return F.pmod(_col(ts) + F.lit(offset), F.lit(86400)).cast("long")


def hour_of_day(ts: Column | str, offset: int = 0) -> Column:
    return F.floor(second_of_day(ts, offset) / 3600).cast("int")


def hour_start(ts: Column | str) -> Column:
    return (_col(ts) - F.pmod(_col(ts), F.lit(3600))).cast("long")


def bucket_start(ts: Column | str, seconds: int) -> Column:
    return (_col(ts) - F.pmod(_col(ts), F.lit(seconds))).cast("long")


def daypart(ts: Column | str, mode: str = "Default", offset: int = 0) -> Column:
    bands, rest = DAYPARTS[mode]
    h = hour_of_day(ts, offset)
    out = None
    for name, first, last in bands:
        hit = h.between(first, last)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(rest)


def hhmmss(seconds: Column | str) -> Column:
    s = _col(seconds)
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat_ws(":", two(s / 3600), two(F.pmod(s, F.lit(3600)) / 60), two(F.pmod(s, F.lit(60))))


def partial_day_note(first: Column | str, last: Column | str) -> Column:
    """Note on a day's coverage from hh:mm:ss texts."""
    f, t = _col(first), _col(last)
    partial = (f > "00:05:00") | (t < "23:55:00")
    return F.when(partial, F.concat(F.lit("Partial data: "), f, F.lit(" → "), t)).otherwise("Full/near-full day")


def ist_label(date: Column | str, fmt: str = "dd/MM/yy") -> Column:
    """Label of a UTC date shifted by +5:30 from midnight: the same calendar day.

    It is a label only; for real IST days use :func:`day_date` with the IST offset.
    """
    return F.date_format(_col(date), fmt)
