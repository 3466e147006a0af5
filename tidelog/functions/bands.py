"""Classes and bands of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NULL_SENTINELS, NULL_WORDS, as_text

# ---- fixed values -------------------------------------------------------
RENDITIONS = ("1080p", "720p", "576p", "480p", "360p", "240p", "216p")
VIDEO_EXTENSIONS = [
    (".ts", "ts_segment"), (".m4s", "m4s_segment"), (".mp4", "mp4"),
    (".m3u8", "m3u8_manifest"), (".mpd", "dash_manifest"),
]
SESSION_BINS = [(1, "1"), (5, "2-5"), (10, "6-10"), (25, "11-25"), (50, "26-50"), (100, "51-100")]
ROW_BINS = [(1, "1"), (5, "2-5"), (20, "6-20"), (100, "21-100"), (1000, "101-1K"), (10000, "1K-10K")]
DEVICE_BINS = [(1, "1"), (5, "2-5"), (20, "6-20")]
THROUGHPUT_BANDS = [(1_000_000, "very_low"), (3_000_000, "low"), (8_000_000, "medium")]


def quality(path: Column | str) -> Column:
    """segment, master, NNNp, variant_N or unknown; later rules of the ladder win."""
    p = F.coalesce(as_text(path), F.lit(""))
    pixels = F.nullif(F.regexp_extract(p, r"(\d+p)", 1), F.lit(""))
    variant = F.nullif(F.regexp_extract(p, r"main_(\d+)\.m3u8", 1), F.lit(""))
    return (
        F.when(p.contains(".ts"), "segment")
        .when(p.rlike("main.m3u8"), "master")
        .when(pixels.isNotNull(), pixels)
        .when(variant.isNotNull(), F.concat(F.lit("variant_"), variant))
        .otherwise("unknown")
    )


def rendition(path: Column | str) -> Column:
    p = as_text(path)
    out = None
    for r in RENDITIONS:
        out = F.when(p.contains(r), r) if out is None else out.when(p.contains(r), r)
    return out.otherwise("Auto/Unknown")


def rendition_any(path: Column | str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(as_text(path), r"([0-9]{3,4}p)", 1), F.lit("")), F.lit("unknown"))


def path_type(path: Column | str) -> Column:
    p = F.lower(as_text(path))
    out = None
    for ext, label in VIDEO_EXTENSIONS:
        out = F.when(p.contains(ext), label) if out is None else out.when(p.contains(ext), label)
    return out.otherwise("other")


def status_class(status: Column | str) -> Column:
    s = as_text(status).try_cast("long")
    out = None
    for n in (2, 3, 4, 5):
        hit = s.between(n * 100, n * 100 + 99)
        out = F.when(hit, f"{n}xx") if out is None else out.when(hit, f"{n}xx")
    return out.otherwise("other")


def error_side(status: Column | str) -> Column:
    """success below 400, client_error below 500, else server_error (also NULL)."""
    s = as_text(status).try_cast("long")
    return F.when(s < 400, "success").when(s < 500, "client_error").otherwise("server_error")


def is_error_text(status: Column | str) -> Column:
    return F.coalesce(as_text(status).rlike("^[45]"), F.lit(False))


def throughput_band(x: Column | str) -> Column:
    v = as_text(x).try_cast("double")
    out = None
    for limit, label in THROUGHPUT_BANDS:
        out = F.when(v < limit, label) if out is None else out.when(v < limit, label)
    return out.otherwise("high")


def count_bin(x: Column | str, bins: list[tuple[int, str]], above: str) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    out = None
    for limit, label in bins:
        out = F.when(c <= limit, label) if out is None else out.when(c <= limit, label)
    return out.otherwise(above)


def watch_bucket(minutes: Column | str) -> Column:
    m = F.col(minutes) if isinstance(minutes, str) else minutes
    return (
        F.when(m < 1, "Bounce (<1m)").when(m < 5, "Short (1-5m)").when(m < 15, "Medium (5-15m)").otherwise("Long (15m+)")
    )


def normalize_asn(asn: Column | str) -> Column:
    """Digits only, without 'AS' and a '.0' tail; null words -> ''."""
    s = F.trim(as_text(asn))
    bad = s.isNull() | F.lower(s).isin(*NULL_WORDS, *NULL_SENTINELS)
    t = F.regexp_replace(F.trim(F.replace(F.upper(s), F.lit("AS"), F.lit(""))), r"\.0$", "")
    return F.when(bad, F.lit("")).otherwise(F.regexp_replace(t, "[^0-9]", ""))


def lower_asn(asn: Column | str) -> Column:
    """Join form: trimmed, lower-case, leading 'as' removed."""
    return F.regexp_replace(F.lower(F.trim(as_text(asn))), "^as", "")


def upper_asn(asn: Column | str) -> Column:
    """Share-report form: leading 'AS' and trailing '.0' removed; null words -> NULL."""
    s = F.regexp_replace(F.regexp_replace(F.upper(F.trim(as_text(asn))), "^AS", ""), r"\.0$", "")
    return F.when(~s.isin("", "NAN", "NONE", "NULL", "(NULL)", "-", "^", "0"), s)


def has_value(c: Column | str) -> Column:
    return F.nullif(F.trim(as_text(c)), F.lit("")).isNotNull()
