"""Decoding and cleaning of text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NULL_SENTINELS, as_text


def _well_formed(c: Column) -> Column:
    """Escape a '%' that is not followed by two hex digits, so it survives decoding."""
    return F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")


def decode_form(c: Column | str) -> Column:
    """Form decoding: '+' is a space, %xx decoded, malformed escapes kept as text."""
    c = as_text(c)
    return F.when(c.contains("%") | c.contains("+"), F.coalesce(F.try_url_decode(_well_formed(c)), c)).otherwise(c)


def decode_uri(c: Column | str) -> Column:
    """URI decoding: like :func:`decode_form` but '+' stays '+'."""
    c = as_text(c)
    escaped = F.replace(_well_formed(c), F.lit("+"), F.lit("%2B"))
    return F.when(c.contains("%"), F.coalesce(F.try_url_decode(escaped), c)).otherwise(c)


def unescape_spaces(c: Column | str) -> Column:
    """Replace %20, then %2520, by a space; nothing else is decoded."""
    c = F.replace(as_text(c), F.lit("%20"), F.lit(" "))
    return F.replace(c, F.lit("%2520"), F.lit(" "))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(as_text(c)), F.lit(""))


def sentinel_to_null(c: Column | str, sentinels: tuple[str, ...] = NULL_SENTINELS) -> Column:
    c = as_text(c)
    return F.when(~c.isin(*sentinels), c)


def label_blank(c: Column | str, label: str = "(blank/null)", trim: bool = True) -> Column:
    c = as_text(c)
    return F.coalesce(F.nullif(F.trim(c) if trim else c, F.lit("")), F.lit(label))


def clean_location(c: Column | str) -> Column:
    c = F.trim(as_text(c))
    return F.when(c.isin("", *NULL_SENTINELS) | c.isNull(), F.lit("Unknown")).otherwise(c)


def is_filled(c: Column | str) -> Column:
    """True when not NULL and, trimmed, none of '', '-', '^'."""
    c = as_text(c)
    return c.isNotNull() & ~F.trim(c).isin("", *NULL_SENTINELS)
