"""Query-string access. Two extract dialects exist on purpose and are named apart."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import as_text
from .text import blank_to_null, decode_form

# ---- fixed values: aliases of the device key, first match wins ----------
DEVICE_KEY_ALIASES = ("device_id", "did", "deviceId", "uid", "subscriber_id", "deviceid")


def _key(key: str, before: str = "&") -> str:
    """Pattern of 'key=' at the start of the text or after one of ``before``.

    The literal comes first and a look-behind checks what precedes it, so the engine can
    search for the literal; '(?:^|&)key=' would be tried at every position.
    """
    k = re.escape(key) + "="
    return f"{k}(?<![^{before}]{k})"


def qs_text(qs: Column | str, key: str) -> Column:
    """Strict dialect without the blank rule: '' when the key is absent, NULL for a NULL text."""
    return F.regexp_extract(as_text(qs), _key(key) + "([^&]+)", 1)


def qs_value(qs: Column | str, key: str) -> Column:
    """Strict dialect: key after start or '&', non-empty value; otherwise NULL."""
    return F.nullif(qs_text(qs, key), F.lit(""))


def qs_present(qs: Column | str, key: str) -> Column:
    """True exactly where :func:`qs_value` is not NULL.

    As a filter it is one pattern test, while "value is not NULL" would be pushed below the
    projection as a second extraction.
    """
    return F.coalesce(as_text(qs).rlike(_key(key) + "[^&]"), F.lit(False))


def qs_trimmed(qs: Column | str, key: str) -> Column:
    """Tolerant dialect: also after '?', blank allowed, trimmed, blank -> NULL."""
    return blank_to_null(F.regexp_extract(as_text(qs), _key(key, "?&") + "([^&]*)", 1))


def qs_has_key(qs: Column | str, key: str, after_question: bool = True) -> Column:
    """Key present, even when its value is blank."""
    return F.coalesce(as_text(qs), F.lit("")).rlike(_key(key, "?&" if after_question else "&"))


def qs_mentions(qs: Column | str, key: str) -> Column:
    """Loose LIKE '%key=%' test; also true inside a longer key such as xkey=."""
    return F.coalesce(as_text(qs).contains(f"{key}="), F.lit(False))


def qs_pairs(qs: Column | str) -> Column:
    """array<struct<key,value>> in text order, decoded, blanks kept, empty pieces skipped."""
    pieces = F.filter(F.split(F.coalesce(as_text(qs), F.lit("")), "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            decode_form(F.substring_index(p, "=", 1)).alias("key"),
            F.when(p.contains("="), decode_form(F.regexp_replace(p, "^[^=]*=", "")))
            .otherwise(F.lit(""))
            .alias("value"),
        ),
    )


def qs_map(qs: Column | str) -> Column:
    """map<string,string>; the last duplicate of a key wins, under any map policy."""

    def build(pairs: Column) -> Column:
        # a pair is kept when no later pair has its key
        last = F.filter(
            pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == p["key"])
        )
        return F.map_from_entries(last)

    # the one-element array binds the parsed pairs, so the text is parsed once
    return F.transform(F.array(qs_pairs(qs)), build)[0]


def device_id_any_alias(qs: Column | str) -> Column:
    """First alias found anywhere in the text, case-insensitive, unanchored."""
    qs = as_text(qs)
    return F.coalesce(
        *[F.nullif(F.regexp_extract(qs, f"(?i){k}=([^&]+)", 1), F.lit("")) for k in DEVICE_KEY_ALIASES]
    )


def querystring_class(qs: Column | str) -> Column:
    """empty_queryStr / m_only / rich_metadata / misc_queryStr."""
    qs = as_text(qs)
    t = F.lower(F.trim(qs))
    empty = qs.isNull() | t.isin("", "null", "(null)", "none", "nan")
    rich = qs_trimmed(qs, "device_id").isNotNull() | qs_trimmed(qs, "session_id").isNotNull()
    for key in ("channel", "category_name", "content_title", "platform"):
        rich = rich | qs_has_key(qs, key)
    return (
        F.when(empty, "empty_queryStr")
        .when(qs.rlike("^m=[^&]+$"), "m_only")
        .when(rich, "rich_metadata")
        .otherwise("misc_queryStr")
    )
