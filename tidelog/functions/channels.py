"""Channel, content and stream naming."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import NULL_WORDS, as_text
from .querystring import qs_value
from .text import decode_uri

# ---- fixed values -------------------------------------------------------
STREAM_PATTERN = r"(vglive-sk-\d+)"
CDN_DOMAIN = ".akamaized.net"
PLATFORM_TOKENS = (
    "firetv", "firestick", "fireos", "androidtv", "android", "web", "webos", "lg", "lgtv",
    "apple", "appletv", "ios", "iphone", "ipad", "samsung", "samsungtv", "tizen", "roku",
    "mi", "mitv", "xiaomi", "sony", "bravia", "id", "tv", "mobile", "phone", "tablet",
)
EARLY_PLATFORM_TOKENS = ("firetv", "androidtv", "android", "web")
_ANY_SUFFIX = "(?i)_(" + "|".join(PLATFORM_TOKENS) + ")$"
_NO_ID_SUFFIX = "(?i)_(" + "|".join(t for t in PLATFORM_TOKENS if t != "id") + ")$"
_EARLY_SUFFIX = "(?i)_(" + "|".join(EARLY_PLATFORM_TOKENS) + ")$"


def stream_id(path: Column | str) -> Column:
    return F.nullif(F.regexp_extract(as_text(path), STREAM_PATTERN, 1), F.lit(""))


def stream_key(path: Column | str) -> Column:
    """Stream id, else first folder, else the whole path, else a marker."""
    p = as_text(path)
    return F.coalesce(
        stream_id(p),
        F.nullif(F.regexp_extract(p, "^([^/]+)/", 1), F.lit("")),
        F.nullif(p, F.lit("")),
        F.lit("__unknown_stream__"),
    )


def channel_raw(qs: Column | str, path: Column | str | None = None) -> Column:
    """channel, else channel_name, else the stream id of the path, else Unknown."""
    options = [qs_value(qs, "channel"), qs_value(qs, "channel_name")]
    if path is not None:
        options.append(stream_id(path))
    return F.coalesce(*options, F.lit("Unknown"))


def content_label(qs: Column | str, path: Column | str) -> Column:
    return F.coalesce(
        qs_value(qs, "content_title"), qs_value(qs, "channel"), qs_value(qs, "channel_name"),
        stream_id(path), as_text(path),
    )


def channel_report(qs: Column | str) -> Column:
    """Report form: decoded, one platform suffix cut, trimmed, case kept."""
    return F.trim(F.regexp_replace(decode_uri(channel_raw(qs)), _NO_ID_SUFFIX, ""))


def channel_folded(raw: Column | str) -> Column:
    """Lower-case form: '_' spacing normalised, one platform suffix cut."""
    spaced = F.regexp_replace(as_text(raw), r"\s*_\s*", "_")
    return F.lower(F.regexp_replace(spaced, _ANY_SUFFIX, ""))


def _token(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "")


def _allowed(last: Column, own: list[Column]) -> Column:
    """The last part is a listed token, or the row's own platform or device, or that without 'tv'."""
    hit = last.isin(*PLATFORM_TOKENS)
    for t in own:
        hit = hit | ((last != "") & ((last == t) | (F.concat(last, F.lit("tv")) == t)))
    return hit


def channel_pure(raw: Column | str, platform: Column | str, device: Column | str) -> Column:
    """Business channel: every trailing platform/device token is cut, then lower-cased.

    The cut is a fold over the '_' parts, so it needs no UDF; names without '_' skip it.
    """
    r = F.trim(as_text(raw))
    s = F.trim(F.regexp_replace(F.regexp_replace(r, r"\s*_\s*", "_"), r"\s+", " "))
    own = [_token(as_text(platform)), _token(as_text(device))]

    def cut(acc: Column, _step: Column) -> Column:
        shorter = F.trim(F.btrim(F.regexp_replace(acc, "_[^_]*$", ""), F.lit("_ ")))
        last = _token(F.substring_index(acc, "_", -1))
        return F.when(acc.contains("_") & _allowed(last, own), shorter).otherwise(acc)

    folded = F.aggregate(F.sequence(F.lit(2), F.size(F.split(s, "_"))), s, cut)
    name = F.when(r.contains("_"), folded).otherwise(s)
    unknown = r.isNull() | F.lower(r).isin(*NULL_WORDS)
    return F.when(unknown, F.lit("unknown")).otherwise(F.lower(F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))))


def channel_early(raw: Column | str) -> Column:
    """Early normaliser: short suffix list, spaces squeezed, case kept, NULL -> ''."""
    s = F.regexp_replace(F.trim(as_text(raw)), r"\s*_\s*", "_")
    s = F.regexp_replace(s, _EARLY_SUFFIX, "")
    return F.coalesce(F.trim(F.regexp_replace(s, r"\s+", " ")), F.lit(""))


def channel_suffix(raw: Column | str) -> Column:
    """The platform suffix itself, as written; '' when there is none."""
    s = F.regexp_replace(F.trim(as_text(raw)), r"\s*_\s*", "_")
    return F.coalesce(F.regexp_extract(s, _EARLY_SUFFIX, 1), F.lit(""))


def host_channel(host: Column | str, tenant_suffix: str = "", cdn_domain: str = CDN_DOMAIN) -> Column:
    """Request host -> channel: CDN domain and the tenant's own suffix removed."""
    c = F.replace(as_text(host), F.lit(cdn_domain), F.lit(""))
    if tenant_suffix:
        c = F.regexp_replace(c, re.escape(tenant_suffix) + "$", "")
    return c
