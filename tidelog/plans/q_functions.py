"""Scalar functions (FN-1..40). Each query runs its function over every row of a table."""

from pyspark.sql import functions as F

from ..functions import bands, channels, clock, devices, querystring as qs, text
from ..model import epoch_seconds, typed
from ..operators import dimensions, users, watch
from ..operators.profile import is_mostly_numeric
from .q_filters import FAMILY_SQL
from .registry import (CHANNEL_RAW, DAYPART_SQL, DEVICE_TYPE_SQL, STREAM_ID, TOKENS, TV, TV_WIDE, day, logs, on_logs, on_timelines,
                       query, table, x, xt)


def _q(sql):
    return on_logs(f"SELECT event_id, {sql} FROM t")


@query("fn_1_qs_extract", _q(f"{x('device_id')} AS device_id, {x('channel')} AS channel"))
def _(spark, d):
    return logs(spark, d).select("event_id", qs.qs_value("queryStr", "device_id").alias("device_id"), qs.qs_value("queryStr", "channel").alias("channel"))


@query("fn_2_qs_extract_tolerant", _q(f"{xt('device_id')} AS device_id, {xt('content_title')} AS content_title"))
def _(spark, d):
    return logs(spark, d).select("event_id", qs.qs_trimmed("queryStr", "device_id").alias("device_id"),
                                 qs.qs_trimmed("queryStr", "content_title").alias("content_title"))


@query("fn_2_url_query_keys", r"""SELECT page_id, NULLIF(TRIM(regexp_extract(url, '(?:^|[?&])id=([^&]*)', 1)), '') AS id,
 regexp_matches(COALESCE(url, ''), '(^|[?&])id=') AS has_id FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", qs.qs_trimmed("url", "id").alias("id"), qs.qs_has_key("url", "id").alias("has_id"))


@query("fn_3_key_present", _q("""CASE WHEN regexp_matches(COALESCE(queryStr, ''), '(^|&)device_id=') THEN 1 ELSE 0 END AS strict_flag,
 CASE WHEN regexp_matches(COALESCE(queryStr, ''), '(^|[?&])session_id=') THEN 1 ELSE 0 END AS tolerant_flag"""))
def _(spark, d):
    return logs(spark, d).select("event_id", qs.qs_has_key("queryStr", "device_id", False).cast("int").alias("strict_flag"),
                                 qs.qs_has_key("queryStr", "session_id").cast("int").alias("tolerant_flag"))


@query("fn_4_parse_query_string", on_logs("""SELECT event_id, url_decode(replace(split_part(p, '=', 1), '+', ' ')) AS key,
 CASE WHEN contains(p, '=') THEN url_decode(replace(substr(p, strpos(p, '=') + 1), '+', ' ')) ELSE '' END AS value
 FROM (SELECT event_id, unnest(string_split(queryStr, '&')) AS p FROM logs WHERE queryStr IS NOT NULL) WHERE p <> ''"""))
def _(spark, d):
    parsed = qs.qs_map("queryStr")
    return logs(spark, d).select("event_id", F.explode(parsed).alias("key", "value"))


@query("fn_5_device_id_any_alias", _q("""COALESCE(""" + ", ".join(
    f"NULLIF(regexp_extract(queryStr, '(?i){k}=([^&]+)', 1), '')" for k in ("device_id", "did", "deviceId", "uid", "subscriber_id", "deviceid")) + ") AS device_id"))
def _(spark, d):
    return logs(spark, d).select("event_id", qs.device_id_any_alias("queryStr").alias("device_id"))


@query("fn_6_url_decode", _q(f"""url_decode(replace({x('device')}, '+', ' ')) AS form_decoded, url_decode({x('content_title')}) AS uri_decoded,
 replace(replace({x('device')}, '%20', ' '), '%2520', ' ') AS unescaped"""))
def _(spark, d):
    dev, title = qs.qs_value("queryStr", "device"), qs.qs_value("queryStr", "content_title")
    return logs(spark, d).select("event_id", text.decode_form(dev).alias("form_decoded"), text.decode_uri(title).alias("uri_decoded"),
                                 text.unescape_spaces(dev).alias("unescaped"))


@query("fn_6_decode_documents", """SELECT doc_id, text AS decoded FROM documents""")
def _(spark, d):
    # prose holds no valid %xx escape and no '+' may change under URI decoding
    return table(spark, d, "documents").select("doc_id", text.decode_uri("text").alias("decoded"))


@query("fn_7_channel_fallback", _q(f"{CHANNEL_RAW} AS channel_raw"))
def _(spark, d):
    return logs(spark, d).select("event_id", channels.channel_raw("queryStr", "reqPath").alias("channel_raw"))


_NOID = TOKENS.replace("|id|", "|")


@query("fn_8_channel_report_form", _q(f"TRIM(regexp_replace(url_decode(COALESCE({x('channel')}, {x('channel_name')}, 'Unknown')), '_({_NOID})$', '', 'i')) AS channel"))
def _(spark, d):
    return logs(spark, d).select("event_id", channels.channel_report("queryStr").alias("channel"))


@query("fn_9_channel_folded", _q(f"lower(regexp_replace(regexp_replace({CHANNEL_RAW}, '\\s*_\\s*', '_', 'g'), '_({TOKENS})$', '', 'i')) AS channel"))
def _(spark, d):
    return logs(spark, d).select("event_id", channels.channel_folded(channels.channel_raw("queryStr", "reqPath")).alias("channel"))


# every name in the data carries at most two trailing tokens, so the SQL cuts repeatedly by pattern
@query("fn_10_channel_pure", on_logs(f"""SELECT event_id, COALESCE(NULLIF(lower(regexp_replace(raw, '(_(' || tokens || '))+$', '', 'i')), ''), 'unknown') AS channel
 FROM (SELECT event_id, {CHANNEL_RAW} AS raw, '{TOKENS}' AS tokens FROM logs)"""))
def _(spark, d):
    raw = channels.channel_raw("queryStr", "reqPath")
    return logs(spark, d).select("event_id", channels.channel_pure(
        raw, qs.qs_value("queryStr", "platform"), qs.qs_value("queryStr", "device")).alias("channel"))


@query("fn_11_content_label", _q(f"COALESCE({x('content_title')}, {x('channel')}, {x('channel_name')}, {STREAM_ID}, reqPath) AS label"))
def _(spark, d):
    return logs(spark, d).select("event_id", channels.content_label("queryStr", "reqPath").alias("label"))


@query("fn_12_quality", _q(r"""CASE WHEN contains(reqPath, '.ts') THEN 'segment' WHEN regexp_matches(reqPath, 'main.m3u8') THEN 'master'
 WHEN regexp_extract(reqPath, '(\d+p)', 1) <> '' THEN regexp_extract(reqPath, '(\d+p)', 1)
 WHEN regexp_extract(reqPath, 'main_(\d+)\.m3u8', 1) <> '' THEN 'variant_' || regexp_extract(reqPath, 'main_(\d+)\.m3u8', 1) ELSE 'unknown' END AS quality"""))
def _(spark, d):
    return logs(spark, d).select("event_id", bands.quality("reqPath").alias("quality"))


@query("fn_13_rendition", _q("""CASE WHEN contains(reqPath, '1080p') THEN '1080p' WHEN contains(reqPath, '720p') THEN '720p' WHEN contains(reqPath, '576p') THEN '576p'
 WHEN contains(reqPath, '480p') THEN '480p' WHEN contains(reqPath, '360p') THEN '360p' WHEN contains(reqPath, '240p') THEN '240p'
 WHEN contains(reqPath, '216p') THEN '216p' ELSE 'Auto/Unknown' END AS ladder,
 COALESCE(NULLIF(regexp_extract(reqPath, '([0-9]{3,4}p)', 1), ''), 'unknown') AS any_pixels"""))
def _(spark, d):
    return logs(spark, d).select("event_id", bands.rendition("reqPath").alias("ladder"), bands.rendition_any("reqPath").alias("any_pixels"))


@query("fn_14_device_type", _q(f"{DEVICE_TYPE_SQL.format(p=x('platform'), tv=TV)} AS device_type, {DEVICE_TYPE_SQL.format(p=x('platform'), tv=TV_WIDE)} AS device_type_wide"))
def _(spark, d):
    p = qs.qs_value("queryStr", "platform")
    return logs(spark, d).select("event_id", devices.device_type("UA", p).alias("device_type"), devices.device_type("UA", p, wide=True).alias("device_type_wide"))


_TVCLASS = """CASE WHEN contains(u, 'apple tv') OR contains(u, 'applecoremedia') THEN 'Apple TV' WHEN contains(u, 'aft') THEN 'Amazon Fire TV'
 WHEN contains(u, 'bravia') OR contains(u, 'sony') THEN 'Sony TV' WHEN contains(u, 'mitv') OR contains(u, 'xiaomi') THEN 'Mi TV'
 WHEN contains(u, 'swtv') OR contains(u, 'skyworth') THEN 'Skyworth TV' WHEN contains(u, 'tizen') THEN 'Samsung TV' WHEN contains(u, 'webos') THEN 'LG TV'
 WHEN contains(u, 'android tv') OR contains(u, 'google tv') THEN 'Android TV'
 WHEN contains(u, 'exoplayer') OR contains(u, 'dalvik') OR contains(u, 'yourappname') THEN
  CASE WHEN contains(u, 'tv') OR contains(u, 'build') OR contains(u, 'box') OR contains(u, 'stb') THEN 'Android TV Box' ELSE 'Android Mobile App' END
 WHEN contains(u, 'mozilla') THEN 'Web Browser' ELSE 'Other/System' END"""


@query("fn_15_device_family", on_logs(f"SELECT event_id, {FAMILY_SQL} AS family, {_TVCLASS} AS tv_class FROM (SELECT *, lower(COALESCE(UA, 'none')) AS u FROM logs)"))
def _(spark, d):
    return logs(spark, d).select("event_id", devices.device_family("UA").alias("family"), devices.tv_class("UA").alias("tv_class"))


TAG_SQL = r"""CASE WHEN UA IS NULL OR UA = '' THEN 'Null/Invalid'
 WHEN contains(lower(UA), 'dalvik') THEN CASE WHEN regexp_matches(UA, '(?i)aft[a-z0-9]') THEN 'Amazon Fire TV' WHEN contains(lower(UA), 'bravia') THEN 'Sony BRAVIA'
  WHEN contains(lower(UA), 'mibox') OR contains(lower(UA), 'mitvstick') THEN 'Xiaomi/MiBox' ELSE 'Other Android TV' END
 WHEN contains(lower(UA), 'web0s') OR contains(lower(UA), 'webos') THEN 'LG WebOS' WHEN contains(lower(UA), 'tizen') THEN 'Samsung Tizen'
 WHEN contains(lower(UA), 'applecoremedia') THEN CASE WHEN contains(lower(UA), 'apple tv') THEN 'Apple TV' WHEN contains(lower(UA), 'iphone') THEN 'iPhone (ACM)' ELSE 'Apple Other' END
 WHEN contains(lower(UA), 'iphone') THEN 'iPhone Browser' WHEN contains(lower(UA), 'ipad') THEN 'iPad Browser'
 WHEN contains(lower(UA), 'macintosh') THEN 'Mac Browser' WHEN contains(lower(UA), 'windows') THEN 'Windows Browser'
 WHEN contains(lower(UA), 'exoplayer') THEN 'App: ' || COALESCE(NULLIF(regexp_extract(UA, '^([^\s/]+)', 1), ''), 'ExoPlayer')
 WHEN contains(lower(UA), 'lavf') OR contains(lower(UA), 'ffmpeg') THEN 'Tool: FFmpeg' WHEN contains(lower(UA), 'curl') THEN 'Tool: curl'
 WHEN contains(lower(UA), 'adflag') THEN 'Service: AdFlag' WHEN contains(lower(UA), 'hls2disk') THEN 'Service: hls2disk'
 WHEN contains(lower(UA), 'palo alto') OR contains(lower(UA), 'xpanse') THEN 'Scanner: Palo Alto' WHEN contains(lower(UA), 'slackbot') THEN 'Bot: Slack'
 WHEN TRIM(UA) IN ('(null)', '-', '') THEN 'Null/Invalid' ELSE 'Other' END"""


@query("fn_16_platform_tag", on_logs(f"SELECT event_id, {TAG_SQL} AS tag FROM logs"))
def _(spark, d):
    return logs(spark, d).select("event_id", devices.platform_tag("UA").alias("tag"))


@query("fn_16_platform_tag_on_text", f"SELECT doc_id, {TAG_SQL} AS tag FROM (SELECT doc_id, text AS UA FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", devices.platform_tag("text").alias("tag"))


BRAND_SQL = """CASE WHEN regexp_matches(u, 'firetv|aft|amazon') THEN 'Amazon Fire TV' WHEN regexp_matches(u, 'bravia|sony') THEN 'Sony BRAVIA'
 WHEN regexp_matches(u, 'tizen|samsung') THEN 'Samsung' WHEN regexp_matches(u, 'webos|lg') THEN 'LG' WHEN contains(u, 'roku') THEN 'Roku'
 WHEN contains(u, 'android') THEN 'Android' WHEN regexp_matches(u, 'iphone|ipad') THEN 'Apple iOS' WHEN regexp_matches(u, 'windows|macintosh') THEN 'Desktop'
 WHEN TRIM(u) = '' OR u IN ('nan', 'none', 'null') THEN 'Missing / Null' ELSE 'Unknown' END"""
BTYPE_SQL = """CASE WHEN regexp_matches(u, 'firetv|aft|amazon|bravia|sony|tizen|samsung|webos|lg|roku') THEN 'Connected TV'
 WHEN contains(u, 'android') THEN 'Android / Mobile / CTV' WHEN regexp_matches(u, 'iphone|ipad') THEN 'Mobile / Tablet'
 WHEN regexp_matches(u, 'windows|macintosh') THEN 'Desktop' ELSE 'Unknown' END"""


@query("fn_17_device_brand", on_logs(f"SELECT event_id, {BRAND_SQL} AS brand, {BTYPE_SQL} AS brand_type FROM (SELECT *, lower(COALESCE(UA, '')) AS u FROM logs)"))
def _(spark, d):
    return logs(spark, d).select("event_id", devices.device_brand("UA").alias("brand"), devices.brand_type("UA").alias("brand_type"))


@query("fn_18_device_code_name", on_logs(f"""SELECT event_id, CASE c WHEN 'AFTSS' THEN 'Amazon Fire TV Stick (2nd Gen / Lite)'
 WHEN 'BRAVIA 4K' THEN 'Sony Bravia TV (BRAVIA 4K)' END AS device_model FROM (SELECT event_id, replace({x('device')}, '%20', ' ') AS c FROM logs)"""))
def _(spark, d):
    df = logs(spark, d).select("event_id", qs.qs_value("queryStr", "device").alias("code"))
    return devices.with_device_name(df, "code").drop("code")


@query("fn_19_android_version_model", _q(r"""NULLIF(regexp_extract(UA, 'Android (\d+)', 1), '') AS version, NULLIF(regexp_extract(UA, 'Android[%20\s]+(\d+)', 1), '') AS version_encoded,
 NULLIF(TRIM(regexp_extract(UA, 'Android [\d.]+;\s*(.+?)\s*Build/', 1)), '') AS model"""))
def _(spark, d):
    return logs(spark, d).select("event_id", devices.android_version("UA").alias("version"), devices.android_version_encoded("UA").alias("version_encoded"),
                                 devices.device_model("UA").alias("model"))


@query("fn_20_stream_key", _q(f"COALESCE({STREAM_ID}, NULLIF(regexp_extract(reqPath, '^([^/]+)/', 1), ''), NULLIF(reqPath, ''), '__unknown_stream__') AS stream_key"))
def _(spark, d):
    return logs(spark, d).select("event_id", channels.stream_key("reqPath").alias("stream_key"))


@query("fn_21_host_channel", _q("regexp_replace(replace(reqHost, '.akamaized.net', ''), '-live$', '') AS channel"))
def _(spark, d):
    return logs(spark, d).select("event_id", channels.host_channel("reqHost", tenant_suffix="-live").alias("channel"))


@query("fn_22_path_type", _q("""CASE WHEN lower(reqPath) LIKE '%.ts%' THEN 'ts_segment' WHEN lower(reqPath) LIKE '%.m4s%' THEN 'm4s_segment'
 WHEN lower(reqPath) LIKE '%.mp4%' THEN 'mp4' WHEN lower(reqPath) LIKE '%.m3u8%' THEN 'm3u8_manifest' WHEN lower(reqPath) LIKE '%.mpd%' THEN 'dash_manifest' ELSE 'other' END AS path_type"""))
def _(spark, d):
    return logs(spark, d).select("event_id", bands.path_type("reqPath").alias("path_type"))


@query("fn_23_epoch_unit_detect", on_logs("""SELECT event_id, CASE WHEN abs(v) >= 1e17 THEN v / 1e9 WHEN abs(v) >= 1e14 THEN v / 1e6 WHEN abs(v) >= 1e11 THEN v / 1e3 ELSE v END AS seconds
 FROM (SELECT event_id, TRY_CAST(CASE event_id % 4 WHEN 0 THEN reqTimeSec WHEN 1 THEN reqTimeSec || '000' WHEN 2 THEN reqTimeSec || '000000' ELSE reqTimeSec || '000000000' END AS DOUBLE) AS v FROM logs)"""))
def _(spark, d):
    scale = F.element_at(F.array(F.lit(""), F.lit("000"), F.lit("000000"), F.lit("000000000")), (F.col("event_id") % 4 + 1).cast("int"))
    return logs(spark, d).select("event_id", clock.epoch_any_unit(F.concat("reqTimeSec", scale)).alias("seconds"))


@query("fn_24_daypart", _q(f"""{DAYPART_SQL} AS day_part, CASE WHEN (req_ts % 86400) // 3600 BETWEEN 5 AND 9 THEN 'Morning' WHEN (req_ts % 86400) // 3600 BETWEEN 10 AND 16 THEN 'Daytime'
 WHEN (req_ts % 86400) // 3600 BETWEEN 17 AND 21 THEN 'Evening' ELSE 'Late Night' END AS tv_part"""))
def _(spark, d):
    return typed(logs(spark, d)).select("event_id", clock.daypart("req_ts").alias("day_part"), clock.daypart("req_ts", "TV Style").alias("tv_part"))


@query("fn_25_day_id", _q("CAST(FLOOR(req_ts / 86400.0) AS BIGINT) AS utc_day, CAST(FLOOR((req_ts + 19800) / 86400.0) AS BIGINT) AS ist_day"))
def _(spark, d):
    return typed(logs(spark, d)).select("event_id", clock.day_id("req_ts").alias("utc_day"), clock.day_id("req_ts", 19800).alias("ist_day"))


@query("fn_26_hhmmss", _q("""strftime(make_timestamp(req_ts * 1000000), '%H:%M:%S') AS at, CASE WHEN strftime(make_timestamp(req_ts * 1000000), '%H:%M:%S') > '00:05:00'
 THEN 'Partial data: ' || strftime(make_timestamp(req_ts * 1000000), '%H:%M:%S') || ' → 23:59:59' ELSE 'Full/near-full day' END AS note"""))
def _(spark, d):
    df = typed(logs(spark, d)).select("event_id", clock.hhmmss(clock.second_of_day("req_ts")).alias("at"))
    return df.withColumn("note", clock.partial_day_note("at", F.lit("23:59:59")))


@query("fn_27_location_clean", _q("""COALESCE(NULLIF(NULLIF(NULLIF(TRIM(country), ''), '-'), '^'), 'Unknown') AS country,
 COALESCE(NULLIF(NULLIF(NULLIF(TRIM(state), ''), '-'), '^'), 'Unknown') AS state"""))
def _(spark, d):
    return logs(spark, d).select("event_id", text.clean_location("country").alias("country"), text.clean_location("state").alias("state"))


@query("fn_28_value_clean", _q("COALESCE(NULLIF(TRIM(state), ''), '(blank/null)') AS state, COALESCE(NULLIF(queryStr, ''), '(blank)') AS qs, COALESCE(UA, '(null)') AS ua"))
def _(spark, d):
    return logs(spark, d).select("event_id", text.label_blank("state").alias("state"), text.label_blank("queryStr", "(blank)", trim=False).alias("qs"),
                                 F.coalesce("UA", F.lit("(null)")).alias("ua"))


@query("fn_29_asn_normalise", _q(r"""CASE WHEN asn IS NULL OR lower(TRIM(asn)) IN ('', 'nan', 'none', 'null', '(null)', '-', '^') THEN ''
 ELSE regexp_replace(regexp_replace(TRIM(replace(upper(TRIM(asn)), 'AS', '')), '\.0$', ''), '[^0-9]', '', 'g') END AS digits,
 regexp_replace(lower(TRIM(asn)), '^as', '') AS lower_form, CASE WHEN regexp_replace(upper(TRIM(asn)), '^AS', '') NOT IN ('', '-', '^', '0') THEN regexp_replace(upper(TRIM(asn)), '^AS', '') END AS upper_form"""))
def _(spark, d):
    return logs(spark, d).select("event_id", bands.normalize_asn("asn").alias("digits"), bands.lower_asn("asn").alias("lower_form"), bands.upper_asn("asn").alias("upper_form"))


CLASS_SQL = f"""CASE WHEN queryStr IS NULL OR TRIM(queryStr) = '' OR lower(TRIM(queryStr)) IN ('null', '(null)', 'none', 'nan') THEN 'empty_queryStr'
 WHEN regexp_matches(queryStr, '^m=[^&]+$') THEN 'm_only'
 WHEN {xt('device_id')} IS NOT NULL OR {xt('session_id')} IS NOT NULL OR regexp_matches(queryStr, '(^|[?&])(channel|category_name|content_title|platform)=') THEN 'rich_metadata'
 ELSE 'misc_queryStr' END"""


@query("fn_30_query_string_class", _q(f"{CLASS_SQL} AS qs_class"))
def _(spark, d):
    return logs(spark, d).select("event_id", qs.querystring_class("queryStr").alias("qs_class"))


@query("fn_31_status_class", _q("""CASE WHEN TRY_CAST(statusCode AS BIGINT) BETWEEN 200 AND 299 THEN '2xx' WHEN TRY_CAST(statusCode AS BIGINT) BETWEEN 300 AND 399 THEN '3xx'
 WHEN TRY_CAST(statusCode AS BIGINT) BETWEEN 400 AND 499 THEN '4xx' WHEN TRY_CAST(statusCode AS BIGINT) BETWEEN 500 AND 599 THEN '5xx' ELSE 'other' END AS class,
 CASE WHEN TRY_CAST(statusCode AS BIGINT) < 400 THEN 'success' WHEN TRY_CAST(statusCode AS BIGINT) < 500 THEN 'client_error' ELSE 'server_error' END AS side"""))
def _(spark, d):
    return logs(spark, d).select("event_id", bands.status_class("statusCode").alias("class"), bands.error_side("statusCode").alias("side"))


@query("fn_32_throughput_band", _q("""CASE WHEN CAST(throughput AS DOUBLE) < 1000000 THEN 'very_low' WHEN CAST(throughput AS DOUBLE) < 3000000 THEN 'low'
 WHEN CAST(throughput AS DOUBLE) < 8000000 THEN 'medium' ELSE 'high' END AS band"""))
def _(spark, d):
    return logs(spark, d).select("event_id", bands.throughput_band("throughput").alias("band"))


@query("fn_33_viewer_keys", _q("""COALESCE(cliIP, 'NA') || '|' || COALESCE(UA, 'NA') AS pseudo_user,
 CASE WHEN cliIP IS NOT NULL AND UA IS NOT NULL THEN cliIP || '|' || UA WHEN cliIP IS NOT NULL THEN cliIP ELSE UA END AS viewer_key,
 CASE WHEN cliIP IS NOT NULL AND UA IS NOT NULL THEN 'ipua:' || cliIP || '|' || UA WHEN cliIP IS NOT NULL THEN 'ip:' || cliIP ELSE 'ua:' || UA END AS viewer_id,
 CASE WHEN cliIP IS NOT NULL AND UA IS NOT NULL THEN 'cliIP_UA' WHEN cliIP IS NOT NULL THEN 'cliIP_only' WHEN UA IS NOT NULL THEN 'UA_only' ELSE 'no_viewer' END AS viewer_type"""))
def _(spark, d):
    df = users.with_pseudo_user(logs(spark, d))
    vid, kind = users.viewer_id(F.col("cliIP"), F.col("UA"))
    return df.select("event_id", "pseudo_user", watch.viewer_key(F.col("cliIP"), F.col("UA")).alias("viewer_key"), vid.alias("viewer_id"), kind.alias("viewer_type"))


@query("fn_34_timeline_key", on_timelines("SELECT event_id, timeline_key, row_group FROM tl1"))
def _(spark, d):
    df = logs(spark, d)
    dev, sid = qs.qs_trimmed("queryStr", "device_id"), qs.qs_trimmed("queryStr", "session_id")
    ip, ua = text.blank_to_null("cliIP"), text.blank_to_null("UA")
    df = df.select("event_id", dev.alias("dv"), sid.alias("sd"), ip.alias("ip"), ua.alias("ua"), channels.stream_key("reqPath").alias("st"))
    return df.select("event_id", watch.timeline_key(*[F.col(c) for c in ("dv", "sd", "ip", "ua", "st")]).alias("timeline_key"),
                     watch.row_group(F.col("dv"), F.col("sd")).alias("row_group"))


EST_SQL = f"""SELECT event_id, dev AS device_id, dsrc AS device_id_source, COALESCE({x('session_id')}, 'est_' || md5(dev || '|' || CAST({day()} AS VARCHAR) || '|' || CAST((req_ts % 86400) // 3600 AS VARCHAR))) AS session_id,
 CASE WHEN {x('session_id')} IS NOT NULL THEN 'queryStr.session_id' ELSE 'estimated_device_date_hour' END AS session_id_source
 FROM (SELECT *, COALESCE({x('device_id')}, 'est_' || md5(COALESCE(cliIP, '') || '|' || COALESCE(UA, ''))) AS dev,
 CASE WHEN {x('device_id')} IS NOT NULL THEN 'queryStr.device_id' ELSE 'estimated_cliIP_UA' END AS dsrc FROM t)"""


@query("fn_35_estimated_ids", on_logs(EST_SQL))
def _(spark, d):
    from ..operators import summary

    return summary.with_estimated_ids(typed(logs(spark, d))).select("event_id", "device_id", "device_id_source", "session_id", "session_id_source")


@query("fn_36_ist_label", _q(f"strftime({day()}, '%d/%m/%y') AS label, {day(offset=19800)} AS real_ist_date"))
def _(spark, d):
    df = typed(logs(spark, d))
    return df.select("event_id", clock.ist_label(clock.day_date("req_ts")).alias("label"), clock.day_date("req_ts", 19800).alias("real_ist_date"))


@query("fn_37_country_name", _q("CASE country WHEN 'IN' THEN 'India' WHEN 'AE' THEN 'United Arab Emirates' ELSE 'Unknown' END AS country_name"))
def _(spark, d):
    return dimensions.with_country_name(logs(spark, d), "country").select("event_id", "country_name")


@query("fn_38_count_bins", """SELECT o_custkey, n, CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25' WHEN n <= 50 THEN '26-50'
 WHEN n <= 100 THEN '51-100' ELSE '100+' END AS session_bin, CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' WHEN n <= 100 THEN '21-100'
 WHEN n <= 1000 THEN '101-1K' WHEN n <= 10000 THEN '1K-10K' ELSE '10K+' END AS row_bin FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1)""")
def _(spark, d):
    df = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return df.select("o_custkey", "n", bands.count_bin("n", bands.SESSION_BINS, "100+").alias("session_bin"), bands.count_bin("n", bands.ROW_BINS, "10K+").alias("row_bin"))


@query("fn_39_mostly_numeric", on_logs("""SELECT * FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, ROUND(100.0 * COUNT(TRY_CAST({c} AS DOUBLE)) / COUNT(*), 2) AS numeric_pct, COUNT(TRY_CAST({c} AS DOUBLE)) > 0.75 * COUNT(*) AS is_numeric FROM logs"
    for c in ("totalBytes", "statusCode", "queryStr", "UA", "asn")) + ")"))
def _(spark, d):
    return is_mostly_numeric(logs(spark, d), ["totalBytes", "statusCode", "queryStr", "UA", "asn"])


@query("fn_40_channel_suffix", _q(rf"""COALESCE(regexp_extract(regexp_replace(TRIM({x('channel')}), '\s*_\s*', '_', 'g'), '(?i)_(firetv|androidtv|android|web)$', 1), '') AS suffix,
 COALESCE(TRIM(regexp_replace(regexp_replace(regexp_replace(TRIM({x('channel')}), '\s*_\s*', '_', 'g'), '(?i)_(firetv|androidtv|android|web)$', ''), '\s+', ' ', 'g')), '') AS channel"""))
def _(spark, d):
    c = qs.qs_value("queryStr", "channel")
    return logs(spark, d).select("event_id", channels.channel_suffix(c).alias("suffix"), channels.channel_early(c).alias("channel"))
