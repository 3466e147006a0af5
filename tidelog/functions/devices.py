"""Device, platform and user-agent classes. Branch order is part of the meaning."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import as_text

# ---- fixed values: device code -> model name ----------------------------
DEVICE_NAMES = (
    ("AFTSS", "Amazon Fire TV Stick (2nd Gen / Lite)"),
    ("AFTSSS", "Amazon Fire TV Stick 4K"),
    ("AFTMM", "Amazon Fire TV Cube"),
    ("AFTKA", "Amazon Fire TV Stick 4K Max"),
    ("AFTKM", "Amazon Fire TV Stick (3rd Gen)"),
    ("AFTBU001", "Amazon Fire TV Stick 4K Max"),
    ("AFTBTX4", "Amazon Fire TV Stick 4K Max (2023)"),
    ("AFTDE70DFC", "Amazon Fire TV device (unidentified model)"),
    ("AFTMA08C15", "Amazon Fire TV device"),
    ("AFTMAN001", "Amazon Fire TV device"),
    ("AFTMV00", "Amazon Fire TV device"),
    ("AFTNE4E43F", "Amazon Fire TV device"),
    ("AFTPR001", "Amazon Fire TV device"),
    ("AFTLE", "Amazon Fire TV Stick Lite"),
    ("AFTGRO001", "Amazon Fire TV device"),
    ("AFTCA002", "Amazon Fire TV device"),
    ("AFTGAZL", "Amazon Fire TV device"),
    ("AFTBOXE1", "Amazon Fire TV Stick (box edition)"),
    ("AFTKRT", "Amazon Fire TV Stick (Krypton)"),
    ("AFTMA475B1", "Amazon Fire TV device"),
    ("AFTANNA0", "Amazon Fire TV device"),
    ("AFTJMST12", "Amazon Fire TV device"),
    ("AFTEAMR311", "Amazon Fire TV device"),
    ("AFTCL001", "Amazon Fire TV device"),
    ("AFTHA004", "Amazon Fire TV device"),
    ("AFTA", "Amazon Fire TV (original / 1st gen)"),
    ("AFTDEC012E", "Amazon Fire TV device"),
    ("AFTEU011", "Amazon Fire TV (European)"),
    ("AFTKADE001", "Amazon Fire TV device"),
    ("Chromecast", "Google Chromecast"),
    ("Chromecast HD", "Google Chromecast with Google TV (HD)"),
    ("Chromecast with Google TV", "Google Chromecast with Google TV (4K)"),
    ("BRAVIA", "Sony Bravia TV"),
    ("BRAVIA 4K VH2", "Sony Bravia 4K VH2 series"),
    ("BRAVIA 4K VH21", "Sony Bravia 4K VH21 series"),
    ("BRAVIA 4K VH22", "Sony Bravia 4K VH22 series"),
    ("BRAVIA 4K AE2", "Sony Bravia 4K AE2 series"),
    ("BRAVIA 4K GB", "Sony Bravia 4K GB series"),
    ("BRAVIA 4K UR2", "Sony Bravia 4K UR2 series"),
    ("BRAVIA 4K UR3", "Sony Bravia 4K UR3 series"),
    ("BRAVIA 2015", "Sony Bravia (2015 model)"),
    ("BRAVIA VU1", "Sony Bravia VU1 series"),
    ("BRAVIA VU2", "Sony Bravia VU2 series"),
    ("BRAVIA VU3", "Sony Bravia VU3 series"),
    ("BRAVIA VU31", "Sony Bravia VU31 series"),
    ("BRAVIA BF1", "Sony Bravia BF1 series"),
    ("BRAVIA VH1", "Sony Bravia VH1 series"),
    ("MiTV-AXSO0", "Xiaomi Mi TV Stick (4K)"),
    ("MiTV-AXSO1", "Xiaomi Mi TV Stick (1080p)"),
    ("MiTV-AXSO2", "Xiaomi Mi TV Stick (4K)"),
    ("MiTV-MOOQ0", "Xiaomi Mi Box S"),
    ("MiTV-MOOQ1", "Xiaomi Mi Box S (2nd Gen)"),
    ("MiTV-MOOQ3", "Xiaomi Mi TV Stick (2023)"),
    ("MiTV-AXFR2", "Xiaomi Mi TV Stick (4K)"),
    ("MiTV-AESP0", "Xiaomi Mi TV P1"),
    ("MiTV-MOSR1", "Xiaomi Mi TV Stick (4K)"),
    ("MiTV-MZTU0", "Xiaomi Mi TV Stick (unidentified)"),
    ("MIBOX4", "Xiaomi Mi Box 4"),
    ("realme Smart TV", "Realme Smart TV"),
    ("realme Smart TV 4K", "Realme Smart TV 4K"),
    ("Oneplus Dosa IN", "OnePlus TV (Dosa series India)"),
    ("VU 4K", "VU 4K TV"),
    ("VU 4K Google TV", "VU 4K Google TV"),
    ("VU TV FFM", "VU TV (FFM series)"),
    ("haierATV", "Haier Android TV"),
    ("haierATVnippori", "Haier Android TV (Nippori series)"),
    ("Tata Sky Binge Plus", "Tata Sky Binge+ set-top box"),
    ("XStream Smart Box 001", "Airtel Xstream Smart Box"),
    ("Xstream4 AR", "Airtel Xstream 4K"),
    ("XstreamIPTV1-VT", "Airtel Xstream IPTV (VT)"),
    ("XstreamIPTV2-SM", "Airtel Xstream IPTV (SM)"),
    ("NSTV", "Nokia Streaming Box"),
    ("NSTV FF", "Nokia Streaming Box (FF series)"),
    ("CloudTV518", "Cloud TV (generic Android TV box)"),
    ("CloudTV521", "Cloud TV (generic Android TV box)"),
    ("Cloud TV", "Cloud TV (generic)"),
    ("AndroidTV", "Generic Android TV device"),
    ("Smart TV", "Generic Smart TV"),
    ("Smart TV Pro", "Generic Smart TV Pro"),
    ("SmartTV 4K", "Generic 4K Smart TV"),
    ("SmartTV 4K FFM", "Generic 4K Smart TV (FFM series)"),
    ("Toshiba TV", "Toshiba Android TV"),
    ("Toshiba TV with MIC", "Toshiba Android TV (with microphone)"),
    ("Philips Smart 4K TV", "Philips 4K Android TV"),
    ("Philips UHD Android TV", "Philips UHD Android TV"),
    ("Panasonic TV", "Panasonic Android TV"),
    ("HiSmartTV A4", "Hisense Smart TV (A4 series)"),
    ("HiSmart TV", "Hisense Smart TV"),
    ("LLOYD 4K SMART TV", "Lloyd 4K Android TV"),
    ("LLOYD 2K SMART TV", "Lloyd 2K Android TV"),
)


def with_device_name(df: DataFrame, code: str, out: str = "device_model") -> DataFrame:
    """Add the model name of a device code; the name table is a fixed 90 rows."""
    names = df.sparkSession.createDataFrame(list(DEVICE_NAMES), "_code string, _name string")
    plain = F.replace(as_text(code), F.lit("%20"), F.lit(" "))
    joined = df.withColumn("_plain", plain).join(F.broadcast(names), F.col("_plain") == F.col("_code"), "left")
    c = F.col("_plain")
    label = (
        F.when(F.col("_name").isNotNull(), F.col("_name"))
        .when(c.startswith("AFT"), F.concat(F.lit("Amazon Fire TV device (code: "), c, F.lit(")")))
        .when(c.startswith("BRAVIA"), F.concat(F.lit("Sony Bravia TV ("), c, F.lit(")")))
        .when(c.startswith("MiTV"), F.concat(F.lit("Xiaomi Mi TV ("), c, F.lit(")")))
        .otherwise(c)
    )
    return joined.withColumn(out, label).drop("_plain", "_code", "_name")


def _low(c: Column | str) -> Column:
    return F.lower(F.coalesce(as_text(c), F.lit("")))


def _first_hit(text: Column, table: list[tuple[str, tuple[str, ...]]], otherwise: str) -> Column:
    """First label whose any keyword is contained in the text."""
    out = None
    for label, words in table:
        hit = text.contains(words[0])
        for w in words[1:]:
            hit = hit | text.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


TV_WORDS = r"smarttv|hismarttv|bravia|\btv\b"
TV_WORDS_WIDE = r"smarttv|hismarttv|bravia|cloudtv|xstream|tata sky binge|\btv\b"


def device_type(ua: Column | str, platform: Column | str, wide: bool = False) -> Column:
    """Smart TV, Android, iPhone, iPad, Windows, Mac or Other; first branch wins."""
    u = _low(ua)
    tv = _low(platform).contains("android_tv") | u.rlike(TV_WORDS_WIDE if wide else TV_WORDS)
    return (
        F.when(tv, "Smart TV")
        .when(u.contains("android"), "Android")
        .when(u.contains("iphone"), "iPhone")
        .when(u.contains("ipad"), "iPad")
        .when(u.contains("windows"), "Windows")
        .when(u.contains("mac"), "Mac")
        .otherwise("Other")
    )


# Families in order, each with its keyword groups; an agent must hold all keywords of a group.
FAMILIES = (
    ("Fire TV", (("android", "aft"),)),
    ("Android TV", (("android tv",),)),
    ("Android Mobile", (("android",),)),
    ("iOS", (("iphone",), ("ipad",), ("ios",))),
    ("Sony TV", (("bravia",),)),
    ("Samsung TV", (("tizen",), ("samsungbrowser",))),
    ("LG TV", (("webos",), ("lg",))),
    ("Windows", (("windows",),)),
    ("Mac", (("mac os",), ("macintosh",))),
    ("Linux", (("linux",),)),
)


def device_family(ua: Column | str) -> Column:
    """Eleven families used as a facet."""
    u = _low(ua)
    holds = lambda group: functools.reduce(lambda a, b: a & b, map(u.contains, group))
    out = F.lit("Other")
    for label, groups in reversed(FAMILIES):
        out = F.when(functools.reduce(lambda a, b: a | b, map(holds, groups)), label).otherwise(out)
    return out


def tv_class(ua: Column | str, app_marker: str = "yourappname") -> Column:
    """Twelve TV and app classes."""
    u = F.lower(F.coalesce(as_text(ua), F.lit("none")))
    app = u.contains("exoplayer") | u.contains("dalvik") | u.contains(app_marker)
    box = u.contains("tv") | u.contains("build") | u.contains("box") | u.contains("stb")
    return _chain(
        _first_hit(
            u,
            [  # fixed values
                ("Apple TV", ("apple tv", "applecoremedia")),
                ("Amazon Fire TV", ("aft",)),
                ("Sony TV", ("bravia", "sony")),
                ("Mi TV", ("mitv", "xiaomi")),
                ("Skyworth TV", ("swtv", "skyworth")),
                ("Samsung TV", ("tizen",)),
                ("LG TV", ("webos",)),
                ("Android TV", ("android tv", "google tv")),
            ],
            "",
        ),
        F.when(app & box, "Android TV Box")
        .when(app, "Android Mobile App")
        .when(u.contains("mozilla"), "Web Browser")
        .otherwise("Other/System"),
    )


def _chain(first: Column, then: Column) -> Column:
    return F.coalesce(F.nullif(first, F.lit("")), then)


def platform_tag(ua: Column | str) -> Column:
    """About 22 classes of players, tools, bots and scanners."""
    raw = as_text(ua)
    u = F.lower(raw)
    dalvik = (
        F.when(raw.rlike("(?i)aft[a-z0-9]"), "Amazon Fire TV")
        .when(u.contains("bravia"), "Sony BRAVIA")
        .when(u.contains("mibox") | u.contains("mitvstick"), "Xiaomi/MiBox")
        .otherwise("Other Android TV")
    )
    media = (
        F.when(u.contains("apple tv"), "Apple TV").when(u.contains("iphone"), "iPhone (ACM)").otherwise("Apple Other")
    )
    app_name = F.nullif(F.regexp_extract(raw, r"^([^\s/]+)", 1), F.lit(""))
    tail = _first_hit(
        u,
        [  # fixed values
            ("Tool: FFmpeg", ("lavf", "ffmpeg")),
            ("Tool: curl", ("curl",)),
            ("Service: AdFlag", ("adflag",)),
            ("Service: hls2disk", ("hls2disk",)),
            ("Scanner: Palo Alto", ("palo alto", "xpanse")),
            ("Bot: Slack", ("slackbot",)),
        ],
        "",
    )
    return (
        F.when(raw.isNull() | (raw == ""), "Null/Invalid")
        .when(u.contains("dalvik"), dalvik)
        .when(u.contains("web0s") | u.contains("webos"), "LG WebOS")
        .when(u.contains("tizen"), "Samsung Tizen")
        .when(u.contains("applecoremedia"), media)
        .when(u.contains("iphone"), "iPhone Browser")
        .when(u.contains("ipad"), "iPad Browser")
        .when(u.contains("macintosh"), "Mac Browser")
        .when(u.contains("windows"), "Windows Browser")
        .when(u.contains("exoplayer"), F.concat(F.lit("App: "), F.coalesce(app_name, F.lit("ExoPlayer"))))
        .otherwise(
            _chain(tail, F.when(F.trim(raw).isin("(null)", "-", ""), "Null/Invalid").otherwise("Other"))
        )
    )


# ---- fixed values: brand, type and the keywords that select them --------
BRANDS = [
    ("Amazon Fire TV", "Connected TV", ("firetv", "aft", "amazon")),
    ("Sony BRAVIA", "Connected TV", ("bravia", "sony")),
    ("Samsung", "Connected TV", ("tizen", "samsung")),
    ("LG", "Connected TV", ("webos", "lg")),
    ("Roku", "Connected TV", ("roku",)),
    ("Android", "Android / Mobile / CTV", ("android",)),
    ("Apple iOS", "Mobile / Tablet", ("iphone", "ipad")),
    ("Desktop", "Desktop", ("windows", "macintosh")),
]


def device_brand(ua: Column | str) -> Column:
    u = _low(ua)
    missing = F.when(F.trim(u).isin("") | u.isin("nan", "none", "null"), "Missing / Null").otherwise("Unknown")
    return _chain(_first_hit(u, [(b, w) for b, _, w in BRANDS], ""), missing)


def brand_type(ua: Column | str) -> Column:
    return _first_hit(_low(ua), [(t, w) for _, t, w in BRANDS], "Unknown")


def android_version(ua: Column | str) -> Column:
    """Version after 'Android '; NULL when absent."""
    return F.nullif(F.regexp_extract(as_text(ua), r"Android (\d+)", 1), F.lit(""))


def android_version_encoded(ua: Column | str) -> Column:
    """Same for percent-encoded agents: any mix of blank, '%', '2', '0' before the digits."""
    return F.nullif(F.regexp_extract(as_text(ua), r"Android[%20\s]+(\d+)", 1), F.lit(""))


def device_model(ua: Column | str) -> Column:
    """Model between 'Android x;' and 'Build/'; NULL when absent."""
    return F.nullif(F.trim(F.regexp_extract(as_text(ua), r"Android [\d.]+;\s*(.+?)\s*Build/", 1)), F.lit(""))


# ---- fixed values: bot words for the keyword fallback of UA parsing -----
BOT_WORDS = r"bot|crawl|spider|slurp|curl|wget|python-requests|scanner"


def is_bot(ua: Column | str) -> Column:
    return _low(ua).rlike(BOT_WORDS)


def os_family(ua: Column | str) -> Column:
    return _first_hit(
        _low(ua),
        [  # fixed values
            ("Android", ("android",)),
            ("iOS", ("iphone", "ipad", "applecoremedia")),
            ("Windows", ("windows",)),
            ("Mac OS X", ("mac os", "macintosh")),
            ("Tizen", ("tizen",)),
            ("webOS", ("webos", "web0s")),
            ("Linux", ("linux",)),
        ],
        "Unknown",
    )
