"""Scalar functions of the telemetry pipelines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_bytes(c: Column) -> Column:
    return F.unhex(F.replace(c, F.lit("-"), F.lit("")))


def _as_uuid(hexed: Column) -> Column:
    return F.concat_ws("-", *[F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def parse_uuid(text: Column) -> Column:
    """An id in lower case with hyphens; null for what is none. It may come without hyphens, in braces or as a URN."""
    dashed = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    good = text.rlike(rf"^(?:[0-9a-fA-F]{{32}}|(?:urn:uuid:)?{dashed}|\{{{dashed}\}})\z")
    return F.when(good, _as_uuid(F.lower(F.regexp_replace(text, r"^urn:uuid:|[{}-]", ""))))


def hash_id(ident: Column, project: Column) -> Column:
    """A project's pseudonym of an id: 16 bytes of SHA-256 over both ids' bytes."""
    return _as_uuid(F.sha2(F.concat(uuid_bytes(ident), uuid_bytes(project)), 256))


def day_of(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def cookieless_id(ip: Column, user_agent: Column, project: Column, ms: Column) -> Column:
    """A visitor id without a cookie that changes every UTC day."""
    return _as_uuid(F.sha2(F.concat(F.encode(ip, "UTF-8"), F.encode(user_agent, "UTF-8"), uuid_bytes(project), F.encode(day_of(ms), "UTF-8")), 256))


def exact_hash(kind: Column, message: Column, stack: Column) -> Column:
    """SHA-256 of the three texts; a missing one is empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in (kind, message, stack)]), 256)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def client_ip(cf: Column, forwarded_for: Column, real_ip: Column, forwarded: Column) -> Column:
    """The first address header that is present; '' without any."""
    part = F.get(F.filter(F.transform(F.split(forwarded, ";"), trimmed), lambda x: x.startswith("for=")), F.lit(0))
    value = F.regexp_replace(F.substring(part, 5, 1000), '^"+|"+$', "")
    bare = F.split(F.regexp_replace(F.regexp_replace(value, r"^\[+", ""), r"\]+$", ""), ":")[0]
    return F.coalesce(cf, trimmed(F.split(forwarded_for, ",")[0]), real_ip, bare, F.lit(""))


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, else null."""
    return F.nullif(F.lower(F.regexp_extract(trimmed(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def request_origin(origin: Column, referer: Column) -> Column:
    return F.coalesce(host_of(origin), host_of(referer))


def hostname_allowed(patterns: Column, host: Column) -> Column:
    """No patterns allow all; else there has to be a host, and it has to be one, or lie under a `*.` pattern at a dot."""

    def one(p: Column) -> Column:
        low = F.lower(p)
        under = F.substring(low, 3, 1000)
        return (low == "*") | (low == F.lower(host)) | (F.startswith(low, F.lit("*.")) & ((F.lower(host) == under) | F.endswith(F.lower(host), F.concat(F.lit("."), under))))

    return (F.size(patterns) == 0) | F.coalesce(host.isNotNull() & F.exists(patterns, one), F.lit(False))


def normalize_route(url: Column) -> Column:
    """A URL's path with one leading and no trailing slash. `host:port/x` is read as scheme and path."""
    t = trimmed(url)
    path = F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_extract(t, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)).otherwise(F.regexp_replace(t, "[?#].*$", ""))
    tidy = F.regexp_replace(F.regexp_replace(path, "^([^/])", "/$1"), "/+$", "")
    return F.when(F.coalesce(tidy, F.lit("")) == "", "/").otherwise(tidy)


def whole_number(c: Column) -> Column:
    """A non-negative whole number as a long, else null."""
    return F.when((c >= 0) & (c == F.floor(c)), c.cast("long"))


def as_u16(c: Column) -> Column:
    return F.when((c >= 0) & (c <= 65535) & (c == F.floor(c)), c.cast("int"))


# Keywords of device classes.
DEVICE_WORDS = {
    "Bot": ["bot", "spider", "crawler", "headless"],
    "Mobile": ["mobile", "iphone", "ipod", "windows phone", "blackberry"],
    "Tablet": ["tablet", "ipad", "kindle"],
    "TV": ["smart-tv", "smarttv", "googletv", "appletv", "hbbtv"],
    "Console": ["playstation", "xbox", "nintendo"],
    "Wearable": ["watch"],
}


def classify_device(user_agent: Column) -> Column:
    """The first class with a keyword in the user agent; Android without `tablet` is Mobile."""
    low = F.lower(user_agent)
    has = {name: low.rlike("|".join(words)) for name, words in DEVICE_WORDS.items()}
    has["Mobile"] = has["Mobile"] | (low.contains("android") & ~low.contains("tablet"))
    out = F.when(has["Bot"], "Bot")
    for name in list(has)[1:]:
        out = out.when(has[name], name)
    return out.otherwise("Desktop")


# Flush reasons that are counted by name.
FLUSH_REASONS = ["interval", "maxEvents", "maxBytes", "checkout", "fullSnapshot", "minLength", "pageHidden", "pageShow", "unload", "stop", "sessionRotate", "coalesced", "manual"]


def flush_reason_label(c: Column) -> Column:
    return F.when(c.startswith("coalesced:"), "coalesced").when(c.isin(FLUSH_REASONS), c).otherwise("unknown")


# Bounds of valid vitals and where they count as poor.
VITAL_MAX = {"CLS": 100.0, "LCP": 86_400_000.0, "FCP": 86_400_000.0, "INP": 86_400_000.0, "TTFB": 86_400_000.0, "FID": 86_400_000.0}
VITAL_POOR = {"LCP": 4000.0, "FCP": 3000.0, "INP": 500.0, "CLS": 0.25, "TTFB": 1800.0, "FID": 300.0}


def _by_metric(metric: Column, table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[metric]


def valid_vital(metric: Column, value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (value >= 0) & (value <= _by_metric(metric, VITAL_MAX)), F.lit(False))


def poor_vital(metric: Column, value: Column) -> Column:
    return F.coalesce(value >= _by_metric(metric, VITAL_POOR), F.lit(False))
