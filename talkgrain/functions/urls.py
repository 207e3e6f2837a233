"""URLs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")
ASSETS = ("avif", "css", "csv", "doc", "docx", "gif", "ico", "jpeg", "jpg", "js", "json", "mp3", "mp4", "pdf", "png", "svg", "webp", "woff", "woff2", "xls", "xlsx", "xml", "zip")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", "")), r"\.+$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), ":([0-9]+)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """Lower-case scheme and host, no default port, fragment, tracking parameter or trailing slash; parameters sorted.

    Null for what isn't http or https, has no host, credentials or an unusual port.
    """
    s, h, p = scheme(url), host(url), port(url)
    usual = ((s == "https") & (p == "443")) | ((s == "http") & (p == "80")) | (p == "")
    place = F.when(usual, h).otherwise(F.concat(h, F.lit(":"), p))
    bare = F.regexp_replace(path(url), "/+$", "")
    name = lambda kv: F.lower(F.substring_index(kv, "=", 1))
    wanted = F.filter(F.split(query(url), "&"), lambda kv: (kv != "") & ~name(kv).startswith("utm_") & ~name(kv).isin(*TRACKING))
    q = F.array_join(F.array_sort(F.transform(wanted, lambda kv: F.when(F.contains(kv, F.lit("=")), kv).otherwise(F.concat(kv, F.lit("="))))), "&")
    out = F.concat(s, F.lit("://"), place, F.when(bare == "", F.lit("/")).otherwise(bare), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
    good = s.isin("http", "https") & (h != "") & ~F.contains(authority(url), F.lit("@")) & p.isin("", "80", "443")
    return F.when(good, out)


def allowed(url: Column, domains: list[str]) -> Column:
    h = host(url)
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out


def concrete(url: Column) -> Column:
    """Not a template of routes such as /blog/[slug]."""
    route = F.try_url_decode(F.concat(path(url), F.lit("?"), query(url)))
    return ~F.coalesce(route, F.lit("[")).rlike(r"[\[\]{}]")


def is_asset(url: Column) -> Column:
    return path(url).rlike(r"(?i)\.(" + "|".join(ASSETS) + ")$")


def under_prefix(url: Column, prefixes: list[str]) -> Column:
    """Whether the decoded path is one of the prefixes or below it."""
    p = F.regexp_replace(F.coalesce(F.try_url_decode(path(url)), path(url)), "/+$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    out = F.lit(False)
    for x in (x.rstrip("/") for x in prefixes if x.startswith("/")):
        out = out | (p == x) | p.startswith(x + "/")
    return out


def without_query(url: Column) -> Column:
    """For logs: scheme, host, port and path."""
    p = port(url)
    at = F.concat(host(url), F.when(p == "", F.lit("")).otherwise(F.concat(F.lit(":"), p)))
    return F.when(authority(url) == "", F.lit("[redacted-url]")).otherwise(F.concat(scheme(url), F.lit("://"), at, path(url)))
