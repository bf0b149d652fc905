"""URL algebra: parts, keys, joins and trailing slashes of URLs, as columns inside generated code.

One regular expression splits a URL; hosts and paths are taken as they are written. Percent-encoding,
dot segments and international host names are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"^(?i)(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME, HOST, PATH, QUERY, FRAGMENT = 1, 2, 3, 4, 5


def part(url: Column, which: int) -> Column:
    """One part of a URL, empty where it is missing or the URL is not http(s)."""
    return F.regexp_extract(url, SPLIT, which)


def head(url: Column) -> Column:
    """Scheme and host as they are written, empty for what is not a URL."""
    return F.regexp_extract(url, r"^(?i)https?://[^/?#]+", 0)


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#]"), F.lit(False))


def origin(url: Column) -> Column:
    """Scheme and host in lower case, without user and the scheme's own port; empty for what is not a URL."""
    low = F.lower(head(url))
    odd = F.regexp_replace(F.regexp_replace(low, r"^(https?://)[^@]*@", "$1"), r"^(?:(http://[^:]*):80|(https://[^:]*):443)$", "$1$2")
    return F.when(F.length(F.translate(low, "@:", "")) < F.length(low) - 1, odd).otherwise(low)


def host(url: Column) -> Column:
    """The host in lower case with a port other than the scheme's own; null for what is not a URL."""
    return F.nullif(F.regexp_replace(origin(url), "^https?://", ""), F.lit(""))


def normalize_host(name: Column) -> Column:
    """Lower case, without one leading www."""
    return F.regexp_replace(F.lower(name), r"^www\.", "")


def loc_host(url: Column) -> Column:
    """The normalised host name of an http(s) loc, without a port; null for anything else."""
    return normalize_host(F.regexp_replace(host(url), r":[0-9]*$", ""))


def same_domain(detected: Column, expected: Column) -> Column:
    """Equal hosts, or a subdomain of the expected one."""
    return (detected == expected) | F.endswith(detected, F.concat(F.lit("."), expected))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?i)https?://[^/?#]+([^?#]*)", 1)


def path(url: Column) -> Column:
    """The path of a URL, at least a slash."""
    return F.when(is_url(url), F.coalesce(F.nullif(_path(url), F.lit("")), F.lit("/")))


def dedup_key(url: Column, keep_query: bool = False) -> Column:
    """What makes two locs the same: scheme and host in lower case, the path as written less one trailing slash.

    Query and fragment do not count, unless the query is asked for. What is not a URL is its own key,
    trimmed and in lower case.
    """
    stem = F.regexp_replace(F.concat(_path(url), F.lit("/")), "(?<=.)//?$|^/$", "")
    query = part(url, QUERY) if keep_query else F.lit("")
    return F.when(is_url(url), F.concat(origin(url), F.when(stem == "", "/").otherwise(stem), query)).otherwise(F.lower(F.trim(url)))


def segments(p: Column) -> Column:
    """The non-empty segments of a path."""
    return F.filter(F.split(p, "/"), lambda s: s != "")


def resolve(base: Column, loc: Column) -> Column:
    """A loc against a base URL: absolute ones stay, rooted paths take the host, others the base's folder."""
    root = F.concat(part(base, SCHEME), F.lit("://"), part(base, HOST))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(loc.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), loc)
        .when(F.startswith(loc, F.lit("//")), F.concat(part(base, SCHEME), F.lit(":"), loc))
        .when(F.startswith(loc, F.lit("/")), F.concat(root, loc))
        .when(F.startswith(loc, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), loc))
        .otherwise(F.concat(root, folder, loc))
    )


def path_and_query(url: Column) -> Column:
    return F.concat(path(url), part(url, QUERY))


def join_path(base: Column, p: Column) -> Column:
    """A base URL without trailing slashes, and a path with one leading slash."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p)))


def path_key(value: Column) -> Column:
    """The path of a URL, or the value as a path."""
    return F.coalesce(path(value), F.when(F.startswith(value, F.lit("/")), value).otherwise(F.concat(F.lit("/"), value)))


FILE_END = r"\.[A-Za-z0-9]{1,8}$"


def add_slash(url: Column) -> Column:
    """The URL with a slash behind its path; null where it has one, is the root, or names a file."""
    p = part(url, PATH)
    wanted = is_url(url) & (p != "") & ~p.rlike("/$") & ~p.rlike(FILE_END)
    return F.when(wanted, F.concat(part(url, SCHEME), F.lit("://"), part(url, HOST), p, F.lit("/"), part(url, QUERY), part(url, FRAGMENT)))


def strip_slash(url: Column) -> Column:
    """The URL without the slash behind its path; null where there is none or the path is the root."""
    p = part(url, PATH)
    wanted = is_url(url) & (F.length(p) > 1) & p.rlike("/$")
    return F.when(wanted, F.concat(part(url, SCHEME), F.lit("://"), part(url, HOST), F.regexp_replace(p, "/$", ""), part(url, QUERY), part(url, FRAGMENT)))


def add_path_slash(value: Column) -> Column:
    """As add_slash, for a path with a query."""
    p, q = F.substring_index(value, "?", 1), F.regexp_extract(value, r"(\?.*)$", 1)
    return F.when((p != "") & ~p.rlike("/$") & ~p.rlike(FILE_END), F.concat(p, F.lit("/"), q))


def strip_path_slash(value: Column) -> Column:
    p, q = F.substring_index(value, "?", 1), F.regexp_extract(value, r"(\?.*)$", 1)
    return F.when((F.length(p) > 1) & p.rlike("/$"), F.concat(F.regexp_replace(p, "/$", ""), q))


# What a page says instead of a 404 status.
NOT_FOUND_PHRASES = (
    "no entity selected",
    "page not found",
    "404",
    "not found",
    "no results",
    "no data found",
    "does not exist",
)


def looks_not_found(url: Column) -> Column:
    """Whether a URL's own words say that there is nothing: a marker, a phrase, or 404 standing alone."""
    plain = F.lower(F.coalesce(F.try_url_decode(url), url))
    spaced = F.translate(plain, "-_+/?&=", " " * 7)
    phrases = [F.contains(spaced, F.lit(p)) for p in NOT_FOUND_PHRASES if p != "404"]
    found = plain.rlike(r"\bnot[-_ ]?found\b") | spaced.rlike(r"\b404\b")
    for p in phrases:
        found = found | p
    return found


def soft_404(body: Column, window: int | None = None, short: int = 1000) -> Column:
    """Whether a body is a soft 404: it says so (within a window from its start, if one is given), or has fewer than 1000 bytes."""
    head = F.lower(F.substring(body, 1, window) if window else body)
    said = F.lit(False)
    for p in NOT_FOUND_PHRASES:
        said = said | F.contains(head, F.lit(p))
    return said | (F.octet_length(body) < short)
