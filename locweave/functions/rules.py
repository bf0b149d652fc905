"""Statuses, redirect rules, find and replace, XML text, names and dates as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def redirect_status(status: Column) -> Column:
    return status.isin(301, 302, 307, 308)


def category(status: Column, soft_404: Column) -> Column:
    """success, soft_404, redirect or failure, of a status as first answered."""
    return (
        F.when(redirect_status(status), "redirect")
        .when(status.between(200, 299), F.when(F.coalesce(soft_404, F.lit(False)), "soft_404").otherwise("success"))
        .otherwise("failure")
    )


def weight(kind: Column) -> Column:
    """What a sample of a category counts for."""
    return F.when(kind == "success", 1.0).when(kind == "redirect", 0.5).when(kind == "soft_404", 0.25).otherwise(0.0)


def status_bucket(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "UNKNOWN").when(confidence >= 80, "GOOD").when(confidence >= 50, "WARNING").otherwise("BAD")


def request_error(message: Column) -> Column:
    """ssl_cert, timeout or no_response; the first that the message speaks of."""
    low = F.lower(message)
    return (
        F.when(low.rlike("cert|self-signed|self signed|ssl|unable to verify"), "ssl_cert")
        .when(low.rlike("timeout|timed out|aborted|aborterror"), "timeout")
        .otherwise("no_response")
    )


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two strings have in common at the start."""
    least = F.least(F.length(a), F.length(b))
    at = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(at, lambda i: F.left(a, i) == F.left(b, i)))


def diff_rule(source: Column, dest: Column) -> Column:
    """What turned one URL into another: struct(prefix, find, put), null for equal ones.

    find is what stands between the common start and end; where it is empty, put is inserted behind prefix.
    """
    p = common_prefix(source, dest)
    a, b = F.substring(source, p + 1, F.length(source)), F.substring(dest, p + 1, F.length(dest))
    s = common_prefix(F.reverse(a), F.reverse(b))
    return F.when(
        source != dest,
        F.struct(
            F.when(F.length(a) == s, F.left(source, p)).alias("prefix"),
            F.left(a, F.length(a) - s).alias("find"),
            F.left(b, F.length(b) - s).alias("put"),
        ),
    )


def apply_rule(url: Column, rule: Column) -> Column:
    """The URL by the rule; null where it does not apply or changes nothing."""
    replaced = F.when(F.contains(url, rule["find"]), F.replace(url, rule["find"], rule["put"]))
    inserted = F.when(F.startswith(url, rule["prefix"]), F.concat(rule["prefix"], rule["put"], F.substring(url, F.length(rule["prefix"]) + 1, F.length(url))))
    made = F.when(rule["find"] != "", replaced).otherwise(inserted)
    return F.when(made != url, made)


def find_replace(text: Column, find: str, put: str, ignore_case: bool = False) -> Column:
    """All places of a literal string replaced."""
    if not ignore_case:
        return F.replace(text, F.lit(find), F.lit(put))
    return F.regexp_replace(text, F.lit("(?i)" + re.escape(find)), F.lit(put.replace("\\", "\\\\").replace("$", "\\$")))


def has(text: Column, find: str, ignore_case: bool = False) -> Column:
    return F.contains(F.lower(text), F.lit(find.lower())) if ignore_case else F.contains(text, F.lit(find))


def xml_escape(text: Column) -> Column:
    for raw, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def xml_unescape(text: Column) -> Column:
    for raw, coded in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("'", "&#39;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def file_status(deleted: Column, valid: Column, empty: Column) -> Column:
    return F.when(deleted, "deleted").when(~valid, "invalid").when(empty, "empty").otherwise("active")


def safe_name(text: Column, most: int = 60) -> Column:
    """Lower case, other characters than letters and digits as single hyphens, cut to a length."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(most))


def ellipsis(text: Column, most: int = 32) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def fix_action(sampled: Column, dead: Column) -> Column:
    """skip what was not sampled, delete what leads nowhere, fix the rest."""
    return F.when(~sampled, "skip").when(dead, "delete").otherwise("fix")


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def local_day(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts).cast("date")


def working_days(first: Column, last: Column) -> Column:
    """Mondays to Fridays from first to last, both included."""
    days = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    return F.filter(days, lambda d: F.weekday(d) < 5)


def chunk(position: Column, size: int) -> Column:
    """The chunk of an item by its position from 0."""
    return F.floor(position / size).cast("int")
