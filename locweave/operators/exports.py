"""Tables for export: patterns, sampled and mismatched URLs, desk logs; and the numbers and remarks that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls

#: Rows of a desk export at most: the export's own bound.
LOG_ROWS = 10_000

# What follows the session's id in the stored names of edited copies of files.
EDITED_MARKS = ("fixed", "renamed", "bulk", "transformed", "deleted", "slashed")

# The columns of the patterns export, as its readers know them.
PATTERN_COLUMNS = (
    "Role", "Pattern", "Source File", "URL Occurrences", "Coverage %", "Sampled", "Hit", "Miss", "Confidence %", "Redirect %", "Status", "Missing In Current",
    "Suspicious Segment", "Sample URLs",
)
#: Sampled URLs told for each pattern.
PREVIEW = 3
DAY_IN_WORDS = "dd MMMM yyyy, HH:mm 'UTC'"


def _yes(flag: Column) -> Column:
    return F.when(F.coalesce(flag, F.lit(False)), "Yes").otherwise("No")


def _blank(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def _stamp(at: Column, form: str = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") -> Column:
    """A time in UTC, as ISO 8601 writes it unless another form is asked for; empty where there is none."""
    return F.coalesce(F.date_format(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), form), F.lit(""))


def pattern_sheet(patterns: DataFrame, samples: DataFrame) -> DataFrame:
    """The patterns as their sheet has them: pattern_id, the export's columns, and Original Template.

    samples has pattern_id, url, checked_at and sample_id; the first PREVIEW of each pattern are told. A pattern
    counts what was sampled and hit by itself (sampled_count, hit_count, miss_count); nulls are 0, or empty.
    """
    rank = F.row_number().over(Window.partitionBy("pattern_id").orderBy("checked_at", "sample_id"))
    told = samples.select("pattern_id", "url", rank.alias("rank")).where(F.col("rank") <= PREVIEW)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"]), ", ")
    told = told.groupBy(F.col("pattern_id").alias("of")).agg(joined.alias("urls"))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    one = lambda c: F.round(number(c).cast("double"), 1)
    suspicious = F.when(F.coalesce("has_suspicious_segment", F.lit(False)), F.coalesce("suspicious_segment_value", F.lit("Yes"))).otherwise("No")
    values = [
        F.when(F.col("source_role") == "legacy", "Legacy").otherwise("Current"), F.col("template"), _blank(F.col("source_file")), number("total_urls"), one("coverage_pct"), number("sampled_count"),
        number("hit_count"), number("miss_count"), one("confidence_pct"), one("redirect_pct"), F.col("status"), _yes(F.col("missing_in_current")), suspicious, _blank(F.col("urls")),
    ]
    named = [v.alias(n) for v, n in zip(values, PATTERN_COLUMNS, strict=True)]
    return patterns.join(told, F.col("pattern_id") == F.col("of"), "left").select("pattern_id", *named, _blank(F.col("original_template")).alias("Original Template"))


def pattern_table(patterns: DataFrame, samples: DataFrame) -> DataFrame:
    """The 14 columns of the patterns export, to be written as a CSV."""
    return pattern_sheet(patterns, samples).select(*PATTERN_COLUMNS)


def summary(session: DataFrame, patterns: DataFrame) -> DataFrame:
    """metric, value of a session's report, ten rows: session has one row (name, base_url, created_at, total_urls, mismatched_url_count).

    Health is the mean confidence of the current patterns weighed by coverage, rounded, 0 without coverage.
    """
    current = F.col("source_role") == "current"
    weight = F.when(current, F.coalesce(F.col("coverage_pct").cast("double"), F.lit(0.0))).otherwise(0.0)
    counted = patterns.agg(
        F.sum(weight).alias("coverage"), F.sum(weight * F.coalesce("confidence_pct", F.lit(0))).alias("weighed"),
        *[F.count_if(current & (F.col("status") == s)).alias(s) for s in ("GOOD", "WARNING", "BAD")], F.count_if("missing_in_current").alias("missing"),
    )
    health = F.when(F.col("coverage") > 0, F.floor(F.col("weighed") / F.col("coverage") + 0.5)).otherwise(0)
    told = [
        ("Session name", _blank(F.col("name"))), ("Base URL", _blank(F.col("base_url"))), ("Date", _stamp(F.col("created_at"), DAY_IN_WORDS)), ("Health score", health),
        ("Total URLs", F.coalesce("total_urls", F.lit(0))), ("Healthy patterns", F.col("GOOD")), ("Warning patterns", F.col("WARNING")), ("Broken patterns", F.col("BAD")),
        ("Missing legacy patterns", F.col("missing")), ("Mismatched URLs", F.coalesce("mismatched_url_count", F.lit(0))),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("string").alias("value")) for n, v in told])
    return session.crossJoin(counted).select(F.inline(rows))


def sample_sheet(samples: DataFrame, patterns: DataFrame) -> DataFrame:
    """The sampled URLs with their patterns' templates, as their sheet has them."""
    names = patterns.select(F.col("pattern_id").alias("of"), "template", "source_file")
    values = {
        "Pattern": F.col("template"), "Source File": _blank(F.col("source_file")), "URL": F.col("url"), "HTTP Status": _blank(F.col("http_status")), "Response Time (ms)": _blank(F.col("response_ms")),
        "Category": _blank(F.col("category")), "Soft-404": _yes(F.col("is_soft_404")), "Final URL": _blank(F.col("final_url")), "Redirect Count": F.col("redirect_count"), "Hit": _yes(F.col("is_hit")),
        "Checked At": _stamp(F.col("checked_at")),
    }
    return samples.join(names, F.col("pattern_id") == F.col("of")).select("sample_id", *[v.alias(n) for n, v in values.items()])


def mismatch_sheet(mismatched: DataFrame) -> DataFrame:
    """The mismatched URLs (url, detected_host, expected_host, filename, found_at) as their sheet has them."""
    return mismatched.select(
        F.col("url").alias("URL"), F.col("detected_host").alias("Detected Host"), F.col("expected_host").alias("Expected Host"), F.col("filename").alias("Sitemap File"), _stamp(F.col("found_at")).alias("Found At")
    )


def workbook(session: DataFrame, patterns: DataFrame, samples: DataFrame, mismatched: DataFrame) -> dict[str, DataFrame]:
    """The tables of a session's report by name, each to be written as a CSV; mismatched URLs only where there are any."""
    sheets = {"Summary": summary(session, patterns), "Patterns": pattern_sheet(patterns, samples), "Sampled URLs": sample_sheet(samples, patterns)}
    return sheets if mismatched.isEmpty() else {**sheets, "Mismatched URLs": mismatch_sheet(mismatched)}


def log_export(rows: DataFrame, visible: DataFrame | None = None, status: str | None = None, script: str | None = None, first: str | None = None, last: str | None = None, most: int = LOG_ROWS) -> DataFrame:
    """The newest runs as users get them: log_id, User, Email (only where all are seen), Script, Status, Exit Code, Started At, Completed At, Duration (ms).

    visible has the users the viewer may see, by the rule of reports.visible; without it all runs are told. Days
    from first to last both count whole. Nulls are empty.
    """
    if visible is not None:
        rows = rows.join(visible.select(F.col("user_id").alias("in_scope")).distinct(), F.col("user_id") == F.col("in_scope"), "left_semi")
    rows = rows.where(F.col("status") == status) if status else rows
    rows = rows.where(F.col("script_slug") == script) if script else rows
    rows = rows.where(F.col("started_at") >= F.lit(first).cast("date")) if first else rows
    rows = rows.where(F.col("started_at") < F.date_add(F.lit(last).cast("date"), 1)) if last else rows
    owner = {"User": _blank(F.col("user_name")), "Email": _blank(F.col("user_email"))} if visible is None else {}
    values = owner | {
        "Script": _blank(F.col("script_name")), "Status": _blank(F.col("status")), "Exit Code": _blank(F.col("exit_code")), "Started At": _stamp(F.col("started_at")), "Completed At": _stamp(F.col("completed_at")),
        "Duration (ms)": _blank(F.col("duration_ms")),
    }
    return rows.orderBy(F.desc("started_at"), F.desc("log_id")).limit(most).select("log_id", *[v.alias(n) for n, v in values.items()])


def remarks(patterns: DataFrame) -> DataFrame:
    """pattern_id, ordinal, message, tone: what is told of patterns, in this order: ordinal 0 of all, then pattern by pattern.

    Legacy patterns that are missing in the current sitemaps have one remark (ordinal 0), current ones up to five.
    """
    name, current = F.concat(F.lit("Pattern "), F.col("template")), F.col("source_role") == "current"
    percent = lambda c: F.concat(F.floor(c + 0.5).cast("string"), F.lit("%"))
    failed = F.greatest(F.lit(0), 100 - F.col("confidence_pct"))
    # The remarks' words.
    said = [
        (F.coalesce("missing_in_current", F.lit(False)) & ~current, F.concat(name, F.lit(" found in old sitemap - no matching pattern in new sitemap."))),
        (current & F.col("status").isin("WARNING", "BAD"), F.concat(name, F.lit(" covers "), percent(F.col("coverage_pct")), F.lit(" of URLs; "), percent(failed), F.lit(" of sampled checks did not pass. Check how these pages open on the new site."))),
        (current & F.coalesce("has_suspicious_segment", F.lit(False)), F.concat(name, F.lit(" contains a suspicious fixed segment "), F.coalesce("suspicious_segment_value", F.lit("unknown")), F.lit(" that may be a migration artifact."))),
        (current & (F.col("redirect_pct") > 50), F.concat(name, F.lit(" has a high redirect rate ("), percent(F.col("redirect_pct")), F.lit("). URLs are live, but redirects may slow search engines down."))),
        (current & (F.coalesce("artifact_segment", F.lit("")) != ""), F.concat(F.lit("Redirects suggest segment "), F.col("artifact_segment"), F.lit(" is a migration artifact."))),
        (current & F.coalesce("has_soft_404", F.lit(False)), F.concat(name, F.lit(" has soft-404 responses — pages load but show no content. Verify these URLs return real data."))),
    ]
    listed = F.filter(F.array(*[F.when(c, F.struct(F.lit(i).alias("ordinal"), m.alias("message"))) for i, (c, m) in enumerate(said)]), lambda x: x.isNotNull())
    return patterns.select("pattern_id", F.explode(listed).alias("r")).select("pattern_id", "r.*").withColumn("tone", tone(F.col("message")))


def tone(message: Column) -> Column:
    """orange for pages that say not found, red for what is missing or fails, amber for redirects and artifacts, else indigo."""
    low = F.lower(message)
    return F.when(low.contains("soft-404"), "orange").when(low.rlike("no matching|did not pass"), "red").when(low.rlike("redirect|migration artifact"), "amber").otherwise("indigo")


def eta(seconds: Column) -> Column:
    """A time left in words: whole minutes from a minute on, else seconds, one at least; halves are rounded up."""
    whole = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    return F.when(seconds >= 60, F.concat(whole(seconds / 60), F.lit(" min"))).otherwise(F.concat(whole(F.greatest(seconds.cast("double"), F.lit(1.0))), F.lit(" sec")))


def grouped(number: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(number, 0)


def history_summary(sessions: DataFrame) -> DataFrame:
    """One row: sessions, URLs of all, and the rounded mean health of those that have one."""
    return sessions.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("urls"), F.lit(0)).alias("urls"), F.round(F.avg("health").cast("decimal(38,10)"), 0).cast("int").alias("health"))


def group_counts(links: DataFrame, groups: DataFrame) -> DataFrame:
    """group_id, n: the links of all members of each group, 0 for one without; links are counted by user first."""
    by_user = links.groupBy(F.col("user_id").alias("__u")).agg(F.count("*").alias("__n"))
    members = groups.select("group_id", F.explode_outer(F.array_distinct("member_user_ids")).alias("__m"))
    return members.join(by_user, F.col("__m") == F.col("__u"), "left").groupBy("group_id").agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"))


def checked_ratio(items: Column) -> Column:
    """The share of a checklist's results that are checked, 0 without any."""
    return F.when(F.size(items) > 0, F.size(F.filter(items, lambda r: r["checked"])) / F.size(items)).otherwise(0.0)


def property_users(daily: DataFrame, properties: DataFrame) -> DataFrame:
    """property, users: the sum of its days, 0 for one that could not be read."""
    sums = daily.groupBy(F.col("property").alias("__p")).agg(F.sum("users").alias("__u"))
    return properties.join(sums, F.col("property") == F.col("__p"), "left").select("property", F.coalesce("__u", F.lit(0)).alias("users"))


def guard_counts(users: DataFrame) -> DataFrame:
    """One row: what must not fall to zero when users are changed."""
    return users.agg(F.count_if((F.col("role") == "super-admin") & F.col("active")).alias("active_super_admins"), F.count_if("active").alias("active_users"), F.count("*").alias("users"))


def suspicious_position(template: Column, suspicious: Column, sampled: Column) -> Column:
    """Which {param} of a template, from 0, holds the suspicious segment: by the first of the sampled URLs that has it within a param's value.

    Null where none has it. What is no URL is passed over.
    """
    params = F.filter(F.transform(urls.segments(template), lambda s, i: F.when(s == "{param}", i)), lambda i: i.isNotNull())
    holds = lambda url: F.transform(params, lambda i: F.coalesce(F.get(urls.segments(urls.path(url)), i), F.lit("")).contains(suspicious))
    places = F.transform(sampled, lambda url: F.array_position(F.coalesce(holds(url), F.array().cast("array<boolean>")), True))
    return (F.get(F.filter(places, lambda p: p > 0), F.lit(0)) - 1).cast("int")


_ID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}-"


def display_name(stored: Column, session: Column) -> Column:
    """A stored file's name as users know it: without the session's id, the mark of an edit, the upload's id, and what says when it was fetched."""
    prefix = F.concat(session, F.lit("-"))
    bare = F.when(F.startswith(stored, prefix), F.substring(stored, F.length(prefix) + 1, F.lit(1 << 30))).otherwise(stored)
    return F.regexp_replace(bare, rf"(?i)^(?:(?:{'|'.join(EDITED_MARKS)})-[0-9a-f]+-)?(?:{_ID})?(?:fetched-[0-9]+-{_ID})?", "")


def download_name(stored: Column, session: Column) -> Column:
    """The display name without the role in front of it."""
    return F.regexp_replace(display_name(stored, session), "^(?:current|legacy)-", "")
