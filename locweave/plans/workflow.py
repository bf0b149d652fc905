"""Queries of sessions' work: mismatched hosts, files to extract, edits, queues, backlinks, checklists, exports.

Pages stand for locs and files' entries, orders for files, line items for samples, events for links and
logs, customers for sessions and users, parts for stored files.
"""

from __future__ import annotations

import functools

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules, templates, urls
from ..operators import cleaning, exports, mismatches, patterns, reports, rewriting, workflow
from ..operators.ordering import placed
from ..sources import readers
from .inventory import LOCS, RX, _part, _segs, page_locs, read

QUERIES: dict = {}
SQL: dict = {}
DOMAIN = "example.net"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HOST = f"regexp_replace(regexp_replace(lower({_part('loc', 2)}), ':[0-9]*$', ''), '^www\\.', '')"
HOSTS = f"""{LOCS}, h AS (SELECT *, CASE WHEN file_idx % 3 = 0 THEN 'legacy' ELSE 'current' END AS source_role, {HOST} AS host,
  {HOST} = '{DOMAIN}' OR {HOST} LIKE '%.{DOMAIN}' AS mine FROM locs)"""


def _roles(spark, d):
    return page_locs(spark, d).withColumn("source_role", F.when(F.col("file_idx") % 3 == 0, "legacy").otherwise("current"))


@query(f"WITH {HOSTS} SELECT file_idx, loc_idx, loc, host FROM h WHERE NOT mine AND source_role = 'current'")
def mismatched_urls(spark, d):
    return mismatches.split_hosts(_roles(spark, d), DOMAIN)[1].select("file_idx", "loc_idx", "loc", "host")


@query(f"WITH {HOSTS} SELECT file_idx, loc_idx, loc FROM h WHERE mine OR source_role = 'legacy'")
def extractable_locs(spark, d):
    return mismatches.split_hosts(_roles(spark, d), DOMAIN)[0].select("file_idx", "loc_idx", "loc")


@query(f"WITH {HOSTS} SELECT file_idx, source_file, count(*) AS mismatches, string_agg(DISTINCT host, ', ' ORDER BY host) AS hosts FROM h WHERE NOT mine AND source_role = 'current' GROUP BY ALL")
def mismatches_per_file(spark, d):
    files = page_locs(spark, d).select("file_idx", "source_file").distinct()
    return mismatches.per_file(mismatches.split_hosts(_roles(spark, d), DOMAIN)[1], files)


@query(f"WITH {HOSTS} SELECT file_idx, loc_idx, loc FROM h WHERE mine")
def on_domain_locs(spark, d):
    return mismatches.on_domain_locs(page_locs(spark, d), DOMAIN).select("file_idx", "loc_idx", "loc")


@query("""SELECT page_id, p[(page_id % 3) + 1] AS loc FROM (SELECT page_id, url, ['mailto:a@b.c', url, 'https://elsewhere.org/x'] AS p FROM pages)
    WHERE page_id % 3 = 0 OR (page_id % 3 = 1 AND regexp_matches(lower(url), '^https?://([^/?#]*\\.)?example\\.net(:[0-9]*)?([/?#]|$)'))""")
def downloadable_locs(spark, d):
    mixed = F.element_at(F.array(F.lit("mailto:a@b.c"), F.col("url"), F.lit("https://elsewhere.org/x")), (F.col("page_id") % 3 + 1).cast("int"))
    return mismatches.downloadable(read(spark, d, "pages").select("page_id", mixed.alias("loc")), DOMAIN)


HITS = """hits AS (SELECT o_orderkey AS file_id, 's' || (o_custkey % 9) AS session_id, CASE WHEN o_orderkey % 6 = 5 THEN 'https://e.com/' ELSE '' END
    || 's' || (o_custkey % 9) || ['-', '-fixed-a1-', '-current-'][(o_orderkey % 3) + 1] || 'f' || o_orderkey || '.xml' AS stored_name,
  CASE WHEN o_orderkey % 4 = 0 THEN 'legacy' ELSE 'current' END AS source_role, o_orderkey % 10 = 0 AS deleted, o_orderkey % 11 = 0 AS is_index,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 50 END AS total_urls, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey % 70 END AS mismatched_url_count FROM orders),
  hit AS (SELECT *, coalesce(mismatched_url_count, 0) AS n, coalesce(total_urls, 0) AS t, stored_name LIKE session_id || '-fixed-%' AS edited FROM hits
    WHERE source_role = 'current' AND NOT deleted AND NOT is_index AND stored_name NOT LIKE 'http%' AND coalesce(mismatched_url_count, 0) > 0)"""


def _hits(spark, d):
    """Files with the number of their URLs on other hosts."""
    k, s = F.col("o_orderkey"), F.concat(F.lit("s"), (F.col("o_custkey") % 9).cast("string"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("-", "-fixed-a1-", "-current-")]), (k % 3 + 1).cast("int"))
    stored = F.concat(F.when(k % 6 == 5, "https://e.com/").otherwise(""), s, kind, F.lit("f"), k.cast("string"), F.lit(".xml"))
    return read(spark, d, "orders").select(
        k.alias("file_id"), s.alias("session_id"), stored.alias("stored_name"), F.when(k % 4 == 0, "legacy").otherwise("current").alias("source_role"), (k % 10 == 0).alias("deleted"), (k % 11 == 0).alias("is_index"),
        F.when(k % 13 != 0, F.col("o_custkey") % 50).alias("total_urls"), F.when(k % 17 != 0, F.col("o_custkey") % 70).alias("mismatched_url_count"),
    )


@query(f"WITH {HITS} SELECT file_id, 'f' || file_id || '.xml' AS filename, t AS total_urls, n AS foreign_url_count, t > n AS foreign_url_count_is_minimum, t > 0 AND n >= t AS will_be_empty FROM hit")
def foreign_impact(spark, d):
    return mismatches.impact(_hits(spark, d))


@query(f"WITH {HITS} SELECT file_id, t > 0 AND n >= t AS will_be_empty FROM hit WHERE edited")
def foreign_impact_edited(spark, d):
    return mismatches.impact(_hits(spark, d), edited_only=True).select("file_id", "will_be_empty")


@query(f"WITH {HITS} SELECT count(*) > 0 AS has_foreign_urls, count(*) AS total_affected_files, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_foreign_urls_min, coalesce(bool_or(t > n), FALSE) AS counts_are_sampled FROM hit")
def foreign_impact_totals(spark, d):
    return mismatches.impact_totals(mismatches.impact(_hits(spark, d)))


@query(f"WITH {LOCS}, one AS (SELECT min(loc) AS u FROM locs) SELECT source_file, count(*) AS n FROM locs, one WHERE loc = u GROUP BY source_file")
def url_occurrences(spark, d):
    locs = page_locs(spark, d)
    return mismatches.occurrences_of(locs, locs.agg(F.min("loc").alias("first")).scalar())


FILES = """files AS (SELECT o_orderkey AS file_id, o_custkey AS session_id, 'f' || (o_orderkey % 50) || '.xml' AS filename,
  CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status, o_orderkey % 11 = 0 AS is_index, o_orderkey % 3 <> 0 AS is_valid, o_orderkey % 7 = 0 AS is_empty FROM orders)"""


def _files(spark, d):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return read(spark, d, "orders").select(
        k.alias("file_id"), F.col("o_custkey").alias("session_id"), F.concat(F.lit("f"), (k % 50).cast("string"), F.lit(".xml")).alias("filename"),
        F.when(s == "F", "parsed").when(s == "O", "failed").otherwise("pending").alias("status"), (k % 11 == 0).alias("is_index"), (k % 3 != 0).alias("is_valid"), (k % 7 == 0).alias("is_empty"),
    )


@query(f"WITH {FILES} SELECT file_id, filename FROM files WHERE status = 'parsed' AND NOT is_index AND ((is_valid AND NOT is_empty) OR file_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))")
def extractable_files(spark, d):
    partial = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file_id"))
    return workflow.extractable(_files(spark, d), partial).select("file_id", "filename")


@query(f"WITH {FILES} SELECT file_id, row_number() OVER (ORDER BY is_index DESC, filename, file_id) AS place FROM files")
def index_files_first(spark, d):
    return placed(_files(spark, d), workflow.index_first()).select("file_id", "place")


PATTERNS = """pats AS (SELECT p_partkey AS pattern_id, '/' || p_size || '/' || (p_partkey % 40) AS template, CASE WHEN p_partkey % 2 = 0 THEN 'current' ELSE 'legacy' END AS source_role,
  p_partkey % 5 = 0 AND p_partkey % 2 = 1 AS missing_in_current, CAST(p_size AS BIGINT) * 10 AS total_urls,
  CASE WHEN p_partkey % 3 = 0 THEN 'GOOD' WHEN p_partkey % 3 = 1 THEN 'WARNING' ELSE 'BAD' END AS status, CAST(p_partkey % 100 AS INTEGER) AS confidence_pct, CAST(p_partkey * 7 % 100 AS INTEGER) AS redirect_pct,
  100.0 / (1 + p_partkey % 7) AS coverage_pct, CASE WHEN p_partkey % 17 = 0 THEN 'tmp' END AS artifact_segment, p_partkey % 19 = 0 AS has_soft_404 FROM part)"""


def _patterns(spark, d):
    k = F.col("p_partkey")
    return read(spark, d, "part").select(
        k.alias("pattern_id"), F.concat(F.lit("/"), F.col("p_size").cast("string"), F.lit("/"), (k % 40).cast("string")).alias("template"), F.when(k % 2 == 0, "current").otherwise("legacy").alias("source_role"),
        ((k % 5 == 0) & (k % 2 == 1)).alias("missing_in_current"), (F.col("p_size").cast("long") * 10).alias("total_urls"),
        F.when(k % 3 == 0, "GOOD").when(k % 3 == 1, "WARNING").otherwise("BAD").alias("status"), (k % 100).cast("int").alias("confidence_pct"), (k * 7 % 100).cast("int").alias("redirect_pct"),
        (k % 13 < 2).alias("has_suspicious_segment"), F.when(k % 13 == 0, "old").alias("suspicious_segment_value"), (F.lit(100.0) / (1 + k % 7)).alias("coverage_pct"),
        (k % 9).alias("sampled_count"), (k % 5).alias("hit_count"), F.lit(None).cast("int").alias("miss_count"), F.when(k % 4 == 0, "a.xml").alias("source_file"), F.lit(None).cast("string").alias("original_template"), F.when(k % 17 == 0, "tmp").alias("artifact_segment"), (k % 19 == 0).alias("has_soft_404"),
    )


@query(f"WITH {PATTERNS} SELECT pattern_id, row_number() OVER (ORDER BY CASE source_role WHEN 'current' THEN 0 ELSE 1 END, missing_in_current DESC, total_urls DESC, template, pattern_id) AS place FROM pats")
def pattern_order(spark, d):
    return placed(_patterns(spark, d), [*workflow.pattern_order(), F.col("pattern_id")]).select("pattern_id", "place")


@query(f"""WITH {PATTERNS}, r AS (SELECT pattern_id, source_role = 'current' AS cur, unnest([
      CASE WHEN missing_in_current THEN {{'ordinal': 0, 'message': 'Pattern ' || template || ' found in old sitemap - no matching pattern in new sitemap.', 'tone': 'red'}} END,
      CASE WHEN source_role = 'current' AND status <> 'GOOD' THEN {{'ordinal': 1, 'message': 'Pattern ' || template || ' covers ' || CAST(floor(coverage_pct + 0.5) AS BIGINT) || '% of URLs; ' || (100 - confidence_pct)
        || '% of sampled checks did not pass. Check how these pages open on the new site.', 'tone': 'red'}} END,
      CASE WHEN source_role = 'current' AND pattern_id % 13 < 2 THEN {{'ordinal': 2, 'message': 'Pattern ' || template || ' contains a suspicious fixed segment ' || CASE WHEN pattern_id % 13 = 0 THEN 'old' ELSE 'unknown' END
        || ' that may be a migration artifact.', 'tone': 'amber'}} END,
      CASE WHEN source_role = 'current' AND redirect_pct > 50 THEN {{'ordinal': 3, 'message': 'Pattern ' || template || ' has a high redirect rate (' || redirect_pct || '%). URLs are live, but redirects may slow search engines down.', 'tone': 'amber'}} END,
      CASE WHEN source_role = 'current' AND pattern_id % 17 = 0 THEN {{'ordinal': 4, 'message': 'Redirects suggest segment tmp is a migration artifact.', 'tone': 'amber'}} END,
      CASE WHEN source_role = 'current' AND has_soft_404 THEN {{'ordinal': 5, 'message': 'Pattern ' || template || ' has soft-404 responses — pages load but show no content. Verify these URLs return real data.', 'tone': 'orange'}} END]) AS x FROM pats)
    SELECT pattern_id, x.ordinal AS ordinal, x.message AS message, x.tone AS tone FROM r WHERE x IS NOT NULL""")
def pattern_remarks(spark, d):
    return exports.remarks(_patterns(spark, d))


SAMPLES = """s AS (SELECT l_orderkey * 10 + l_linenumber AS sample_id, l_partkey AS pattern_id, l_returnflag = 'N' AS is_hit, 'https://e.com/' || l_orderkey || '/' || l_linenumber AS url, l_shipdate AS checked_at,
  CASE WHEN l_linenumber % 3 > 0 THEN 200 + l_linenumber END AS http_status, l_linenumber % 2 = 0 AS is_soft_404 FROM lineitem)"""


def _samples(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    u = F.concat(F.lit("https://e.com/"), k.cast("string"), F.lit("/"), n.cast("string"))
    none = F.lit(None).cast("string")
    return read(spark, d, "lineitem").select(
        (k * 10 + n).alias("sample_id"), F.col("l_partkey").alias("pattern_id"), (F.col("l_returnflag") == "N").alias("is_hit"), u.alias("url"), F.col("l_shipdate").alias("checked_at"), F.when(n % 3 > 0, 200 + n).alias("http_status"),
        (n % 2 == 0).alias("is_soft_404"), none.alias("response_ms"), none.alias("category"), none.alias("final_url"), F.lit(0).alias("redirect_count"),
    )


@query(f"""WITH {PATTERNS}, {SAMPLES}, t AS (SELECT pattern_id AS p, string_agg(url, ', ' ORDER BY checked_at, sample_id) AS urls FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY checked_at, sample_id) AS rn FROM s) WHERE rn <= 3 GROUP BY pattern_id)
    SELECT CASE source_role WHEN 'legacy' THEN 'Legacy' ELSE 'Current' END AS "Role", template AS "Pattern", CASE WHEN pattern_id % 4 = 0 THEN 'a.xml' ELSE '' END AS "Source File", total_urls AS "URL Occurrences", round(coverage_pct, 1) AS "Coverage %",
      pattern_id % 9 AS "Sampled", pattern_id % 5 AS "Hit", CAST(0 AS INTEGER) AS "Miss", CAST(confidence_pct AS DOUBLE) AS "Confidence %", CAST(redirect_pct AS DOUBLE) AS "Redirect %", status AS "Status", CASE WHEN missing_in_current THEN 'Yes' ELSE 'No' END AS "Missing In Current",
      CASE pattern_id % 13 WHEN 0 THEN 'old' WHEN 1 THEN 'Yes' ELSE 'No' END AS "Suspicious Segment", coalesce(urls, '') AS "Sample URLs" FROM pats LEFT JOIN t ON p = pattern_id""")
def export_pattern_columns(spark, d):
    return exports.pattern_table(_patterns(spark, d), _samples(spark, d))


@query(f"""WITH {PATTERNS}, c AS (SELECT coalesce(sum(confidence_pct * coverage_pct) FILTER (source_role = 'current') / nullif(sum(coverage_pct) FILTER (source_role = 'current'), 0), 0) AS health, count(*) FILTER (status = 'GOOD' AND source_role = 'current') AS good,
      count(*) FILTER (status = 'WARNING' AND source_role = 'current') AS warning, count(*) FILTER (status = 'BAD' AND source_role = 'current') AS bad, count(*) FILTER (missing_in_current) AS missing FROM pats),
    o AS (SELECT max(o_orderdate) AS made, count(*) AS n FROM orders)
    SELECT unnest(['Session name', 'Base URL', 'Date', 'Health score', 'Total URLs', 'Healthy patterns', 'Warning patterns', 'Broken patterns', 'Missing legacy patterns', 'Mismatched URLs']) AS metric,
      unnest(['all orders', '', strftime(made, '%d %B %Y, %H:%M UTC'), CAST(CAST(floor(health + 0.5) AS BIGINT) AS VARCHAR), CAST(n AS VARCHAR), CAST(good AS VARCHAR), CAST(warning AS VARCHAR), CAST(bad AS VARCHAR), CAST(missing AS VARCHAR), '0']) AS value FROM c, o""")
def export_summary(spark, d):
    session = read(spark, d, "orders").agg(F.max("o_orderdate").alias("created_at"), F.count("*").alias("total_urls"))
    session = session.withColumns({"name": F.lit("all orders"), "base_url": F.lit(None).cast("string"), "mismatched_url_count": F.lit(None).cast("long")})
    return exports.summary(session, _patterns(spark, d))


@query(f"""WITH {PATTERNS}, {SAMPLES} SELECT sample_id, template AS "Pattern", CASE WHEN s.pattern_id % 4 = 0 THEN 'a.xml' ELSE '' END AS "Source File", url AS "URL", coalesce(CAST(http_status AS VARCHAR), '') AS "HTTP Status", '' AS "Response Time (ms)", '' AS "Category",
    CASE WHEN is_soft_404 THEN 'Yes' ELSE 'No' END AS "Soft-404", '' AS "Final URL", CAST(0 AS INTEGER) AS "Redirect Count", CASE WHEN is_hit THEN 'Yes' ELSE 'No' END AS "Hit", strftime(checked_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS "Checked At" FROM s JOIN pats ON pats.pattern_id = s.pattern_id""")
def export_sampled_urls(spark, d):
    return exports.sample_sheet(_samples(spark, d), _patterns(spark, d))


@query(f"WITH {HOSTS} SELECT loc AS \"URL\", host AS \"Detected Host\", '{DOMAIN}' AS \"Expected Host\", source_file AS \"Sitemap File\", '2024-02-03T04:05:06.000Z' AS \"Found At\" FROM h WHERE NOT mine AND source_role = 'current'")
def export_mismatched_urls(spark, d):
    found = mismatches.split_hosts(_roles(spark, d), DOMAIN)[1]
    rows = found.select(F.col("loc").alias("url"), F.col("host").alias("detected_host"), F.lit(DOMAIN).alias("expected_host"), F.col("source_file").alias("filename"), F.lit("2024-02-03 04:05:06").cast("timestamp_ntz").alias("found_at"))
    return exports.mismatch_sheet(rows)


RUNS = """runs AS (SELECT event_id AS log_id, user_id, event_type AS script_slug, upper(event_type) AS script_name, CASE WHEN event_id % 4 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 4 = 1 THEN 0 END AS exit_code,
  ts AS started_at, CASE WHEN event_id % 5 > 0 THEN ts + INTERVAL 90 SECOND END AS completed_at, CASE WHEN event_id % 5 > 0 THEN 90000 END AS duration_ms FROM events)"""
ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"
TOLD = f"""script_name AS "Script", status AS "Status", coalesce(CAST(exit_code AS VARCHAR), '') AS "Exit Code", strftime(started_at, {ISO}) AS "Started At", coalesce(strftime(completed_at, {ISO}), '') AS "Completed At", coalesce(CAST(duration_ms AS VARCHAR), '') AS "Duration (ms)" """


def _runs(spark, d):
    i, done = F.col("event_id"), F.col("event_id") % 5 > 0
    return read(spark, d, "events").select(
        i.alias("log_id"), "user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_name"), F.lit(None).cast("string").alias("user_email"), F.col("event_type").alias("script_slug"), F.upper("event_type").alias("script_name"),
        F.when(i % 4 == 0, "error").otherwise("success").alias("status"), F.when(i % 4 == 0, 1).when(i % 4 == 1, 0).alias("exit_code"), F.col("ts").alias("started_at"), F.when(done, F.col("ts") + F.expr("INTERVAL 90 SECONDS")).alias("completed_at"),
        F.when(done, 90000).alias("duration_ms"),
    )


@query(f"WITH {RUNS} SELECT log_id, 'u' || user_id AS \"User\", '' AS \"Email\", {TOLD} FROM runs WHERE status = 'success' AND CAST(started_at AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY started_at DESC, log_id DESC LIMIT 10000")
def log_export(spark, d):
    return exports.log_export(_runs(spark, d), status="success", first="2024-01-05", last="2024-01-20")


@query(f"WITH {RUNS} SELECT log_id, {TOLD} FROM runs WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3 OR s_suppkey = 7) AND script_slug = 'click' ORDER BY started_at DESC, log_id DESC LIMIT 10000")
def log_export_scoped(spark, d):
    """What the leader of a group (a nation's suppliers) may export: own runs and those of the members."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.when(F.col("s_suppkey") == 7, "sub-lead").otherwise("user").alias("role"), "s_nationkey")
    groups = s.where("s_nationkey = 3").agg(F.collect_set("user_id").alias("member_user_ids")).select(F.lit(7).cast("long").alias("lead_user_id"), "member_user_ids")
    seen = reports.members_seen(s, groups).where("viewer_id = 7").select(F.col("member").alias("user_id"))
    return exports.log_export(_runs(spark, d), seen, script="click")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_runs(spark, d):
    return read(spark, d, "events").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(10)


STORED = """stored AS (SELECT c_custkey AS id, 's' || (c_custkey % 9) AS session_id, CASE WHEN c_custkey % 4 = 1 THEN 'legacy' ELSE 'current' END AS source_role, c_custkey % 10 = 0 AS deleted, 'current-f' || (c_custkey % 50) || '.xml' AS shown,
  's' || (c_custkey % 9) || ['-', '-fixed-0a1b-', '-renamed-c2-', '-copy-', '-slashed-9e-'][(c_custkey % 5) + 1] || CASE WHEN c_custkey % 3 = 0 THEN '0a1b2c3d-0000-4000-8000-0123456789ab-' ELSE '' END || 'current-f' || (c_custkey % 50) || '.xml' AS stored_name FROM customer)"""


def _stored(spark, d):
    k = F.col("c_custkey")
    session, name = F.concat(F.lit("s"), (k % 9).cast("string")), F.concat(F.lit("current-f"), (k % 50).cast("string"), F.lit(".xml"))
    mark = F.element_at(F.array(*[F.lit(m) for m in ("-", "-fixed-0a1b-", "-renamed-c2-", "-copy-", "-slashed-9e-")]), (k % 5 + 1).cast("int"))
    upload = F.when(k % 3 == 0, "0a1b2c3d-0000-4000-8000-0123456789ab-").otherwise("")
    role = F.when(k % 4 == 1, "legacy").otherwise("current")
    return read(spark, d, "customer").select(k.alias("id"), session.alias("session_id"), role.alias("source_role"), (k % 10 == 0).alias("deleted"), F.concat(session, mark, upload, name).alias("stored_name"))


@query(f"WITH {STORED} SELECT id, id % 5 IN (1, 2, 4) AS edited FROM stored")
def edited_names(spark, d):
    return _stored(spark, d).select("id", workflow.is_edited(F.col("stored_name"), F.col("session_id")).alias("edited"))


@query(f"""WITH {STORED}, pat AS (SELECT o_orderkey AS pattern_id, 's' || (o_custkey % 12) AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN 'legacy' ELSE 'current' END AS source_role FROM orders),
    occ AS (SELECT l_orderkey AS pattern_id, 'current-f' || (l_partkey % 60) || '.xml' AS filename FROM lineitem WHERE l_orderkey % 4 <> 0),
    ed AS (SELECT session_id, source_role, stored_name, shown FROM stored WHERE id % 5 IN (1, 2, 4) AND NOT deleted)
    SELECT pattern_id, stored_name, 'corrected-' || shown AS download_name FROM (
      SELECT p.pattern_id, e.stored_name, e.shown, row_number() OVER (PARTITION BY p.pattern_id ORDER BY e.stored_name) AS rn FROM pat p JOIN ed e ON e.session_id = p.session_id AND e.source_role = p.source_role
      WHERE NOT EXISTS (SELECT 1 FROM occ o WHERE o.pattern_id = p.pattern_id) OR EXISTS (SELECT 1 FROM occ o WHERE o.pattern_id = p.pattern_id AND o.filename = e.shown)) WHERE rn = 1""")
def corrected_download(spark, d):
    k = F.col("o_orderkey")
    pats = read(spark, d, "orders").select(k.alias("pattern_id"), F.concat(F.lit("s"), (F.col("o_custkey") % 12).cast("string")).alias("session_id"), F.when(k % 3 == 0, "legacy").otherwise("current").alias("source_role"))
    occ = read(spark, d, "lineitem").where("l_orderkey % 4 <> 0").select(F.col("l_orderkey").alias("pattern_id"), F.concat(F.lit("current-f"), (F.col("l_partkey") % 60).cast("string"), F.lit(".xml")).alias("filename"))
    return workflow.corrected_download(pats, occ, _stored(spark, d))


@query("SELECT event_id, [200, 301, 302, 404, 500, 308][(event_id % 6) + 1] AS http_status FROM events WHERE event_id % 6 IN (1, 3)")
def status_list(spark, d):
    statuses = F.element_at(F.array(*[F.lit(s) for s in (200, 301, 302, 404, 500, 308)]), (F.col("event_id") % 6 + 1).cast("int"))
    return workflow.with_statuses(read(spark, d, "events").select("event_id", statuses.alias("http_status")), [301, 404, 999])


MADE = "made AS (SELECT event_id, event_type = 'view' AS automated, CASE WHEN event_type <> 'view' THEN user_id END AS user_id FROM events)"


def _made(spark, d):
    auto = F.col("event_type") == "view"
    return read(spark, d, "events").select("event_id", auto.alias("automated"), F.when(~auto, F.col("user_id")).alias("user_id"))


@query(f"""WITH {MADE} SELECT 'scope' AS view, event_id FROM made WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 9) UNION ALL SELECT 'selected', event_id FROM made WHERE user_id = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey < 9)
    UNION ALL SELECT 'automated', event_id FROM made WHERE automated UNION ALL SELECT 'manual', event_id FROM made WHERE NOT automated UNION ALL SELECT 'all', event_id FROM made
    UNION ALL SELECT 'hidden', event_id FROM made WHERE NOT automated AND user_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 9) UNION ALL SELECT 'team', event_id FROM made WHERE user_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 9)""")
def run_types(spark, d):
    made, s = _made(spark, d), read(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), "s_nationkey")
    visible, team = s.where("s_nationkey < 9"), s.where("s_nationkey = 9")
    one = visible.agg(F.min("user_id")).first()[0]
    views = {
        "scope": workflow.runs_of(made, "all", visible), "selected": workflow.runs_of(made, "all", visible, selected=one), "automated": workflow.runs_of(made, "automated", visible), "manual": workflow.runs_of(made, "manual"),
        "all": workflow.runs_of(made), "hidden": workflow.runs_of(made, "manual", visible, selected=-5), "team": workflow.runs_of(made, "all", team=team, selected=one),
    }
    return functools.reduce(lambda a, b: a.unionByName(b), [v.select(F.lit(n).alias("view"), "event_id") for n, v in views.items()])


QUEUE = "q AS (SELECT event_id, 'https://e.com/' || event_type || '/' || event_id AS url, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'open' END AS gsc_status, CASE WHEN event_id % 5 = 0 THEN 'done' ELSE 'open' END AS bing_status FROM events)"


def _queue(spark, d):
    i = F.col("event_id")
    u = F.concat(F.lit("https://e.com/"), F.col("event_type"), F.lit("/"), i.cast("string"))
    return read(spark, d, "events").select(i, u.alias("url"), F.when(i % 3 == 0, "done").otherwise("open").alias("gsc_status"), F.when(i % 5 == 0, "done").otherwise("open").alias("bing_status"))


@query(f"WITH {QUEUE} SELECT event_id, url FROM q WHERE gsc_status = 'open' AND bing_status = 'done' AND regexp_matches(url, '(?i)CLICK|view')")
def queue_filter(spark, d):
    return workflow.queue_page(_queue(spark, d), "open", "done", "CLICK|view").select("event_id", "url")


@query(f"WITH {QUEUE} SELECT q.event_id, q.url, coalesce(r.status, 'Unknown') AS status FROM q LEFT JOIN (SELECT url, CASE WHEN event_id % 2 = 0 THEN 'indexed' ELSE 'not indexed' END AS status FROM q WHERE event_id % 7 < 3) r ON r.url = q.url")
def queue_results(spark, d):
    q = _queue(spark, d)
    results = q.where("event_id % 7 < 3").select("url", F.when(F.col("event_id") % 2 == 0, "indexed").otherwise("not indexed").alias("status"))
    return workflow.with_results(q.select("event_id", "url"), results)


@query("""WITH n AS (SELECT o_custkey AS site, count(*) AS c FROM orders GROUP BY o_custkey), low AS (SELECT site FROM n WHERE c * 1000 < 10000)
    SELECT site, md5_rank, url FROM (SELECT site, 'https://e.com/' || o_orderkey AS url, row_number() OVER (PARTITION BY site ORDER BY md5('0' || 'https://e.com/' || o_orderkey), o_orderkey) AS md5_rank
      FROM orders JOIN low ON o_custkey = site) WHERE md5_rank <= 3""")
def queue_refill(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("site"), F.concat(F.lit("https://e.com/"), F.col("o_orderkey").cast("string")).alias("url"))
    sites = o.groupBy("site").agg((F.count("*") * 1000).alias("queued"))
    picked = workflow.refill(sites, o, "gsc", 3, 3)
    return picked.withColumn("md5_rank", F.row_number().over(Window.partitionBy("site").orderBy(F.md5(F.concat(F.lit("0"), "url")), "url")).cast("long"))


@query("SELECT event_id, CAST(user_id AS BIGINT) AS member, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click' AND user_id = 7 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def view_filters(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("user_id").cast("long").alias("member"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("status"))
    return workflow.shown(e, "click", 7, "2024-01-05", "2024-01-20").drop("status")


@query("SELECT s_suppkey AS member, CAST(coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 10 END, 9999) AS INTEGER) AS reporting_order FROM supplier")
def reporting_order(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("member"))
    return workflow.by_reporting_order(s, s.where("member % 3 = 0").select("member", (F.col("member") % 10).cast("int").alias("reporting_order")))


@query("SELECT event_id, row_number() OVER (ORDER BY event_type = 'view' DESC, event_id) AS place FROM events")
def verified_first(spark, d):
    e = read(spark, d, "events").select("event_id", (F.col("event_type") == "view").alias("is_sampled"), F.col("event_id").alias("seq"))
    return placed(e, workflow.verified_first()).select("event_id", "place")


FOUND = f"f AS (SELECT seq, source_file, loc, replace(loc, 'example', 'sample') AS new FROM locs)"


@query(f"WITH {LOCS}, {FOUND} SELECT seq, loc AS before, new AS after FROM f WHERE loc <> new ORDER BY seq LIMIT 5")
def rewrite_preview(spark, d):
    rows = page_locs(spark, d).select("seq", "loc")
    return workflow.preview(rows, rewriting.rewrite(rows, {"kind": "find_replace", "find": "example", "put": "sample"}), "seq")


@query(f"WITH {LOCS} SELECT seq, replace(loc, 'example', 'sample') AS between, loc FROM locs")
def rewrite_undo(spark, d):
    """The URLs as a rewrite left them, and as they were again when it was taken back."""
    rows = page_locs(spark, d).select("seq", "loc")
    once = rewriting.rewrite(rows, {"kind": "find_replace", "find": "example", "put": "sample"})
    back = rewriting.undo(once).select(F.col("seq").alias("s"), F.col("loc").alias("b"))
    return once.select("seq", F.col("loc").alias("between")).join(back, F.col("seq") == F.col("s")).select("seq", "between", F.col("b").alias("loc"))


@query(f"WITH {LOCS} SELECT source_file, count(*) FILTER (seq % 3 <> 0) AS kept, count(*) FILTER (seq % 3 = 0) AS removed FROM (SELECT source_file, loc, min(seq) OVER (PARTITION BY loc) AS seq FROM locs) GROUP BY source_file")
def delete_counts(spark, d):
    rows = page_locs(spark, d).withColumn("first", F.min("seq").over(Window.partitionBy("loc")))
    targets = rows.where("first % 3 = 0").select(F.col("loc").alias("url"), F.lit(None).cast("array<string>").alias("files")).distinct()
    return workflow.block_counts(rows, rewriting.delete_urls(rows, targets))


@query(f"""WITH {LOCS}, p AS (SELECT source_file, {_segs('loc')} AS segs FROM locs WHERE regexp_matches(loc, '{RX}'))
    SELECT f.source_file, '/en/{{param}}' AS old, '/english/{{param}}' AS new, count(p.segs) AS changed FROM (SELECT DISTINCT source_file FROM locs) f
    LEFT JOIN p ON p.source_file = f.source_file AND len(segs) = 2 AND segs[1] = 'en' GROUP BY f.source_file""")
def rename_history(spark, d):
    rows = page_locs(spark, d).select("source_file", "loc")
    empty = spark.createDataFrame([], "source_file string, old string, new string, changed long, at date")
    return workflow.rename(rows, empty, rows, "/en/{param}", "/english/{param}", F.lit("2024-02-03").cast("date"))[1].drop("at")


@query(f"WITH {FILES} SELECT file_id, file_id % 4 = 0 AS deleted FROM files")
def soft_delete(spark, d):
    f = _files(spark, d).withColumns({"deleted": F.lit(False), "deleted_at": F.lit(None).cast("timestamp")})
    now = F.lit("2024-02-03").cast("timestamp")
    gone = workflow.soft_delete(f, f.where("file_id % 2 = 0").select("file_id"), now)
    return workflow.soft_delete(gone, f.where("file_id % 4 = 2").select("file_id"), now, restore=True).select("file_id", "deleted")


SENT = """sent AS (SELECT CASE WHEN event_id % 50 = 1 THEN ' ' ELSE 'https://e.com/' || event_id END AS url, 'src' || (event_id % 200) AS source, CASE WHEN user_id % 7 > 0 THEN 't' || (user_id % 7) END AS target, user_id FROM events WHERE event_id % 2 = 1)"""


@query(f"""WITH {SENT}, held AS (SELECT DISTINCT 'src' || (event_id % 200) AS source, CASE WHEN user_id % 7 > 0 THEN 't' || (user_id % 7) ELSE '' END AS target FROM events WHERE event_id % 6 = 3 AND event_type <> 'error'),
    ranked AS (SELECT s.*, coalesce(s.target, '') AS t, trim(url) = '' AS empty, row_number() OVER (PARTITION BY source, coalesce(s.target, ''), trim(url) = '' ORDER BY url, user_id) AS rn, CAST(substr(source, 4) AS INTEGER) AS k FROM sent s)
    SELECT url, source, target, user_id, CASE WHEN empty THEN 'incomplete' WHEN k >= 190 THEN 'unknown source' WHEN k % 5 = 0 THEN 'accepted'
      WHEN rn > 1 OR EXISTS (SELECT 1 FROM held h WHERE h.source = ranked.source AND h.target = t) THEN 'taken' ELSE 'accepted' END AS outcome FROM ranked""")
def backlinks_once(spark, d):
    e, i = read(spark, d, "events"), F.col("event_id")
    source, target = F.concat(F.lit("src"), (i % 200).cast("string")), F.when(F.col("user_id") % 7 > 0, F.concat(F.lit("t"), (F.col("user_id") % 7).cast("string")))
    held = e.where("event_id % 6 = 3").select(source.alias("source"), target.alias("target"), F.when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "view", "pending").otherwise("approved").alias("status"))
    sent = e.where("event_id % 2 = 1").select(F.when(i % 50 == 1, " ").otherwise(F.concat(F.lit("https://e.com/"), i.cast("string"))).alias("url"), source.alias("source"), target.alias("target"), "user_id")
    sources = spark.range(190).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"), (F.col("id") % 5 == 0).alias("reusable"))
    return workflow.new_backlinks(held, sent, sources)


@query("""SELECT event_id AS link_id, user_id, CASE WHEN event_id % 3 = 0 AND user_id % 2 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'approved' ELSE 'rejected' END ELSE 'pending' END AS status FROM events""")
def backlink_decisions(spark, d):
    links = read(spark, d, "events").select(F.col("event_id").alias("link_id"), "user_id", F.lit("pending").alias("status"))
    made = links.where("link_id % 3 = 0").select("link_id", F.when(F.col("link_id") % 2 == 0, "approved").otherwise("rejected").alias("decision"), F.lit(1).cast("long").alias("decider_id"))
    allowed = links.where("user_id % 2 = 0").select(F.lit(1).cast("long").alias("viewer_id"), F.col("user_id").alias("member")).distinct()
    return workflow.decide(links, made, allowed)


@query("""SELECT 'o' || o_orderkey AS name, o_custkey AS list_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END, 'o' || o_orderkey) AS position FROM orders""")
def checklist_appended(spark, d):
    o = read(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_custkey").alias("list_id"), F.col("o_orderkey").alias("k"))
    held = o.where("k % 3 <> 0").withColumn("position", F.row_number().over(Window.partitionBy("list_id").orderBy("k")).cast("long")).drop("k")
    return workflow.appended(held, o.where("k % 3 = 0").drop("k"))


@query("SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 4 = 0 THEN 1000 - o_orderkey % 100 ELSE o_orderkey % 7 END AS position FROM orders")
def checklist_reordered(spark, d):
    items = read(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 7).alias("position"))
    return workflow.reordered(items, items.where("item_id % 4 = 0").select("item_id", (1000 - F.col("item_id") % 100).alias("position")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TRUE WHEN event_id % 3 = 0 THEN FALSE ELSE event_id % 3 > event_id % 5 END AS fresh FROM events")
def packed_freshness(spark, d):
    i = F.col("event_id")
    return read(spark, d, "events").select("event_id", workflow.is_fresh(F.when(i % 3 != 0, i % 3), F.when(i % 2 != 0, i % 5)).alias("fresh"))


@query("SELECT o_orderkey, o_custkey AS session_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def sessions_deleted(spark, d):
    gone = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("session_id"))
    return workflow.without_sessions(read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("session_id")), gone).select("o_orderkey", "session_id")


@query(f"""WITH {STORED}, w AS (SELECT *, id % 5 = 0 AS missing, id % 7 = 0 AS failed FROM stored WHERE id % 2 = 0)
    SELECT CASE WHEN missing THEN 'missing' WHEN failed THEN 'failed' ELSE 'removed' END AS outcome, count(*) AS n, CAST(coalesce(sum(CASE WHEN NOT missing THEN id END), 0) AS BIGINT) AS bytes FROM w GROUP BY ALL""")
def cleanup_report(spark, d):
    s = _stored(spark, d).where("id % 2 = 0").withColumn("stored_name", F.concat("stored_name", F.col("id").cast("string")))
    found = s.where("id % 5 <> 0").select("stored_name", F.col("id").alias("bytes"), F.when(F.col("id") % 7 == 0, "busy").alias("error"))
    return workflow.cleanup_report(s.select("stored_name"), found)


@query("SELECT 'https://e.com/maps/f' || page_id || CASE WHEN page_id % 2 = 0 THEN '.xml' ELSE '.xml.gz' END AS child FROM pages WHERE page_id % 3 <> 0")
def children_without_twins(spark, d):
    i = F.col("page_id").cast("string")
    p = read(spark, d, "pages")
    ending = F.when(F.col("page_id") % 2 == 0, ".xml").otherwise(".xml.gz")
    return workflow.without_twins(p.select(F.concat(F.lit("https://e.com/maps/f"), i, ending).alias("child")), p.where("page_id % 3 = 0").select(F.concat(F.lit("f"), i, F.lit(".xml")).alias("filename")))


@query(f"WITH {FILES} SELECT session_id FROM files GROUP BY session_id HAVING count(*) FILTER (status <> 'pending') >= count(*) AND count(*) FILTER (status IN ('parsed', 'failed')) >= count(*)")
def parse_finished(spark, d):
    f = _files(spark, d)
    return workflow.parse_finished(f.groupBy("session_id").agg(F.count("*").alias("total_files")), f)


@query("SELECT count(*) AS sessions, CAST(sum(n) AS BIGINT) AS urls, CAST(round(avg(CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 101 END)) AS INTEGER) AS health FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def history_summary(spark, d):
    s = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("urls"))
    return exports.history_summary(s.withColumn("health", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 101)))


@query("""WITH g AS (SELECT s_nationkey AS group_id, s_suppkey AS m FROM supplier), u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
    SELECT group_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM g LEFT JOIN u ON u.user_id = m GROUP BY group_id""")
def links_per_group(spark, d):
    groups = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("group_id")).agg(F.collect_set("s_suppkey").alias("member_user_ids"))
    return exports.group_counts(read(spark, d, "events"), groups)


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') / count(*) AS ratio FROM orders GROUP BY o_custkey")
def audit_ratio(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct((F.col("o_orderstatus") == "F").alias("checked"))).alias("items"))
    return o.select("o_custkey", exports.checked_ratio(F.col("items")).alias("ratio"))


@query("SELECT s_suppkey AS property, CAST(coalesce((SELECT sum(l_linenumber) FROM lineitem WHERE l_suppkey = s_suppkey AND l_linestatus = 'O'), 0) AS BIGINT) AS users FROM supplier")
def users_per_property(spark, d):
    daily = read(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_suppkey").alias("property"), F.col("l_linenumber").alias("users"))
    return exports.property_users(daily, read(spark, d, "supplier").select(F.col("s_suppkey").alias("property")))


@query("SELECT count(*) FILTER (c_custkey % 10 = 0 AND c_acctbal > 0) AS active_super_admins, count(*) FILTER (c_acctbal > 0) AS active_users, count(*) AS users FROM customer")
def guard_counts(spark, d):
    k = F.col("c_custkey")
    return exports.guard_counts(read(spark, d, "customer").select(F.when(k % 10 == 0, "super-admin").otherwise("admin").alias("role"), (F.col("c_acctbal") > 0).alias("active")))


@query("""SELECT event_id, CASE WHEN s >= 60 THEN CAST(floor(s / 60 + 0.5) AS BIGINT) || ' min' ELSE greatest(1, CAST(floor(s + 0.5) AS BIGINT)) || ' sec' END AS eta, format('{:,}', n * 1001) AS grouped FROM (SELECT event_id, event_id * 37 % 20000 AS n, (event_id * 37 % 20000) / 8.0 AS s FROM events)""")
def formatted_numbers(spark, d):
    n = F.col("event_id") * 37 % 20000
    return read(spark, d, "events").select("event_id", exports.eta(n / 8.0).alias("eta"), exports.grouped(n * 1001).alias("grouped"))


@query(f"""WITH {LOCS} SELECT seq, CASE WHEN contains(coalesce(g[1], ''), 'e') THEN 0 WHEN contains(coalesce(g[3], ''), 'e') THEN 1 END AS place FROM (SELECT seq, CASE WHEN regexp_matches(loc, '{RX}') THEN {_segs('loc')} END AS g FROM locs)""")
def suspicious_places(spark, d):
    sampled = F.array(F.lit("not a URL"), F.lit("https://x.com/"), F.col("loc"))
    return page_locs(spark, d).select("seq", exports.suspicious_position(F.lit("/{param}/static/{param}"), F.lit("e"), sampled).alias("place"))


@query(f"WITH {STORED} SELECT id, CASE WHEN id % 5 = 3 THEN 'copy-' ELSE '' END || CASE WHEN id % 5 = 3 AND id % 3 = 0 THEN '0a1b2c3d-0000-4000-8000-0123456789ab-' ELSE '' END || shown AS name, CASE WHEN id % 5 = 3 THEN name ELSE 'f' || (id % 50) || '.xml' END AS download FROM stored")
def display_names(spark, d):
    stored, session = F.col("stored_name"), F.col("session_id")
    return _stored(spark, d).select("id", exports.display_name(stored, session).alias("name"), exports.download_name(stored, session).alias("download"))


@query("SELECT page_id, ['xml', 'list', 'try_xml', 'xml'][(page_id % 4) + 1] AS kind FROM pages")
def child_kinds(spark, d):
    url = F.concat(F.lit("https://e.com/s"), F.element_at(F.array(*[F.lit(x) for x in (".xml", ".TXT", "", ".xml.gz?v=1")]), (F.col("page_id") % 4 + 1).cast("int")))
    return read(spark, d, "pages").select("page_id", readers.child_kind(url).alias("kind"))


@query("""SELECT o_orderkey, (SELECT max(e.event_id) FROM events e WHERE e.user_id = o_custkey AND e.ts <= o_orderdate + INTERVAL 10000 DAY) AS event_id FROM orders""")
def ext_as_of(spark, d):
    """The last event of an order's customer up to a time: both sides in one order of time, so that no join grows."""
    e = read(spark, d, "events").groupBy(F.col("user_id").alias("k"), "ts").agg(F.max("event_id").alias("event_id"))
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderdate").cast("date") + F.lit(10000)).cast("timestamp_ntz").alias("ts"), "o_orderkey")
    both = e.select("k", "ts", "event_id", F.lit(None).cast("long").alias("o_orderkey")).unionByName(o.withColumn("event_id", F.lit(None).cast("long")))
    upto = Window.partitionBy("k").orderBy("ts", F.col("o_orderkey").asc_nulls_first())
    return both.withColumn("event_id", F.max("event_id").over(upto)).where("o_orderkey IS NOT NULL").select("o_orderkey", "event_id")


@query("SELECT event_type, TRUE AS near FROM events GROUP BY event_type")
def ext_approximate_distinct(spark, d):
    events = read(spark, d, "events")
    # Beside an exact count in one aggregate, each different user would have a sketch.
    near = events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"))
    exact = events.groupBy(F.col("event_type").alias("of")).agg(F.count_distinct("user_id").alias("n"))
    return near.join(exact, F.col("event_type").eqNullSafe(F.col("of"))).select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("near"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '[^a-z0-9]+', '-', 'g') AS name FROM pages")
def safe_names(spark, d):
    return read(spark, d, "pages").select("page_id", rules.safe_name(urls.host(F.col("url"))).alias("name"))


PATHS = "p AS (SELECT page_id, ['/a/b', 'a/b/', '/', '/x.html', '/a?x=1', '/a/?x=1', ''][(page_id % 7) + 1] AS v FROM pages)"


def _paths(spark, d):
    values = ("/a/b", "a/b/", "/", "/x.html", "/a?x=1", "/a/?x=1", "")
    return read(spark, d, "pages").select("page_id", F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("page_id") % 7 + 1).cast("int")).alias("v"))


@query(f"""WITH {PATHS} SELECT page_id, 'https://e.com' || CASE WHEN v[1:1] = '/' THEN v ELSE '/' || v END AS joined,
    ['/a/b/', NULL, NULL, NULL, '/a/?x=1', NULL, NULL][(page_id % 7) + 1] AS slashed, [NULL, 'a/b', NULL, NULL, NULL, '/a?x=1', NULL][(page_id % 7) + 1] AS stripped FROM p""")
def path_variants(spark, d):
    v = F.col("v")
    return _paths(spark, d).select("page_id", urls.join_path(F.lit("https://e.com//"), v).alias("joined"), urls.add_path_slash(v).alias("slashed"), urls.strip_path_slash(v).alias("stripped"))


@query("""SELECT page_id, [0, 1, 2][(page_id % 3) + 1] AS params, ['/a/b', '/a/{A}', '/{A}/x/{B}'][(page_id % 3) + 1] AS lettered FROM pages""")
def pattern_params(spark, d):
    p = F.element_at(F.array(*[F.lit(x) for x in ("/a/b", "/a/{param}", "/{param}/x/{param}")]), (F.col("page_id") % 3 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", templates.count_params(p).alias("params"), templates.letters_for_params(p).alias("lettered"))


@query("""SELECT event_id, ['ssl_cert', 'timeout', 'timeout', 'no_response', 'ssl_cert'][(event_id % 5) + 1] AS kind,
    CASE WHEN event_id % 3 = 0 THEN 'skip' WHEN event_id % 2 = 0 THEN 'delete' ELSE 'fix' END AS action FROM events""")
def error_classes(spark, d):
    i = F.col("event_id")
    message = F.element_at(F.array(*[F.lit(m) for m in ("Self-signed thing", "request TIMED OUT", "AbortError", "socket hang up", "unable to verify")]), (i % 5 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", rules.request_error(message).alias("kind"), rules.fix_action(i % 3 != 0, i % 2 == 0).alias("action"))


@query("""SELECT page_id, ['https://e.com/a/b', 'https://e.com/b', 'https://o.org/x', 'https://o.org/y'][(page_id % 4) + 1] AS target FROM pages""")
def redirect_targets(spark, d):
    to = F.element_at(F.array(*[F.lit(m) for m in ("b", "/b", "https://o.org/x", "//o.org/y")]), (F.col("page_id") % 4 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", urls.resolve(F.lit("https://e.com/a/c"), to).alias("target"))


@query(f"WITH {LOCS} SELECT source_file, loc FROM (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY file_idx, loc_idx) AS rn FROM locs) WHERE rn = 1")
def exact_first_wins(spark, d):
    return cleaning.first_wins(page_locs(spark, d), exact=True).select("source_file", "loc")


@query("SELECT o_orderpriority AS status, count(*) FILTER (o_totalprice > 100000) AS large, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_orderpriority")
def content_counts(spark, d):
    o = read(spark, d, "orders").where("o_custkey % 2 = 0").withColumnRenamed("o_orderpriority", "status")
    return reports.counts_where(o, ["status"], {"large": F.col("o_totalprice") > 100000, "finished": F.col("o_orderstatus") == "F"})


@query(f"""WITH {PATTERNS} SELECT template, CASE WHEN length(template) > 5 THEN template[1:2] || '...' ELSE template END AS label, total_urls FROM pats ORDER BY total_urls DESC, template, pattern_id LIMIT 10""")
def top10_labels(spark, d):
    top = _patterns(spark, d).orderBy(F.desc("total_urls"), "template", "pattern_id").limit(10)
    return top.select("template", rules.ellipsis(F.col("template"), 5).alias("label"), "total_urls")


@query(f"""WITH {LOCS} SELECT seq, rtrim(regexp_extract(loc, '^(?i)[a-z]+://[^/?#]+', 0), '/') AS site, loc FROM locs""")
def template_undo(spark, d):
    """A template rewrite and the same one backwards give the locs as they were."""
    rows = page_locs(spark, d).select("seq", "loc")
    there = rewriting.rewrite(rows, {"kind": "template", "old": "/en/{param}", "new": "/english/{param}"})
    back = rewriting.rewrite(there.select("seq", "loc"), {"kind": "template", "old": "/english/{param}", "new": "/en/{param}"})
    return back.select("seq", F.regexp_extract("loc", r"^(?i)[a-z]+://[^/?#]+", 0).alias("site"), "loc")


@query(f"""WITH {LOCS}, f AS (SELECT seq, loc, CASE WHEN loc LIKE '%/' OR regexp_matches(loc, '[?#]') OR regexp_matches(loc, '\\.[A-Za-z0-9]+$') THEN loc ELSE loc || '/' END AS fixed FROM locs WHERE NOT regexp_matches(loc, '[?#]'))
    SELECT seq, fixed AS loc, fixed <> loc AS fixed FROM f""")
def slash_fix(spark, d):
    rows = page_locs(spark, d).where(~F.col("loc").rlike("[?#]")).select("seq", "loc")
    return rewriting.rewrite(rows, {"kind": "trailing_slash"}).select("seq", "loc", F.col("rewritten").alias("fixed"))


@query("SELECT event_id, event_type, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view' ORDER BY user_id DESC, event_type, event_id LIMIT 40")
def any_column_sort(spark, d):
    e = read(spark, d, "events").where("event_type = 'view'").select("event_id", "event_type", "user_id", F.col("ts").cast("date").alias("day"))
    return reports.page(e, [F.desc("user_id"), F.asc("event_type"), F.asc("event_id")], 1, 40)


@query(f"""WITH {FILES} SELECT session_id, count(*) AS total, count(*) FILTER (status = 'parsed') AS parsed, min(file_id) FILTER (status = 'pending') AS next_file,
    count(*) FILTER (status = 'parsed' AND file_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS parsed_with_rest FROM files GROUP BY session_id""")
def readiness_counters(spark, d):
    rest = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file_id")).distinct().withColumn("rest", F.lit(True))
    return workflow.readiness(_files(spark, d).join(rest, "file_id", "left"))
