"""Reports of the operations desk, and labelled extensions, over the driver's relational tables.

Orders stand for files and tasks, customers for sessions and users, events for queue rows and logs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import reports, rewriting
from .inventory import read

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH f AS (SELECT o_custkey, count(*) AS files, count(*) FILTER (o_orderstatus = 'F') AS finished, max(o_orderdate) AS last_at FROM orders GROUP BY o_custkey),
    p AS (SELECT o_custkey, count(*) AS patterns, count(*) FILTER (l_returnflag = 'R') AS bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
    SELECT c_custkey, coalesce(files, 0) AS files, coalesce(finished, 0) AS finished, last_at, coalesce(patterns, 0) AS patterns, coalesce(bad, 0) AS bad
    FROM customer LEFT JOIN f ON f.o_custkey = c_custkey LEFT JOIN p ON p.o_custkey = c_custkey"""
)
def session_history(spark, d):
    orders, lines = read(spark, d, "orders"), read(spark, d, "lineitem")
    f = orders.groupBy("o_custkey").agg(F.count("*").alias("files"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.max("o_orderdate").alias("last_at"))
    # Lines are summed by order first, so that the join with orders carries one row an order.
    by_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    p = by_order.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("patterns"), F.sum("r").alias("bad"))
    c = read(spark, d, "customer").select("c_custkey")
    out = c.join(f, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey").join(p, F.col("c_custkey") == F.col("o_custkey"), "left")
    return out.select("c_custkey", *[F.coalesce(x, F.lit(0)).alias(x) if x != "last_at" else F.col(x) for x in ("files", "finished", "last_at", "patterns", "bad")])


@query(
    """SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderpriority IS NULL OR o_orderpriority = '5-LOW') AS silent,
    count(*) > 10 AND count(*) FILTER (o_orderpriority IS NULL OR o_orderpriority = '5-LOW') > 0.9 * count(*) AS connectivity_warning FROM orders GROUP BY o_custkey"""
)
def session_detail(spark, d):
    silent = F.count_if(F.col("o_orderpriority").isNull() | (F.col("o_orderpriority") == "5-LOW"))
    grouped = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), silent.alias("silent"))
    return grouped.withColumn("connectivity_warning", (F.col("total") > 10) & (F.col("silent") > 0.9 * F.col("total")))


@query(
    """SELECT o_custkey AS session_id, total_files, parsed_files, extracted_files, patterns, sampled_patterns,
    CASE WHEN parsed_files < total_files THEN 'parse' WHEN extracted_files < total_files THEN 'extract' WHEN sampled_patterns < patterns THEN 'sample' ELSE 'complete' END AS phase FROM (
      SELECT o_custkey, count(*) AS total_files, count(*) FILTER (o_orderstatus <> 'P') AS parsed_files, count(*) FILTER (o_orderstatus = 'F' OR o_custkey % 3 = 0) AS extracted_files,
             count(*) FILTER (o_totalprice > 1000) AS patterns, count(*) FILTER (o_totalprice > 1000 AND o_custkey % 2 = 0) AS sampled_patterns FROM orders GROUP BY o_custkey)"""
)
def resume_phase(spark, d):
    done = (F.col("o_orderstatus") == "F") | (F.col("o_custkey") % 3 == 0)
    priced = F.col("o_totalprice") > 1000
    counters = reports.counts_where(
        read(spark, d, "orders").withColumnRenamed("o_custkey", "session_id").withColumn("o_custkey", F.col("session_id")),
        ["session_id"],
        {"total_files": F.lit(True), "parsed_files": F.col("o_orderstatus") != "P", "extracted_files": done, "patterns": priced, "sampled_patterns": priced & (F.col("o_custkey") % 2 == 0)},
    )
    return reports.resume_phase(counters)


@query(
    """SELECT o_orderkey, count(l_orderkey) AS sampled, count(*) FILTER (l_returnflag = 'N') AS hits, count(*) FILTER (l_returnflag <> 'N') AS misses
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def export_patterns(spark, d):
    s = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("sampled"), F.count_if(F.col("l_returnflag") == "N").alias("hits"), F.count_if(F.col("l_returnflag") != "N").alias("misses"))
    o = read(spark, d, "orders").select("o_orderkey")
    return o.join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sampled", "hits", "misses")])


@query("SELECT o_custkey, max_by(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderpriority FROM orders GROUP BY o_custkey")
def latest_per_key(spark, d):
    return reports.latest(read(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")


@query(
    """SELECT o_custkey, string_agg(k, ', ' ORDER BY rn) AS k FROM (
      SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 3 GROUP BY o_custkey"""
)
def top3_concat(spark, d):
    rows = read(spark, d, "orders").withColumn("k", F.col("o_orderkey").cast("string"))
    return reports.first_values(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "k", 3)


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS c_mktsegment FROM customer GROUP BY c_nationkey")
def distinct_list(spark, d):
    return reports.distinct_list(read(spark, d, "customer"), "c_nationkey", "c_mktsegment")


@query(
    """WITH locs AS (SELECT 'f' || (page_id % 8) AS source_file, url AS loc FROM pages), p AS (
      SELECT url, CASE WHEN page_id % 2 = 0 THEN 404 ELSE 301 END AS http_status, page_id % 20 AS pattern_id FROM pages WHERE page_id % 3 = 0
    ), hit AS (SELECT DISTINCT source_file, loc, http_status, pattern_id FROM locs JOIN p ON loc = url), r AS (
      SELECT source_file, loc, row_number() OVER (PARTITION BY source_file ORDER BY loc) AS rn FROM (SELECT DISTINCT source_file, loc FROM hit))
    SELECT source_file, count(DISTINCT loc) AS n, string_agg(DISTINCT http_status, ',' ORDER BY http_status) AS statuses, count(DISTINCT pattern_id) AS patterns,
           (SELECT string_agg(loc, ' ' ORDER BY rn) FROM r WHERE rn <= 5 AND r.source_file = hit.source_file) AS first_urls FROM hit GROUP BY source_file"""
)
def problem_files(spark, d):
    from .inventory import page_locs

    p = read(spark, d, "pages").where("page_id % 3 = 0")
    problems = p.select("url", F.when(F.col("page_id") % 2 == 0, 404).otherwise(301).alias("http_status"), (F.col("page_id") % 20).alias("pattern_id"))
    return reports.problem_files(page_locs(spark, d).select("source_file", "loc"), problems)



def _conditions():
    kind = F.col("event_type")
    return {k: kind == k for k in ("click", "error", "purchase", "signup", "view")} | {"needs_refill": (kind == "view") & (F.col("value") < 50)}


PIVOT = ", ".join(f"count(*) FILTER (event_type = '{k}') AS \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + ", count(*) FILTER (event_type = 'view' AND value < 50) AS needs_refill"


@query(f"SELECT user_id, {PIVOT} FROM events GROUP BY user_id")
def queue_pivot(spark, d):
    return reports.counts_where(read(spark, d, "events"), ["user_id"], _conditions())


@query(f"SELECT user_id, {PIVOT} FROM events GROUP BY ROLLUP (user_id)")
def queue_totals_rollup(spark, d):
    return reports.with_totals(read(spark, d, "events"), "user_id", _conditions())


@query(
    """SELECT event_id, ts, user_id, event_type, value FROM events WHERE regexp_matches(event_type, '(?i)CLI|sign') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'
    ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50"""
)
def backlinks_filtered_page(spark, d):
    e = read(spark, d, "events").where(F.col("event_type").rlike("(?i)CLI|sign") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz")))
    return reports.page(e.select("event_id", "ts", "user_id", "event_type", "value"), [F.desc("ts"), F.desc("event_id")], 3, 25)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM events WHERE event_type = 'click'")
def page_count(spark, d):
    return reports.page_count(read(spark, d, "events").where("event_type = 'click'"), 25)


@query(f"SELECT {PIVOT}, count(DISTINCT user_id) AS users FROM events")
def overview_counts(spark, d):
    e = read(spark, d, "events")
    return e.agg(*[F.count_if(c).alias(n) for n, c in _conditions().items()], F.count_distinct("user_id").alias("users"))


@query(
    """SELECT user_id, strftime(ts, '%Y-%m') AS month, CAST(date_trunc('week', ts) AS DATE) AS week_start, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(38,4)), 2) AS total
    FROM events GROUP BY ROLLUP (user_id, month, week_start)"""
)
def weekly_rollup(spark, d):
    e = read(spark, d, "events").select("user_id", rules.month_key(F.col("ts")).alias("month"), rules.week_start(F.col("ts")).alias("week_start"), F.col("value").cast("decimal(18,4)").alias("v"))
    return e.rollup("user_id", "month", "week_start").agg(F.count("*").alias("n"), F.round(F.sum("v").cast("decimal(38,4)"), 2).alias("total"))


def _reports(spark, d):
    kind = F.when(F.col("event_type") == "error", "leave").when(F.col("event_type") == "signup", "public-holiday").otherwise("report")
    return read(spark, d, "events").select(F.col("user_id").alias("member"), F.col("ts").cast("date").alias("day"), kind.alias("kind"))


REPORTS = """r AS (SELECT user_id AS member, CAST(ts AS DATE) AS day, max(CASE event_type WHEN 'error' THEN 'leave' WHEN 'signup' THEN 'public-holiday' ELSE 'report' END) AS kind FROM events GROUP BY ALL),
grid AS (SELECT member, CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT user_id AS member FROM events))"""


@query(
    f"""WITH {REPORTS} SELECT member, day, CASE kind WHEN 'report' THEN 'P' WHEN 'leave' THEN 'L' WHEN 'public-holiday' THEN 'PH' ELSE CASE WHEN isodow(day) >= 6 THEN '-' ELSE 'X' END END AS mark
    FROM grid LEFT JOIN r USING (member, day)"""
)
def attendance_matrix(spark, d):
    r = _reports(spark, d)
    return reports.attendance(r, r.select("member").distinct(), "2024-01-01", "2024-01-31")


@query(f"WITH {REPORTS} SELECT member, min(day) AS oldest FROM grid WHERE isodow(day) < 6 AND NOT EXISTS (SELECT 1 FROM r WHERE r.member = grid.member AND r.day = grid.day) GROUP BY member")
def oldest_missing_day(spark, d):
    r = _reports(spark, d)
    return reports.missing_days(r, r.select("member").distinct(), "2024-01-01", "2024-01-31").groupBy("member").agg(F.min("day").alias("oldest"))


@query(
    """WITH u AS (SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 10 = 0 THEN 'super-admin' WHEN s_suppkey % 3 = 0 THEN 'sub-lead' ELSE 'admin' END AS role, s_nationkey FROM supplier),
    seen AS (SELECT user_id AS viewer_id, user_id AS member FROM u WHERE role <> 'super-admin' UNION
      SELECT a.user_id, b.user_id FROM u a JOIN u b USING (s_nationkey) WHERE a.role = 'sub-lead' UNION SELECT a.user_id, b.user_id FROM u a, u b WHERE a.role = 'super-admin')
    SELECT viewer_id, count(*) AS visible FROM seen JOIN lineitem ON l_suppkey = member GROUP BY viewer_id"""
)
def rbac_scope(spark, d):
    i = F.col("s_suppkey")
    s = read(spark, d, "supplier")
    users = s.select(i.alias("user_id"), F.when(i % 10 == 0, "super-admin").when(i % 3 == 0, "sub-lead").otherwise("admin").alias("role"))
    group = F.col("s_nationkey").alias("group")
    rows = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return reports.scoped_totals(rows, "l_suppkey", "n", users, s.select(i.alias("lead_user_id"), group), s.select(group, i.alias("member"))).select("viewer_id", F.col("n").alias("visible"))


@query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def used_sources_anti(spark, d):
    used = read(spark, d, "lineitem").where("l_linestatus = 'O'").select("l_suppkey").distinct()
    reusable = read(spark, d, "supplier").where("s_acctbal < 0").select("s_suppkey")
    return used.join(reusable, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")


@query("SELECT p_partkey FROM part WHERE p_size % 5 = 2 OR p_partkey % 7 = 2")
def assigned_any(spark, d):
    p = read(spark, d, "part").withColumn("assigned", F.array((F.col("p_size") % 5).cast("long"), F.col("p_partkey") % 7))
    return p.where(F.exists("assigned", lambda a: a == 2)).select("p_partkey")


@query("SELECT event_type, count(value) AS samples, quantile_disc(value, 0.95) AS value FROM events GROUP BY event_type")
def p95_nearest_rank(spark, d):
    return reports.nearest_rank(read(spark, d, "events"), "event_type", "value")


@query(
    """WITH f AS (SELECT user_id AS run, event_type AS stage, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS s FROM events)
    SELECT run, stage, CAST(coalesce(sum(s), 0) AS BIGINT) AS micros FROM f GROUP BY ALL"""
)
def stage_attribution(spark, d):
    return reports.stage_times(read(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), "ts", F.col("event_id").alias("seq")))


@query(
    """SELECT owner, event_id, running, running <= 5000 AS keep FROM (
      SELECT user_id AS owner, event_id, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS UNBOUNDED PRECEDING) AS running FROM events)"""
)
def retention_running_sum(spark, d):
    rows = read(spark, d, "events").select(F.col("user_id").alias("owner"), "event_id", "ts", F.floor("value").alias("size"))
    return reports.under_ceiling(rows, [F.desc("ts"), "event_id"], "size", 5000).select("owner", "event_id", "running", "keep")


@query(
    """WITH o AS (SELECT c_custkey AS k, c_nationkey AS a, c_acctbal AS b FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 100 END AS a, c_acctbal AS b FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 = 0)
    SELECT coalesce(o.k, n.k) AS k, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b FROM o FULL JOIN n ON o.k = n.k"""
)
def weekly_upsert(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("a"), F.col("c_acctbal").alias("b"))
    new = c.where("k % 2 = 0 OR k % 5 = 0").withColumn("a", F.when(F.col("k") % 2 == 0, F.col("a") + 100))
    return rewriting.upsert(c.where("k % 3 <> 0"), new, ["k"])


@query("SELECT c_custkey AS k, c_nationkey AS a FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_nationkey + 100 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0")
def queue_insert_new(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("a"))
    return rewriting.insert_new(c.where("k % 3 <> 0"), c.where("k % 2 = 0").withColumn("a", F.col("a") + 100), ["k"])


@query("SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-10' THEN 'error' ELSE event_type END AS status FROM events WHERE ts >= TIMESTAMP '2024-01-03'")
def stale_and_retention(spark, d):
    e = read(spark, d, "events").where(F.col("ts") >= F.lit("2024-01-03").cast("timestamp_ntz"))
    stale = (F.col("event_type") == "view") & (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    return e.select("event_id", F.when(stale, "error").otherwise(F.col("event_type")).alias("status"))


# Extensions: built-in operators that the inventory lists as absent.
@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def ext_tumbling_window(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("event_type", F.window(F.col("ts"), "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("hour"), "n")


@query(
    """WITH e AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM e)
    SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, g"""
)
def ext_sessions(spark, d):
    e = read(spark, d, "events")
    return e.groupBy("user_id", F.session_window(F.col("ts"), "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("started")).select("user_id", "started", "n")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def ext_intersect(spark, d):
    return read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey").intersect(read(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0")
def ext_except(spark, d):
    return read(spark, d, "customer").select("c_custkey").exceptAll(read(spark, d, "orders").where("o_orderkey % 7 = 0").select("o_custkey").distinct())
