"""Relational reports: roll-ups with conditions, latest rows, scopes, pages of results, attendance and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules


def counts_where(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """One count a condition for each key."""
    return rows.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def with_totals(rows: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """As counts_where, with one more row for the grand totals, whose key is null."""
    return rows.rollup(key).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def latest(rows: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """key, value of each key's row with the greatest (at, tie)."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(at, tie)).alias(value))


def first_values(rows: DataFrame, key: str, order: list[str], value: str, n: int, sep: str = ", ") -> DataFrame:
    """key, value: the first n values of each key, joined."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    kept = rows.withColumn("__rn", rank).where(F.col("__rn") <= n)
    listed = F.sort_array(F.collect_list(F.struct("__rn", value)))
    return kept.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x[value]), sep).alias(value))


def distinct_list(rows: DataFrame, key: str, value: str, sep: str = ", ") -> DataFrame:
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(value)), sep).alias(value))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """One page of an ordered result, numbered from 1."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("pages"))


def members_seen(users: DataFrame, groups: DataFrame) -> DataFrame:
    """viewer_id, member: themselves, and for leads the members of their groups; super-admins, who see all, are not listed.

    users has user_id and role; groups has lead_user_id and member_user_ids.
    """
    led = groups.select(F.col("lead_user_id").alias("viewer_id"), F.explode("member_user_ids").alias("member"))
    own = users.where("role <> 'super-admin'").select(F.col("user_id").alias("viewer_id"), F.col("user_id").alias("member"))
    sub = users.where("role = 'sub-lead'").select(F.col("user_id").alias("viewer_id")).join(led, "viewer_id")
    return own.unionByName(sub).distinct()


def scoped(rows: DataFrame, owner: str, viewer: int, users: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows one viewer may see: own ones, those of a led group's members, or all."""
    if not users.where((F.col("user_id") == viewer) & (F.col("role") == "super-admin")).isEmpty():
        return rows
    mine = members_seen(users, groups).where(F.col("viewer_id") == viewer).select(F.col("member").alias("__m"))
    return rows.join(mine, F.col(owner) == F.col("__m"), "left_semi")


def scoped_totals(counts: DataFrame, owner: str, n: str, users: DataFrame, groups: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """viewer_id, n: the sum over what each viewer may see. Owners are summed first; super-admins all have the one total.

    With members (group, member), groups has lead_user_id and group in place of arrays: a group is then summed once,
    however many lead it, and only who leads several groups has members told apart.
    """
    by_owner = counts.groupBy(F.col(owner).alias("__o")).agg(F.sum(n).alias("__n"))
    if members is None:
        seen = members_seen(users, groups).join(by_owner, F.col("member") == F.col("__o")).groupBy("viewer_id").agg(F.sum("__n").alias(n))
    else:
        seen = _seen_by_group(by_owner, users, groups, members).withColumnRenamed("__n", n)
    every = users.where("role = 'super-admin'").select(F.col("user_id").alias("viewer_id"))
    return seen.unionByName(every.withColumn(n, by_owner.agg(F.sum("__n").alias("total")).scalar()))


def _seen_by_group(by_owner: DataFrame, users: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """viewer_id, __n of what each viewer but super-admins may see, if it is anything."""
    belongs = members.select(F.col("group").alias("__g"), F.col("member").alias("__m")).distinct()
    sums = belongs.join(by_owner, F.col("__m") == F.col("__o")).groupBy(F.col("__g").alias("__of")).agg(F.sum("__n").alias("__n"))
    leads = users.where("role = 'sub-lead'").select(F.col("user_id").alias("viewer_id")).distinct()
    led = leads.join(groups.select("lead_user_id", F.col("group").alias("__led")).where("group IS NOT NULL").distinct(), F.col("viewer_id") == F.col("lead_user_id")).drop("lead_user_id")
    led = led.join(led.groupBy(F.col("viewer_id").alias("__v")).agg(F.count("*").alias("__k")), F.col("viewer_id") == F.col("__v")).drop("__v")
    one, several = led.where("__k = 1"), led.where("__k > 1")
    whole = one.join(sums, F.col("__led") == F.col("__of")).select("viewer_id", "__n")
    told = several.join(belongs, F.col("__led") == F.col("__g")).select("viewer_id", F.col("__m").alias("__seen")).distinct()
    # Their own rows, unless a group that is summed or told apart has them.
    held = led.join(belongs, (F.col("__led") == F.col("__g")) & (F.col("viewer_id") == F.col("__m"))).select(F.col("viewer_id").alias("__v")).distinct()
    own = users.where("role <> 'super-admin'").select(F.col("user_id").alias("viewer_id")).distinct().join(held, F.col("viewer_id") == F.col("__v"), "left_anti")
    apart = told.unionByName(own.withColumn("__seen", F.col("viewer_id"))).join(by_owner, F.col("__seen") == F.col("__o")).select("viewer_id", "__n")
    return whole.unionByName(apart).groupBy("viewer_id").agg(F.sum("__n").alias("__n"))


def missing_days(reports: DataFrame, members: DataFrame, first: str, last: str) -> DataFrame:
    """member, day of the working days from first to last without a report (member, day)."""
    days = members.select("member", F.explode(rules.working_days(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(reports.select("member", "day").distinct(), ["member", "day"], "left_anti")


def attendance(reports: DataFrame, members: DataFrame, first: str, last: str) -> DataFrame:
    """member, day, mark: P, L or PH by the kind of report, - on weekends without one, X where one is missing."""
    grid = members.select("member", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    one = reports.groupBy("member", "day").agg(F.max("kind").alias("kind"))
    mark = (
        F.when(F.col("kind") == "report", "P").when(F.col("kind") == "leave", "L").when(F.col("kind") == "public-holiday", "PH").when(F.weekday("day") >= 5, "-").otherwise("X")
    )
    return grid.join(one, ["member", "day"], "left").select("member", "day", mark.alias("mark"))


def nearest_rank(rows: DataFrame, key: str, value: str, q: float = 0.95) -> DataFrame:
    """key, samples, value: the smallest value that a share q of the samples does not exceed."""
    return rows.groupBy(key).agg(F.count(value).alias("samples"), F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(value))


def stage_times(frames: DataFrame) -> DataFrame:
    """run, stage, micros: the time from each frame to the next counts for the stage that is open."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = frames.select("run", "stage", (F.lead(micros).over(Window.partitionBy("run").orderBy("ts", "seq")) - micros).alias("m"))
    return timed.groupBy("run", "stage").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("micros"))


def under_ceiling(rows: DataFrame, order: list, size: str, ceiling: int) -> DataFrame:
    """The rows with keep: whether the sizes of the rows up to this one, in this order by key, stay under a ceiling."""
    total = F.sum(size).over(Window.partitionBy("owner").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", total).withColumn("keep", total <= ceiling)


def problem_files(locs: DataFrame, problems: DataFrame, samples: int = 5) -> DataFrame:
    """source_file, n, statuses, patterns and the first problem URLs of each file.

    problems has url, http_status and pattern_id; a URL counts once a file.
    """
    hit = locs.select("source_file", "loc").distinct().join(problems, F.col("loc") == F.col("url"))
    facts = hit.groupBy("source_file").agg(
        F.count_distinct("loc").alias("n"),
        F.array_join(F.sort_array(F.collect_set("http_status")), ",").alias("statuses"),
        F.count_distinct("pattern_id").alias("patterns"),
    )
    first = first_values(hit.select("source_file", "loc").distinct(), "source_file", ["loc"], "loc", samples, " ")
    return facts.join(first.withColumnRenamed("loc", "first_urls"), "source_file")


def resume_phase(sessions: DataFrame) -> DataFrame:
    """The sessions with phase: the first step that is not finished, from their counters."""
    phase = (
        F.when(F.col("parsed_files") < F.col("total_files"), "parse")
        .when(F.col("extracted_files") < F.col("total_files"), "extract")
        .when(F.col("sampled_patterns") < F.col("patterns"), "sample")
        .otherwise("complete")
    )
    return sessions.withColumn("phase", phase)
