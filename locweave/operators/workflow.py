"""Steps of a session's life: which files are worked on, edits with their history, queues, backlinks, checklists, clearing up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import templates
from .exports import EDITED_MARKS, display_name

SHOWN_STATUSES = (301, 302, 307, 308, 404)
NO_ORDER = 9999
#: Submissions a day below which a site's queue is filled up, by engine.
FULL_QUEUE = {"gsc": 10_000, "bing": 50_000}


def extractable(files: DataFrame, partial: DataFrame) -> DataFrame:
    """The files patterns are taken from, by name and then id: parsed ones that are no index and valid with locs, or saved in part."""
    some = partial.select(F.col("file_id").alias("__p")).distinct()
    flagged = files.join(some, F.col("file_id") == F.col("__p"), "left")
    good = (F.col("is_valid") & ~F.col("is_empty")) | F.col("__p").isNotNull()
    return flagged.where((F.col("status") == "parsed") & ~F.col("is_index") & good).drop("__p").orderBy("filename", "file_id")


def is_edited(stored: Column, session: Column) -> Column:
    """Whether a stored name is that of an edited copy: the session's id, and one of the marks between hyphens right after it."""
    marks = [F.startswith(stored, F.concat(session, F.lit(f"-{m}-"))) for m in EDITED_MARKS]
    return F.coalesce(F.exists(F.array(*marks), lambda hit: hit), F.lit(False))


def corrected_download(patterns: DataFrame, occurrences: DataFrame, stored: DataFrame) -> DataFrame:
    """pattern_id, stored_name, download_name of each pattern's corrected file; patterns that no edited file belongs to are absent.

    The first by stored name of the edited files of the pattern's session and role that are not deleted and
    no URLs, among those whose display name is one of the pattern's occurrences (pattern_id, filename), or
    among all where it has none.
    """
    names = stored.where(is_edited(F.col("stored_name"), F.col("session_id")) & ~F.coalesce("deleted", F.lit(False)) & ~F.col("stored_name").rlike("^https?://"))
    names = names.select("session_id", "source_role", "stored_name", display_name(F.col("stored_name"), F.col("session_id")).alias("shown"))
    first = names.groupBy("session_id", "source_role").agg(F.min("stored_name").alias("stored_name"))
    by_name = names.groupBy("session_id", "source_role", "shown").agg(F.min("stored_name").alias("stored_name"))
    occurring = occurrences.select(F.col("pattern_id").alias("of"), F.col("filename").alias("shown")).distinct()
    without = patterns.join(occurring, F.col("pattern_id") == F.col("of"), "left_anti").join(first, ["session_id", "source_role"])
    among = patterns.join(occurring, F.col("pattern_id") == F.col("of")).join(by_name, ["session_id", "source_role", "shown"])
    wanted = ["pattern_id", "session_id", "stored_name"]
    found = without.select(*wanted).unionByName(among.groupBy("pattern_id", "session_id").agg(F.min("stored_name").alias("stored_name")))
    return found.select("pattern_id", "stored_name", F.concat(F.lit("corrected-"), display_name(F.col("stored_name"), F.col("session_id"))).alias("download_name"))


def with_statuses(rows: DataFrame, asked: list[int] | None, status: str = "http_status") -> DataFrame:
    """The rows with one of the statuses asked for; of others than SHOWN_STATUSES, or of none at all, all shown ones count."""
    good = [s for s in asked or [] if s in SHOWN_STATUSES]
    return rows.where(F.col(status).isin(*(good or SHOWN_STATUSES)))


def runs_of(rows: DataFrame, kind: str = "all", visible: DataFrame | None = None, team: DataFrame | None = None, selected: int | str | None = None) -> DataFrame:
    """The runs of a view: automated ones whoever looks; manual ones, or all, of the users in scope.

    visible has the users a viewer may see (None: all of them), team those of a chosen team. A selected
    user counts if visible; without a bound on what is visible the team goes before the selected user.
    Runs without a user, as automated ones are, are in no scope, so that only a viewer without bounds and
    filters has them among all.
    """
    if kind == "automated":
        return rows.where("automated")
    rows = rows.where(~F.coalesce("automated", F.lit(False))) if kind == "manual" else rows
    users = visible if visible is not None else team
    if visible is not None and selected is not None:
        chosen = visible.where(F.col("user_id") == F.lit(selected))
        users = chosen if not chosen.isEmpty() else visible
    if users is not None:
        return rows.join(users.select(F.col("user_id").alias("in_scope")).distinct(), F.col("user_id") == F.col("in_scope"), "left_semi")
    return rows if selected is None else rows.where(F.col("user_id") == F.lit(selected))


def queue_page(rows: DataFrame, gsc: str | None = None, bing: str | None = None, url_like: str | None = None) -> DataFrame:
    """The queue's rows with these statuses and URLs like a pattern, whatever its case; what is not asked for is no filter."""
    for column, value in (("gsc_status", gsc), ("bing_status", bing)):
        rows = rows.where(F.col(column) == value) if value else rows
    return rows.where(F.col("url").rlike(f"(?i){url_like}")) if url_like else rows


def shown(rows: DataFrame, status: str | None = None, member: int | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """The rows of a view's filters: a status, a member, days from first to last, both included."""
    rows = rows.where(F.col("status") == status) if status else rows
    rows = rows.where(F.col("member") == member) if member is not None else rows
    rows = rows.where(F.col("day") >= F.lit(first).cast("date")) if first else rows
    return rows.where(F.col("day") <= F.lit(last).cast("date")) if last else rows


def pattern_order() -> list[Column]:
    """Current ones first, then those missing there, the larger, and the name."""
    return [F.when(F.col("source_role") == "current", 0).otherwise(1), F.col("missing_in_current").desc(), F.col("total_urls").desc(), F.col("template").asc()]


def index_first() -> list[Column]:
    return [F.col("is_index").desc(), F.col("filename").asc(), F.col("file_id").asc()]


def verified_first() -> list[Column]:
    """Sampled rows first, each kind in the order it came in (seq)."""
    return [F.col("is_sampled").desc(), F.col("seq").asc()]


def by_reporting_order(rows: DataFrame, orders: DataFrame, key: str = "member") -> DataFrame:
    """The rows with reporting_order, NO_ORDER where the table of orders (key, reporting_order) has none."""
    return rows.join(orders.select(key, "reporting_order"), key, "left").withColumn("reporting_order", F.coalesce("reporting_order", F.lit(NO_ORDER)))


def preview(rows: DataFrame, rewritten: DataFrame, key: str, loc: str = "loc", n: int = 5) -> DataFrame:
    """The first n rows, by key, that a rewrite changes: key, before, after."""
    new = rewritten.where("rewritten").select(key, F.col(loc).alias("after"))
    return rows.select(key, F.col(loc).alias("before")).join(new, key).orderBy(key).limit(n)


def block_counts(rows: DataFrame, kept: DataFrame, file: str = "source_file") -> DataFrame:
    """source_file, kept, removed after a deletion."""
    left = kept.groupBy(F.col(file).alias("__f")).agg(F.count("*").alias("kept"))
    counts = rows.groupBy(file).agg(F.count("*").alias("__all")).join(left, F.col(file) == F.col("__f"), "left")
    return counts.select(file, F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("__all") - F.coalesce("kept", F.lit(0))).alias("removed"))


def rename(rows: DataFrame, history: DataFrame, files: DataFrame, old: str, new: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with a template renamed, and the history with a row a file more: source_file, old, new, changed, at.

    A file where nothing matches has a row with 0 too.
    """
    renamed = templates.rewrite_template(F.col("loc"), old, new)
    made = rows.withColumn("loc", F.coalesce(renamed, "loc"))
    counts = rows.groupBy(F.col("source_file").alias("__f")).agg(F.count_if(renamed.isNotNull()).alias("__n"))
    entries = files.select("source_file").distinct().join(counts, F.col("source_file") == F.col("__f"), "left")
    entries = entries.select("source_file", F.lit(old).alias("old"), F.lit(new).alias("new"), F.coalesce("__n", F.lit(0)).alias("changed"), at.alias("at"))
    return made, history.unionByName(entries)


def soft_delete(files: DataFrame, ids: DataFrame, at: Column, restore: bool = False) -> DataFrame:
    """The files with those ids flagged as deleted at a time, or no longer so; others stay as they are."""
    hit = files.join(ids.select(F.col("file_id").alias("__d")).distinct(), F.col("file_id") == F.col("__d"), "left")
    mine = F.col("__d").isNotNull()
    when = F.lit(None).cast("timestamp") if restore else F.coalesce("deleted_at", at)
    return hit.withColumns({"deleted": F.when(mine, F.lit(not restore)).otherwise(F.col("deleted")), "deleted_at": F.when(mine, when).otherwise(F.col("deleted_at"))}).drop("__d")


def refill(sites: DataFrame, pool: DataFrame, engine: str, least: int, most: int, seed: str = "0") -> DataFrame:
    """site, url to queue: of sites below the engine's full queue, a batch of least to most URLs each, of the same ones every time for a seed.

    sites has site and queued; pool has site and url. A batch's size and its URLs go by hashes.
    """
    low = sites.where(F.col("queued") < FULL_QUEUE[engine]).select("site", (F.lit(least) + F.pmod(F.xxhash64("site", F.lit(seed)), F.lit(most - least + 1))).alias("__n"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.md5(F.concat(F.lit(seed), "url")), "url"))
    return pool.join(low, "site").withColumn("__rn", rank).where("__rn <= __n").select("site", "url")


def with_results(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue with status by the results (canonical URL, status): Unknown where an URL asked for has none."""
    one = results.groupBy(F.col("url").alias("__u")).agg(F.max("status").alias("__s"))
    return queue.join(one, F.col("url") == F.col("__u"), "left").withColumn("status", F.coalesce("__s", F.lit("Unknown"))).drop("__u", "__s")


def new_backlinks(held: DataFrame, sent: DataFrame, sources: DataFrame) -> DataFrame:
    """sent (url, source, target, user_id) with outcome: accepted, taken, unknown source or incomplete.

    A source serves a target once, while the link held (source, target, status) is pending or approved; reusable
    sources always do. Of several sent at once for one pair the first by url and user is accepted. No target
    is a target like any other; without an URL or a source nothing is sent.
    """
    key = lambda c: F.coalesce(F.col(c), F.lit(""))
    known = sources.groupBy(F.col("source").alias("known")).agg(F.max("reusable").alias("free"))
    active = held.where(F.col("status").isin("pending", "approved")).select(F.col("source").alias("held_source"), key("target").alias("held_target")).distinct()
    whole = (F.trim(key("url")) != "") & (key("source") != "")
    first = sent.where(whole).groupBy(F.col("source").alias("first_source"), key("target").alias("first_target")).agg(F.min(F.struct("url", "user_id")).alias("first"))
    joined = sent.join(known, F.col("source") == F.col("known"), "left")
    joined = joined.join(active, (F.col("source") == F.col("held_source")) & (key("target") == F.col("held_target")), "left")
    joined = joined.join(first, (F.col("source") == F.col("first_source")) & (key("target") == F.col("first_target")), "left")
    taken = F.col("held_source").isNotNull() | ~F.struct("url", "user_id").eqNullSafe(F.col("first"))
    outcome = F.when(~whole, "incomplete").when(F.col("known").isNull(), "unknown source").when(~F.coalesce("free", F.lit(False)) & taken, "taken").otherwise("accepted")
    return joined.select(*sent.columns, outcome.alias("outcome"))


def decide(links: DataFrame, decisions: DataFrame, allowed: DataFrame) -> DataFrame:
    """The links with status by decisions (link_id, decision), where the decider (decider_id, link's user_id in allowed) may see the owner; others stay."""
    may = allowed.select(F.col("viewer_id").alias("__v"), F.col("member").alias("__m")).distinct()
    made = decisions.select(F.col("link_id").alias("__l"), "decision", "decider_id")
    both = links.join(made, F.col("link_id") == F.col("__l"), "left").join(may, (F.col("decider_id") == F.col("__v")) & (F.col("user_id") == F.col("__m")), "left")
    return both.withColumn("status", F.when(F.col("__v").isNotNull() & F.col("decision").isin("approved", "rejected"), F.col("decision")).otherwise(F.col("status"))).select(*links.columns)


def appended(items: DataFrame, new: DataFrame, group: str = "list_id") -> DataFrame:
    """The checklist with new items behind those of their list, in the order of their names."""
    last = items.groupBy(F.col(group).alias("__g")).agg(F.max("position").alias("__last"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("name"))
    added = new.withColumn("__rn", rank).join(last, F.col(group) == F.col("__g"), "left")
    return items.unionByName(added.withColumn("position", (F.coalesce("__last", F.lit(0)) + F.col("__rn")).cast(items.schema["position"].dataType)).select(*items.columns))


def reordered(items: DataFrame, orders: DataFrame) -> DataFrame:
    """The checklist with the positions of another order (item_id, position); items it does not name keep theirs."""
    new = orders.select(F.col("item_id").alias("__i"), F.col("position").alias("__p"))
    return items.join(new, F.col("item_id") == F.col("__i"), "left").withColumn("position", F.coalesce("__p", "position")).drop("__i", "__p")


def is_fresh(generated: Column, changed: Column) -> Column:
    """Whether a packed download still holds: nothing has changed, or it was made after the change; at the same time is too early."""
    return F.when(changed.isNull(), True).otherwise(F.coalesce(generated > changed, F.lit(False)))


def without_sessions(table: DataFrame, gone: DataFrame) -> DataFrame:
    """A table of sessions' rows without those of deleted sessions."""
    return table.join(gone.select("session_id").distinct(), "session_id", "left_anti")


def cleanup_report(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """outcome, n, bytes of stored files to remove: removed, missing, or failed where an error is noted."""
    both = wanted.join(found.select(F.col("stored_name").alias("__n"), "bytes", "error"), F.col("stored_name") == F.col("__n"), "left")
    outcome = F.when(F.col("__n").isNull(), "missing").when(F.col("error").isNotNull(), "failed").otherwise("removed")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def without_twins(children: DataFrame, uploaded: DataFrame) -> DataFrame:
    """The children of indexes (child) that no uploaded file (filename) is the twin of, by base name with or without .gz."""
    base = F.element_at(F.split(F.regexp_replace("child", r"[?#].*$", ""), "/"), -1)
    names = children.select("child", F.explode(F.array_distinct(F.array(base, F.regexp_replace(base, r"\.gz$", "")))).alias("__n"))
    twins = names.join(uploaded.select(F.col("filename").alias("__n")).distinct(), "__n", "left_semi").select("child").distinct()
    return children.join(twins, "child", "left_anti")


def parse_finished(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """session_id of sessions whose files have all been parsed and have all come to an end."""
    counts = files.groupBy("session_id").agg(F.count_if(F.col("status") != "pending").alias("parsed"), F.count_if(F.col("status").isin("parsed", "failed")).alias("ended"))
    return sessions.where("total_files > 0").join(counts, "session_id").where("parsed >= total_files AND ended >= total_files").select("session_id")


def readiness(files: DataFrame) -> DataFrame:
    """session_id, total, parsed, next_file (the least pending id), parsed_with_rest, from files with rest (whether some of it was saved apart)."""
    parsed = F.col("status") == "parsed"
    return files.groupBy("session_id").agg(
        F.count("*").alias("total"), F.count_if(parsed).alias("parsed"), F.min(F.when(F.col("status") == "pending", F.col("file_id"))).alias("next_file"), F.count_if(parsed & F.coalesce("rest", F.lit(False))).alias("parsed_with_rest")
    )
