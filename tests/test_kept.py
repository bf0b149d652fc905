"""What is kept between uploads, edits and micro-batches gives what one pass over all would."""

import itertools
import random
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from locweave import shipping
from locweave.operators import cleaning, edit_log, kept_index, retention, sketches, summaries, walks
from locweave.plans import streams, workflow
from locweave.streaming import live_runs, uploads, windows


def _locs(spark, rows):
    return spark.createDataFrame(rows, "file_idx long, loc_idx long, source_file string, loc string")


def test_uploads_in_any_order_give_one_cleaning(spark, tmp_path):
    r = random.Random(3)
    rows = [(f, i, f"f{f}", r.choice([f"https://e.com/{r.randint(0, 40)}", f"https://E.com/{r.randint(0, 40)}/", "https://e.com/hot", "junk", None])) for f in range(9) for i in range(20)]
    locs = _locs(spark, rows)
    want = sorted(map(tuple, cleaning.first_wins(locs.where("loc IS NOT NULL")).select("file_idx", "loc_idx", "loc").collect()))
    parts = ["file_idx < 3", "file_idx IN (3, 4, 5)", "file_idx > 5"]
    for k, order in enumerate(itertools.permutations(parts)):
        if k % 2:
            continue
        index = kept_index.create(spark, f"t_{uuid.uuid4().hex[:8]}", str(tmp_path / f"i{k}"), slots=3, buckets=2)
        standing = set()
        for part in order:
            told = index.upload(locs.where(part)).collect()
            standing -= {(x.file_idx, x.loc_idx) for x in told if x.change == "retracted"}
            standing |= {(x.file_idx, x.loc_idx) for x in told if x.change == "kept"}
        assert sorted((x.file_idx, x.loc_idx, x.loc) for x in index.rows().collect()) == want
        assert standing == {w[:2] for w in want}
        assert index.upload(locs.where(parts[0])).isEmpty()
        assert index.duplicates(locs).count() == locs.where("loc IS NOT NULL").count() - len(want)
        assert index.upload(locs.limit(0)).isEmpty()


def test_the_index_does_not_move_and_other_slots_stay(spark, tmp_path):
    index = kept_index.create(spark, f"t_{uuid.uuid4().hex[:8]}", str(tmp_path / "i"), slots=8, buckets=4)
    index.upload(spark.range(2000).select(F.lit(5).cast("long").alias("file_idx"), F.col("id").alias("loc_idx"), F.lit("f5").alias("source_file"), F.concat(F.lit("https://e.com/"), F.col("id").cast("string")).alias("loc")))
    one = _locs(spark, [(1, 0, "f1", "https://e.com/7")])
    slot = index.incoming(one).first().slot
    plan = index.compared(index.incoming(one), [slot])._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.rindex("Sort [old_key") :]
    assert "Exchange" not in scan and "Bucketed: true" in scan and "PartitionFilters: [isnotnull(slot" in scan
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
    assert sorted(x.change for x in index.upload(one).collect()) == ["kept", "retracted"]
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
    assert {p.parent.name for p in before.items() ^ after.items() for p in [p[0]]} == {f"slot={slot}"}
    assert index.rows().count() == 2000


def test_an_index_is_found_again(spark, tmp_path):
    path = str(tmp_path / "i")
    kept_index.create(spark, "found_1", path, 2, 2).upload(_locs(spark, [(0, 0, "a", "https://e.com/1")]))
    spark.sql("DROP TABLE found_1")
    again = kept_index.create(spark, "found_2", path, 2, 2)
    assert again.rows().count() == 1 and again.upload(_locs(spark, [(1, 0, "b", "https://e.com/1/")])).isEmpty()


def test_one_edit_is_taken_back_and_later_ones_stay(spark, tmp_path):
    log = edit_log.EditLog(spark, str(tmp_path / "log"))
    rows = spark.createDataFrame([(1, "a", "https://old.com/x"), (2, "b", "https://old.com/y"), (3, None, None)], "seq long, source_file string, loc string")
    look = lambda v=None: {r.seq: r.loc for r in edit_log.as_of(rows, log.entries(v)).collect()}
    assert look() == {1: "https://old.com/x", 2: "https://old.com/y"}
    v1 = log.edit({"kind": "find_replace", "find": "old.com", "put": "new.com"})
    v2 = log.edit({"kind": "trailing_slash"}, files=["a"])
    v3 = log.delete("https://new.com/y")
    assert look() == {1: "https://new.com/x/"}
    v4 = log.undo(v1)
    assert look() == {1: "https://old.com/x/", 2: "https://old.com/y"}
    v5 = log.undo(v4)
    assert look() == {1: "https://new.com/x/"} and look(v4) == {1: "https://old.com/x/", 2: "https://old.com/y"} and look(v2) == {1: "https://new.com/x/", 2: "https://new.com/y"}
    log.undo(v3)
    assert look() == {1: "https://new.com/x/", 2: "https://new.com/y"}
    for wrong in (v3, v4, 99):
        with pytest.raises(edit_log.EditError):
            log.undo(wrong)
    with pytest.raises(edit_log.EditError):
        log.edit({"kind": "no such"})
    told = sorted(map(tuple, edit_log.history(rows, log.entries()).collect()))
    assert told == [(1, v1, "https://old.com/x", "https://new.com/x"), (1, v2, "https://new.com/x", "https://new.com/x/"), (2, v1, "https://old.com/y", "https://new.com/y")]
    assert v5 == 5 and [e.version for e in log.entries()] == [1, 2, 3, 4, 5, 6]


def test_settling_of_undos():
    e = lambda v, u=None: edit_log.Entry(v, "undo" if u else "edit", None, None, u)
    assert edit_log.in_force([e(1), e(2), e(3, 1), e(4, 3), e(5, 4)]) == {2, 3, 5}
    assert edit_log.in_force([]) == set()


def test_walks_end_on_cycles_and_keep_folders_apart(spark):
    names = ["https://e.com/a/index.xml", "https://e.com/b/index.xml"]
    rows = [(names[0], "sitemapindex", ["/b/index.xml", "https://e.com/a/index.xml", "one.xml", "/gone.xml"]), (names[1], "sitemapindex", ["https://e.com/a/index.xml", "one.xml"]),
            ("https://e.com/a/one.xml", "urlset", ["https://e.com/p1"]), ("https://e.com/b/one.xml", "urlset", ["https://e.com/p2", "https://e.com/p1"])]
    scanned = spark.createDataFrame(rows, "url string, root string, locs array<string>")
    roots = scanned.limit(1).select("url")
    found = {r.url: r.level for r in walks.walk(walks.edges_of(scanned), roots, 9).collect()}
    assert found == {names[0]: 0, names[1]: 1, "https://e.com/a/one.xml": 1, "https://e.com/gone.xml": 1, "https://e.com/b/one.xml": 2}
    assert {(r.loc, r.level) for r in walks.pages_below(scanned, roots).collect()} == {("https://e.com/p1", 1), ("https://e.com/p2", 2)}
    assert walks.walk(walks.edges_of(scanned), roots, 9, most=2).count() == 4 and walks.walk(walks.edges_of(scanned), roots, 0).count() == 1
    assert walks.walk(walks.edges_of(scanned.limit(0)), roots.limit(0), 3).isEmpty()


def test_sketches_of_days_merge(spark):
    rows = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 9000).alias("who"), F.col("id").cast("double").alias("v"))
    days = sketches.daily(rows, "k", "who", "v")
    for r in sketches.merged(days, "k", F.lit(1)).select("n", sketches.distinct(F.col("seen")).alias("d"), sketches.quantile(F.col("values"), 0.5).alias("q")).collect():
        assert r.n == 10_000 and abs(r.d - 4500) <= sketches.DISTINCT_ERROR * 4500 and abs(r.q / 20_000 - 0.5) < 2 * sketches.RANK_ERROR


def test_kept_ids_count_exactly(spark):
    rows = spark.range(60_000).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") % 5 > 0, F.col("id") % 45_000 - 9000).alias("who"))
    days = sketches.daily_ids(rows, "k", "who")
    want = {k: {r.who for r in rows.where(F.col("k") == k).collect() if r.who is not None} for k in (0, 1)}
    assert {r.k: r.users for r in sketches.counted(sketches.merged_ids(days, "k", F.lit(1)), "k").collect()} == {k: len(v) for k, v in want.items()}
    split = F.col("day") < "1970-01-20"
    half = {(k, b): {r.who for r in rows.where((F.col("k") == k) & ((F.to_date("ts") < "1970-01-20") == F.lit(b)) & F.col("who").isNotNull()).collect()} for k in (0, 1) for b in (True, False)}
    got = {r.k: tuple(r)[1:] for r in sketches.exact_returning(days, "k", split).collect()}
    assert got == {k: (len(half[k, True] & half[k, False]), len(half[k, True] - half[k, False]), len(half[k, False] - half[k, True])) for k in (0, 1)}


def test_approximate_counts_hold_no_sketch_for_each_user(spark):
    plan = workflow.ext_approximate_distinct(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "partial_approx_count_distinct" in plan and "merge_approx_count_distinct" not in plan


def _stream(spark, folder):
    return spark.readStream.schema("run_id string, batch long, attempt long, item string").option("maxFilesPerTrigger", 1).json(str(folder))


def test_later_attempts_withdraw_and_a_restart_goes_on(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    files = [[("r", 0, 0, "a"), ("r", 0, 0, "a"), ("r", 1, 1, "x")], [("r", 0, 1, "b"), ("r", 1, 0, "late"), ("s", 0, 0, "z")], [("r", 0, 0, "older"), ("r", 0, 1, "c"), (None, 0, 0, "n")]]
    columns = ("run_id", "batch", "attempt", "item")
    for k, rows in enumerate(files[:2]):
        spark.createDataFrame(rows, "run_id string, batch long, attempt long, item string").coalesce(1).write.json(str(tmp_path / f"w{k}"))
        next((tmp_path / f"w{k}").glob("*.json")).rename(source / f"{k}.json")
    run = lambda: uploads.finished(uploads.changes(_stream(spark, source)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.item for r in uploads.standing(run()).collect()) == ["b", "x", "z"]
    spark.createDataFrame(files[2], "run_id string, batch long, attempt long, item string").coalesce(1).write.json(str(tmp_path / "w2"))
    next((tmp_path / "w2").glob("*.json")).rename(source / "2.json")
    told = run()
    assert sorted(r.item for r in uploads.standing(told).collect()) == ["b", "c", "x", "z"]
    assert sorted((r["item"], r["change"]) for r in told.collect()) == [("a", -1), ("a", -1), ("a", 1), ("a", 1), ("b", 1), ("c", 1), ("x", 1), ("z", 1)]
    complete = spark.createDataFrame([("s", 1)], "run_id string, total_batches long")
    assert [r["item"] for r in uploads.drained(told, complete).collect()] == ["z"] and columns == tuple(told.columns[:4])


def test_batches_of_one_state_are_withdrawn_apart(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice("ab"), r.randint(0, 9), r.randint(0, 2), f"i{k}") for k in range(300)]
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[k::3], "run_id string, batch long, attempt long, item string").coalesce(1).write.mode("append").json(str(source))
    newest = {}
    for run, batch, attempt, _ in rows:
        newest[run, batch] = max(attempt, newest.get((run, batch), 0))
    told = uploads.finished(uploads.changes(_stream(spark, source), together=4), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, uploads.standing(told).collect())) == sorted(x for x in rows if x[2] == newest[x[0], x[1]])


def test_frames_are_known_on_disk(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.unset(provider)
    frames = spark.createDataFrame([("r", 1, "2024-01-01 00:00:00")] * 2, "run string, seq long, ts string")
    for _ in range(2):
        frames.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("run string, seq long, ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    told = windows.run_to_table(windows.first_frames(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert told.count() == 1 and "RocksDB" in spark.conf.get(provider)


def test_barriers_count_batches_of_many_blocks_once(spark, tmp_path):
    far = 1 << 40
    files = [[("r", b, 70_001) for b in range(0, 70_000, 2)] + [("s", -1, 3), ("s", far, 3), ("w", 1, 2)], [("r", b, 70_001) for b in range(69_999)] + [("s", far, 3), ("w", 1, None)], [("r", 69_999, 70_001), ("r", far, 70_001), ("s", 0, 3), ("s", 1, 3)]]
    stream = lambda k: spark.readStream.schema("run_id string, batch long, total_batches long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    told = []
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "run_id string, batch long, total_batches long").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        told.append(sorted(map(tuple, uploads.finished(uploads.ready(stream(k)), str(tmp_path / "out"), str(tmp_path / "cp")).collect())))
    assert told == [[], [], [("r", 70_001), ("s", 3)]]
    states = spark.read.format("statestore").option("stateVarName", "blocks").load(str(tmp_path / "cp")).count()
    assert states == 4 + 3 + 1  # of r, s and w


def test_retention_over_trees(spark):
    rows = [("a/b/x", "2024-01-01", 5), ("a/b/y", "2024-02-01", None), ("a/z", None, 3), ("c/d", "2023-01-01", 2), ("top", "2024-01-05", 1), (None, "2024-01-01", 9)]
    files = spark.createDataFrame(rows, "path string, modified string, bytes long").withColumn("modified", F.col("modified").cast("timestamp_ntz"))
    tree = retention.folders(files)
    assert {(r.folder, str(r.newest)[:10], r.bytes, r.files) for r in tree.collect()} == {("", "2024-02-01", 11, 5), ("a", "2024-02-01", 8, 3), ("a/b", "2024-02-01", 5, 2), ("c", "2023-01-01", 2, 1)}
    assert [r.folder for r in retention.expired(tree, F.lit("2024-02-02").cast("timestamp_ntz"), "30 DAYS").collect()] == ["c"]
    days = spark.createDataFrame([("2024-01-01", 9), ("2024-01-10", 4), ("2024-01-11", None), ("2024-01-12", 5), ("2024-01-13", 5)], "day string, bytes long")
    got = {r.day: r.reason for r in retention.sweep(days, F.lit("2024-01-13").cast("date"), 5, 10).collect()}
    assert got == {"2024-01-01": "expired", "2024-01-10": "over ceiling", "2024-01-11": "kept", "2024-01-12": "kept", "2024-01-13": "kept"}
    assert retention.sweep(days.limit(0), F.lit("2024-01-13").cast("date"), 5, 10).isEmpty()


def test_running_total_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(retention, "BLOCK", 7)
    rows = spark.range(100).select("id", (F.col("id") % 5).alias("size"))
    got = {r.id: r.running for r in retention.running_total(rows, [F.col("id").desc()], "size").collect()}
    assert got == {i: sum(k % 5 for k in range(i, 100)) for i in range(100)}


def test_tables_of_a_job_are_deleted(spark):
    with shipping.passing(spark):
        path = shipping.scratch(spark, "x")
        spark.range(3).write.parquet(path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
    other = shipping.scratch(spark, "y")
    spark.range(3).write.parquet(other)
    assert shipping.cleared(spark, other) == 1


def test_runs_are_reaped_by_timers_and_come_back(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    minute = lambda m, s=0: f"2024-01-01 00:{m:02d}:{s:02d}"
    batches = [
        [("p", minute(0), "pending", 1), ("q", minute(0), "uploading", 0), ("c", minute(0), "cleaning", 0), (None, minute(0), "pending", 0)],
        [("p", minute(0, 30), "pending", 1), ("w", minute(1), "uploading", 1), ("q", minute(0), "finished", 0)],
        [("w", minute(20), "finished", 0)],
        [("p", minute(21), "uploading", 1), ("w", minute(19), "pending", 0)],
        [("z", minute(40), "pending", 0)],
    ]
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "run string, ts string, phase string, subscribers long")
        frame.coalesce(1).write.json(str(tmp_path / f"w{k}"))
        next((tmp_path / f"w{k}").glob("*.json")).rename(source / f"{k}.json")
    stream = spark.readStream.schema("run string, ts timestamp, phase string, subscribers long").option("maxFilesPerTrigger", 1).json(str(source))
    for late in ("30 minutes", "0 seconds"):  # before any timer goes off, or after
        name = late.split()[1]
        told = uploads.finished(live_runs.changes(stream, late), str(tmp_path / f"out-{name}"), str(tmp_path / f"cp-{name}"))
        states = {}
        for r in sorted(told.collect(), key=lambda r: (r.at_ms, r.state != "live")):
            states.setdefault(r.run, []).append(r.state)
        assert states.pop("z")[0] == "live"
        assert states == {"p": ["live", "expired", "live"], "q": ["live", "finished"], "c": ["live"], "w": ["live", "finished"]}
        assert {r.run: r.state for r in live_runs.latest(told).collect()}["p"] == "live"


def test_runs_of_a_bucket_are_reaped_apart(spark, tmp_path):
    r = random.Random(10)
    beats = sorted(((r.randint(0, 3_000), f"r{r.randint(0, 60)}", r.choice(["pending", "cleaning", "uploading", "finished"]), r.randint(0, 1)) for _ in range(600)), key=lambda b: b[0])
    beats = list({(at, run): (at, run, *rest) for at, run, *rest in beats}.values())
    quarters = [[b for b in beats if b[0] // 750 == k] for k in range(4)] + [[(3_001, "z", "cleaning", 0)]]
    want, now = [], quarters[-1][0][0] * 1000
    for run, own in itertools.groupby(sorted(itertools.chain(*quarters), key=lambda b: (b[1], b[0])), key=lambda b: b[1]):
        told, gone, phase = "", None, ""
        for at, _, new, looking in [*own, (None,) * 4]:
            if gone is not None and gone <= (now if at is None else at * 1000):
                told = "expired" if phase == "pending" else "abandoned"
                want.append((run, told, gone))
            if at is None:
                break
            phase, state = new, "finished" if new == "finished" else "live"
            want += [(run, state, at * 1000)] if state != told else []
            told = state
            waits = [] if phase in ("finished", "cleaning") else [120_000] * (phase == "pending") + [300_000] * (looking == 0)
            gone = at * 1000 + min(waits) + 1 if waits else None
    schema = "run string, ts timestamp, phase string, subscribers long"
    for k, rows in enumerate(quarters):
        frame = spark.createDataFrame(rows, "at long, run string, phase string, subscribers long").selectExpr("run", "timestamp_seconds(at) AS ts", "phase", "subscribers")
        frame.coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        changes = live_runs.changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), buckets=3)
        told = uploads.finished(changes, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert spark.read.format("statestore").option("stateVarName", "runs").load(str(tmp_path / "cp")).count() <= 3
    assert sorted(map(tuple, told.collect())) == sorted(want)


def test_runs_that_fell_silent_early_are_told(spark, tmp_path):
    rows = [(n, f"2024-01-{1 + n % 4 * 7 + n // 200:02d} {n % 24:02d}:00:00", n % 40) for n in range(800)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    frame.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(streams.SQL["stream_liveness"]).fetchall())
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    assert sorted(map(tuple, streams.stream_liveness(spark, str(tmp_path)).select("run", "state").collect())) == want
    assert len(want) == 40 and spark.conf.get(idle) == before


def test_shapes_do_not_count_positions_again(spark):
    _, shapes = summaries.summary(spark.createDataFrame([("https://e.com/a/b",)], "loc string"))
    assert "posexplode" not in shapes._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_summaries_of_any_split_give_one_table(spark, parts):
    rows = spark.range(600).select("id", F.concat(F.lit("https://e.com/"), F.when(F.col("id") % 4 == 0, "a").otherwise("b"), F.lit("/"), (F.col("id") % 130).cast("string"), F.when(F.col("id") % 3 == 0, "/x").otherwise("")).alias("loc"))
    rows = rows.unionByName(spark.createDataFrame([(-1, "junk"), (-2, None), (-3, "https://e.com")], "id long, loc string"))
    whole = summaries.table(*summaries.summary(rows)).orderBy("template").collect()
    assert [(r.template, r.urls) for r in whole] == [("/", 1), ("/a/{param}", 100), ("/a/{param}/x", 50), ("/b/{param}", 300), ("/b/{param}/x", 150)]
    made = [summaries.summary(rows.where(F.pmod("id", F.lit(parts)) == k)) for k in range(parts)]
    positions, shapes = made[0]
    for p, s in made[1:]:
        positions, shapes = positions.unionByName(p), shapes.unionByName(s)
    assert summaries.table(summaries.merged_positions(positions), shapes).orderBy("template").collect() == whole
    assert all(len(r.samples) == min(5, len(set(r.samples))) for r in whole)
