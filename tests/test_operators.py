import random

import pytest
from pyspark.sql import functions as F

from locweave.operators import clean_job, cleaning, patterns, reports, rewriting, scoring
from locweave.sources import readers


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


LOCS = "file_idx long, source_file string, loc_idx long, loc string"
CORPUS = [
    (0, "a", 0, "https://e.com/x"), (0, "a", 1, "https://e.com/dup"), (1, "b", 0, "https://e.com/dup/"), (1, "b", 1, "https://e.com/y"),
    (2, "c", 0, "https://e.com/dup"), (2, "c", 1, "https://e.com/z"), (2, "c", 2, "https://e.com/z"), (3, "d", 0, "https://e.com/x"),
]


@pytest.mark.parametrize("seed", range(3))
def test_first_wins_whatever_the_order_of_arrival(spark, seed):
    rows = CORPUS[:]
    random.Random(seed).shuffle(rows)
    locs = frame(spark, rows, LOCS).repartition(1 + 3 * seed)
    kept = sorted((r.source_file, r.loc) for r in cleaning.first_wins(locs).collect())
    assert kept == [("a", "https://e.com/dup"), ("a", "https://e.com/x"), ("b", "https://e.com/y"), ("c", "https://e.com/z")]
    again = [(r.url, r.kept_in, r.duplicate_in) for r in cleaning.duplicates(locs).orderBy("file_idx", "loc_idx").collect()]
    assert again == [("https://e.com/dup/", "a", "b"), ("https://e.com/dup", "a", "c"), ("https://e.com/z", "c", "c"), ("https://e.com/x", "a", "d")]


def test_clean_drops_empty_and_foreign_files(spark):
    locs = frame(spark, CORPUS, LOCS)
    files = cleaning.file_totals(locs, "www.e.com").withColumns({"is_valid": F.lit(True), "root_element": F.lit("urlset")})
    _, report, result = cleaning.clean(locs, files)
    assert {r.source_file: r.decision for r in result.collect()} == {"a": "candidate", "b": "candidate", "c": "candidate", "d": "empty"}
    one = cleaning.summary(result, report).first()
    assert (one.files_kept, one.files_dropped, one.duplicates_removed, one.total_urls_kept_files, one.clean_urls_remaining) == (3, 1, 4, 7, 4)
    foreign = cleaning.file_totals(locs, "other.com").withColumns({"is_valid": F.lit(True), "root_element": F.lit("urlset")})
    assert {r.decision for r in cleaning.select_files(foreign).collect()} == {"wrong_domain"}


def test_output_names(spark):
    rows = [(0, "a.xml"), (1, "a.xml"), (2, "a-2.xml"), (3, "a.xml"), (4, "b.xml.gz"), (5, "b.xml.gz")]
    got = cleaning.output_names(frame(spark, rows, "file_idx int, filename string")).orderBy("file_idx").collect()
    names = [r.output_name for r in got]
    assert names == ["a.xml", "a-3.xml", "a-2.xml", "a-4.xml", "b.xml.gz", "b-2.xml.gz"]


def test_output_names_pass_taken_numbers_without_one_task(spark):
    r = random.Random(4)
    rows = [(k, r.choice(["a.xml", "a.xml", "b.xml.gz", "c"])) for k in range(60)] + [(60 + k, f"a-{n}.xml") for k, n in enumerate([0, 1, 2, 3, 7, 8, 20, 40, 2])] + [(90, "b-3.xml.gz"), (91, "a-99999999999.xml"), (92, None), (93, None)]
    files = frame(spark, rows, "file_idx int, filename string")
    taken = {n for _, n in rows}
    want, free = {}, {}
    for k, name in rows:
        if name is None or name not in free:
            want[k], free[name] = name, 2
            continue
        stem, dot, ending = name.partition(".xml")
        while dot and f"{stem}-{free[name]}.xml{ending}" in taken:
            free[name] += 1
        want[k] = f"{stem}-{free[name]}{dot}{ending}"
        free[name] += 1
    got = cleaning.output_names(files)
    assert {r.file_idx: r.output_name for r in got.collect()} == want
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_batches(spark):
    attempts = frame(spark, [("r", 0, 1, "x"), ("r", 0, 2, "y"), ("r", 2, 1, "z")], "run_id string, batch int, attempt int, file string")
    assert sorted(r.file for r in cleaning.latest_batches(attempts).collect()) == ["y", "z"]
    missing = cleaning.missing_batches(attempts, frame(spark, [("r", 4)], "run_id string, total_batches int"))
    assert sorted(r.batch for r in missing.collect()) == [1, 3]


def online(paths):
    seen, values, flags = {}, {}, {}
    for segs in paths:
        for i, s in enumerate(segs):
            seen[i] = seen.get(i, 0) + 1
            values.setdefault(i, set()).add(s)
            d = len(values[i])
            flags[i] = flags.get(i, False) or d > 100 or (seen[i] >= 3 and d >= 0.6 * seen[i])
    return flags


@pytest.mark.parametrize("seed", range(4))
def test_online_positions(spark, seed, monkeypatch):
    monkeypatch.setattr(patterns, "BLOCK", 7)
    r = random.Random(seed)
    paths = [["s%d" % r.choice((0, 0, 0, 1)), "p%d" % r.randrange(1 + 30 * (seed % 2)), *(["q"] if r.random() < 0.5 else [])] for _ in range(60)]
    facts = frame(spark, list(enumerate(paths)), "seq long, segs array<string>").repartition(5)
    assert {x.pos: x.parameter for x in patterns.online_positions(facts).collect()} == online(paths)


def test_capped_weights_and_occurrences(spark):
    rows = [(0, "a", i, f"https://e.com/p/{i}") for i in range(12)] + [(1, "b", i, f"https://e.com/p/x{i}") for i in range(3)]
    locs = frame(spark, rows, LOCS)
    kept = patterns.capped(locs, cap=5)
    assert kept.count() == 8
    totals = patterns.pattern_totals(kept.withColumn("template", F.lit("/p/{param}")))
    assert totals.first().total_urls == 15
    occ = patterns.file_occurrences(kept.withColumn("template", F.lit("/p/{param}")), totals)
    assert {r.source_file: r.occurrences for r in occ.collect()} == {"a": 12, "b": 3}


def test_rewrites_and_undo(spark):
    rows = frame(spark, [("https://e.com/a",), ("https://e.com/a/",)], "loc string")
    once = rewriting.rewrite(rows, {"kind": "trailing_slash"})
    twice = rewriting.rewrite(once, {"kind": "find_replace", "find": "/A/", "put": "/b/", "ignore_case": True})
    assert {r.loc for r in twice.collect()} == {"https://e.com/b/"}
    assert sorted(r.loc for r in rewriting.undo(twice).collect()) == ["https://e.com/a", "https://e.com/a/"]


def test_rules_need_agreement(spark):
    pairs = [(1, "https://e.com/a/x", "https://e.com/x"), (1, "https://e.com/a/y", "https://e.com/y"), (2, "https://e.com/p", "https://e.com/q"), (2, "https://e.com/p1", "https://e.com/z1")]
    got = {r.pattern_id: r.rule.find for r in scoring.redirect_rules(frame(spark, pairs, "pattern_id int, source string, dest string")).collect()}
    assert list(got) == [1] and len(got[1]) == 2


def test_delete_is_by_file_or_everywhere(spark):
    locs = frame(spark, [("f", "u"), ("g", "u"), ("f", "v")], "source_file string, loc string")
    targets = frame(spark, [("u", ["f"]), ("v", None)], "url string, files array<string>")
    assert [(r.source_file, r.loc) for r in rewriting.delete_urls(locs, targets).collect()] == [("g", "u")]


def test_delete_of_one_place_leaves_others_of_its_url(spark):
    locs = frame(spark, [(1, "f", "u"), (2, "f", "u"), (3, "g", "u"), (4, "g", None), (5, "f", None)], "seq long, source_file string, loc string")
    targets = frame(spark, [(1, "u", None), (3, "u", ["f"]), (4, None, None)], "seq long, url string, files array<string>")
    assert sorted(r.seq for r in rewriting.delete_urls(locs, targets, place="seq").collect()) == [2, 3, 5]


def test_scopes_by_group_equal_those_by_arrays(spark):
    users = frame(spark, [(1, "sub-lead"), (2, "sub-lead"), (3, "admin"), (4, "super-admin"), (5, "sub-lead"), (6, "admin"), (7, "sub-lead")], "user_id long, role string")
    counts = frame(spark, [(k, 10**k) for k in range(1, 6)] + [(3, 1), (9, 7)], "o long, n long")
    members = {"a": [1, 2, 3, 3], "b": [3, 4], "c": [6]}
    led = [(1, "a"), (1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, "a"), (5, "b"), (7, "c"), (7, None)]
    arrays = frame(spark, [(u, members.get(g)) for u, g in led], "lead_user_id long, member_user_ids array<long>")
    rows = frame(spark, [(g, m) for g, ms in members.items() for m in ms], "group string, member long")
    got = reports.scoped_totals(counts, "o", "n", users, frame(spark, led, "lead_user_id long, group string"), rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, reports.scoped_totals(counts, "o", "n", users, arrays).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_nearest_rank(spark):
    rows = frame(spark, [("k", float(i)) for i in range(1, 21)], "k string, v double")
    assert reports.nearest_rank(rows, "k", "v").first().v == 19.0


def test_whole_cleaning_of_a_folder(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    (source / "more").mkdir(parents=True)
    xml = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    (source / "a.xml").write_text(xml("https://e.com/1", "https://e.com/2/", "https://o.org/x", "https://e.com/1"))
    (source / "b.xml").write_text(xml("https://www.E.com/3", "https://e.com/2"))
    (source / "more" / "b.xml").write_text(xml("https://e.com/3x"))
    (source / "c.xml").write_text(xml("https://o.org/1", "https://o.org/2"))
    (source / "d.xml").write_text(xml("https://e.com/1"))
    (source / "e.xml").write_text("<urlset><url><loc>https://e.com/9</loc></url>")
    (source / "i.xml").write_text("<sitemapindex><sitemap><loc>https://e.com/a.xml</loc></sitemap></sitemapindex>")
    row = clean_job.clean_folder(spark, str(source), str(out), "e.com", lastmod=F.lit("2024-02-03").cast("date")).first()
    assert (row.files_processed, row.files_kept, row.files_dropped, row.index_files_detected) == (6, 3, 3, 1)
    assert (row.clean_urls_remaining, row.duplicates_removed) == (4, 3)
    back = readers.ordered_locs(readers.scan_files(spark, str(out / "sitemaps"), readers.WRITTEN_NAMES))
    assert sorted((r.source_file, r.loc) for r in back.collect()) == [("a.xml", "https://e.com/1"), ("a.xml", "https://e.com/2/"), ("b-2.xml", "https://e.com/3x"), ("b.xml", "https://www.E.com/3")]
    report = spark.read.option("header", True).csv(str(out / "report")).orderBy("file_idx", "loc_idx")
    assert [(r.url, r.kept_in, r.duplicate_in) for r in report.collect()] == [("https://e.com/1", "a.xml", "a.xml"), ("https://e.com/2", "a.xml", "b.xml"), ("https://e.com/1", "a.xml", "d.xml")]
    index = "".join(p.read_text() for p in sorted((out / "index").glob("part-*")))
    assert readers.scan_xml(index.encode())["locs"] == [f"https://e.com/sitemaps/{n}" for n in ("a.xml", "b.xml", "b-2.xml")]


def test_one_viewer_s_scope(spark):
    users = frame(spark, [(1, "super-admin"), (2, "sub-lead"), (3, "admin")], "user_id long, role string")
    groups = frame(spark, [(2, [3, 4])], "lead_user_id long, member_user_ids array<long>")
    rows = frame(spark, [(k, f"r{k}") for k in (1, 2, 3, 4, 5)], "owner long, v string")
    seen = lambda viewer: sorted(r.owner for r in reports.scoped(rows, "owner", viewer, users, groups).collect())
    assert (seen(1), seen(2), seen(3), seen(9)) == ([1, 2, 3, 4, 5], [2, 3, 4], [3], [])
