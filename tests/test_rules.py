"""Rules with literal cases: names, freshness, remarks, exports, scopes, nulls included."""

import pytest
from pyspark.sql import functions as F

from locweave.operators import exports, mismatches, ordering, workflow
from locweave.sources import readers

ID = "0a1b2c3d-0000-4000-8000-0123456789ab"


@pytest.mark.parametrize("stored, edited, shown, download", [
    ("s1-current-a.xml", False, "current-a.xml", "a.xml"),
    ("s1-fixed-0a1b2c3d-current-a.xml", True, "current-a.xml", "a.xml"),
    ("s1-renamed-ff-legacy-a.xml", True, "legacy-a.xml", "a.xml"),
    ("s1-bulk-0-a-fixed-b.xml", True, "a-fixed-b.xml", "a-fixed-b.xml"),
    ("s1-transformed-1-a.xml", True, "a.xml", "a.xml"), ("s1-deleted-1-a.xml", True, "a.xml", "a.xml"), ("s1-slashed-1-a.xml", True, "a.xml", "a.xml"),
    (f"s1-{ID}-a.xml", False, "a.xml", "a.xml"), (f"s1-fetched-1700000000-{ID}-a.xml", False, "a.xml", "a.xml"), (f"s1-slashed-a1-{ID}-fetched-17-{ID}-a.xml", True, "a.xml", "a.xml"),
    ("s2-fixed-1-a.xml", False, "s2-fixed-1-a.xml", "s2-fixed-1-a.xml"), ("s1-edited-1-a.xml", False, "edited-1-a.xml", "edited-1-a.xml"), ("s1-a-fixed-1-b.xml", False, "a-fixed-1-b.xml", "a-fixed-1-b.xml"),
    (None, False, None, None),
])
def test_stored_names(spark, stored, edited, shown, download):
    row = spark.createDataFrame([(stored, "s1")], "n string, s string").select(
        workflow.is_edited(F.col("n"), F.col("s")), exports.display_name(F.col("n"), F.col("s")), exports.download_name(F.col("n"), F.col("s"))
    )
    assert tuple(row.first()) == (edited, shown, download)


def test_freshness(spark):
    rows = spark.createDataFrame([(None, None), (5, None), (None, 5), (5, 5), (6, 5), (4, 5)], "g int, c int")
    assert [r[0] for r in rows.select(workflow.is_fresh(F.col("g"), F.col("c"))).collect()] == [True, True, False, False, True, False]


def test_eta(spark):
    rows = spark.createDataFrame([(0.0,), (0.4,), (1.5,), (59.4,), (60.0,), (89.9,), (90.0,), (3600.0,)], "s double")
    assert [r[0] for r in rows.select(exports.eta(F.col("s"))).collect()] == ["1 sec", "1 sec", "2 sec", "59 sec", "1 min", "1 min", "2 min", "60 min"]


@pytest.mark.parametrize("template, segment, urls, place", [
    ("/m/{param}/{param}/", "old", ["https://e.com/m/a/x-old-y/"], 1), ("/m/{param}", "old", ["junk", None, "https://e.com/m/older"], 0), ("/m/{param}", "m", ["https://e.com/m/a"], None),
    ("/m/{param}", "old", [], None), ("/m/{param}/{param}", "o", ["https://e.com/m/a/b", "https://e.com/m/a/o", "https://e.com/m/o/b"], 1), ("/m", "m", ["https://e.com/m"], None),
])
def test_suspicious_position(spark, template, segment, urls, place):
    row = spark.createDataFrame([(template, segment, urls)], "t string, s string, u array<string>")
    assert row.select(exports.suspicious_position(F.col("t"), F.col("s"), F.col("u"))).first()[0] == place


def test_tones(spark):
    texts = ["Soft-404 redirect", "no matching redirect", "did not pass", "Redirects", "a migration artifact", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "m string").select(exports.tone(F.col("m")))
    assert [r[0] for r in rows.collect()] == ["orange", "red", "red", "amber", "amber", "indigo"]


def test_backlinks_by_source_and_target(spark):
    held = spark.createDataFrame([("a", "t", "pending"), ("b", "t", "rejected"), ("c", None, "approved"), ("r", "t", "approved")], "source string, target string, status string")
    sources = spark.createDataFrame([("a", False), ("b", None), ("c", False), ("r", True)], "source string, reusable boolean")
    sent = spark.createDataFrame([("u1", "a", "t", 1), ("u2", "a", "other", 1), ("u3", "b", "t", 1), ("u4", "b", "t", 1), ("u5", "c", None, 1), ("u6", "r", "t", 1), ("u7", "r", "t", 1), ("u8", "x", "t", 1), (" ", "a", "q", 1), ("u9", None, "q", 1)], "url string, source string, target string, user_id long")
    got = {r.url: r.outcome for r in workflow.new_backlinks(held, sent, sources).collect()}
    assert got == {"u1": "taken", "u2": "accepted", "u3": "accepted", "u4": "taken", "u5": "taken", "u6": "accepted", "u7": "accepted", "u8": "unknown source", " ": "incomplete", "u9": "incomplete"}


def test_impact_passes_over_what_is_not_downloaded(spark):
    rows = [(1, "s-current-a.xml", "current", False, False, 10, 3), (2, "s-b.xml", "legacy", False, False, 10, 3), (3, "s-c.xml", "current", True, False, 10, 3), (4, "s-d.xml", "current", False, True, 10, 3),
            (5, "https://e.com/e.xml", "current", False, False, 10, 3), (6, "s-fixed-1-f.xml", "current", False, False, 4, 4), (7, "s-g.xml", "current", False, False, None, 2), (8, "s-h.xml", "current", False, False, 5, None)]
    files = spark.createDataFrame([(i, "s", *r) for i, *r in rows], "file_id long, session_id string, stored_name string, source_role string, deleted boolean, is_index boolean, total_urls int, mismatched_url_count int")
    got = [tuple(r) for r in mismatches.impact(files).collect()]
    assert got == [(6, "f.xml", 4, 4, False, True), (1, "a.xml", 10, 3, True, False), (7, "g.xml", 0, 2, False, False)]
    assert [r.file_id for r in mismatches.impact(files, edited_only=True).collect()] == [6]
    assert tuple(mismatches.impact_totals(mismatches.impact(files.limit(0))).first()) == (False, 0, 0, False)


def test_places_of_a_whole_order(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 3 == 0).alias("a"), F.lit("x").alias("__of"))
    got = ordering.placed(rows, [F.col("a").desc(), F.col("id").asc()]).orderBy("place").collect()
    assert [r.id for r in got] == [i for i in range(5000) if i % 3 == 0] + [i for i in range(5000) if i % 3]
    assert [r.place for r in got] == list(range(1, 5001))
    alike = ordering.placed(rows, [F.col("__of")], first=0)
    assert sorted(r.place for r in alike.collect()) == list(range(5000))
    assert ordering.placed(rows.limit(0), [F.col("id")]).count() == 0


def test_usual_places():
    assert len(readers.FALLBACK_PATHS) == 10 and "/news-sitemap.xml" in readers.FALLBACK_PATHS and "/sitemap.txt" not in readers.FALLBACK_PATHS
