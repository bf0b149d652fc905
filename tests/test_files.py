"""Files as bytes and as a data source: what is untouched stays, what fails leaves nothing, large ones come back whole."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from locweave.functions import rules
from locweave.sources import datasource, in_place, readers, writers

DOC = b"""<?xml version="1.0"?>\r\n<urlset xmlns="x" xmlns:image="y">\r\n<!-- <loc>in a comment</loc> -->
  <url>\n\t<loc> https://e.com/a?x=1&amp;y=2 </loc><lastmod>2020-01-01</lastmod><image:image><image:loc>https://e.com/a.png</image:loc></image:image></url>
  <url><priority>0.5</priority><loc><![CDATA[https://e.com/b&c]]></loc></url>\n\n  <url><loc>https://e.com/\xc3\xa9</loc></url><url><nothing/></url>
</urlset>\n<!-- end -->"""


def locs_of(content):
    return [in_place.loc_of(t) for k, t in in_place.tokens(in_place.unpacked(content)) if k == "loc"]


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_tokens_join_to_the_document_in_any_pieces(size):
    pieces = [DOC[k : k + size] for k in range(0, len(DOC), size)]
    found = list(in_place.tokens(iter(pieces)))
    assert b"".join(t for _, t in found) == DOC
    assert [in_place.loc_of(t) for k, t in found if k == "loc"] == ["in a comment", "https://e.com/a?x=1&y=2", "https://e.com/b&c", "https://e.com/é"]
    assert [k for k, _ in found if k in ("open", "close")] == ["open", "close"] * 4


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_only_what_is_asked_for_changes(size):
    pieces = lambda: iter([DOC[k : k + size] for k in range(0, len(DOC), size)])
    counts = {}
    same = b"".join(in_place.changed(pieces(), {1: in_place.Change("https://e.com/a?x=1&y=2"), 9: in_place.Change(drop=True)}, counts))
    assert same == DOC and counts == {"kept": 4, "removed": 0, "rewritten": 0}
    new = b"".join(in_place.changed(pieces(), {1: in_place.Change("https://f.com/<&>"), 2: in_place.Change("https://f.com/b&c"), 3: in_place.Change(drop=True)}, counts))
    want = DOC.replace(b" https://e.com/a?x=1&amp;y=2 ", b" https://f.com/&lt;&amp;&gt; ").replace(b"[https://e.com/b&c]", b"[https://f.com/b&c]").replace(b"\n\n  <url><loc>https://e.com/\xc3\xa9</loc></url>", b"")
    assert new == want and counts == {"kept": 3, "removed": 1, "rewritten": 2}


def test_cut_off_and_odd_documents():
    for content in (b"", b"<url", b"<url><loc>https://e.com/a</loc>", b"\xff\xfe<loc>\xff</loc>", b"<loc></loc>", b"   \n " * 1000 + b"<url>"):
        counts = {}
        assert b"".join(in_place.changed(in_place.unpacked(content), {0: in_place.Change(drop=True)}, counts)) == content


def test_files_are_rewritten_by_rules_in_columns(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(DOC)
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(DOC[:300]) + gzip.compress(DOC[300:]))
    (tmp_path / "c.xml").write_bytes(b"<urlset/>")
    (tmp_path / "d.txt").write_bytes(DOC)
    locs = in_place.byte_locs(spark, str(tmp_path))
    assert locs.count() == 8 and locs.where("in_block").count() == 6
    edits = in_place.edits_of(locs, F.when(rules.has(F.col("loc"), "e.com", False), rules.find_replace(F.col("loc"), "e.com", "f.com", False)), F.col("loc").endswith("b&c"))
    got = {os.path.basename(r.path): r for r in in_place.rewrite_files(spark, str(tmp_path), edits).collect()}
    assert sorted(got) == ["a.xml", "b.xml.gz", "c.xml"] and bytes(got["c.xml"].content) == b"<urlset/>"
    want = DOC.replace(b"https://e.com/a?", b"https://f.com/a?").replace(b"\n  <url><priority>0.5</priority><loc><![CDATA[https://e.com/b&c]]></loc></url>", b"").replace(b"https://e.com/\xc3", b"https://f.com/\xc3")
    assert bytes(got["a.xml"].content) == want and gzip.decompress(bytes(got["b.xml.gz"].content)) == want
    assert [(got[n].kept, got[n].removed, got[n].rewritten) for n in sorted(got)] == [(3, 1, 2), (3, 1, 2), (0, 0, 0)]
    none = in_place.rewrite_files(spark, str(tmp_path), edits.limit(0)).collect()
    assert {os.path.basename(r.path): bytes(r.content) for r in none} == {n: (tmp_path / n).read_bytes() for n in got}


def test_documents_of_many_parts_are_files_of_their_own(spark, tmp_path):
    locs = spark.range(25).select(F.lit("a.xml").alias("source_file"), F.col("id").alias("loc_idx"), F.concat(F.lit("https://e.com/"), F.col("id").cast("string")).alias("loc"))
    writers.write_documents(writers.sitemap_documents(locs, F.lit("2024-02-03").cast("date"), 10), str(tmp_path / "out"))
    scanned = readers.scan_files(spark, str(tmp_path / "out"), readers.WRITTEN_NAMES).collect()
    assert len(scanned) == 3 and all(r.is_valid for r in scanned)
    assert [x for r in sorted(scanned, key=lambda r: r.path) for x in r.locs] == [f"https://e.com/{i}" for i in range(25)]


def test_many_small_files_share_tasks():
    files = [(f"f{k}", 100) for k in range(50_000)] + [("large", 1 << 30), ("last", 5)]
    tasks = datasource.shared_out(files)
    assert [p for t in tasks for p in t.paths] == [p for p, _ in files]
    assert 150 < len(tasks) < 400 and ["large"] in [t.paths for t in tasks]
    assert [t.paths for t in datasource.shared_out(files[:9])] == [[f"f{k}"] for k in range(9)] and datasource.shared_out([]) == []


def test_sitemaps_as_a_data_source(spark, tmp_path):
    out = str(tmp_path / "maps")
    n = 200_000
    locs = spark.range(n).select(F.lit("big.xml").alias("source_file"), F.col("id").alias("position"), F.concat(F.lit("https://e.com/?a&b='"), F.col("id").cast("string")).alias("loc"), F.when(F.col("id") % 2 == 0, "2024-02-03").alias("lastmod"))
    datasource.write_sitemaps(locs.orderBy(F.rand(1)), out)
    assert sorted(os.listdir(out)) == ["big-2.xml", "big-3.xml", "big-4.xml", "big.xml"]
    back = spark.read.format("sitemap").load(out)
    assert back.rdd.getNumPartitions() == 4
    assert back.groupBy("source_file").count().select("count").distinct().collect()[0][0] == 50_000
    part = F.coalesce(F.nullif(F.regexp_extract("source_file", "-([0-9])", 1), F.lit("")).cast("int") - 1, F.lit(0))
    told = back.select((part * 50_000 + F.col("position")).alias("position"), "loc", "lastmod")
    assert told.exceptAll(locs.select("position", "loc", "lastmod")).isEmpty() and told.count() == n
    assert all(r.is_valid for r in readers.scan_files(spark, out).select("is_valid").collect())
    datasource.write_sitemaps(locs.limit(3), out, "overwrite", packed=True)
    assert os.listdir(out) == ["big.xml.gz"] and spark.read.format("sitemap").load(out).count() == 3


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "maps")
    rows = spark.range(100).select(F.concat(F.lit("f"), (F.col("id") % 5).cast("string")).alias("source_file"), F.col("id").alias("position"), F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise("https://e.com/").alias("loc"), F.lit(None).cast("string").alias("lastmod"))
    with pytest.raises(Exception, match="no"):
        datasource.write_sitemaps(rows, out)
    assert not os.path.exists(out) or os.listdir(out) == []


def test_broken_and_foreign_files_are_read_as_far_as_they_go(spark, tmp_path):
    (tmp_path / "a.xml").write_bytes(b"junk <urlset xmlns:n='x'><n:url><n:loc> https://e.com/1 </n:loc><image:loc>no</image:loc></n:url><url><lastmod>2020</lastmod><loc>https://e.com/2</loc></url><url><loc>https://e.com/3")
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(b"<sitemapindex><sitemap><loc>https://e.com/x.xml</loc></sitemap></sitemapindex>")[:-6])
    (tmp_path / "_hidden.xml").write_bytes(b"<urlset><url><loc>no</loc></url></urlset>")
    datasource.register(spark)
    got = sorted((r.source_file, r.root, r.position, r.loc, r.lastmod) for r in spark.read.format("sitemap").load(str(tmp_path)).collect())
    assert got == [("a.xml", "urlset", 0, "https://e.com/1", None), ("a.xml", "urlset", 1, "https://e.com/2", "2020"), ("b.xml.gz", "sitemapindex", 0, "https://e.com/x.xml", None)]


def test_random_documents_keep_all_other_bytes():
    r = random.Random(4)
    for _ in range(60):
        blocks, urls = [], []
        for k in range(r.randint(0, 12)):
            u = f"https://e.com/{k}{r.choice(['', '?a=1', '/x'])}"
            urls.append(u)
            blocks.append((r.choice(["\n  ", "", "\t\r\n"]) + "<url>" + r.choice(["", "<x/>"]), u, r.choice(["", "<lastmod>1</lastmod>"]) + "</url>"))
        content = ("<urlset>" + "".join(a + f"<loc>{u}</loc>" + z for a, u, z in blocks) + "\n</urlset>").encode()
        gone = {k for k in range(len(blocks)) if r.random() < 0.3}
        new = {k: f"https://f.com/{k}" for k in range(len(blocks)) if k not in gone and r.random() < 0.4}
        changes = {k: in_place.Change(drop=True) for k in gone} | {k: in_place.Change(t) for k, t in new.items()}
        want = ("<urlset>" + "".join(a + f"<loc>{new.get(k, u)}</loc>" + z for k, (a, u, z) in enumerate(blocks) if k not in gone) + "\n</urlset>").encode()
        size = r.randint(1, 40)
        counts = {}
        assert b"".join(in_place.changed(iter([content[k : k + size] for k in range(0, len(content), size)]), changes, counts)) == want
        assert counts == {"kept": len(blocks) - len(gone), "removed": len(gone), "rewritten": len(new)}
