import gzip
import io
import zipfile

from pyspark.sql import functions as F

from locweave.sources import readers, writers
from locweave.streaming import progress, windows


def test_scan_xml_cases():
    good = b'<?xml version="1.0"?><urlset xmlns:i="x"><url><loc> https://e.com/a </loc></url><url><i:loc><![CDATA[https://e.com/b?x=1&y=2]]></i:loc></url><url><loc></loc></url></urlset>'
    got = readers.scan_xml(good)
    assert got["is_valid"] and got["locs"] == ["https://e.com/a", "https://e.com/b?x=1&y=2"]
    broken = readers.scan_xml(b"<urlset><url><loc>https://e.com/a</loc></url><url><loc>https://e.com/b</url></urlset>")
    assert not broken["is_valid"] and broken["locs"] == ["https://e.com/a"] and broken["error_offset"]
    junk = readers.scan_xml(b"Warning: something\n<urlset><url><loc>https://e.com/a&amp;b</loc></url></urlset>")
    assert junk["had_preamble"] and junk["is_valid"] and junk["locs"] == ["https://e.com/a&b"]
    assert readers.scan_xml(b"")["is_valid"] is False
    assert readers.scan_xml(gzip.compress(good))["locs"] == got["locs"]
    assert readers.scan_xml(b"\x1f\x8bxx")["is_valid"] is False


def test_files_in_order(spark, tmp_path):
    (tmp_path / "b.xml").write_text("<urlset><url><loc>https://e.com/1</loc></url><url><loc>https://e.com/2</loc></url></urlset>")
    (tmp_path / "a.xml.gz").write_bytes(gzip.compress(b"<sitemapindex><sitemap><loc>https://e.com/c.xml</loc></sitemap><sitemap><loc>https://e.com/c.xml</loc></sitemap></sitemapindex>"))
    (tmp_path / "notes.txt").write_text("x")
    scanned = readers.scan_files(spark, str(tmp_path))
    assert {r.source_file: (r.is_index, r.total_urls) for r in readers.file_facts(scanned).collect()} == {"b.xml": (False, 2), "a.xml.gz": (True, 2)}
    locs = [(r.file_idx, r.loc_idx, r.loc) for r in readers.ordered_locs(scanned).orderBy("loc_idx").collect()]
    assert locs == [(1, 0, "https://e.com/1"), (1, 1, "https://e.com/2")]
    assert [(r.child, r.position) for r in readers.index_children(scanned).collect()] == [("https://e.com/c.xml", 0)]


def test_round_trip_of_documents(spark, tmp_path):
    locs = spark.createDataFrame([("f.xml", 1, "https://e.com/b?x=1&y=\"2\""), ("f.xml", 0, "https://e.com/a")], "source_file string, loc_idx long, loc string")
    xml = writers.sitemap_documents(locs, F.lit("2024-02-03").cast("date")).first().xml
    assert readers.scan_xml(xml.encode())["locs"] == ["https://e.com/a", "https://e.com/b?x=1&y=\"2\""]
    index = writers.index_document(spark.createDataFrame([(0, "f.xml")], "file_idx long, source_file string"), "https://e.com/", "maps", F.lit("2024-02-03").cast("date"))
    assert readers.scan_xml(index.first().xml.encode())["locs"] == ["https://e.com/maps/f.xml"]
    assert index.select(writers.index_folder(F.col("xml"))).first()[0] == "/maps/"


def test_lists(spark):
    one = lambda text: spark.createDataFrame([(text,)], "value string")
    assert [r.url for r in readers.list_lines(one("# no\n https://e.com/a \n\nhttps://e.com/b")).collect()] == ["https://e.com/a", "https://e.com/b"]
    assert [tuple(r) for r in readers.tsv_sites(one("https://e.com\tDA 45\t3%\n\nb.com")).collect()] == [("https://e.com", 45.0, 3.0), ("b.com", None, None)]
    assert [r.sitemap for r in readers.robots_sitemaps(one("Sitemap: https://e.com/s.xml")).collect()] == ["https://e.com/s.xml"]
    assert one("  <!DOCTYPE html><html>").select(readers.is_tag_soup(F.col("value"))).first()[0]


def test_csv_headers(spark, tmp_path):
    (tmp_path / "x.csv").write_text(" URL ,N\nhttps://e.com,1\n,2\n")
    assert [tuple(r) for r in readers.csv_urls(spark, str(tmp_path / "x.csv")).collect()] == [("https://e.com", "1")]


def test_stream_of_progress_equals_the_fold(spark, tmp_path):
    rows = [("r", i, f"2024-01-01 00:00:{i:02d}", "classify" if i < 20 else "clean", i * 5, 200) for i in range(40)]
    frames = spark.createDataFrame(rows, "run string, seq long, ts string, stage string, current int, total int").withColumn("ts", F.col("ts").cast("timestamp"))
    frames.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    live = windows.run_to_table(progress.live_progress(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = [tuple(r) for r in progress.fold(frames).orderBy("seq").collect()]
    assert [tuple(r) for r in live.orderBy("seq").collect()] == want
    percents = [w[2] for w in want]
    assert percents == sorted(percents)


def test_files_of_one_name_are_two_files(spark, tmp_path):
    for folder, k in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "s.xml").write_text(f"<urlset><url><loc>https://e.com/{k}</loc></url></urlset>")
    locs = readers.ordered_locs(readers.scan_files(spark, str(tmp_path))).collect()
    assert sorted((r.file_idx, r.loc_idx, r.loc) for r in locs) == [(0, 0, "https://e.com/1"), (1, 0, "https://e.com/2")]


def test_zip_entries_and_sessions_names(spark, tmp_path):
    xml = "<urlset><url><loc>https://e.com/1</loc></url></urlset>"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for name in ("in/a.xml", "in/.hidden.xml", "__MACOSX/in/a.xml", "b.txt", "c.xml.gz"):
            z.writestr(name, gzip.compress(xml.encode()) if name.endswith("gz") else xml)
    (tmp_path / "d.xml.gz").write_bytes(gzip.compress(xml.encode()))
    got = readers.zip_entries(spark, str(tmp_path)).collect()
    assert sorted((r.source_file, r.locs) for r in got) == [("a.xml", ["https://e.com/1"]), ("c.xml.gz", ["https://e.com/1"])]
    assert readers.scan_files(spark, str(tmp_path), readers.SESSION_NAMES).count() == 0


def test_broken_zip_files_and_entries_are_rows_with_errors(spark):
    xml = "<urlset>" + "".join(f"<url><loc>https://e.com/{k}</loc></url>" for k in range(5)) + "</urlset>"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.xml", xml)
        z.writestr("b.xml", xml)
    whole = held.getvalue()
    spoilt = whole.replace(b"e.com/4", b"e.com/5", 1)  # the first entry no longer has its checksum
    unknown = bytearray(whole)
    for sign, at in ((b"PK\x03\x04", 8), (b"PK\x01\x02", 10)):
        unknown[whole.index(sign) + at] = 99  # a method that nothing unpacks
    files = [("1.zip", whole), ("2.zip", spoilt), ("3.zip", whole[:-30]), ("4.zip", bytes(unknown)), ("5.zip", b""), ("6.zip", None), (None, whole)]
    rows = readers.entries_of(spark.createDataFrame(files, "path string, content binary")).collect()
    got = {r.path: (r.source_file, r.is_valid, len(r.locs), r.error is None) for r in rows}
    assert got["1.zip!/a.xml"] == ("a.xml", True, 5, True) == got["!/a.xml"]
    assert got["2.zip!/a.xml"][1:] == (False, got["2.zip!/a.xml"][2], False) and got["2.zip!/b.xml"][1]
    assert got["3.zip"] == ("3.zip", False, 0, False) and got["5.zip"] == ("5.zip", False, 0, False)
    assert got["4.zip!/a.xml"] == ("a.xml", False, 0, False) and got["4.zip!/b.xml"][1:] == (True, 5, True)
    assert len(rows) == len(got) == 10
    empty = spark.createDataFrame([], "path string, content binary")
    assert readers.entries_of(empty).count() == 0


def test_cut_gzip_keeps_what_came_before(spark):
    locs = [f"https://e.com/{k}/{hash(str(k))}" for k in range(20_000)]
    packed = gzip.compress(("<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>").encode())
    got = readers.scan_xml(packed[: len(packed) // 2])
    assert not got["is_valid"] and 0 <= len(got["locs"]) < len(locs) and got["locs"] == locs[: len(got["locs"])]


def test_tree_follows_indexes_to_a_depth(spark):
    rows = [(f"p/{n}", n, r, x) for n, r, x in [("i0.xml", "sitemapindex", ["h/i1.xml", "h/s0.xml"]), ("i1.xml", "sitemapindex", ["h/i2.xml", "h/i0.xml"]), ("i2.xml", "sitemapindex", ["h/s2.xml"]), ("s0.xml", "urlset", ["u1", "u2"]), ("s2.xml", "urlset", ["u2", "u3"])]]
    scanned = spark.createDataFrame(rows, "path string, source_file string, root string, locs array<string>")
    tree = lambda **k: [(r.loc, r.level) for r in readers.tree_locs(scanned, "i0.xml", **k).collect()]
    assert tree() == [("u1", 1), ("u2", 1), ("u3", 3)] and tree(depth=2) == [("u1", 1), ("u2", 1)] and tree(most=1) == [("u1", 1)]
