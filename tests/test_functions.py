import pytest
from pyspark.sql import functions as F

from locweave.functions import rules, templates, urls


def values(spark, column, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, u string")
    return [r[0] for r in frame.orderBy("i").select(column).collect()]


def test_dedup_key(spark):
    got = values(spark, urls.dedup_key(F.col("u")), "HTTPS://Example.com/A/b/?q=1#x", "https://example.com", "https://example.com/", "https://e.com/a//", " Junk ", "https://e.com/a:80/b")
    assert got == ["https://example.com/A/b", "https://example.com/", "https://example.com/", "https://e.com/a/", "junk", "https://e.com/a:80/b"]


def test_same_domain(spark):
    rows = [("example.com", "example.com", True), ("shop.example.com", "example.com", True), ("notexample.com", "example.com", False), ("example.com.au", "example.com", False)]
    frame = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r.got == r.want for r in frame.select("want", urls.same_domain(F.col("a"), F.col("b")).alias("got")).collect())


def test_slashes(spark):
    texts = ["https://e.com/a", "https://e.com/a?x=1", "https://e.com/a#f", "https://e.com/a.html", "https://e.com/", "https://e.com", "https://e.com/a/", "junk"]
    assert values(spark, urls.add_slash(F.col("u")), *texts) == ["https://e.com/a/", "https://e.com/a/?x=1", "https://e.com/a/#f", None, None, None, None, None]
    assert values(spark, urls.strip_slash(urls.add_slash(F.col("u"))), *texts[:3]) == texts[:3]
    assert values(spark, urls.add_path_slash(F.col("u")), "/a?x=1", "/a/", "/") == ["/a/?x=1", None, None]
    assert values(spark, urls.strip_path_slash(F.col("u")), "/a/?x=1", "/a", "/") == ["/a?x=1", None, None]


def test_not_found_urls(spark):
    texts = ["https://e.com/rfq?ref=part-not-found&n=1", "https://e.com/404", "https://e.com/1404x", "https://e.com/page%20not%20found", "https://e.com/no_results", "https://e.com/a"]
    assert values(spark, urls.looks_not_found(F.col("u")), *texts) == [True, True, False, True, True, False]


def test_template_rewrite(spark):
    texts = ["https://e.com/a/1/b/2?q=1#f", "https://e.com/a/1/b/2/", "https://e.com/a/1/c/2", "https://e.com/a/1/b"]
    got = values(spark, templates.rewrite_template(F.col("u"), "/a/{param}/b/{param}", "/x/{param}/{param}"), *texts)
    assert got == ["https://e.com/x/1/2?q=1#f", "https://e.com/x/1/2/", None, None]
    with pytest.raises(ValueError):
        templates.rewrite_template(F.col("u"), "/a/{param}", "/a")


def test_structures(spark):
    current = templates.parse_structure("/shop/{A}/{B}")
    new = templates.parse_structure("/s/{B|old|new|}/{A|upper|}/")
    templates.check_structures("/shop/{param}/{param}", current, new)
    texts = ["https://e.com/shop/ab/old-x?q", "https://e.com/other/ab/x", "https://e.com/shop/ab"]
    assert values(spark, templates.transform_structure(F.col("u"), current, new), *texts) == ["https://e.com/s/new-x/AB/?q", None, None]
    same = templates.parse_structure("/shop/{A}/{B}")
    assert values(spark, templates.transform_structure(F.col("u"), current, same), texts[0]) == [None]
    for bad in ("/{1}", "/a{B}", "/{A||}", "/{A|x}", "/{A||y|}", "/{}"):
        with pytest.raises(templates.StructureError):
            templates.parse_structure(bad)
    with pytest.raises(templates.StructureError):
        templates.check_structures("/shop/{param}/{param}", current, templates.parse_structure("/{A}"))


def test_structure_problems_are_those_of_the_checks(spark):
    patterns = ["/shop/{param}", "/{param}/{param}/", "/about", "", None]
    structures = ["/shop/{A}", "{A}/{B|x|}/", "/{B|upper|}/{A|a|b|}", "/{A|a||}", "/{A}/{A}", "/", "", "//", "/a//b", "/a{B}", "/{1}", "/{}", "/{", "/{A||}", "/{A|x}", "/{A||y|}", "/{A|{|}", " /x/{A} ", None]

    def fault(pattern, current, new):
        if None in (pattern, current, new):
            return None
        read = []
        for text, kind in ((current, "current_unreadable"), (new, "new_unreadable")):
            try:
                read.append(templates.parse_structure(text))
            except templates.StructureError:
                return kind
        try:
            templates.check_structures(pattern, *read)
        except templates.StructureError as said:
            return {"number": "other_count", "twice": "named_twice", "unknown": "unknown", "drops": "dropped"}[next(w for w in ("number", "twice", "unknown", "drops") if w in str(said))]
        return "ok"

    jobs = [(p, c, n) for p in patterns for c in structures for n in structures]
    frame = spark.createDataFrame(jobs, "p string, c string, n string").withColumn("problem", templates.structure_problem(F.col("p"), F.col("c"), F.col("n")))
    wrong = [(r, fault(r.p, r.c, r.n)) for r in frame.collect() if r.problem != fault(r.p, r.c, r.n)]
    assert not wrong, wrong[:5]


def test_redirect_rules(spark):
    rows = [
        ("https://e.com/a-parts-catalog/1", "https://e.com/a/1", "-parts-catalog", ""),
        ("https://e.com/a/1", "https://e.com/en/a/1", "", "en/"),
        ("https://e.com/a", "https://e.com/a", None, None),
    ]
    frame = spark.createDataFrame(rows, "s string, d string, find string, put string").withColumn("r", rules.diff_rule(F.col("s"), F.col("d")))
    for r in frame.withColumn("again", rules.apply_rule(F.col("s"), F.col("r"))).collect():
        if r.find is None:
            assert r.r is None
        else:
            assert r.again == r.d
            assert len(r.r.find) == len(r.find) and len(r.r.put) == len(r.put)


def test_small_rules(spark):
    assert values(spark, rules.request_error(F.col("u")), "self-signed certificate", "connect timeout", "ECONNREFUSED") == ["ssl_cert", "timeout", "no_response"]
    assert values(spark, rules.xml_unescape(rules.xml_escape(F.col("u"))), "a&b<c>\"d\" &amp;") == ["a&b<c>\"d\" &amp;"]
    assert values(spark, rules.find_replace(F.col("u"), "A.b", "$1\\", True), "xa.Bx aXb") == ["x$1\\x aXb"]
    assert values(spark, rules.safe_name(F.col("u")), " My Shop! ") == ["my-shop"]
    assert values(spark, F.size(rules.working_days(F.lit("2024-01-05").cast("date"), F.lit("2024-01-09").cast("date"))), "x") == [3]
    assert values(spark, templates.letters_for_params(F.col("u")), "/a/{param}/b/{param}") == ["/a/{A}/b/{B}"]
