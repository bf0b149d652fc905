import hashlib
import re

from pyspark.sql import functions as F

from locweave.llm import exact_dedup

SCHEMA = "doc_id long, text string, body string, id long"


def groups(spark, rows, **more):
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    return exact_dedup.exact_groups(frame, **more).collect()


def test_equal_but_for_white_space(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b\n"), (4, "abc"), (5, None), (6, ""), (7, " \t"), (8, "a b"), (9, "a b\n ")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in groups(spark, rows)}
    assert got[1] == got[2] == (3, 4, False) or got[3] == (3, 4, True)
    assert got[3] == (3, 4, True) and got[9] == (3, 4, False)
    assert got[4] == (4, 1, True) and got[8] == (8, 1, True)
    assert got[5] == (7, 3, False) and got[6] == (7, 3, False) and got[7] == (7, 3, True)


def test_ties_repeats_and_nulls(spark):
    rows = [(5, "same"), (3, "same"), (None, "same"), (3, "same")]
    got = groups(spark, rows)
    assert {r.keep_id for r in got} == {3} and {r.group_size for r in got} == {4}
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, False), (3, True), (3, True), (5, False)]


def test_empty_table_and_long_texts(spark):
    assert groups(spark, []) == []
    long = "ab " * 200_000
    got = {r.doc_id: r.group_size for r in groups(spark, [(1, long), (2, long + " "), (3, long + "c")])}
    assert got == {1: 2, 2: 2, 3: 1}


def test_same_length_and_prefix(spark):
    rows = [(i, "p" * 100 + str(i % 10)) for i in range(40)]
    assert {r.group_size for r in groups(spark, rows)} == {4}
    got = groups(spark, rows + [(99, "single")], digest_all=True)
    norm = dict(rows + [(99, "single")])
    assert all(bytes(r.full_hash).hex() == hashlib.sha256(re.sub("[ \t-\r]", "", norm[r.doc_id]).encode()).hexdigest() for r in got)


def test_large_group_is_not_expanded(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot copy").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.exact_groups(frame).groupBy("group_size").count().collect()
    assert {(r.group_size, r["count"]) for r in got} == {(6667, 6667), (1, 13333)}
