import hashlib
import random

import pytest
from pyspark.sql import functions as F

from locweave.llm import merkle

from ..oracle import duck, rows_of

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """The root and for each leaf its siblings, level by level."""
    paths, nodes, under = [[] for _ in leaves], list(leaves), [[k] for k in range(len(leaves))]
    while len(nodes) > 1:
        ups, below = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for k in range(len(run)):
                for leaf in under[a + k]:
                    paths[leaf] += run[:k] + run[k + 1 :]
            ups.append(sha(*run))
            below.append([x for u in under[a : a + 8] for x in u])
        nodes, under = ups, below
    return nodes[0], paths


def leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute(rows):
    """doc_id, leaf, subroot, root and the proof's digest of every row."""
    parts = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for part in parts:
        mine = sorted((r for r in rows if r[2] == part), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *plain_tree([leaf(r) for r in mine])))
    root, ups = plain_tree([t[1] for t in trees])
    return sorted([(r[0], leaf(r), sub, root, sha(*path, *up)) for (mine, sub, paths), up in zip(trees, ups, strict=True) for r, path in zip(mine, paths, strict=True)], key=repr)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 512, 700])
def test_traversal_gives_the_paths_of_the_whole_tree(n):
    leaves = [sha(str(k)) for k in range(n)]
    height = merkle.height_of(n)
    root, paths = plain_tree(leaves)
    got = list(merkle.traverse(leaves, height))
    assert [merkle.siblings_of(p) for p in got] == paths
    assert all(merkle.fold(x, p) == root for x, p in zip(leaves, got, strict=True))
    assert n == 1 or merkle.subtree_root(leaves, height) == root


def test_traversal_holds_little():
    most = 0
    for path in merkle.traverse([sha(str(k)) for k in range(4096)], 4):
        most = max(most, sum(len(run) for run, _ in path))
    assert most <= 32


@pytest.mark.parametrize("rows", [
    [(5, "s", "en", 3, "Abc")], [(1, None, None, None, None), (None, "x", None, 0, ""), (2, "s", "", 1, "é"), (2, "s", "", 1, "é"), (2, "t", "", 1, "é")],
    [(k, f"s{k}", f"l{k % 20}", k, "T" * (k % 5)) for k in range(90)], [(7, "s", "en", 1, "same")] * 30 + [(8, "s", "de", 1, "X" * 200_000)],
])
def test_manifest_equals_brute_force(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit(1), "tree": F.lit(2), "range": F.lit(3), "id": F.lit(4)})
    got = merkle.manifest(frame).collect()
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got], key=repr) == brute(rows)
    assert all(r.verified and r.folded_root == r.root for r in got)


def test_more_than_a_block_and_what_was_tampered_with(spark):
    r = random.Random(1)
    rows = [(k, "s", "en" if k < 4500 else r.choice(["de", "fr"]), 1, f"Text {k}") for k in range(4600)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    seen = F.when(F.col("doc_id") % 10 == 0, merkle.leaf_digest([F.lower(c) if c == "text" else F.col(c) for c in merkle.FIELDS]))
    got = merkle.manifest(frame, seen=seen, with_siblings=True).collect()
    assert sorted([(x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256) for x in got], key=repr) == brute(rows)
    assert all(x.verified == (x.doc_id % 10 != 0) for x in got)
    assert all(sha(*x.siblings) == x.proof_sha256 for x in got)


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_on_the_larger_table(spark):
    frame = merkle.op13_merkle_manifest(spark, "/root/testdata/sf0.01")
    assert rows_of(frame) == duck(merkle.OP13_SQL, "/root/testdata/sf0.01")[1]
