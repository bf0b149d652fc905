import random

import pytest

from locweave.llm import jaccard_join
from locweave.llm import shingles as sh


def brute(rows, size=5, percent=75):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(words, r, n):
    words = words[:]
    for _ in range(n):
        words[r.randrange(len(words))] = "w%d" % r.randrange(10**6)
    return " ".join(words)


def corpus(seed, copies=60):
    r = random.Random(seed)
    base = ["b%d" % r.randrange(10**6) for _ in range(120)]
    passage = ["p%d" % i for i in range(90)]
    texts = [edited(base, r, r.randrange(0, 7)) for _ in range(copies)]
    texts += [" ".join(passage + ["u%d" % r.randrange(10**6) for _ in range(r.randrange(5, 40))]) for _ in range(30)]
    texts += [" ".join("r%d" % r.randrange(500) for _ in range(r.randrange(0, 60))) for _ in range(40)]
    texts += [None, "", "one", "One", "two words", "a b c d e", "A b c  d\ne", "a b c d e f"]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n long, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame).collect()}
    assert got == brute(rows)


def test_remaining_pairs_are_compared(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MAX_TURNS", 1)
    monkeypatch.setattr(jaccard_join, "CHUNK", 7)
    monkeypatch.setattr(jaccard_join, "CELL_PAIRS", 50)
    monkeypatch.setattr(jaccard_join, "FRAGMENT_HASHES", 500)
    rows = corpus(9, 80)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(frame).collect()}
    assert got == brute(rows)


def test_nothing_to_link(spark):
    assert jaccard_join.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, None), (2, ""), (None, " "), (4, "x y")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (None, 0, None), (4, 1, 4)}


def test_repeated_rows_and_one_long_text(spark):
    long = " ".join("x%d" % i for i in range(50_000))
    rows = [(3, long), (3, long), (2, long + " end"), (9, "other")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 2), (3, 2), (3, 2), (9, 9)]


def test_shingles_are_case_blind_for_ascii_only():
    import pyarrow as pa

    a, b, c = sh.sets(pa.array(["A B C D E", "a b\tc\vd e", "É b c d e"]))
    assert a.tolist() == b.tolist() and c.tolist() != sh.sets(pa.array(["é b c d e"]))[0].tolist()
