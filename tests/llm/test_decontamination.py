import random
import re

import pytest

from locweave.llm import decontamination as dc


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=13):
    wins = [(str(i) if i is not None else "", tuple(w[k : k + window])) for i, t in items if (w := words(t)) for k in range(max(1, len(w) - window + 1))]
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for name, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    named.add(name)
        out.append((-1 if i is None else i, len(w), len(hit), sorted(named), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, words string, n long")
    b = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, win string")
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in dc.decontaminate(d, b, **more).collect())


def fixture(seed):
    r = random.Random(seed)
    w = lambda n, k=30: " ".join(r.choice(["Wort", "é", "x1", "the"]) + str(r.randrange(k)) for _ in range(n))
    items = [(1, w(40)), (2, w(13)), (3, w(5)), (4, "Two words"), (5, "one"), (6, None), (7, ""), (8, "..."), (None, w(20)), (9, w(13)), (10, "the the the the the the")]
    items.append((11, items[0][1]))
    docs = [(i, w(60) + ". " + (items[i % len(items)][1] or "") + "; " + w(r.randrange(300))) for i in range(30)]
    docs += [(100, None), (101, ""), (102, items[0][1]), (None, items[1][1].upper()), (102, "two-words"), (103, "the " * 40), (104, " ".join(words(items[0][1])[3:20]))]
    return docs, items


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_brute_force(spark, seed):
    docs, items = fixture(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_large_benchmarks_are_shuffled(spark):
    docs, items = fixture(5)
    assert run(spark, docs, items, broadcast_bytes=0) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = fixture(6)
    assert run(spark, [], items) == []
    assert all(r[2] == 0 and not r[4] for r in run(spark, docs, []))
