import random
import zlib

import numpy as np
import pandas as pd

from locweave.llm import gam, quality


def corpus(n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(30, 120))]
        good = r.random() < 0.8
        text = ". ".join(" ".join(words[k : k + 9]).capitalize() for k in range(0, len(words), 9)) if good else " ".join(w.upper() + "!!" for w in words) if i % 2 else " ".join([words[0]] * len(words))
        rows.append((i, text, int(good)))
    return rows


def test_held_out_accuracy_and_order_of_scores(spark):
    rows = corpus(800)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows] + [(None, "no id", 0.1), (9000, None, 0.1), (9001, "", 0.2)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.mine for r in quality.scored(docs, model, name="mine").collect()}
    assert len(got) == 803 and all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001]
    held = [(got[i] >= quality.THRESHOLD) == bool(q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.95


def test_held_out_rows_teach_nothing(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a = quality.train(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int"))
    b = quality.train(docs, spark.createDataFrame([(i, 1 - q if held(i) else q) for i, _, q in rows], "doc_id long, quality int"))
    x = quality.matrix(pd.Series([t for _, t, _ in rows]))
    assert (a.score(x) == b.score(x)).all()


def test_no_labels_and_one_label(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.scored(docs, none).collect()] == [0.5, 0.5]
    model = gam.fit(np.random.default_rng(0).random((20, 3)), np.ones(20))
    assert (model.score(np.zeros((2, 3))) > 0.9).all()
    assert quality.scored(docs.limit(0), none).count() == 0


def test_pairs_learn_what_single_features_cannot():
    r = np.random.default_rng(1)
    x = r.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = gam.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_bounded_training_set(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    one, two = (quality.train(docs, labels, max_rows=50) for _ in range(2))
    x = quality.matrix(pd.Series([t for _, t, _ in rows]))
    assert (one.score(x) == two.score(x)).all()


def noisy_corpus(n):
    """Labels drawn with a chance that falls with shouting, repeats and digits together, so that no model can be sure; the chance too."""
    r = random.Random(3)
    rows = []
    for i in range(n):
        shout, again, digits = r.random(), r.random(), r.random()
        words = []
        for _ in range(r.randint(40, 120)):
            w = words[-1] if words and r.random() < 0.4 * again else "".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8)))
            words.append(w.upper() if r.random() < 0.5 * shout else str(r.randrange(1000)) if r.random() < 0.3 * digits else w)
        chance = 1 / (1 + np.exp(-(3 - 4 * shout - 3 * again * (digits > 0.5) - 1.5 * digits)))
        rows.append((i, " ".join(words), int(r.random() < chance), chance))
    return rows


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    yes = np.asarray(labels) == 1
    return (order[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())


def test_auc_on_hard_labels_comes_near_the_best_possible(spark):
    rows = noisy_corpus(4000)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([(i, q) for i, _, q, _ in rows], "doc_id long, quality int"))
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    labels = [x[2] for x in held]
    got, best = auc(model.score(quality.matrix(pd.Series([x[1] for x in held]))), labels), auc([x[3] for x in held], labels)
    # The best knows the three chances behind a text, of which its words are a small sample.
    assert 0.7 < best < 0.95 and got > best - 0.065, (got, best)


def test_a_repeated_id_brings_one_row(spark):
    docs = spark.createDataFrame([(1, f"text {i} of one id") for i in range(500)] + [(2, "A calm text."), (3, "LOUD!! LOUD!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int")
    seen = []
    fit, gam.fit = gam.fit, lambda x, y, **k: seen.append(len(y)) or fit(x, y, **k)
    try:
        quality.train(docs, labels)
    finally:
        gam.fit = fit
    assert seen and seen[0] <= 3
