import random
import string

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from locweave.llm import toxicity as tox

DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"
FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("text, words", [
    (None, []), ("", []), ("You i.d.i.o.t, no!", ["you", "idiot"]), ("what an i d i o t he is", ["what", "idiot"]), ("a-b", []), ("ÉTÉ 12345", ["été", "12345"]), ("x" * 30, ["x" * 24, "x" * 14]), ("ab" * 24, ["ab" * 12] * 2 + ["ab" * 8]),
])
def test_words(text, words):
    assert tox.words_of(text) == words


def plain_kernel(a, b):
    """The kernel by all places of all triples."""
    def shares(w):
        out = {}
        for i in range(len(w)):
            for k in range(i + 2, min(len(w), i + tox.SPAN)):
                for j in range(i + 1, k):
                    key = w[i] + w[j] + w[k]
                    out[key] = out.get(key, 0) + tox.DECAY ** (k - i - 2)
        return out
    norm = lambda w: np.sqrt(sum(tox.DECAY ** (2 * (k - i - 2)) for i in range(len(w)) for k in range(i + 2, min(len(w), i + tox.SPAN)) for _ in range(i + 1, k))) ** 0.5
    x, y = shares(a), shares(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / norm(a) / norm(b)


def test_kernel_and_folded_table_equal_brute_force():
    r = random.Random(2)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(3, 12))) for _ in range(60)]
    marks = tox.Landmarks(words[:9])
    want = np.array([[plain_kernel(a, b) for b in words[:9]] for a in words])
    assert np.allclose(marks.kernel(words), want, atol=1e-4)
    coefficients = np.linspace(-1, 1, 9).astype(np.float32)
    assert np.allclose(tox.weighed(words, marks.folded(coefficients)), want @ coefficients, atol=1e-4)


def test_a_gapped_word_stays_near():
    near = tox.Landmarks(["worthless"]).kernel(["worthless", "worthxless", "wort-hless".replace("-", "q"), "somewhere", "bicycles"])[:, 0]
    assert near[0] > near[1] > 2 * near[3] and near[2] > 2 * near[4]


def test_landmarks_are_apart():
    words = ["stupid", "stupid", "stupids", "clown", "tables", "clowns"]
    chosen = tox.pick_landmarks(words, np.ones(6), 3)
    assert len(set(w[:4] for w in chosen)) == 3


def test_machine_separates():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 5))
    y = np.where(x @ np.array([1, -2, 0, 0, 0.5]) > 0.3, 1.0, -1.0)
    w, offset = tox.support_vectors(x, y, np.ones(400))
    assert (np.sign(x @ w + offset) == y).mean() > 0.98


def held_out_facts(spark, folder=FOLDER):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.train(docs, labels)
    got = tox.scored(docs.select("doc_id", "text"), model).withColumn("held_out", tox.held_out()).join(labels, "doc_id").toPandas()
    return model, got


def test_held_out_texts_and_gapped_insults(spark):
    model, got = held_out_facts(spark, "/root/testdata/sf0.1")
    held = got[got.held_out]
    told, is_toxic = held.score >= tox.THRESHOLD, held.toxic == 1
    # A few labels say toxic of texts without an insult: no model finds these.
    assert (told & is_toxic).sum() >= 0.85 * is_toxic.sum() and (told & is_toxic).sum() >= 0.9 * told.sum()
    r = random.Random(1)
    clean = held[~is_toxic & (held.score < 0.2)].text.dropna().tolist()[:150]
    insults = "loser idiot pathetic scum worthless moron trash clown disgusting stupid".split()

    def share(change):
        out = []
        for text in clean:
            words = text.split()[:120]
            for _ in range(3):
                words.insert(r.randint(0, len(words)), change(r.choice(insults)))
            out.append(" ".join(words))
        return (model.score(model.facts(pd.Series(out))) >= tox.THRESHOLD).mean()

    def gapped(word):
        k = r.randint(1, len(word) - 1)
        return word[:k] + r.choice(string.ascii_lowercase) + word[k:]

    assert share(lambda w: w) > 0.9 and share(".".join) > 0.9 and share(" ".join) > 0.9
    assert share(gapped) > 0.5


def test_labels_of_the_held_out_fold_are_not_looked_at(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(tox.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.lit(0))
    a, b = tox.train(docs, labels), tox.train(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), other)
    assert np.array_equal(a.table, b.table) and np.array_equal(a.curve, b.curve)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en"), (1, "a stupid idiot", "en"), (2, "", "en"), (None, "x", None), (3, "word " * 100_000, "de"), (4, "nice people", "en")], DOCS).withColumns({"id": F.lit(1), "body": F.lit(2), "label": F.lit(3)})
    for rows in ([], [(1, 1, None), (None, 1, 1)], [(4, 1, 1)], [(4, None, 0), (1, 0, 1), (1, 0, 0), (1, 1, 1), (3, 1, 0)]):
        model = tox.train(docs, spark.createDataFrame(rows, LABELS))
        got = tox.scored(docs.withColumn("score", F.lit("old")), model).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert tox.scored(empty, tox.train(empty, spark.createDataFrame([], LABELS))).count() == 0


def test_query(spark):
    frame = tox.op11_toxicity(spark, "/root/testdata/sf0.001")
    rows = frame.collect()
    assert frame.columns == ["doc_id", "held_out", "score", "predicted"] and len(rows) == 200
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
