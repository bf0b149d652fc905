import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from locweave.llm import lm_scoring as lm


def schema_rows(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens long, id string")


ROWS = [(i, " ".join(f"w{(i * 7 + k * k) % (11 + i % 5)}" for k in range(i % 23))) for i in range(120)] + [(500, None), (501, ""), (502, "Never Seen words"), (None, "w1 w2"), (3, "W1 w2 W3")]


def test_base_scores_equal_brute_force(spark, tmp_path):
    frame = schema_rows(spark, ROWS)
    model, counts = lm.learn(frame.where(lm.trained_on()))
    got = lm.scores(frame, model, counts).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    tokens = [(i, (t or "").lower().split() + [None]) for i, t in ROWS]
    c = Counter(w for i, ts in tokens if fold(i) != 1 for w in ts)
    total, kinds = sum(c.values()), len(c)
    norm = math.log10(total + 0.5 * (kinds + 1))
    want = sorted((-1 if i is None else i, len(ts), sum(c[w] > 0 for w in ts), total, round(sum(math.log10(c[w] + 0.5) for w in ts) - len(ts) * norm, 6)) for i, ts in tokens)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_rare_words_come_back_exactly(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_WORDS", 16)
    test_base_scores_equal_brute_force(spark, None)


def test_nothing_to_learn_from(spark):
    none = schema_rows(spark, [])
    model, counts = lm.learn(none)
    got = lm.scores(schema_rows(spark, [(1, "a b"), (2, None)]), model, counts).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got) == [(1, 3, 0, 0.0), (2, 1, 0, 0.0)]
    assert lm.scores(none, model, counts).collect() == []


def test_filter_keeps_levels():
    r = np.random.default_rng(0)
    cells, cell_bits = 16, 1 << 14
    grams = np.unique(r.integers(0, 1 << 64, 4000, dtype=np.uint64))
    reached = lm.levels(r.integers(1, 200, len(grams)))
    bits = np.concatenate([lm.filled(grams[c == k], reached[c == k], k, cells, cell_bits) for c in [lm.cell_of(grams, cells)] for k in range(cells)])
    known = lm.probed(bits, grams, cells, cell_bits)
    assert (known >= reached).all()
    others = r.integers(0, 1 << 64, 4000, dtype=np.uint64)
    assert (lm.probed(bits, others, cells, cell_bits) > 0).mean() < 0.2


@pytest.mark.parametrize("count", [1, 2, 3, 5, 9, 100, 10_000])
def test_levels_stand_for_counts(count):
    assert 0.6 < lm.MEAN[lm.levels(np.array([count]))[0]] / count < 1.6


def test_model_is_better_than_single_words_on_repeated_phrases(spark):
    rows = [(i, "alpha beta gamma delta epsilon " * 4) for i in range(60)]
    frame = schema_rows(spark, rows)
    model, counts = lm.learn(frame.where(lm.trained_on()))
    assert all(r.score > r.base_score for r in lm.scores(frame, model, counts).collect())


def plain_scores(rows):
    """Scores by the levels of exact counts, without a filter."""
    texts = [(i, (t or "").lower().split() + [None]) for i, t in rows]
    learnt = [ts for i, ts in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    c = Counter(w for ts in learnt for w in ts)
    c2 = Counter(p for ts in learnt for p in zip([None, *ts], ts, strict=False))
    mean = lambda n: lm.MEAN[lm.levels(np.array([n]))[0]] if n else 0.0
    size = sum(c.values()) + 0.5 * (len(c) + 1)
    part = lambda a, b: math.log10((mean(c2[a, b]) + lm.PRIOR * (mean(c[b]) + 0.5) / size) / (mean(c[a]) + lm.PRIOR))
    return sorted((-1 if i is None else i, round(sum(part(a, b) for a, b in zip([None, *ts], ts, strict=False)), 6)) for i, ts in texts)


@pytest.mark.parametrize("hot, pairs", [(1 << 18, 1 << 18), (16, 4), (1, 0)])
def test_filter_grows_with_the_text(spark, monkeypatch, hot, pairs):
    # The bound that there was, at a load that fills it.
    monkeypatch.setattr(lm.learn, "__defaults__", tuple(1 << 10 if isinstance(d, int) else d for d in lm.learn.__defaults__))
    monkeypatch.setattr(lm, "MIN_BITS", 1 << 10)
    monkeypatch.setattr(lm, "HOT_WORDS", hot)
    monkeypatch.setattr(lm, "HOT_PAIRS", pairs, raising=False)
    r = np.random.default_rng(5)
    rows = ROWS + [(1000 + i, " ".join(f"v{k}" for k in r.integers(0, 3000, 40))) for i in range(400)]
    frame = schema_rows(spark, rows)
    model, counts = lm.learn(frame.where(lm.trained_on()))
    got = sorted((-1 if x.doc_id is None else x.doc_id, round(x.score, 6)) for x in lm.scores(frame, model, counts).collect())
    assert model.cells * model.cell_bits >= sum(len(t or "") for i, t in rows) // 2
    # At a bit for each byte some unseen n-grams are taken for seen ones; a full filter would take all.
    off = np.array([abs(a[1] - b[1]) for a, b in zip(got, plain_scores(rows), strict=True)])
    assert off.mean() < 3


def by_filter_and_exactly(train, test):
    """Scores a token of texts by a filter of the size that the text to learn from gives it, and by exact counts; how full it is."""
    h, before, _ = lm.tokens(pa.array(train))
    (words, n), (pairs, m) = (np.unique(x, return_counts=True) for x in (h, lm.bigrams(h, before)))
    cells, cell_bits = lm.layout(sum(len(t) for t in train))
    names, reached = np.concatenate([words, pairs]), lm.levels(np.concatenate([n, m]))
    cell = lm.cell_of(names, cells)
    bits = np.concatenate([lm.filled(names[cell == k], reached[cell == k], 0, 1, cell_bits) for k in range(cells)])
    h, before, counts = lm.tokens(pa.array(test))
    model = lm.Model(cells, cell_bits, int(n.sum()), len(words), *[np.zeros(0, t) for t in (np.uint64, np.int64, np.uint8, np.uint64, np.uint8)])

    def by_cell(asked):
        at, out = lm.cell_of(asked, cells), np.zeros(len(asked), np.int64)
        for k in range(cells):
            out[at == k] = lm.probed(bits[k * cell_bits // 8 : (k + 1) * cell_bits // 8], asked[at == k], 1, cell_bits)
        return out

    def exact(names, n, asked):
        known, place = lm.found(names, asked)
        return np.where(known, lm.levels(n[place]), 0)

    def score(own, seen, context):
        return np.add.reduceat(model.parts[lm.code(own, seen)] - model.context[context], np.cumsum(counts) - counts) / counts

    got = score(by_cell(h), by_cell(lm.bigrams(h, before)), by_cell(before))
    return got, score(exact(words, n, h), exact(pairs, m, lm.bigrams(h, before)), exact(words, n, before)), np.unpackbits(bits).mean()


@pytest.mark.parametrize("times", [1, 10, 100])
def test_scores_follow_exact_ones_at_any_load(times):
    r = np.random.default_rng(times)
    texts = lambda k: [" ".join(f"w{x}" for x in row) for row in r.zipf(1.2, (k, 60)) % 50_000]
    got, want, full = by_filter_and_exactly(texts(400 * times), texts(400))
    assert full < 0.2 and np.corrcoef(got, want)[0, 1] > 0.99, full


def test_scores_are_the_filters_whatever_is_broadcast(spark, monkeypatch):
    """On the driver's table: what is in the broadcast changes no answer of the filter; scores are close to exact ones and not equal to them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    told = []
    for hot, pairs in ((1 << 18, 1 << 18), (1 << 18, 0), (500, 300), (0, 0)):
        monkeypatch.setattr(lm, "HOT_WORDS", hot)
        monkeypatch.setattr(lm, "HOT_PAIRS", pairs)
        model, counts = lm.learn(docs.where(lm.trained_on()))
        told.append(sorted((r.doc_id, round(r.score, 6), r.n_tokens, round(r.base_score, 6)) for r in lm.scores(docs, model, counts).collect()))
    assert told[0] == told[1]  # which words are frequent says where bigrams lie, and so which bits they share
    assert all(np.corrcoef([t[1] / t[2] for t in told[0]], [t[1] / t[2] for t in other])[0, 1] > 0.99 for other in told[2:])
    exact = dict(plain_scores([(r.doc_id, None if r.text is None else "".join(c.lower() if c.isascii() else c for c in r.text)) for r in docs.collect()]))
    got, want = (np.array([x / n for x, n in v]) for v in (((s, n) for _, s, n, _ in told[0]), ((exact[i], n) for i, _, n, _ in told[0])))
    assert np.corrcoef(got, want)[0, 1] > 0.99
    assert (np.abs(got - want) > 1e-9).mean() > 0.1
