import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locweave.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def check(frame, components=wh.COMPONENTS):
    model = wh.fit(frame, components=components)
    rows = wh.whitened(frame, model, wh.identity_error(frame, model)).collect()
    kept = [(r.vec_id, r.embedding) for r in frame.collect() if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in e] for _, e in kept], np.int64)
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = max(r.component for r in rows)
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    deviation = {}
    for (i, _), row in zip(kept, x, strict=True):
        deviation.setdefault(i, set()).add(sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)))
    assert all(r.deviation in deviation[r.vec_id] for r in rows)
    explained = {r.component: r.explained for r in rows}
    assert all(abs(explained[c + 1] / (values[c] / values.sum()) - 1) < 1e-6 for c in range(k))
    assert rows[0].identity_error < 1e-4
    return rows, centred @ vectors[:, :k] / np.sqrt(values[:k]), kept


def test_equals_eigenvectors_up_to_signs(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").repartition(7)
    rows, want, kept = check(frame)
    place = {i: k for k, (i, _) in enumerate(kept)}
    got = np.zeros_like(want)
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-8
    covariance = (got - got.mean(axis=0)).T @ (got - got.mean(axis=0)) / len(got)
    assert np.abs(covariance - np.eye(32)).max() < 1e-10


def test_unusable_vectors_repeated_rows_and_clashing_names(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0, 2.0], 1), (1, [0.0, 1.0, 2.0], 1), (2, None, 1), (3, [nan, 0.0, 0.0], 1), (4, [0.0, inf, 0.0], None), (5, [0.0, None, 1.0], 2), (None, [3.0, -1.0, 0.5], 2), (6, [-2.0, 0.25, 0.125], 3), (7, [5.0, 1.5, -2.25], 4), (-8, [1.0, 1.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit("x"), "component": F.lit("y"), "v": F.lit("z"), "id": F.lit("w")})
    rows, _, kept = check(frame)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in rows if r.component == 1) == sorted((i is None, i or 0) for i, _ in kept)


def test_without_spread_or_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    alike = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)
    for frame in (none, alike, spark.createDataFrame([(1, None, 0)], SCHEMA), spark.createDataFrame([(1, [], 0)], SCHEMA)):
        model = wh.fit(frame)
        assert model is None and wh.whitened(frame, model, 0.0).collect() == []
    with pytest.raises(ValueError, match="entries"):
        wh.fit(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SCHEMA))


def test_components_without_spread_are_left_out(spark):
    frame = spark.createDataFrame([(k, [float(k % 5), float(k % 5), float(k % 3)], 0) for k in range(30)], SCHEMA)
    assert wh.fit(frame).components.shape == (3, 2)


@pytest.mark.parametrize("width", [1, 2, 3, 8, 17])
def test_rotations_and_stacked_triangles(width):
    r = np.random.default_rng(width)
    rows = r.normal(size=(200, width)) * np.logspace(0, -6, width)
    whole = wh.triangle(rows)
    stacked = wh.triangle(np.vstack([wh.triangle(rows[:3]), wh.triangle(rows[3:90]), wh.triangle(rows[90:])]))
    for t in (whole, stacked):
        sizes, vectors = wh.jacobi(t)
        exact = np.linalg.svd(rows, compute_uv=False)
        assert np.abs(sizes / exact - 1).max() < 1e-9
        assert np.abs(vectors.T @ vectors - np.eye(width)).max() < 1e-12
    assert np.abs(whole.T @ whole - stacked.T @ stacked).max() < 1e-9 * np.abs(whole.T @ whole).max()


def test_deviations_are_exact_or_null():
    x = np.array([[1_000_000, 2_000_000], [1_000_001, -5]], np.int64)
    sums = x.sum(axis=0)
    assert wh._deviations(x, 2, sums) == [sum((2 * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert wh._deviations(x * 10**6, 10**6, sums) == [None, None]
    far = wh._deviations(x, 3 * 10**3, sums)
    assert far == [sum((3000 * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) if sum((3000 * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) < 2**63 else None for row in x]
