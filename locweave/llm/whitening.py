"""Whitening of embeddings by the singular values of their centred rows.

Tasks compress their rows to a triangle R each by QR, block after block; triangles are stacked and
compressed again, a few at a time, until one is left (TSQR). Plane rotations then make R's columns
orthogonal (one-sided Jacobi): the rotations together are the components, the columns' lengths the
standard deviations. The covariance itself is never formed, so that small components keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import passing_tables, ship, table, written

SCALE, SHIFT = 64, 1_000_000
#: Triangles that one task stacks: so many squares of the dimension in doubles are what it holds.
FAN_IN = 8
COMPONENTS = 32
#: Entries beyond this have no exact whole number of 64ths.
LARGEST = 2.0**46


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors' entries as whole numbers: floor(64 c) + 1,000,000."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"entries beyond {LARGEST:g} have no exact whole numbers")
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(-1, width)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from whole numbers as long as they go: (n x - S) / n. Beyond that S/n is split in whole and rest."""
    whole, rest = sums // n, sums % n
    return (x - whole).astype(np.float64) - rest / n


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Each row's sum of (n x - S)^2, exact; null where it does not fit a long."""
    far = n * int(np.abs(x - sums // n).max(initial=0) + 1)  # no |n x - S| is larger
    if far * far * max(1, x.shape[1]) < 2**63:
        scaled = n * (x - sums // n) - sums % n
        return (scaled * scaled).sum(axis=1).tolist()
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [e if e < 2**63 else None for e in exact]


def triangle(rows: np.ndarray) -> np.ndarray:
    """A square R with the same Gram matrix as the rows."""
    width = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == width else np.vstack([r, np.zeros((width - len(r), width))])


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and the right singular vectors as columns.

    A sweep goes through all pairs of columns, in rounds of pairs that share no column and so turn at
    once; it ends when no pair is further from a right angle than rounding.
    """
    width = r.shape[1]
    even = width + width % 2  # an odd width gets a column of zeros, which never turns
    u, v = np.zeros((r.shape[0], even)), np.eye(even)
    u[:, :width] = r
    seats = np.arange(even)
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(even - 1):
            p, q = seats[: even // 2], seats[even // 2 :][::-1]
            a, b, c = (u[:, p] ** 2).sum(axis=0), (u[:, q] ** 2).sum(axis=0), (u[:, p] * u[:, q]).sum(axis=0)
            go = np.abs(c) > eps * np.sqrt(a * b)
            if go.any():
                turned = True
                p, q, a, b, c = p[go], q[go], a[go], b[go], c[go]
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                cos = 1 / np.hypot(1, t)
                sin = cos * t
                for m in (u, v):
                    left, right = m[:, p], m[:, q]
                    m[:, p], m[:, q] = cos * left - sin * right, sin * left + cos * right
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if not turned:
            break
    sizes = np.sqrt((u**2).sum(axis=0))[:width]
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[:width, :width][:, order]


@dataclass
class Whitening:
    """What whitens vectors: n and S of the fit list, components as columns, and the standard deviations along them."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    variance: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whole-number vectors in whitened coordinates."""
        return _centred(x, self.n, self.sums) @ self.components / self.deviations


def _batches(vector: str, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, whole_numbers(batch.column(vector), width)



def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Learn from all usable vectors; None where there are none, or where they are all alike.

    The driver is given sums by dimension and one triangle, whatever the number of rows. Components without
    spread (their singular value is below rounding of the largest) are left out. Vectors of different lengths
    raise ValueError.
    """
    spark = rows.sparkSession
    ship(spark)
    # A second look at the same column, for its lengths, so that Python can take the entries as one array.
    good = rows.where(usable(F.col(vector))).select(F.col(vector).alias("v"))
    least, width = good.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != width:
        raise ValueError(f"vectors have from {least} to {width} entries")
    if not width:
        return None

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(width, np.int64)
        for _, x in _batches("v", width, batches):
            n, sums = n + len(x), sums + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array(range(-1, width), pa.int32()), "value": pa.array([n, *sums.tolist()], pa.int64())})

    totals = good.mapInArrow(summed, "at int, value long").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    n, sums = totals[0]["value"], np.array([t["value"] for t in totals[1:]], np.int64)

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _batches("v", width, batches):
            rows = _centred(x, n, sums)
            r = triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            block = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    def stacked(group: pd.DataFrame) -> pd.DataFrame:
        parts = group.sort_values("block")
        r = triangle(np.vstack([np.asarray(x, float).reshape(width, width) for x in parts["r"]]))
        return pd.DataFrame({"block": [parts["block"].iloc[0] // FAN_IN], "r": [r.ravel().tolist()]})

    with passing_tables(spark):
        blocks = written(good.mapInArrow(compressed, "block long, r array<double>"), "tsqr")
        while (last := blocks.agg(F.max("block")).first()[0]) > 0:
            blocks = written(blocks.groupBy(F.floor(F.col("block") / FAN_IN)).applyInPandas(stacked, "block long, r array<double>"), "tsqr")
        assert last == 0
        r = np.array(blocks.first()["r"], float).reshape(width, width)
    sizes, vectors = jacobi(r)
    kept = int((sizes > sizes[0] * width * np.finfo(float).eps).sum()) if sizes[0] > 0 else 0
    kept = min(kept, components)
    if not kept:
        return None
    return Whitening(n, sums, vectors[:, :kept], sizes[:kept] / np.sqrt(n), float((sizes**2).sum() / n))


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over the fit list."""
    good = rows.where(usable(F.col(vector))).select(F.col(vector).alias("v"))
    width, k = len(model.sums), model.components.shape[1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in _batches("v", width, batches):
            z = model.project(x)
            total[:k] += z.T @ z
            total[k] += z.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(total.size), pa.int32()), "value": pa.array(total.ravel())})

    got = good.mapInArrow(products, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    total = np.array([g["value"] for g in got]).reshape(k + 1, k) / model.n
    covariance = total[:k] - np.outer(total[k], total[k])  # z is centred but for rounding
    return float(np.abs(covariance - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening | None, error: float, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """A row for each usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries have no rows. Rows that repeat others, and rows
    without an id, have rows of their own; other columns are not looked at. Without a model (no usable
    vector, or all alike) there are no rows.
    """
    ship(rows.sparkSession)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = rows.where(usable(F.col(vector))).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    width, k = len(model.sums), model.components.shape[1]
    explained = model.deviations**2 / model.variance

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches("v", width, batches):
            m = len(x)
            by_row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column("id").take(by_row),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, model.n, np.int64)),
                "deviation": pa.array(_deviations(x, model.n, model.sums), pa.int64()).take(by_row),
                "whitened": pa.array(model.project(x).ravel()),
                "explained": pa.array(np.tile(explained, m)),
                "identity_error": pa.array(np.full(m * k, error)),
            })

    return good.mapInArrow(told, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = fit(rows)
    return whitened(rows, model, identity_error(rows, model) if model else 0.0)
