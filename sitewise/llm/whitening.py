"""Whitening of embeddings by a one-sided Jacobi SVD of a blockwise TSQR.

Vectors become whole numbers, and each distinct one is once in the fit list. Tasks stack their centred rows block
by block on the triangle R so far and factor again; the tasks' triangles are stacked and factored in rounds, a
bounded number to a task, until one is left. Its columns are turned against one another in plane rotations until all are
orthogonal: the turns gathered are the components, the columns' lengths the standard deviations times sqrt(n). No covariance
matrix is formed for the fit, which would square the condition number. What reaches the driver is sums of a dimension, one
triangle and one matrix of the size of the components, whatever the number of rows.

Defined cases
* a null vector, and one with a null or non-finite entry: no row, and not in the fit list.
* vectors of another length than most (of equally common lengths the longest): like null ones. Empty vectors have no component.
* null ids, repeated ids and repeated rows: each row has its rows; equal vectors count once in the fit.
* components without variance (within rounding) are left out, so a table of one distinct vector gives no rows.
* an empty table: no rows.
* a deviation that no long holds (beyond some ten million distinct vectors) is an error, not a wrong number.
* other columns pass through; columns named like those that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewise.llm.common import forget, stored

# The scale and the origin of whole numbers.
SCALE, ORIGIN = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 16
#: Rows stacked on a triangle at once, and triangles that one task stacks.
BLOCK_ROWS, FAN_IN = 4096, 64
#: Sweeps over all pairs of columns at most; some ten do.
SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """What a fit has learned: n distinct vectors, their sums, unit components (dimension, component) by falling eigenvalue, share of the variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))


def whole_vector(vector: Column) -> Column:
    """The vector in whole numbers; null where it is null or an entry is null or not finite."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(wide, lambda c: F.floor(SCALE * c) + ORIGIN))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _summing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, None
    for batch in batches:
        if len(batch):
            x = _matrix(batch.column(0))
            n, sums = n + len(x), x.sum(axis=0) + (0 if sums is None else sums)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])


def _triangle(r: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["r"])


def _factoring(n: int, sums: np.ndarray):
    """Triangles of a task's centred rows."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                centred = (n * _matrix(batch.column(0).slice(at, BLOCK_ROWS)) - sums) / n
                r = np.linalg.qr(centred if r is None else np.vstack([r, centred]), mode="r")
        yield from _triangle(r)

    return factor


def _merging(d: int):
    """One triangle of a task's triangles, which may have fewer rows than columns."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for blob in batch.column(0):
                own = np.frombuffer(blob.as_py(), "<f8").reshape(-1, d)
                r = own if r is None else np.linalg.qr(np.vstack([r, own]), mode="r")
        yield from _triangle(r)

    return merge


def tsqr(fit_list: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows, merged in rounds."""
    factors = stored(fit_list.mapInArrow(_factoring(n, sums), "r binary"))
    while (left := factors.count()) > 1:
        merged = stored(factors.repartition(-(-left // FAN_IN)).mapInArrow(_merging(len(sums)), "r binary"))
        forget(factors)
        factors = merged
    blob = factors.first()["r"]
    forget(factors)
    return np.frombuffer(blob, "<f8").reshape(-1, len(sums))


def _rounds(columns: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns as rounds of disjoint pairs: one column stays, the others go around it."""
    ring = list(range(columns + columns % 2))
    rounds = []
    for _ in range(len(ring) - 1):
        pairs = [(p, q) for p, q in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if max(p, q) < columns]
        rounds.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return rounds


def one_sided_jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (a column each) of a matrix."""
    rows, d = r.shape
    w = np.vstack([r, np.eye(d)])  # every turn of columns is gathered below
    tolerance = np.finfo(float).eps * max(1, rows) ** 0.5
    rounds = _rounds(d)
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            x, y = w[:rows, p], w[:rows, q]
            alpha, beta, gamma = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            with np.errstate(over="ignore"):  # an infinite ratio is a turn by nothing
                zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            left, right = w[:, p], w[:, q]
            w[:, p], w[:, q] = c * left - c * t * right, c * t * left + c * right
        if not turned:
            break
    lengths = np.sqrt((w[:rows] ** 2).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")
    vectors = w[rows:, order]
    return lengths[order], vectors / np.sqrt((vectors**2).sum(axis=0))


def _moments(fitted: Whitening):
    """Sums of the projected rows and of their products, a row an entry."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fitted.components.shape[1]
        sums = np.zeros((k + 1, k))
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                z = fitted.project(_matrix(batch.column(0).slice(at, BLOCK_ROWS)))
                sums += np.vstack([z.T @ z, z.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "value"])

    return count


def _identity_error(fit_list: DataFrame, fitted: Whitening) -> float:
    k = fitted.components.shape[1]
    summed = fit_list.mapInArrow(_moments(fitted), "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()  # k x (k + 1) rows
    moments = summed.sort_values("at")["value"].to_numpy().reshape(k + 1, k)
    means = moments[k] / fitted.n
    return float(np.abs(moments[:k] / fitted.n - np.outer(means, means) - np.eye(k)).max())


def fit(vectors: DataFrame, *, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors in column ``x``, all of one length; None if no component has variance."""
    fit_list = stored(vectors.select("x").distinct())
    by_task = stored(fit_list.mapInArrow(_summing, "n bigint, sums array<bigint>"))
    n = by_task.agg(F.sum("n")).first()[0]
    fitted = None
    if n:
        summed = by_task.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()  # a row a dimension
        sums = np.array([r["value"] for r in summed], np.int64)
        lengths, turned = one_sided_jacobi(tsqr(fit_list, n, sums))
        # Beyond rounding: a triangle of d columns leaves that much in a column without variance.
        seen = min(components, int((lengths > lengths[0] * len(sums) * np.finfo(float).eps).sum())) if lengths[0] else 0
        if seen:
            largest = np.abs(turned).argmax(axis=0)
            turned = turned * np.sign(turned[largest, np.arange(turned.shape[1])])
            values = lengths**2 / n
            fitted = Whitening(n, sums, turned[:, :seen], values[:seen], values[:seen] / values.sum(), 0.0)
            fitted = Whitening(n, sums, fitted.components, fitted.eigenvalues, fitted.explained, _identity_error(fit_list, fitted))
    forget(by_task, fit_list)
    return fitted


def _whitening(fitted: Whitening):
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                rows = batch.slice(at, BLOCK_ROWS)
                x = _matrix(rows.column(1))
                off = fitted.n * x - fitted.sums
                if (off.astype(float) ** 2).sum(axis=1).max() >= 2.0**63 * (1 - 1e-9):
                    raise OverflowError("a deviation that no long holds")
                z = fitted.project(x)
                each = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array((off * off).sum(axis=1)), each], names=["_row", "deviation", "whitened"])

    return whiten


def whiten(table: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The rows that remain with ``deviation`` and ``whitened`` (an array by component), and the fit."""
    spark = table.sparkSession
    own = [c for c in table.columns if c not in ("deviation", "whitened")]
    rows = table.select(F.struct(*own).alias("_row"), whole_vector(F.col(vector_col)).alias("x")).where("x is not null")
    length = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    rows = rows.where(F.size("x") == (length["size"] if length else 0))
    fitted = fit(rows, components=components) if length and length["size"] else None
    kind = T.StructType([rows.schema["_row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    made = spark.createDataFrame([], kind) if fitted is None else rows.mapInArrow(_whitening(fitted), kind)
    return made.select(*[f"_row.`{c}`" for c in own], "deviation", "whitened"), fitted


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, fitted = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(float(x)) for x in fitted.explained]) if fitted else F.array().cast("array<double>")
    each = made.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n if fitted else 0).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(fitted.identity_error if fitted else 0.0).alias("identity_error"),
    )
