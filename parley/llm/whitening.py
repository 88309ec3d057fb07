"""Whitening of embeddings by mixed-precision eigenvectors of their covariance.

Vectors become whole numbers, so counts, sums and cross products are exact at any number of
rows: a task multiplies limbs of 20 bits in doubles without rounding, and Spark adds the
products per pair of dimensions. What reaches the driver is one sum per pair of dimensions,
whatever the number of rows.

The eigenvectors start from a single-precision solve. Iterations of matrix products in extended
precision (Ogita and Aishima) then correct them all at once: each step adds ``x @ e`` where ``e``
holds the defects of orthogonality and of diagonality over the gaps of the eigenvalues. Gaps
under the step's own error bound are clusters; the covariance, projected on a cluster and shifted
by its mean eigenvalue, is solved by itself and turns the cluster's vectors, so the next step
sees its true gaps.

Defined cases: a row is left out if its vector is null, empty, or holds a null or non-finite
entry; where lengths differ, the most frequent one counts (of equals the longer) and other rows
are left out; entries beyond 2^62 after scaling count as 2^62; a repeated vector counts once in
the fit, and every row is returned; a component without variance (to rounding) is not returned,
so one distinct vector alone or an empty table give no rows; a deviation beyond 64 bits is null;
null and repeated ids stay as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, OFFSET, LIMIT = 64.0, 1_000_000, 1 << 62
COMPONENTS = 16
#: Bits of a limb, and rows of a block: products of limbs add up to less than 2^53.
LIMB, ROWS = 20, 8_192
#: Most steps of refinement; a well separated spectrum takes three or four.
STEPS = 20


def whole(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that count, ``x`` an array of longs of one length."""
    c = F.col(embedding)
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    entry = lambda e: F.greatest(F.least(F.floor(e.cast("double") * SCALE).cast("long"), F.lit(LIMIT)), F.lit(-LIMIT)) + OFFSET
    rows = embeddings.where(c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.transform(c, entry).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0].d if lengths else 0))


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def gram(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of longs as Python integers, without rounding."""
    d = y.shape[1]
    total = np.zeros((d, d), dtype=object)
    for a in range(0, len(y), ROWS):
        part = y[a : a + ROWS]
        most = max(int(part.max()), -int(part.min()))
        count = max(1, -(-most.bit_length() // LIMB))
        limbs = [((part >> (LIMB * k)) & ((1 << LIMB) - 1) if k < count - 1 else part >> (LIMB * k)).astype(np.float64) for k in range(count)]
        for i in range(count):
            for j in range(count):
                total += (limbs[i].T @ limbs[j]).astype(np.int64).astype(object) * (1 << (LIMB * (i + j)))
    return total


def exact_sums(df: DataFrame, of) -> dict[tuple[int, int], int]:
    """Sums over all rows of the integer matrix that ``of`` makes of a batch of vectors, by (i, j).

    Tasks add their own batches up; sums are cut into two parts so that none overflows.
    """
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", pa.decimal128(38, 0)), ("low", pa.decimal128(38, 0))])
    cut = 1 << 60

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.nonzero(np.tri(*total.shape, dtype=bool).T if total.shape[0] > 1 else np.ones(total.shape, dtype=bool))
            values = [int(v) for v in total[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(v // cut) for v in values], schema.field(2).type), pa.array([Decimal(v % cut) for v in values], schema.field(3).type)], schema=schema)

    parts = df.mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    return {(r.i, r.j): int(r.high) * cut + int(r.low) for r in parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}


class Fit:
    """Number of distinct vectors, exact sums, and the components in falling order of variance."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray):
        self.n, self.sums, self.covariance = n, sums, covariance
        value, vector = eigen(covariance)
        trace = np.trace(covariance)
        self.count = int(np.sum(value[:COMPONENTS] > trace * len(sums) * np.finfo(np.float64).eps))
        self.vectors = vector[:, : self.count].astype(np.float64)
        self.values = value[: self.count].astype(np.float64)
        self.explained = (value[: self.count] / trace).astype(np.float64) if self.count else np.zeros(0)
        #: The whole number next to each mean, and what the mean lies above it.
        self.near = np.array([round(Fraction(s, n)) for s in sums], dtype=np.int64)
        self.rest = [s - n * int(o) for s, o in zip(sums, self.near, strict=True)]
        self.turn = (vector[:, : self.count] / np.sqrt(value[: self.count])).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.near).astype(np.float64) - np.array([r / self.n for r in self.rest])) @ self.turn

    def deviation(self, x: np.ndarray) -> list[int | None]:
        y = x - self.near
        bound = self.n * max(int(y.max()), -int(y.min())) + max(abs(r) for r in self.rest)
        kind = np.int64 if bound * bound * len(self.sums) < 2**63 else object
        off = y.astype(kind) * (self.n if kind is object else np.int64(self.n)) - np.array(self.rest, dtype=kind)
        total = (off * off).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in total]


def clusters(value: np.ndarray, width: float) -> list[np.ndarray]:
    """Runs of indices whose sorted values follow each other within ``width``; single ones left out."""
    order = np.argsort(value)
    cuts = np.flatnonzero(np.diff(value[order]) > width) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix, in extended precision."""
    a = a.astype(np.longdouble)
    scale = np.abs(a).max() if a.size else 0
    if not scale:
        return np.zeros(len(a), dtype=np.longdouble), np.eye(len(a), dtype=np.longdouble)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye, fine = np.eye(len(a), dtype=np.longdouble), np.finfo(np.longdouble).eps * len(a)
    size = np.sqrt((a * a).sum())
    for _ in range(STEPS):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(value)
        width = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum()))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > width
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        if np.abs(e).max() < fine and np.abs(off).max() < fine:
            break
        for run in clusters(value, width):
            # the cluster's own problem: shifted, so that its digits go to the gaps inside
            part, _ = np.linalg.qr(x[:, run].astype(np.float64))
            part = part.astype(np.longdouble)
            part = part + part @ (np.eye(len(run)) - part.T @ part) / 2
            middle = value[run].mean()
            inner = part.T @ (a @ part) - middle * np.eye(len(run))
            inner = (inner + inner.T) / 2
            most = np.abs(inner).max()
            if most > 0:
                part = part @ np.linalg.eigh((inner / most).astype(np.float64))[1].astype(np.longdouble)
            x[:, run] = part
    for _ in range(2):
        x = x + x @ (eye - x.T @ x) / 2
    s = x.T @ (a @ x)
    value = np.diag(s) / np.diag(x.T @ x)
    order = np.argsort(-value, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return value[order] * scale, x


def extended(num: int, den: int) -> np.longdouble:
    """A ratio of whole numbers, rounded once to extended precision."""
    value = Fraction(num, den)
    first = float(value)
    return np.longdouble(first) + np.longdouble(float(value - Fraction(first)))


def fit(distinct: DataFrame) -> Fit | None:
    """``distinct``: column ``x``, each vector once. Exact sums, then products of what lies around them."""

    def sums_and_count(x: np.ndarray) -> np.ndarray:
        total = np.zeros((1, x.shape[1] + 1), dtype=object)
        total[0, 0] = len(x)
        total[0, 1:] = (x >> 31).sum(axis=0).astype(object) * (1 << 31) + (x & ((1 << 31) - 1)).sum(axis=0).astype(object)
        return total

    first = exact_sums(distinct, sums_and_count)
    if not first:
        return None
    n, sums = first[0, 0], [first[0, j] for j in range(1, len(first))]
    near = np.array([round(Fraction(s, n)) for s in sums], dtype=np.int64)
    rest = [s - n * int(o) for s, o in zip(sums, near, strict=True)]
    product = exact_sums(distinct, lambda x: gram(x - near))
    covariance = np.zeros((len(sums), len(sums)), dtype=np.longdouble)
    for (i, j), v in product.items():
        covariance[i, j] = covariance[j, i] = extended(n * v - rest[i] * rest[j], n * n)
    return Fit(n, sums, covariance)


def identity_error(distinct: DataFrame, held) -> float:
    """The largest absolute entry of the covariance of the whitened vectors less the identity, measured on all of them."""

    def sums(center: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for batch in batches:
                if batch.num_rows:
                    z = held.value.whitened(matrix(batch.column(0)))
                    total = total + (z.sum(axis=0)[None, :] if center is None else (z - center).T @ (z - center))
            if not isinstance(total, int):
                i, j = np.indices(total.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

        found = distinct.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        out = np.zeros((1 if center is None else len(center), held.value.count))
        for r in found:
            out[r.i, r.j] = r.v
        return out / held.value.n

    covariance = sums(sums(None)[0])
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def report(embeddings: DataFrame) -> DataFrame:
    """The columns of the registered query: a row for each vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    rows = written(whole(embeddings).select(F.col("vec_id").cast("long").alias("vec_id"), "x"))
    distinct = written(rows.select("x").distinct())
    found = fit(distinct)
    if found is None or not found.count:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(found)
    error = identity_error(distinct, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        k = model.count
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                m = len(x)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, dtype=np.int64)),
                        pa.array(model.deviation(x), pa.int64()).take(pa.array(each)),
                        pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(model.explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "x").mapInArrow(run, schema)
