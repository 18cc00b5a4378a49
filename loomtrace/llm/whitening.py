"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The matrix A has the centred vectors as rows and is never held: every step is one pass over the vectors that makes u = A p and,
with the same rows, A^T u, the squared length of u and its products with all earlier left vectors. Left vectors lie in the range
of A, so each is kept as the combination p of columns that makes it; nothing grows per row. Right vectors are kept whole. Both are
reorthogonalised against all earlier ones. With as many steps as the vectors have entries, A V = U B holds with V square, and the
singular value decomposition of the small bidiagonal B gives all components and deviations, repeated ones included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written
from .vectors import matrix, scaled, shape

SCALE, OFFSET = 64, 1_000_000
#: A direction with less than this share of the whole length counts as without variance.
NOTHING = 1e-13


class Centring:
    """Count, sums and squares of whole-number vectors, exact; n*x - S of a batch, exact; x - S/n rounded once."""

    def __init__(self, n: int, sums: list[int], squares: list[int], largest: int):
        self.n, self.sums, self.width = n, sums, len(sums)
        #: n^2 times the trace of the covariance.
        self.spread = sum(n * q - s * s for q, s in zip(squares, sums, strict=True))
        #: Products stay within 64 bits; beyond that Python's whole numbers are used.
        self.kind = np.int64 if self.width * (2 * n * (largest + 1)) ** 2 < 2**63 else object

    def whole(self, v: np.ndarray) -> np.ndarray:
        return v.astype(self.kind) * self.n - np.array(self.sums, dtype=self.kind)

    def centred(self, v: np.ndarray) -> np.ndarray:
        return self.whole(v).astype(float) / self.n


def _totals(rows: DataFrame, width: int, amount: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, float | Decimal]:
    """Sums over all rows of what `amount` makes of a batch's vectors: one row per task and place, added up by Spark."""
    decimal = kind != "double"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = amount(matrix(batch.column("v"), width))
                total = made if total is None else total + made
        if total is not None:
            values = pa.array([Decimal(int(x)) for x in total], pa.decimal128(38, 0)) if decimal else pa.array(total, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), values], names=["place", "amount"])

    partial = rows.select("v").mapInArrow(add, f"place int, amount {kind}")
    return dict(partial.groupBy("place").agg(F.sum("amount").cast(kind).alias("amount")).collect())


def _list(totals: dict[int, float | Decimal]) -> np.ndarray:
    return np.array([totals[k] for k in range(len(totals))])


def centring(rows: DataFrame) -> Centring:
    """One pass for count and width, one for sums and squares per entry."""
    n, width = shape(rows)
    if not n:
        return Centring(0, [], [], 0)

    def amount(v: np.ndarray) -> np.ndarray:
        v = v.astype(object) if v.size and len(v) * int(np.abs(v).max()) ** 2 >= 2**62 else v
        return np.concatenate([v.sum(axis=0), (v * v).sum(axis=0)]).astype(object)

    both = [int(x) for x in _list(_totals(rows, width, amount, "decimal(38,0)"))]
    largest = rows.agg(F.max(F.greatest(F.abs(F.array_min("v")), F.abs(F.array_max("v"))))).first()[0]
    return Centring(n, both[:width], both[width:], largest)


def bidiagonalise(rows: DataFrame, centre: Centring) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): orthonormal right vectors as columns, and the upper bidiagonal matrix with A V = U B."""
    width, small = centre.width, NOTHING * float(np.sqrt(centre.spread / centre.n))
    right, upper = np.zeros((width, 0)), np.zeros((width, width))
    made_by, back = np.zeros((width, 0)), np.zeros((width, 0))  # p and A^T u of every left vector
    random = np.random.default_rng(7)

    def apart(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - basis @ (basis.T @ x)
        return x

    def another() -> np.ndarray:
        x = apart(random.standard_normal(width), right)
        x = apart(x / np.linalg.norm(x), right)
        return x / np.linalg.norm(x)

    v, beta = another(), 0.0
    for k in range(width):
        right = np.column_stack([right, v])
        p = v - (beta * made_by[:, k - 1] if k else 0)

        def amount(x: np.ndarray, p: np.ndarray = p, earlier: np.ndarray = made_by) -> np.ndarray:
            x = centre.centred(x)
            u = x @ p
            return np.concatenate([x.T @ u, (x @ earlier).T @ u, [u @ u]])

        got = _list(_totals(rows, width, amount, "double"))
        z, overlap, length = got[:width], got[width:-1], got[-1]
        p, z = p - made_by @ overlap, z - back @ overlap
        alpha = float(np.sqrt(max(0.0, length - overlap @ overlap)))
        if alpha <= small:
            alpha, p, z = 0.0, np.zeros(width), np.zeros(width)
        else:
            p, z = p / alpha, z / alpha
        made_by, back = np.column_stack([made_by, p]), np.column_stack([back, z])
        upper[k, k] = alpha
        if k + 1 < width:
            rest = apart(z - alpha * v, right)
            beta = float(np.linalg.norm(rest))
            if beta <= small:
                v, beta = another(), 0.0
            else:
                v = apart(rest / beta, right)
                v = v / np.linalg.norm(v)
            upper[k, k + 1] = beta
    return right, upper


def whiten(vectors: DataFrame, components: int = 32, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error) of every vector and component.

    Entries become x = floor(64 * entry) + 1000000; all statistics are over all remaining vectors with divisor n. Components are
    numbered from 1 by falling variance. Those without variance (also: one row, equal rows, fewer entries than asked for) are not
    there. `deviation` is a decimal of 38 digits, as n*x squared outgrows 64 bits. Vectors that are null, empty or hold null or
    non-finite entries give no rows, as does an empty table; several widths are an error. Equal vectors, ids that repeat and null
    ids give a row each. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    key = vectors.schema[id].dataType
    names = T.StructType(
        [T.StructField(id, key), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0))]
        + [T.StructField(name, T.DoubleType()) for name in ("whitened", "explained", "identity_error")]
    )
    rows = written(scaled(vectors, SCALE, OFFSET, [id], vector).select(F.col(id).alias("key"), "v"), "vectors")
    centre = centring(rows)
    if not centre.spread:
        return spark.createDataFrame([], names)
    right, upper = bidiagonalise(rows, centre)
    _, deviations, turned = np.linalg.svd(upper)
    kept = int(min(components, (deviations > NOTHING * np.sqrt(centre.spread / centre.n)).sum()))
    axes = right @ turned[:kept].T
    variance = deviations[:kept] ** 2 / centre.n
    to_unit = axes / np.sqrt(variance)
    explained = variance / (centre.spread / centre.n**2)

    def products(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ to_unit
        return (w.T @ w).ravel()

    covariance = _list(_totals(rows, centre.width, products, "double")).reshape(kept, kept) / centre.n
    error = float(np.abs(covariance - np.eye(kept)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v, m = matrix(part.column("v"), centre.width), part.num_rows
                whole = centre.whole(v)
                length = (whole * whole).sum(axis=1)
                lengths = pa.array([Decimal(int(x)) for x in length], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(m), kept))
                columns = [
                    part.column("key").take(each),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * kept, centre.n, np.int64)),
                    lengths.take(each),
                    pa.array((centre.centred(v) @ to_unit).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * kept, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names.names)

    return rows.mapInArrow(project, names)
