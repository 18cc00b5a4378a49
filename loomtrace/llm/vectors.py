"""Vectors as whole numbers, and their rows in Arrow batches as numpy matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Doubles hold whole numbers exactly below this bound; so do all products that `exact` lets through.
EXACT = 2**53


def scaled(df: DataFrame, factor: int, offset: int = 0, keep: Sequence[str] = ("vec_id",), vector: str = "embedding") -> DataFrame:
    """The columns of `keep` and `v`, the entries as floor(factor * entry) + offset, worked out in doubles.

    Rows whose vector is null or empty, or holds null or non-finite entries, are left out. An entry whose product is 2**53 or
    more has no exact whole number and is an error.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = lambda x: F.when(F.abs(x.cast("double") * factor) < EXACT, F.floor(x.cast("double") * factor) + offset).otherwise(
        F.raise_error(F.lit("a vector entry is too large")).cast("bigint")
    )
    rows = df.select(*keep, vector).where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    return rows.select(*keep, F.transform(vector, whole).alias("v"))


def shape(vectors: DataFrame) -> tuple[int, int]:
    """Number of vectors and their one width (0 without vectors); several widths are an error."""
    n, least, most = vectors.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} entries cannot be compared")
    return n, most or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of whole numbers without nulls, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether dot products and squared distances between rows of `a` and `b` stay exact in doubles."""
    largest = max((int(np.abs(x).max()) if x.size else 0) for x in (a, b))
    return 4 * largest * largest * a.shape[1] < EXACT


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows, exact at any size."""
    if exact(a, b):
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between whole-number rows, exact at any size."""
    if exact(a, b):
        a, b = a.astype(float), b.astype(float)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    a, b = a.astype(object), b.astype(object)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
