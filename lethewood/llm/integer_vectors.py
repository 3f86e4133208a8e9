"""Vectors as integers, and exact products of them.

``exact_products`` multiplies integer matrices by float64 BLAS without a rounding error: the
factors are broken into limbs so narrow that every sum of products stays below 2**53, and the
limbs' products are put together again in int64.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EXACT_BITS = 53
_LARGEST_LONG = 2**63 - 1


def _limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """``x`` as a sum of limbs, the i-th times 2**(bits * i); all are below 2**bits in size."""
    parts: list[np.ndarray] = []
    while x.size and max(int(x.max()), -int(x.min())) >= 1 << bits:
        parts.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*parts, x.astype(np.float64)]


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of two integer matrices, exact wherever the result fits 64 bits."""
    width = max(1, a.shape[1])
    bits = (_EXACT_BITS - (width - 1).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    right = _limbs(b, bits)
    for i, left in enumerate(_limbs(a, bits)):
        for j, other in enumerate(right):
            out += (left @ other.T).astype(np.int64) << (bits * (i + j))
    return out


def squared_lengths(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def largest_component(dims: int) -> int:
    """Components up to this size keep squared distances of such vectors within 64 bits."""
    return isqrt(_LARGEST_LONG // (4 * max(1, dims)))


def integer_vectors(
    vectors: DataFrame, id_col: str, vector_col: str, scale: int, dims: int | None = None, keep: tuple[str, ...] = ()
) -> tuple[DataFrame, int]:
    """(id, q, k0, k1, ... for the columns of ``keep``) with q = floor(scale * x) of every component,
    and the number of components.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do those of
    another length than ``dims`` (by default that of most rows; the smaller one if tied) or with
    a component beyond ``largest_component``, whose distances 64 bits cannot hold.
    """
    v = F.col("v")
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(vector_col).alias("v"),
        *[F.col(name).alias(f"k{i}") for i, name in enumerate(keep)],
    ).where(v.isNotNull() & (F.size(v) > 0))
    rows = rows.where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))))
    if dims is None:
        top = rows.groupBy(F.size(v).alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        dims = top["dims"] if top else 0
    bound = float(largest_component(dims))
    rows = rows.where(F.size(v) == dims).where(
        F.forall(v, lambda c: F.abs(c.cast("double") * float(scale)) < bound)
    )
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * float(scale)).cast("int"))
    return rows.withColumn("v", whole).withColumnRenamed("v", "q"), dims


def matrix(column: pa.Array | pa.ChunkedArray, dims: int, kind: type = np.int64) -> np.ndarray:
    """A column of lists, all ``dims`` long, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a column of lists."""
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))
