"""Vector codes: every part of a vector is replaced by the number of its nearest codebook entry.

Vectors are integers (``integer_vectors``), so codebooks, codes and errors are exact and do not
depend on how rows are dealt to tasks. A round sends the codebooks to the tasks, which find
every part's nearest entry with exact limb products, add up the parts of each entry, and return
one row per codebook number; Spark adds these up. A codebook has a fixed size, so what
reaches the driver does not grow with the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lethewood.llm.integer_vectors import exact_products, integer_vectors, matrix, squared_lengths
from lethewood.sources.scratch import Scratch

BATCH_ROWS = 8192
HEAVY_SHARE = 1000


@dataclass(frozen=True)
class Codebooks:
    """(part, entry, position) integers."""

    entries: np.ndarray

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances), each (row, part), of the nearest entries; ties go to the
        lower number. ``q`` has (row, part, position)."""
        codes = np.zeros(q.shape[:2], np.int64)
        far = np.zeros(q.shape[:2], np.int64)
        for part, entries in enumerate(self.entries):
            x = np.ascontiguousarray(q[:, part])
            off = squared_lengths(entries)[None, :] - 2 * exact_products(x, entries)
            codes[:, part] = off.argmin(axis=1)
            far[:, part] = off[np.arange(len(x)), codes[:, part]] + squared_lengths(x)
        return codes, far

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _parts(column: pa.Array, dims: int, parts: int) -> np.ndarray:
    """(row, part, position); missing positions of the last part are zero."""
    q = matrix(column, dims)
    width = -(-dims // parts)
    return np.pad(q, ((0, 0), (0, width * parts - dims))).reshape(len(q), parts, width)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, BATCH_ROWS):
            yield whole.slice(at, BATCH_ROWS)


def _improved(rows: DataFrame, dims: int, books: Codebooks) -> Codebooks:
    """Every entry replaced by the floor of the mean of its parts; unused ones stay."""
    parts, size, width = books.entries.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Position 0 counts the parts.
        sums = np.zeros((parts, size, width + 1), np.int64)
        for batch in _pieces(batches):
            q = _parts(batch.column(0), dims, parts)
            codes, _ = books.nearest(q)
            for part in range(parts):
                np.add.at(sums[part, :, 0], codes[:, part], 1)
                np.add.at(sums[part, :, 1:], codes[:, part], q[:, part])
        used = np.repeat(sums[:, :, :1] > 0, width + 1, axis=2)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(index.astype(np.int32)) for index in np.nonzero(used)), pa.array(sums[used])],
            names=["part", "entry", "position", "total"],
        )

    summed = (
        rows.select("q")
        .mapInArrow(add_up, "part int, entry int, position int, total bigint")
        .groupBy("part", "entry", "position")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    )
    totals = {(r["part"], r["entry"], r["position"]): int(r["total"]) for r in summed.collect()}
    entries = books.entries.copy()
    for (part, entry, position), total in totals.items():
        if position:
            entries[part, entry, position - 1] = total // totals[part, entry, 0]
    return Codebooks(entries)


def compress(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    keep: Sequence[str] = (),
    parts: int = 8,
    size: int = 16,
    rounds: int = 6,
    scale: int = 4096,
) -> tuple[DataFrame, Codebooks]:
    """(``id_col``, the columns of ``keep``, ``code`` array<int>, ``error`` bigint) per vector, and
    the codebooks.

    Components become floor(scale * x); a vector is cut into ``parts`` equal parts (filled up with
    zeros). The codebooks start as the parts of the ``size`` smallest ids (of rows with one id, the
    smallest vector; fewer ids, fewer entries) and are improved ``rounds`` times. ``error`` is the
    squared distance to the entries chosen. Which vectors take part says ``integer_vectors``; rows
    without an id are coded, but do not start a codebook; repeated rows count as often as they
    occur. An empty table gives no rows and empty codebooks. Columns that are not named are not
    read; one of ``keep`` named ``code`` or ``error`` is left out.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    keep = tuple(name for name in keep if name not in ("code", "error"))
    found, dims = integer_vectors(vectors, id_col, vector_col, scale, keep=keep)
    rows = scratch.write(found, "vectors")
    by_id = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("q").alias("q"))
    first = [r["q"] for r in by_id.orderBy("id").limit(size).collect()] if dims else []
    width = -(-dims // parts)
    start = np.zeros((len(first), parts * width), np.int64)
    if first:
        start[:, :dims] = first
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, width).transpose(1, 0, 2)))
    if first:
        for _ in range(rounds):
            books = _improved(rows, dims, books)

    kinds = {field.name: field.dataType for field in rows.schema.fields}
    schema = StructType(
        [
            StructField(id_col, LongType()),
            *(StructField(name, kinds[f"k{i}"]) for i, name in enumerate(keep)),
            StructField("code", ArrayType(IntegerType())),
            StructField("error", LongType()),
        ]
    )
    if not first:
        return spark.createDataFrame([], schema), books

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            codes, far = books.nearest(_parts(batch.column(0), dims, parts))
            ends = np.arange(0, codes.size + 1, parts, dtype=np.int32)
            numbers = pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], numbers, pa.array(far.sum(axis=1))], names=schema.names
            )

    carried = [f"k{i}" for i in range(len(keep))]
    return rows.select("q", "id", *carried).mapInArrow(assign, schema), books


def with_group_sum(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over all rows with an equal ``key`` (nulls are equal);
    null if a bigint cannot hold it.

    Keys with over a thousandth of all rows, fewer than a thousand, go by broadcast, so no task
    gets a hot key; the others meet their sum by a shuffle."""
    scratch = Scratch(rows.sparkSession)
    rows = scratch.write(rows, "rows")
    total = F.sum(F.col(value).cast("decimal(38,0)"))
    sums = scratch.write(
        rows.groupBy(F.col(key).alias("_key")).agg(total.try_cast("bigint").alias("_sum"), F.count(F.lit(1)).alias("_n")),
        "sums",
    )
    heavy = F.col("_n") * HEAVY_SHARE > rows.count()
    on = F.col(key).eqNullSafe(F.col("_key"))
    often = F.broadcast(sums.where(heavy))
    parts = (
        rows.join(often, on),
        rows.join(F.broadcast(sums.where(heavy).select("_key")), on, "left_anti").join(sums.where(~heavy), on),
    )
    given = [name for name in rows.columns if name != out]
    found = [part.select(*given, F.col("_sum").alias(out)) for part in parts]
    return found[0].unionByName(found[1])
