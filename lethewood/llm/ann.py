"""Approximate nearest neighbours by cross-polytope hashing.

A table turns vectors by three rounds of random signs and a fast Hadamard transform and files
each row under the signed axis it points to most. A query looks at the axes it points to most
(multiprobe) in every table; what it meets there is scored exactly in double precision.

A bucket is searched in cells: its rows are dealt into chunks, its queries into chunks, and
each pair of chunks is one group whose size is bounded, so a bucket with a third of all rows
is just more cells. All rows of a probed bucket are scored; nothing is capped. A cell
answers with the best ``k`` of its rows for each of its queries.

The largest inner product is wanted. For vectors of different lengths one more coordinate
makes all rows equally long, which keeps the order of inner products; for vectors of one
length it would be zero and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lethewood.sources.scratch import Scratch


@dataclass(frozen=True)
class Search:
    k: int = 20
    tables: int = 10
    probes: int = 16
    seed: int = 7
    chunk_rows: int = 4096
    chunk_queries: int = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    rows, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(rows, size // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        x = x.reshape(rows, size)
        half *= 2
    return x / np.sqrt(size)


def directions(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    """How far each row points along every signed axis of a table's rotation."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    turned = np.zeros((len(x), size))
    turned[:, : x.shape[1]] = x
    random = np.random.default_rng([seed, table])
    for _ in range(3):
        turned = hadamard(turned * random.choice([-1.0, 1.0], size))
    return np.concatenate([turned, -turned], axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, float, bool]:
    """(id, v) of the rows that take part, their dimension, largest length, and whether lengths
    differ. The dimension is that of most rows (the smaller one if tied)."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).where(
        v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
        & F.exists(v, lambda c: c != 0)
        & F.col("id").isNotNull()
    )
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    by_size = rows.groupBy(F.size(v).alias("dims")).agg(
        F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest"), F.min(norm).alias("shortest")
    )
    top = by_size.orderBy(F.desc("n"), "dims").first()
    if top is None:
        return rows, 0, 0.0, False
    spread = top["longest"] - top["shortest"] > 1e-6 * top["longest"]
    return rows.where(F.size(v) == top["dims"]), top["dims"], top["longest"], spread


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    search: Search = Search(),
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for every row of ``queries`` its ``k`` best of the
    rows of ``vectors`` found, largest inner product first, ties to the smaller id.

    Both tables have (id, vector). Vectors that are null, zero, of another length than most, or
    hold null or non-finite components take no part, nor do rows without an id. A query is
    never its own answer; an id that occurs twice with one vector answers once. Empty tables
    give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows, dims, longest, spread = usable(vectors, id_col, vector_col)
    v = F.col("v")
    asked = queries.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    if not dims:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = usable(asked, "id", "v")[0].where(F.size(v) == dims)
    kind = dict(rows.dtypes)["v"]

    def unit(x: np.ndarray, query: bool) -> np.ndarray:
        if not spread:
            return x
        if query:
            return np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
        x = x / longest
        return np.column_stack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(axis=1)))])

    def filed(query: bool, payload: bool):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    batch = whole.slice(at, 2048)
                    x = unit(_matrix(batch.column(1), dims), query)
                    for table in range(search.tables):
                        along = directions(x, table, search.seed)
                        if query:
                            axes = np.argsort(-along, axis=1, kind="stable")[:, : search.probes]
                        else:
                            axes = along.argmax(axis=1)[:, None]
                        take = pa.array(np.repeat(np.arange(len(x)), axes.shape[1]))
                        picked = batch.take(take) if payload else batch.select([0]).take(take)
                        places = pa.array((table * (1 << 20) + axes.ravel()).astype(np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [places, *picked.columns], names=["place", *picked.schema.names]
                        )

        return scan

    def file(source: DataFrame, query: bool, payload: bool) -> DataFrame:
        schema = "place int, id bigint" + (f", v {kind}" if payload else "")
        return source.select("id", "v").mapInArrow(filed(query, payload), schema)

    # Bucket sizes: at most two per dimension and table, whatever the number of rows.
    chunks = scratch.write(
        file(rows, False, False)
        .groupBy("place")
        .agg(F.ceil(F.count(F.lit(1)) / search.chunk_rows).cast("int").alias("row_chunks"))
        .join(
            file(asked, True, False)
            .groupBy("place")
            .agg(F.ceil(F.count(F.lit(1)) / search.chunk_queries).cast("int").alias("query_chunks")),
            "place",
        ),
        "chunks",
    )
    draw = F.xxhash64("id")

    def cells(filed_rows: DataFrame, own: str, other: str) -> DataFrame:
        number = F.sequence(F.lit(0), F.col(f"{other}_chunks") - 1)
        return filed_rows.join(F.broadcast(chunks), "place").select(
            "place",
            F.pmod(draw, F.col(f"{own}_chunks")).cast("int").alias(f"{own}_chunk"),
            F.explode(number).alias(f"{other}_chunk"),
            F.lit(own == "query").alias("query"),
            "id",
            "v",
        )

    both = cells(file(rows, False, True), "row", "query").unionByName(
        cells(file(asked, True, True), "query", "row")
    )

    def score(cell: pa.Table) -> pa.Table:
        asks = cell.column("query").to_numpy()
        x = _matrix(cell.column("v"), dims)
        ids = cell.column("id").to_numpy()
        q, c, qid, cid = x[asks], x[~asks], ids[asks], ids[~asks]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(q) and len(c):
            rough = q @ c.T
            rough[qid[:, None] == cid[None, :]] = -np.inf
            k = min(search.k, len(c))
            # A margin for rounding: the exact score below decides, in one order of adding up.
            margin = 1e-9 * (1 + np.abs(rough).max(axis=1, where=np.isfinite(rough), initial=0.0))
            last = np.partition(rough, len(c) - k, axis=1)[:, len(c) - k] - margin
            for row in range(len(q)):
                some = np.flatnonzero((rough[row] >= last[row]) & np.isfinite(rough[row]))
                exact = (c[some] * q[row]).sum(axis=1)
                best = np.lexsort((cid[some], -exact))[: search.k]
                out.append((np.full(len(best), qid[row]), cid[some][best], exact[best]))
        columns = [np.concatenate(part) for part in zip(*out, strict=True)] if out else [[], [], []]
        return pa.table(
            {
                "query_id": pa.array(columns[0], pa.int64()),
                "vec_id": pa.array(columns[1], pa.int64()),
                "score": pa.array(columns[2], pa.float64()),
            }
        )

    answers = both.groupBy("place", "row_chunk", "query_chunk").applyInArrow(
        score, "query_id bigint, vec_id bigint, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        answers.withColumn("rank", F.dense_rank().over(order))
        .where(F.col("rank") <= search.k)
        .groupBy("query_id", "rank")
        .agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))
        .select("query_id", "rank", "vec_id", "score")
    )
