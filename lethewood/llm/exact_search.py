"""Exact top-k search by largest inner product, with a table of distances to pivots.

Every row's distances to a fixed number of pivots are computed once and written beside it. By the
triangle inequality the largest difference of two rows' pivot distances is a lower bound of their
own distance, and as ``2 q.c = |q|^2 + |c|^2 - |q - c|^2`` it is an upper bound of their product.

Rows are filed in cells under the nearest of some leaders; a cell's smallest and largest pivot
distances bound the products of all its rows. A query first searches the cells of largest bound
that hold enough rows. The score of its k-th best there is a floor: cells whose bound
is below it are eliminated, and in the others candidates are evaluated in the order of
their bounds until the next bound is below the k-th best score. What is left out can
provably not be an answer.

A cell is searched in blocks of rows and of queries, so every group has a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lethewood.llm.integer_vectors import exact_products, integer_vectors, lists, matrix, squared_lengths
from lethewood.sources.scratch import Scratch

ANSWERS = "query_id bigint, rank int, vec_id bigint, score bigint"
SLAB = 256
# Square roots and their differences are off by far less than this share of the squared lengths.
ROUNDING = 1e-12


@dataclass(frozen=True)
class PivotTable:
    """``pivots`` bound, ``block_rows`` and ``block_queries`` size the groups, ``most_cells`` limits
    what the driver keeps of the cells. None of them changes an answer."""

    pivots: int = 32
    block_rows: int = 4096
    block_queries: int = 512
    most_cells: int = 1024


@dataclass(frozen=True)
class Cells:
    """Per cell: rows, largest squared length, and range of every pivot distance."""

    numbers: np.ndarray
    rows: np.ndarray
    longest: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, away: np.ndarray, length: int) -> np.ndarray:
        """For one query, a number no product with a row of the cell exceeds."""
        apart = np.maximum(np.maximum(away - self.high, self.low - away), 0.0).max(axis=1)
        return upper_bounds(apart, self.longest, length)


def upper_bounds(apart: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """Largest products that rows of some squared lengths can have with a query, when they are at
    least ``apart`` from it; rounded up."""
    both = lengths + float(length)
    return (both - apart * apart) / 2 + ROUNDING * both + 1


def _pivot_distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distances to the pivots, squared lengths) of the rows."""
    lengths = squared_lengths(x)
    squares = lengths[:, None] + squared_lengths(pivots)[None, :] - 2 * exact_products(x, pivots)
    return np.sqrt(squares.astype(np.float64)), lengths


def best_of_block(
    q: np.ndarray, away: np.ndarray, length: int, own: int, floor: int | None,
    ids: np.ndarray, vectors: np.ndarray, distances: np.ndarray, lengths: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of one query's ``k`` best rows of a block, best first, none below ``floor``."""
    bound = upper_bounds(np.abs(distances - away).max(axis=1), lengths, length)
    some = np.flatnonzero((ids != own) & (True if floor is None else bound >= floor))
    some = some[np.argsort(-bound[some], kind="stable")]
    found, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, len(some), SLAB):
        least = scores[k - 1] if len(scores) >= k else floor
        if least is not None and bound[some[at]] < least:
            break
        slab = some[at : at + SLAB]
        found = np.concatenate([found, ids[slab]])
        scores = np.concatenate([scores, vectors[slab] @ q])
        order = np.lexsort((found, -scores))[:k]
        found, scores = found[order], scores[order]
    if floor is not None:
        found, scores = found[scores >= floor], scores[scores >= floor]
    return found, scores


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    table: PivotTable = PivotTable(),
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for every row of ``queries`` the ``k`` rows of
    ``vectors`` with the largest inner product of floor(scale * x), ties to the smaller id.

    Which vectors take part says ``integer_vectors``; queries need as many components as the
    vectors. Rows without an id take no part. Rows with the query's id are never its answers; a
    repeated row is an answer as often as it occurs; a repeated query is asked once, and the
    answers of queries that differ under one id share one ranking. Fewer rows than ``k`` are all
    returned; empty tables give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows, dims = integer_vectors(vectors, id_col, vector_col, scale)
    if not dims:
        return spark.createDataFrame([], ANSWERS)
    rows = rows.where("id IS NOT NULL")
    asked, _ = integer_vectors(queries, id_col, vector_col, scale, dims=dims)
    count = rows.count()
    leaders = min(table.most_cells, -(-count // table.block_rows))
    chosen = rows.orderBy(F.xxhash64("id", "q"), "id", "q").limit(max(table.pivots, leaders)).collect()
    if not chosen:
        return spark.createDataFrame([], ANSWERS)
    points = np.array([r["q"] for r in chosen], np.int64)
    pivots, leading = points[: table.pivots], points[:leaders]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for whole in batches:
            for at in range(0, whole.num_rows, table.block_rows):
                batch = whole.slice(at, table.block_rows)
                x = matrix(batch.column(1), dims)
                yield batch, x, *_pivot_distances(x, pivots)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, away, lengths in pieces(batches):
            cell = (squared_lengths(leading)[None, :] - 2 * exact_products(x, leading)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), *batch.columns, lists(away), pa.array(lengths)],
                names=["cell", "id", "q", "away", "length"],
            )

    fields = "id bigint, q array<int>, away array<double>, length bigint"
    filed = scratch.write(rows.select("id", "q").mapInArrow(measured, f"cell int, {fields}"), "pivots")
    ends = [f(F.get("away", F.lit(i))).alias(f"{n}{i}") for n, f in (("l", F.min), ("h", F.max)) for i in range(len(pivots))]
    summary = filed.groupBy("cell").agg(F.count(F.lit(1)), F.max("length"), *ends).orderBy("cell").collect()
    whole = np.array([r[1:] for r in summary], np.float64)
    cells = Cells(
        np.array([r["cell"] for r in summary]),
        whole[:, 0],
        whole[:, 1],
        whole[:, 2 : 2 + len(pivots)],
        whole[:, 2 + len(pivots) :],
    )
    blocks = F.expr(f"CAST(ceil(n / {table.block_rows}) AS INT)")
    sizes = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", blocks.alias("row_blocks"))

    def pick(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """The cells a query searches first, or those it has to search after them."""
        for batch, _, away, lengths in pieces(batches):
            ask, floors = batch.column(2), batch.column(3).to_pylist()
            owner: list[np.ndarray] = []
            cell: list[np.ndarray] = []
            for row in range(batch.num_rows):
                bound = cells.bounds(away[row], int(lengths[row]))
                order = np.argsort(-bound, kind="stable")
                # Enough rows for k answers without the query's own.
                begin = 1 + int(np.searchsorted(np.cumsum(cells.rows[order]), k + 1))
                order = order[:begin] if first else order[begin:]
                if not first and floors[row] is not None:
                    order = order[bound[order] >= floors[row]]
                owner.append(np.full(len(order), row))
                cell.append(cells.numbers[order])
            take = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(cell).astype(np.int32)),
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    lists(away).take(take),
                    pa.array(lengths).take(take),
                    ask.take(take),
                    batch.column(3).take(take),
                ],
                names=["cell", "id", "q", "away", "length", "ask", "floor"],
            )

    def search(cell: pa.Table) -> pa.Table:
        order = pa.compute.is_valid(cell.column("ask")).to_numpy()
        x, away = matrix(cell.column("q"), dims), matrix(cell.column("away"), len(pivots), np.float64)
        ids, lengths = cell.column("id").to_numpy(), cell.column("length").to_numpy()
        floors, asks = cell.column("floor").to_pylist(), cell.column("ask").to_pylist()
        block = (ids[~order], x[~order], away[~order], lengths[~order])
        out: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64),) * 4]
        for row in np.flatnonzero(order):
            found, scores = best_of_block(x[row], away[row], int(lengths[row]), ids[row], floors[row], *block, k)
            out.append((np.full(len(found), asks[row]), np.full(len(found), ids[row]), found, scores))
        return pa.table(
            [pa.array(np.concatenate(part), pa.int64()) for part in zip(*out, strict=True)],
            names=["ask", "query_id", "vec_id", "score"],
        )

    def answers(asking: DataFrame) -> DataFrame:
        asking = scratch.write(asking, "asking")
        wanted = asking.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / table.block_queries).cast("int").alias("query_blocks"))
        plan = F.broadcast(scratch.write(sizes.join(wanted, "cell"), "plan"))  # a row per cell

        def dealt(part: DataFrame, own: str, other: str) -> DataFrame:
            number = F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)
            return part.join(plan, "cell").select(
                "cell",
                F.pmod(F.xxhash64("deal"), F.col(f"{own}_blocks")).cast("int").alias(f"{own}_block"),
                F.explode(number).alias(f"{other}_block"),
                *("id", "q", "away", "length", "ask", "floor"),
            )

        none = F.lit(None).cast("bigint")
        plain = filed.select("*", none.alias("ask"), none.alias("floor"), F.monotonically_increasing_id().alias("deal"))
        asking = asking.withColumn("deal", F.col("ask"))
        both = dealt(plain, "row", "query").unionByName(dealt(asking, "query", "row"))
        return both.groupBy("cell", "row_block", "query_block").applyInArrow(
            search, "ask bigint, query_id bigint, vec_id bigint, score bigint"
        )

    def best(found: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    asked = asked.where("id IS NOT NULL").select("id", "q").distinct()
    asked = scratch.write(asked.withColumn("ask", F.monotonically_increasing_id()), "queries")
    form = f"cell int, {fields}, ask bigint, floor bigint"
    no_floor = F.lit(None).cast("bigint").alias("floor")
    early = answers(asked.select("id", "q", "ask", no_floor).mapInArrow(lambda b: pick(b, True), form))
    early = scratch.write(best(early, "ask").drop("rank"), "early")
    floors = early.groupBy("ask").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    floors = floors.select("ask", F.when(F.col("n") >= k, F.col("floor")).alias("floor"))
    again = asked.join(floors, "ask", "left").select("id", "q", "ask", "floor")
    late = answers(again.mapInArrow(lambda b: pick(b, False), form))
    return best(early.unionByName(late), "query_id").select("query_id", "rank", "vec_id", "score")
