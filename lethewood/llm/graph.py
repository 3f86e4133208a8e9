"""Connected components of a large sparse graph, by random contraction.

Every round each node adopts the smallest node of its closed neighbourhood under a fresh
random order, and the edges are rewritten to the adopted nodes. A constant share of the nodes
disappears each round, whatever the shape of the graph. The random order is ``xxhash64`` of
the id, which is one-to-one on 64-bit integers, so nodes never merge by accident.

A node with very many edges costs one partially aggregated minimum; the two joins that rewrite
edges are plain equi-joins, which adaptive execution splits when one key is hot. No round
broadcasts a table: every broadcast is built by a thread of the driver, whose memory stays taken.
Edges that are few, at the start or after some rounds, are joined in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethewood.sources.scratch import Scratch

# So many edges are joined in one task.
FEW = 1 << 17


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) of all nodes of the edges (u, v): nodes that a path joins have one ``to``."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    columns = [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())]
    yield pa.RecordBatch.from_arrays(columns, names=["node", "to"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges``: (u bigint, v bigint), repeats and self-loops allowed. Returns (node, label):
    two nodes have the same label if and only if a path joins them. Rows with a null end are
    ignored; an empty table gives an empty table."""
    current = scratch.write(edges.select("u", "v").where("u <> v").distinct(), "edges")
    nodes = current.select(F.col("u").alias("node")).union(current.select(F.col("v").alias("node")))
    labels = nodes.distinct().withColumn("label", F.col("node"))
    while edges_left := current.count():
        if edges_left <= FEW:
            found = current.coalesce(1).mapInArrow(_join_edges, "node bigint, to bigint")
            found = scratch.write(found.withColumnRenamed("node", "label"), "adopted")
            labels = labels.join(found.hint("merge"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            return scratch.write(labels, "labels")
        mixed = current.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v"))
        both = mixed.union(mixed.select(F.col("v").alias("u"), F.col("u").alias("v")))
        adopted = scratch.write(
            both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")),
            "adopted",
        )
        left = adopted.select("u", F.col("to").alias("new_u")).hint("merge")
        right = adopted.select(F.col("u").alias("v"), F.col("to").alias("new_v")).hint("merge")
        current = scratch.write(
            mixed.join(left, "u")
            .join(right, "v")
            .where("new_u <> new_v")
            .select(F.least("new_u", "new_v").alias("u"), F.greatest("new_u", "new_v").alias("v"))
            .distinct(),
            "edges",
        )
        labels = scratch.write(
            labels.withColumn("label", F.xxhash64("label"))
            .join(adopted.select(F.col("u").alias("label"), "to").hint("merge"), "label", "left")
            .select("node", F.coalesce("to", "label").alias("label")),
            "labels",
        )
    return labels
