"""The stored leaf map: every (sample, tree) at its leaf, clustered so that a subtree is a range.

A leaf's place is its heap number moved left to a fixed width, so all leaves below a node of depth
d lie between the node's number and the next one, moved alike. Files are split by tree and sorted
by place: reading the rows below a node opens one tree's files and, by their statistics, only the
row groups of its range.

A map is a list of append-only parts. Forgetting appends a row of weight -1 at the leaf, adding
one of weight +1, and regrowing both for every row that moved. A row counts where its weights add
up to one; rows of weight -1 carry no features. After some parts they are folded into one.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits as S
from ..operators.routing import NODE_DEPTH
from ..sources.scratch import Scratch

PLACE_BITS = 61
PART_SCHEMA = "place BIGINT, sample_id BIGINT, label BOOLEAN, features ARRAY<DOUBLE>, w INT, tree_id INT"
# A node's rows are looked up by the ranges of its ancestors of this depth, each cut to what is asked.
RANGE_DEPTH = 5
ROW_GROUP_BYTES = 8 * 1024 * 1024
PLACE = f"shiftleft(node_id, {PLACE_BITS} - {NODE_DEPTH})"
AFTER = f"shiftleft(node_id + 1, {PLACE_BITS} - {NODE_DEPTH})"


def at_depth(depth: int) -> Column:
    """The node of some depth on the way to a place. Places of shallower leaves give a node the model
    does not have."""
    return F.shiftright("place", PLACE_BITS - depth)


@dataclass(frozen=True)
class Ranges:
    """Places asked for, per tree: at most 2 ** RANGE_DEPTH ranges a tree, whatever the number of nodes."""

    by_tree: dict[int, list[tuple[int, int]]]

    @classmethod
    def of(cls, nodes: DataFrame) -> Ranges:
        placed = nodes.selectExpr("tree_id", f"{PLACE} AS lo", f"{AFTER} AS hi")
        cell = F.shiftright("lo", PLACE_BITS - RANGE_DEPTH)
        by_tree: dict[int, list[tuple[int, int]]] = {}
        for row in placed.groupBy("tree_id", cell).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
            by_tree.setdefault(row["tree_id"], []).append((row["lo"], row["hi"]))
        return cls({tree: sorted(ranges) for tree, ranges in sorted(by_tree.items())})

    def condition(self) -> Column:
        """A filter the scan can use: on the files by tree, on row groups by place."""
        trees = F.col("tree_id").isin(list(self.by_tree))
        inside = [
            (F.col("tree_id") == tree) & (F.col("place") >= lo) & (F.col("place") < hi)
            for tree, ranges in self.by_tree.items()
            for lo, hi in ranges
        ]
        return trees & _any(inside) if inside else F.lit(False)


def _any(conditions: list[Column]) -> Column:
    """Their disjunction, as a balanced tree."""
    while len(conditions) > 1:
        pairs = [conditions[i : i + 2] for i in range(0, len(conditions), 2)]
        conditions = [reduce(Column.__or__, pair) for pair in pairs]
    return conditions[0]


@dataclass(frozen=True)
class LeafMap:
    parts: tuple[str, ...]

    @classmethod
    def build(cls, at_leaves: DataFrame, scratch: Scratch) -> LeafMap:
        """``at_leaves``: tree_id, node_id, sample_id, label, features."""
        return cls((_write(at_leaves.withColumn("w", F.lit(1)), scratch),))

    def changed(self, changes: DataFrame, scratch: Scratch, fold_after: int) -> LeafMap:
        """With one more part: rows like those of ``build``, with their weight."""
        kept = LeafMap((*self.parts, _write(changes, scratch)))
        return kept if len(kept.parts) <= fold_after else kept.folded(scratch)

    def folded(self, scratch: Scratch) -> LeafMap:
        """The rows that count, in one part."""
        rows = self.rows(scratch.spark).withColumn("w", F.lit(1))
        return LeafMap((_write_places(rows, scratch),))

    def rows(self, spark: SparkSession, ranges: Ranges | None = None) -> DataFrame:
        """tree_id, place, sample_id, label, features of the rows that count, in some ranges."""

        def part(version: int, path: str) -> DataFrame:
            table = spark.read.schema(PART_SCHEMA).parquet(path)
            if ranges is not None:
                table = table.where(ranges.condition())
            return table.withColumn("v", F.lit(version))

        columns = ["tree_id", "place", "sample_id", "label", "features"]
        tables = [part(version, path) for version, path in enumerate(self.parts)]
        if not tables:
            return spark.createDataFrame([], PART_SCHEMA).select(*columns)
        if len(tables) == 1:
            return tables[0].select(*columns)
        newest = F.max_by(F.struct("label", "features"), F.when(F.col("w") > 0, F.col("v")).otherwise(-1))
        merged = reduce(DataFrame.unionByName, tables).groupBy("tree_id", "place", "sample_id")
        return (
            merged.agg(F.sum("w").alias("w"), newest.alias("row"))
            .where("w > 0")
            .select(*columns[:3], "row.label", "row.features")
        )

    def below(self, spark: SparkSession, nodes: DataFrame, depths: Iterable[int]) -> DataFrame:
        """The rows below some nodes, once per depth of ``depths``, where all the nodes are: ``node_id``
        is the ancestor of that depth, which need not be one of the nodes."""
        rows = self.rows(spark, Ranges.of(nodes))
        path = F.explode(F.array(*[at_depth(d) for d in sorted(depths)]))
        return rows.select("tree_id", path.alias("node_id"), "sample_id", "label", "features", "place")


def moves(now: DataFrame) -> DataFrame:
    """Changes from the places rows had (``place``) to the leaves they stand at now (``node_id``)."""
    moved = now.withColumn("_to", F.expr(PLACE)).where("place <> _to")
    kept = ["tree_id", "sample_id", "label", "features"]
    came = moved.select(*kept, F.col("_to").alias("place"), F.lit(1).alias("w"))
    none = [F.lit(None).cast("boolean").alias("label"), F.lit(None).cast("array<double>").alias("features")]
    return came.unionByName(moved.select("tree_id", "sample_id", *none, "place", F.lit(-1).alias("w")))


def signed(at_leaves: DataFrame) -> DataFrame:
    """Changes for samples that came (w 1) or went (w -1)."""
    came = F.col("w") > 0
    return at_leaves.select(
        "tree_id", "sample_id", F.when(came, F.col("label")).alias("label"),
        F.when(came, F.col("features")).alias("features"), F.expr(PLACE).alias("place"), F.col("w").cast("int").alias("w"),
    )


def _write(rows: DataFrame, scratch: Scratch) -> str:
    return _write_places(rows if "place" in rows.columns else rows.withColumn("place", F.expr(PLACE)), scratch)


def _write_places(rows: DataFrame, scratch: Scratch) -> str:
    columns = [field.split()[0] for field in PART_SCHEMA.split(", ")]
    path = scratch.path("leaves")
    (
        rows.select(*columns)
        .repartitionByRange("tree_id", "place")
        .sortWithinPartitions("tree_id", "place")
        .write.partitionBy("tree_id")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .parquet(path)
    )
    return path
