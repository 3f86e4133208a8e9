"""Questions about a model's node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig


def tree_stats(nodes: DataFrame, spark_trees: DataFrame) -> DataFrame:
    """Depth and size over all T trees; a tree without nodes counts as zero."""
    per_tree = nodes.groupBy("tree_id").agg(
        F.max("depth").alias("depth"), F.count(F.lit(1)).alias("num_nodes")
    )
    return (
        spark_trees.join(per_tree, "tree_id", "left")
        .fillna(0, ["depth", "num_nodes"])
        .agg(
            F.count(F.lit(1)).alias("num_trees"),
            F.min("depth").alias("min_depth"),
            F.max("depth").alias("max_depth"),
            F.avg("depth").alias("avg_depth"),
            F.sum("num_nodes").alias("total_nodes"),
            F.avg("num_nodes").alias("avg_nodes"),
        )
    )


def node_counts(nodes: DataFrame) -> DataFrame:
    """Nodes and samples per tree, kind and tag."""
    return nodes.groupBy("tree_id", "kind", "tag").agg(
        F.count(F.lit(1)).alias("num_nodes"), F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos")
    )


def tag_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tag").agg(F.count(F.lit(1)).alias("num_nodes"))


def splittable_leaves(nodes: DataFrame, config: RunConfig) -> DataFrame:
    """Leaves large and mixed enough to split."""
    return nodes.where(
        (F.col("kind") == "leaf")
        & (F.col("n") >= config.min_samples_split)
        & (F.col("n_pos") > 0)
        & (F.col("n_pos") < F.col("n"))
    ).select("tree_id", "node_id", "depth", "n", "n_pos")


def maintenance_stats(candidates: DataFrame) -> DataFrame:
    """Trees and nodes that carry candidate statistics."""
    nodes = candidates.select("tree_id", "node_id").distinct()
    return nodes.agg(
        F.countDistinct("tree_id").alias("num_trees"), F.count(F.lit(1)).alias("num_nodes")
    )


def node_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either node table that the other lacks (structure and counts, not tags)."""
    columns = ["tree_id", "node_id", "depth", "kind", "attr", "threshold", "subset", "base", "n", "n_pos"]
    a, b = left.select(*columns), right.select(*columns)
    return (
        a.exceptAll(b)
        .withColumn("side", F.lit("left"))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    )
