"""Walking samples down the node table: in one step where it fits a broadcast, else one join per depth."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from . import splits as S
from .descent import Tables, node_reached

NODE_BYTES = 80
NODE_DEPTH = "CAST(length(bin(node_id)) - 1 AS INT)"


def walk(
    rows: DataFrame, nodes: DataFrame, depth_counts: dict[int, int], config: RunConfig
) -> DataFrame:
    """Move every row to the deepest node its path reaches. Extra columns pass through."""
    kept = rows.columns
    internal = nodes.where("kind = 'internal'")
    if not depth_counts:
        return rows
    if sum(depth_counts.values()) * NODE_BYTES <= config.broadcast_bytes:
        splits = internal.where(F.col("depth").isin(list(depth_counts)))
        return rows.withColumn("node_id", node_reached(Tables.of(splits, S.MAX_CATEGORIES)))
    for depth in sorted(depth_counts):
        splits = internal.where(F.col("depth") == depth).select(
            *S.NODE_KEYS, "n", "attr", "threshold", "subset", "base"
        )
        stepped = S.attach(rows, splits, depth_counts[depth] * NODE_BYTES, config, "left")
        rows = stepped.withColumn("node_id", S.step_down(config)).select(*kept)
    return rows


def with_path(rows: DataFrame, depths: Iterable[int] | None = None) -> DataFrame:
    """One row per node on the path from the root, optionally only at some depths."""
    if depths is None:
        path = f"explode(transform(sequence(0, {NODE_DEPTH}), up -> shiftright(node_id, up)))"
    else:
        wanted = ", ".join(str(d) for d in sorted(depths))
        path = (
            f"explode(transform(filter(array({wanted}), d -> d <= {NODE_DEPTH}), "
            f"d -> shiftright(node_id, {NODE_DEPTH} - d)))"
        )
    others = [c for c in rows.columns if c != "node_id"]
    return rows.selectExpr(*others, f"{path} AS node_id").select(*rows.columns)


def at_every_root(queries: DataFrame, num_trees: int) -> DataFrame:
    """Each query once per tree, standing at the root."""
    trees = F.sequence(F.lit(0), F.lit(num_trees - 1)) if num_trees else F.array().cast("array<int>")
    return queries.select(
        F.explode(trees).alias("tree_id"),
        F.lit(1).cast("bigint").alias("node_id"),
        "sample_id",
        "label",
        "features",
    )


def below(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Keys of the rows of ``nodes`` at or under one of ``tops`` (few rows per node: its depth)."""
    keys = with_path(nodes.select("tree_id", "node_id", F.col("node_id").alias("_self")))
    return (
        keys.join(tops.select(*S.NODE_KEYS), S.NODE_KEYS, "left_semi")
        .select("tree_id", F.col("_self").alias("node_id"))
        .distinct()
    )


def topmost(flagged: DataFrame, blockers: DataFrame | None = None) -> DataFrame:
    """Flagged nodes with no proper ancestor among ``blockers`` (default: the flagged)."""
    blockers = flagged if blockers is None else blockers
    keys = flagged.select("tree_id", "node_id", F.col("node_id").alias("_self"))
    shadowed = (
        with_path(keys)
        .where("node_id <> _self")
        .join(blockers.select(*S.NODE_KEYS), S.NODE_KEYS, "left_semi")
        .select("tree_id", F.col("_self").alias("node_id"))
        .distinct()
    )
    return flagged.join(shadowed, S.NODE_KEYS, "left_anti")
