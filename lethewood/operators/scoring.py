"""Votes and predictions of a forest for whole tables of samples."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.growth import Forest, rows_at_roots
from ..plans.leaves import PLACE
from . import splits as S
from .descent import Tables, vote_count
from .routing import NODE_BYTES, at_every_root, walk, with_path


def reached_nodes(forest: Forest, queries: DataFrame) -> DataFrame:
    """sample_id, tree_id, label, node_id: where every sample ends in every tree."""
    rows = at_every_root(queries, forest.config.num_trees)
    return walk(rows, forest.nodes, forest.depth_counts, forest.config)


def query_path(forest: Forest, queries: DataFrame) -> DataFrame:
    """The distinct (tree, node) the queries pass through."""
    reached = reached_nodes(forest, queries).select(*S.NODE_KEYS).distinct()
    return with_path(reached).distinct()


def tree_votes(forest: Forest, queries: DataFrame) -> DataFrame:
    """One vote per (sample, tree): majority of the node reached, ties and missing trees negative."""
    leaves = forest.nodes.select(*S.NODE_KEYS, "n", "n_pos")
    reached = reached_nodes(forest, queries).select(*S.NODE_KEYS, "sample_id", "label")
    joined = S.attach(reached, leaves, forest.node_count * NODE_BYTES, forest.config, "left")
    return joined.select(
        "sample_id",
        "tree_id",
        "label",
        F.coalesce(F.col("n_pos") * 2 > F.col("n"), F.lit(False)).alias("vote"),
    )


def compiled(forest: Forest) -> Tables:
    """The whole model as arrays, with the vote of every node."""
    fields = ["attr", "threshold", "subset", "base"]
    vote = F.coalesce(F.col("n_pos") * 2 > F.col("n"), F.lit(False)).alias("vote")
    inner = F.col("kind") == "internal"
    nodes = forest.nodes.select(
        "tree_id", "node_id", *[F.when(inner, F.col(f)).alias(f) for f in fields], vote
    )
    return Tables.of(nodes, S.MAX_CATEGORIES)


def _voted(forest: Forest, queries: DataFrame, keep: Sequence[str], weights: dict[int, int] | None) -> DataFrame:
    """Queries with ``votes``: positive votes, each counted as often as ``weights`` says (once
    without it). A model that fits a broadcast goes to the tasks as arrays: one row in, one row
    out, no exchange. A larger one is walked by joins; the rows are then numbered and
    written first, so that equal rows stay apart."""
    columns = ["sample_id", "label", *keep]
    if forest.node_count * NODE_BYTES <= forest.config.broadcast_bytes:
        return queries.select(*columns, vote_count(compiled(forest), weights).alias("votes"))
    numbered = forest.scratch.write(queries.withColumn("_row", F.monotonically_increasing_id()), "queries")
    votes = tree_votes(forest, numbered.withColumn("sample_id", F.col("_row")))
    weight = F.lit(1)
    if weights is not None:
        weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for e in weights.items() for x in e)), "tree_id"), F.lit(0))
    counted = votes.groupBy(F.col("sample_id").alias("_row")).agg(
        F.sum(F.col("vote").cast("bigint") * weight).cast("bigint").alias("votes")
    )
    return numbered.select("_row", *columns).join(counted, "_row").select(*columns, "votes")


def predict(forest: Forest, queries: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """sample_id, label, the columns of ``keep``, votes, pred, proba: one row per query row, also
    when ids repeat."""
    size = forest.config.num_trees
    if size == 0:
        return queries.select(
            "sample_id",
            "label",
            *keep,
            F.lit(0).cast("bigint").alias("votes"),
            F.lit(False).alias("pred"),
            F.lit(0.5).alias("proba"),
        )
    return _voted(forest, queries, keep, None).select(
        "sample_id",
        "label",
        *keep,
        "votes",
        (F.col("votes") * 2 > size).alias("pred"),
        (F.col("votes").cast("double") / F.lit(float(size))).alias("proba"),
    )


def predict_subset(forest: Forest, queries: DataFrame, tree_ids: Sequence[int]) -> DataFrame:
    """Majority over chosen trees; a tree listed twice counts twice; unknown trees only enlarge
    the denominator; none gives null."""
    size = len(tree_ids)
    if size == 0:
        return queries.select(
            "sample_id", F.lit(None).cast("boolean").alias("pred"), F.lit(None).cast("double").alias("proba")
        )
    return _voted(forest, queries, (), dict(Counter(tree_ids))).select(
        "sample_id",
        (F.col("votes") * 2 > size).alias("pred"),
        (F.col("votes").cast("double") / F.lit(float(size))).alias("proba"),
    )


def leaf_map(forest: Forest) -> DataFrame:
    """tree_id, sample_id, node_id of every assigned sample: read where it is stored, else derived."""
    if forest.leaves is not None:
        at = forest.nodes.where("kind = 'leaf'").selectExpr("tree_id", "node_id", f"{PLACE} AS place")
        stored = forest.leaves.rows(forest.spark).select("tree_id", "place", "sample_id")
        return stored.join(at, ["tree_id", "place"]).select("tree_id", "sample_id", "node_id")
    rows = rows_at_roots(forest.samples)
    return walk(rows, forest.nodes, forest.depth_counts, forest.config).select(
        "tree_id", "sample_id", "node_id"
    )


def leaf_members(forest: Forest) -> DataFrame:
    """Leaf counts recomputed from the mapping."""
    rows = walk(rows_at_roots(forest.samples), forest.nodes, forest.depth_counts, forest.config)
    return rows.groupBy(*S.NODE_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("n_pos")
    )
