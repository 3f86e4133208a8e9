"""Level-wise tree growth, down to nodes that one task can finish.

While nodes are large, rows never move: the assigned samples are written as blocks, and each level scans these,
walks the rows down the splits found so far, and shuffles only per-node counters. With many nodes
the samples themselves are scanned and walked down through broadcast joins. Every level writes
two small tables (candidates and nodes); the walk is written out once every few levels so
the plan stays short and rows in finished leaves drop out. Nodes with few rows are set aside; in
the end their rows are read once more, walked down to them, and ``subtree`` grows what is below.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import splits as S
from ..operators import tally
from ..operators.assignment import assign_trees
from ..operators.routing import NODE_BYTES, walk
from ..sources.layers import Layered
from ..sources.scratch import Scratch
from .leaves import LeafMap
from .subtree import at_tops, finish, finished_candidates

NODES_SCHEMA = (
    "tree_id INT, node_id BIGINT, depth INT, kind STRING, attr INT, threshold DOUBLE, "
    "subset BIGINT, base DOUBLE, n BIGINT, n_pos BIGINT, tag STRING"
)
CANDIDATES_SCHEMA = (
    "tree_id INT, node_id BIGINT, attr INT, lo DOUBLE, hi DOUBLE, lo_n BIGINT, hi_n BIGINT, "
    f"cuts {S.CUTS_TYPE}"
)
# The JVM does not compile the method that more joins in a row are generated as.
JOINED_STEPS = 2
ASSIGNED_SCHEMA = "sample_id BIGINT, features ARRAY<DOUBLE>, label BOOLEAN, tree_ids ARRAY<INT>"
NODE_COLUMNS = [part.split()[0] for part in NODES_SCHEMA.split(", ")]
CANDIDATE_COLUMNS = ["tree_id", "node_id", "attr", "lo", "hi", "lo_n", "hi_n", "cuts"]


@dataclass(frozen=True)
class Forest:
    """A model: its live samples, node table and candidate statistics; a stored leaf map if it has
    one. ``node_layers`` and ``candidate_layers`` say how the tables are stored when changes lie
    over them."""

    config: RunConfig
    samples: DataFrame
    nodes: DataFrame
    candidates: DataFrame
    scratch: Scratch
    leaves: LeafMap | None = None
    node_layers: Layered | None = None
    candidate_layers: Layered | None = None

    @property
    def spark(self) -> SparkSession:
        return self.scratch.spark

    @cached_property
    def depth_counts(self) -> dict[int, int]:
        """Internal nodes per depth: at most max_depth small rows."""
        internal = self.nodes.where("kind = 'internal'").groupBy("depth").count()
        return {row["depth"]: row["count"] for row in internal.collect()}

    @cached_property
    def node_count(self) -> int:
        return self.nodes.count()

    @cached_property
    def has_pending(self) -> bool:
        return not self.nodes.where("tag <> 'clean'").isEmpty()

    def with_(self, **changes: object) -> Forest:
        if "nodes" in changes:
            changes = {"node_layers": None} | changes
        if "candidates" in changes:
            changes = {"candidate_layers": None} | changes
        return replace(self, **changes)

    def retagged(self, **changes: object) -> Forest:
        """A copy whose splits are the same, so what is known about depths still holds."""
        copy = self.with_(**changes)
        copy.__dict__["depth_counts"] = self.depth_counts
        copy.__dict__["node_count"] = self.node_count
        return copy

    def layered(self) -> tuple[Layered, Layered]:
        """How the two model tables are stored."""
        return (
            self.node_layers or Layered(self.nodes, tuple(S.NODE_KEYS)),
            self.candidate_layers or Layered(self.candidates, (*S.NODE_KEYS, "attr")),
        )


def empty_forest(spark: SparkSession, config: RunConfig, scratch: Scratch | None = None) -> Forest:
    return Forest(
        config,
        spark.createDataFrame([], ASSIGNED_SCHEMA),
        spark.createDataFrame([], NODES_SCHEMA),
        spark.createDataFrame([], CANDIDATES_SCHEMA),
        scratch or Scratch(spark),
    )


def rows_at_roots(assigned: DataFrame) -> DataFrame:
    """One row per (sample, tree), standing at the root."""
    return assigned.select(
        F.explode("tree_ids").alias("tree_id"),
        F.lit(1).cast("bigint").alias("node_id"),
        "sample_id",
        "label",
        "features",
    )


def root_frontier(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*S.NODE_KEYS).agg(
        F.lit(0).alias("depth"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("label").cast("bigint")).alias("n_pos"),
    )


def open_bytes(count: int, config: RunConfig) -> int:
    return count * (56 + 4 * config.features_per_split)


def cut_bytes(count: int, config: RunConfig) -> int:
    return count * config.features_per_split * (64 + 16 * config.num_splits_to_try)


def level_candidates(
    rows: DataFrame, open_nodes: DataFrame, open_count: int, config: RunConfig
) -> DataFrame:
    """Ranges, cut points and counts for one set of open nodes."""
    with_attrs = S.with_attrs(open_nodes, config)
    ranges = S.node_ranges(rows, with_attrs, open_bytes(open_count, config), config)
    cuts = S.with_cut_columns(ranges, config)
    if cut_bytes(open_count, config) > config.broadcast_bytes:
        cuts = cuts.join(open_nodes.select(*S.NODE_KEYS, "n"), S.NODE_KEYS)
    counted = S.count_cuts(rows, cuts, cut_bytes(open_count, config), config)
    return S.pack_candidates(counted, config)


def tallied_candidates(
    blocked: DataFrame, splits: tally.Splits, open_nodes: DataFrame, config: RunConfig
) -> DataFrame:
    """The same for blocks of rows, which still have to walk down the splits."""
    ranges = tally.node_ranges(blocked, splits, S.with_attrs(open_nodes, config), config)
    return S.pack_candidates(tally.count_cuts(blocked, splits, ranges, config), config)


def few_enough(open_count: int, split_count: int, config: RunConfig) -> bool:
    """Whether a level's nodes can go to the tasks and be visited one by one for every block."""
    fits = max(cut_bytes(open_count, config), split_count * NODE_BYTES) <= config.broadcast_bytes
    return fits and open_count + split_count <= tally.MOST_NODES


def grow(
    rows: DataFrame, frontier: DataFrame, config: RunConfig, scratch: Scratch, assigned: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Grow below every frontier node. Returns the new nodes and candidates.

    ``rows`` stand at their frontier node; rows elsewhere are ignored. Draws are keyed by
    node, so the result does not depend on when or with what else a node is grown. ``assigned``
    holds the same rows with a list of trees, if all stand at the roots.
    """
    spark = scratch.spark
    start = rows
    blocked: DataFrame | None = None
    splits: tally.Splits = {}
    tallying = True
    node_parts: list[DataFrame] = []
    candidate_parts: list[DataFrame] = []
    aside: list[DataFrame] = []
    aside_count = 0
    split_counts: dict[int, int] = {}
    steps_since_write = steps_joined = 0
    # What the rows were last written as, and the nodes decided since then, with their splits per depth.
    base, since, since_counts = rows, [], {}
    owned: DataFrame | None = None
    frontier = scratch.write(frontier, "frontier")
    is_open = ~S.stop_rule(config)
    is_small = is_open & (F.col("n") <= config.finish_limit)

    def all_nodes() -> DataFrame:
        return reduce(DataFrame.unionByName, [part.select(*NODE_COLUMNS) for part in node_parts])

    while True:
        open_count, small_count, total = frontier.agg(
            F.coalesce(F.sum(is_open.cast("bigint")), F.lit(0)),
            F.coalesce(F.sum(is_small.cast("bigint")), F.lit(0)),
            F.count(F.lit(1)),
        ).first()
        if small_count:
            aside.append(frontier.where(is_small))
            aside_count += small_count
            frontier = frontier.where(~is_small)
            open_count, total = open_count - small_count, total - small_count
        if total == 0:
            break
        if open_count == 0:
            no_candidates = spark.createDataFrame([], CANDIDATES_SCHEMA)
            node_parts.append(S.decided_nodes(frontier, no_candidates, config))
            break
        open_nodes = frontier.where(is_open)
        if tallying and not few_enough(open_count, sum(split_counts.values()), config):
            tallying = False
            if split_counts:
                base = rows = walk(start, all_nodes(), split_counts, config)
        if tallying:
            if blocked is None:
                blocked = scratch.write(tally.blocks(start if assigned is None else assigned, config), "blocks")
            found = tallied_candidates(blocked, splits, open_nodes, config)
        else:
            found = level_candidates(rows, open_nodes, open_count, config)
        candidates = scratch.write(found, "candidates")
        level = scratch.write(S.decided_nodes(frontier, candidates, config), "nodes")
        node_parts.append(level)
        candidate_parts.append(candidates)

        inner = level.where(F.col("kind") == "internal")
        if tallying:
            for tree, found_splits in tally.splits_of(inner).items():
                splits.setdefault(tree, {}).update(found_splits)
                for node in found_splits:
                    depth = node.bit_length() - 1
                    split_counts[depth] = split_counts.get(depth, 0) + 1
            frontier = S.children(level)
            continue
        steps = inner.select(*S.NODE_KEYS, "n", "attr", "threshold", "subset", "base")
        stepped = S.attach(rows, steps, open_count * 80, config)
        rows = stepped.withColumn("node_id", S.step_down(config)).select(
            *S.NODE_KEYS, "sample_id", "label", "features"
        )
        steps_since_write += 1
        steps_joined += 1
        since.append(level.select(*NODE_COLUMNS))
        for row in inner.groupBy("depth").count().collect():
            for found in (split_counts, since_counts):
                found[row["depth"]] = found.get(row["depth"], 0) + row["count"]
        if steps_since_write >= config.rewrite_every or open_count * 80 > config.broadcast_bytes:
            previous, owned = owned, scratch.write(rows, "rows")
            base = rows = owned
            since, since_counts, steps_since_write, steps_joined = [], {}, 0, 0
            if previous is not None:
                scratch.drop(previous)
        elif steps_joined >= JOINED_STEPS:
            rows, steps_joined = walk(base, reduce(DataFrame.unionByName, since), since_counts, config), 0
        frontier = S.children(level)
    if owned is not None:
        scratch.drop(owned)
    if aside:
        tops = reduce(DataFrame.unionByName, aside)
        if tallying and blocked is not None and few_enough(aside_count, sum(split_counts.values()), config):
            standing = tally.rows_at(blocked, splits, tops, config)
        else:
            at_top = walk(start, all_nodes(), split_counts, config) if split_counts else start
            standing = at_tops(at_top, tops, aside_count, config)
        finished = scratch.write(finish(standing, config), "finished")
        node_parts.append(finished)
        candidate_parts.append(finished_candidates(finished))

    if blocked is not None:
        scratch.drop(blocked)

    def union(parts: list[DataFrame], columns: list[str], schema: str) -> DataFrame:
        if not parts:
            return spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])

    return (
        union(node_parts, NODE_COLUMNS, NODES_SCHEMA),
        union(candidate_parts, CANDIDATE_COLUMNS, CANDIDATES_SCHEMA),
    )


def fit(
    samples: DataFrame,
    config: RunConfig,
    scratch: Scratch | None = None,
    k: str | None = None,
) -> Forest:
    """Assign every sample to its trees and grow all trees together."""
    spark = samples.sparkSession
    scratch = scratch or Scratch(spark)
    assigned = assign_trees(samples, config, F.col(k) if k else None)
    assigned = scratch.write(
        assigned.select("sample_id", "features", "label", "tree_ids"), "samples"
    )
    rows = rows_at_roots(assigned)
    nodes, candidates = grow(rows, root_frontier(rows), config, scratch, assigned)
    return Forest(
        config,
        assigned,
        scratch.write(nodes, "model-nodes"),
        scratch.write(candidates, "model-candidates"),
        scratch,
    )
