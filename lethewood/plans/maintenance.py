"""Adding and forgetting samples, with deferred rebuilds.

Both directions are one signed update of counts along the touched paths, so a batch may
mix them. The update reads only the changed samples and the two model tables, and writes only the
rows of the touched nodes, as changes over the tables. A node whose
stored value range is no longer certain is tagged ``dirty``; one whose best split provably
changed is tagged ``rebuild``. Resolving regrows the topmost such nodes from their live samples;
dirty ones with too many for one task are re-scored first. A stored leaf map gives just the rows
below these nodes; without one the affected trees' samples are scanned and walked down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import splits as S
from ..operators.assignment import assign_trees
from ..operators.routing import NODE_BYTES, below, topmost, walk, with_path
from ..sources.samples import first_of_each_id
from .growth import CANDIDATE_COLUMNS, NODE_COLUMNS, Forest, cut_bytes, grow, level_candidates, rows_at_roots
from .leaves import LeafMap, moves, signed

KEYS = S.NODE_KEYS
EMPTIED = "CASE WHEN node_id = 1 AND n = 0 THEN tree_id END"


@dataclass(frozen=True)
class Delta:
    """A model after an update, and how much of the update made nodes stale."""

    forest: Forest
    marks: DataFrame


def delta_rows(assigned: DataFrame, weight: int) -> DataFrame:
    return assigned.select(
        "sample_id", "features", "label", "tree_ids", F.lit(weight).cast("bigint").alias("w")
    )


def delta_at_leaves(forest: Forest, delta: DataFrame) -> DataFrame:
    """Changed samples at the leaf they belong to, one row per tree holding them."""
    rows = delta.select(
        F.explode("tree_ids").alias("tree_id"),
        F.lit(1).cast("bigint").alias("node_id"),
        "sample_id",
        "label",
        "features",
        "w",
    )
    return walk(rows, forest.nodes, forest.depth_counts, forest.config)


def path_deltas(at_leaves: DataFrame) -> DataFrame:
    """Signed change of n and n_pos for the leaf and all its ancestors."""
    return (
        with_path(at_leaves.select("tree_id", "node_id", "label", "w"))
        .groupBy(*KEYS)
        .agg(
            F.sum("w").alias("dn"),
            F.sum(F.when(F.col("label"), F.col("w")).otherwise(0)).alias("dn_pos"),
        )
    )


def updated_nodes(nodes: DataFrame, deltas: DataFrame, how: str = "full") -> DataFrame:
    """Nodes with new counts, with ``how`` "right" only those that change. A tree's first rows create
    its root as a leaf."""
    joined = nodes.join(deltas, KEYS, how)
    return joined.select(
        *KEYS,
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("kind", F.lit("leaf")).alias("kind"),
        "attr",
        "threshold",
        "subset",
        "base",
        (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"),
        (F.coalesce("n_pos", F.lit(0)) + F.coalesce("dn_pos", F.lit(0))).alias("n_pos"),
        F.coalesce("tag", F.lit("clean")).alias("tag"),
        F.col("dn").isNotNull().alias("touched"),
    )


def candidate_deltas(forest: Forest, at_leaves: DataFrame) -> DataFrame:
    """Signed change of every stored candidate the paths touch."""
    config = forest.config
    cuts = S.cut_columns_of(forest.candidates, config)
    size = cut_bytes(forest.node_count, config)
    if size > config.broadcast_bytes:
        cuts = cuts.join(forest.nodes.select(*KEYS, "n"), KEYS)
    return S.count_cuts(with_path(at_leaves), cuts, size, config, weight="w")


def updated_candidates(
    candidates: DataFrame, deltas: DataFrame, forest: Forest, how: str = "left"
) -> DataFrame:
    """Candidates with new counts, with ``how`` "inner" only those that change; ``invalid`` when the
    value range may have moved."""
    draws = S.draws(forest.config)
    changes = deltas.drop("lo", "hi").withColumnsRenamed({"lo_n": "d_lo", "hi_n": "d_hi"})
    joined = candidates.join(changes, [*KEYS, "attr"], how)
    moved = ", ".join(
        f"struct(cuts[{j}].threshold AS threshold, cuts[{j}].subset AS subset, "
        f"cuts[{j}].n_left + l{j} AS n_left, cuts[{j}].n_left_pos + p{j} AS n_left_pos)"
        for j in draws
    )
    new_cuts = f"CASE WHEN d_lo IS NULL OR size(cuts) = 0 THEN cuts ELSE array({moved}) END"
    return joined.selectExpr(
        *KEYS,
        "attr",
        "lo",
        "hi",
        "lo_n + coalesce(d_lo, 0L) AS lo_n",
        "hi_n + coalesce(d_hi, 0L) AS hi_n",
        f"CAST({new_cuts} AS {S.CUTS_TYPE}) AS cuts",
        "coalesce(outside OR lo_n + d_lo <= 0 OR hi_n + d_hi <= 0, false) AS invalid",
    )


def same_split(left: str, right: str) -> str:
    return " AND ".join(f"{left}.{c} <=> {right}.{c}" for c in ("kind", "attr", "threshold", "subset"))


def reviewed_nodes(nodes: DataFrame, candidates: DataFrame, forest: Forest) -> DataFrame:
    """Touched nodes with ``new_tag``, from the updated counts alone, and whether they must stay leaves."""
    config = forest.config
    touched = nodes.where("touched")
    per_node = candidates.groupBy(*KEYS).agg(F.max("invalid").alias("invalid"))
    wanted = S.decided_nodes(touched.drop("attr", "threshold", "subset", "base", "kind", "tag"), candidates, config)
    wanted = wanted.select(*KEYS, "kind", "attr", "threshold", "subset")
    joined = (
        touched.alias("now")
        .join(wanted.alias("new"), KEYS)
        .join(per_node, KEYS, "left")
        .withColumn("stopped", S.stop_rule(config))
    )
    tag = (
        "CASE WHEN now.tag = 'rebuild' THEN 'rebuild' "
        "WHEN stopped THEN CASE WHEN now.kind = 'internal' THEN 'rebuild' ELSE 'clean' END "
        "WHEN invalid IS NULL THEN 'rebuild' "
        "WHEN invalid OR now.tag = 'dirty' THEN 'dirty' "
        f"WHEN {same_split('now', 'new')} THEN 'clean' ELSE 'rebuild' END"
    )
    own = [f"now.{c} AS {c}" for c in NODE_COLUMNS if c not in KEYS]
    return joined.selectExpr(*KEYS, *own, f"{tag} AS new_tag", "stopped")


def stale_marks(at_leaves: DataFrame, stale: DataFrame) -> DataFrame:
    """Additions count samples, removals count (sample, tree) pairs, whose path is stale."""
    hit = with_path(at_leaves.select("tree_id", "node_id", "sample_id", "w")).join(
        stale.select(*KEYS), KEYS, "left_semi"
    )
    pairs = hit.select("tree_id", "sample_id", "w").distinct()
    removed = pairs.where("w < 0").agg(F.count(F.lit(1)).alias("forget_marks"))
    added = pairs.where("w > 0").select("sample_id").distinct().agg(
        F.count(F.lit(1)).alias("add_marks")
    )
    return added.withColumn("_one", F.lit(1)).join(removed.withColumn("_one", F.lit(1)), "_one").drop("_one")


def apply_delta(
    forest: Forest,
    added: DataFrame | None = None,
    removed: DataFrame | None = None,
    review: bool = True,
) -> Delta:
    """Update counts, candidates and tags. ``review=False`` leaves the structure frozen."""
    parts = [delta_rows(df, w) for df, w in ((added, 1), (removed, -1)) if df is not None]
    delta = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    scratch = forest.scratch
    at_leaves = scratch.write(delta_at_leaves(forest, delta), "delta")
    touched = updated_nodes(forest.nodes, path_deltas(at_leaves), "right")
    deltas = candidate_deltas(forest, at_leaves)
    candidates = scratch.write(updated_candidates(forest.candidates, deltas, forest, "inner"), "counted")
    if review:
        reviewed = scratch.write(reviewed_nodes(touched, candidates, forest), "reviewed")
        stale = reviewed.where("new_tag <> 'clean'")
        emptied, rebuilds = reviewed.agg(F.collect_set(F.expr(EMPTIED)), F.count(F.when(F.col("new_tag") == "rebuild", 1))).first()
        nodes = reviewed.drop("tag")
        if rebuilds:
            # What lies below a node to rebuild is settled with it.
            kept = topmost(stale, stale.where("new_tag = 'rebuild'")).select(*KEYS, "new_tag")
            nodes = nodes.drop("new_tag").join(kept, KEYS, "left")
        nodes = nodes.withColumn("tag", F.coalesce("new_tag", F.lit("clean")))
        settled = reviewed.where("stopped AND kind = 'leaf'").select(*KEYS, F.lit(True).alias("gone"))
        changed = candidates.join(settled, KEYS, "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
        marks = stale_marks(at_leaves, stale)
    else:
        emptied = touched.agg(F.collect_set(F.expr(EMPTIED))).first()[0]
        nodes, changed = touched, candidates.withColumn("gone", F.lit(False))
        marks = stale_marks(at_leaves, touched.where("false"))
    changes = [nodes.select(*NODE_COLUMNS, F.lit(False).alias("gone")), changed.select(*CANDIDATE_COLUMNS, "gone")]
    if emptied:
        # Trees without samples have no nodes.
        there = F.col("tree_id").isin(emptied)
        changes = [
            rows.where(~there).unionByName(old.where(there).select(*columns, F.lit(True).alias("gone")))
            for rows, old, columns in zip(
                changes, (forest.nodes, forest.candidates), (NODE_COLUMNS, CANDIDATE_COLUMNS), strict=True
            )
        ]
    layers = [
        layer.changed(rows, scratch, name, forest.config.fold_after)
        for layer, rows, name in zip(forest.layered(), changes, ("nodes", "candidates"), strict=True)
    ]
    leaves = forest.leaves
    if leaves is not None:
        leaves = leaves.changed(signed(at_leaves), scratch, forest.config.fold_after)
    samples = forest.samples
    if removed is not None:
        samples = samples.join(removed.select("sample_id"), "sample_id", "left_anti")
    if added is not None:
        samples = samples.unionByName(added.select(*forest.samples.columns))
    updated = forest.retagged(
        samples=samples,
        nodes=layers[0].view,
        candidates=layers[1].view,
        node_layers=layers[0],
        candidate_layers=layers[1],
        leaves=leaves,
    )
    return Delta(updated, marks)


def known_samples(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """Live rows among ``ids``. The ids are a written table, so Spark sees their real size
    and sends them to the scan of the samples instead of shuffling the samples."""
    return samples.join(ids.select("sample_id"), "sample_id", "left_semi")


def forget(forest: Forest, ids: DataFrame) -> Delta:
    """Remove known ids; unknown or already forgotten ids are skipped."""
    wanted = forest.scratch.write(ids.select("sample_id").distinct(), "ids")
    removed = forest.scratch.write(known_samples(forest.samples, wanted), "removed")
    return apply_delta(forest, removed=removed)


def add(forest: Forest, samples: DataFrame, review: bool = True) -> Delta:
    """Insert new samples into their k trees; known ids are ignored, and of rows with one id the
    smallest (position, features, label) counts."""
    order = [c for c in ("position", "features", "label") if c in samples.columns]
    batch = forest.scratch.write(first_of_each_id(samples, order), "batch")
    known = forest.scratch.write(known_samples(forest.samples.select("sample_id"), batch), "known")
    fresh = batch.join(known, "sample_id", "left_anti")
    assigned = assign_trees(fresh, forest.config).select(*forest.samples.columns)
    return apply_delta(forest, added=forest.scratch.write(assigned, "added"), review=review)


def live_rows(forest: Forest, tree_ids: list[int]) -> DataFrame:
    """Live samples of some trees, at the roots; other samples are skipped by the scan."""
    wanted = F.array(*[F.lit(t) for t in tree_ids]).cast("array<int>")
    return forest.samples.where(F.arrays_overlap("tree_ids", wanted)).select(
        F.explode(F.array_intersect("tree_ids", wanted)).alias("tree_id"),
        F.lit(1).cast("bigint").alias("node_id"),
        "sample_id",
        "label",
        "features",
    )


@dataclass(frozen=True)
class Spread:
    """Which trees and depths a set of nodes is in: at most one small row per pair."""

    trees: list[int]
    depths: list[int]
    count: int

    @classmethod
    def of(cls, nodes: DataFrame) -> Spread:
        rows = nodes.groupBy("tree_id", "depth").count().collect()
        return cls(
            sorted({r["tree_id"] for r in rows}),
            sorted({r["depth"] for r in rows}),
            sum(r["count"] for r in rows),
        )


def review_dirty(forest: Forest, dirty: DataFrame) -> Forest:
    """Recompute candidates of dirty nodes from their rows; tag them clean or rebuild."""
    config, scratch = forest.config, forest.scratch
    dirty = scratch.write(dirty.select(*KEYS, "depth", "n", "n_pos"), "dirty")
    spread = Spread.of(dirty)
    if spread.count == 0:
        return forest
    if forest.leaves is not None:
        rows = forest.leaves.below(forest.spark, dirty, spread.depths)
    else:
        at_leaf = walk(live_rows(forest, spread.trees), forest.nodes, forest.depth_counts, config)
        rows = with_path(at_leaf, spread.depths)
    fresh = scratch.write(level_candidates(rows, dirty, spread.count, config), "candidates")
    wanted = S.decided_nodes(dirty, fresh, config).select(*KEYS, "kind", "attr", "threshold", "subset")
    verdict = (
        forest.nodes.alias("now")
        .join(wanted.alias("new"), KEYS)
        .selectExpr(*KEYS, f"CASE WHEN {same_split('now', 'new')} THEN 'clean' ELSE 'rebuild' END AS new_tag")
    )
    nodes = forest.nodes.join(verdict, KEYS, "left").withColumn("tag", F.coalesce("new_tag", "tag"))
    candidates = (
        forest.candidates.join(dirty.select(*KEYS), KEYS, "left_anti")
        .select(*CANDIDATE_COLUMNS)
        .unionByName(fresh.select(*CANDIDATE_COLUMNS))
    )
    return forest.retagged(
        nodes=scratch.write(nodes.select(*NODE_COLUMNS), "model-nodes"),
        candidates=candidates,
    )


def regrow(forest: Forest, tops: DataFrame) -> Forest:
    """Replace everything at and below ``tops`` by freshly grown subtrees."""
    config, scratch = forest.config, forest.scratch
    tops = scratch.write(tops.select(*KEYS, "depth", "n", "n_pos"), "tops")
    spread = Spread.of(tops)
    if spread.count == 0:
        return forest.retagged(candidates=scratch.write(forest.candidates, "model-candidates"))
    gone = scratch.write(below(forest.nodes, tops), "gone")
    kept = forest.nodes.join(gone, KEYS, "left_anti").select(*NODE_COLUMNS)
    kept_candidates = forest.candidates.join(gone, KEYS, "left_anti").select(*CANDIDATE_COLUMNS)
    if forest.leaves is not None:
        rows = forest.leaves.below(forest.spark, tops, spread.depths)
    else:
        above = {d: c for d, c in forest.depth_counts.items() if d < max(spread.depths)}
        rows = walk(live_rows(forest, spread.trees), kept, above, config)
    affected = S.attach(rows, tops.select(*KEYS, "n"), spread.count * NODE_BYTES, config).drop("n")
    affected = scratch.write(affected, "affected")
    nodes, candidates = grow(affected, tops.where("n > 0"), config, scratch)
    updated = forest.with_(
        nodes=scratch.write(kept.unionByName(nodes), "model-nodes"),
        candidates=scratch.write(kept_candidates.unionByName(candidates), "model-candidates"),
    )
    if forest.leaves is not None:
        below_tops = {d: c for d, c in updated.depth_counts.items() if d >= min(spread.depths)}
        changes = moves(walk(affected, updated.nodes, below_tops, config))
        updated = updated.with_(leaves=forest.leaves.changed(changes, scratch, config.fold_after))
    scratch.drop(affected)
    return updated


def with_leaves(forest: Forest) -> Forest:
    """The model with a stored leaf map, made by one walk of all samples."""
    rows = walk(rows_at_roots(forest.samples), forest.nodes, forest.depth_counts, forest.config)
    return forest.retagged(leaves=LeafMap.build(rows, forest.scratch))


def resolve(forest: Forest, on_path: DataFrame | None = None) -> Forest:
    """Settle pending nodes: all of them, or only those among ``on_path`` (tree, node).

    Draws do not depend on when a node is settled, so settling the nodes a query meets
    gives it the same answer as settling everything.
    """
    if not forest.has_pending:
        return forest
    on_path = None if on_path is None else forest.scratch.write(on_path, "path")
    in_one_task = F.col("n") <= forest.config.finish_limit

    def selected(model: Forest, condition: Column) -> DataFrame:
        nodes = model.nodes.where(condition)
        return nodes if on_path is None else nodes.join(on_path, KEYS, "left_semi")

    dirty, rebuild = F.col("tag") == "dirty", F.col("tag") == "rebuild"
    forest = review_dirty(forest, topmost(selected(forest, dirty & ~in_one_task), forest.nodes.where(rebuild)))
    return regrow(forest, topmost(selected(forest, rebuild | (dirty & in_one_task))))
