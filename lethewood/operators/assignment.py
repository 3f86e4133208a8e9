"""Bounded assignment: every sample goes to exactly k of the T trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.draws import tree_ranks


def k_for(config: RunConfig, label: Column, k: Column | None = None) -> Column:
    """Trees per sample: a given k, or minority_k for positives, clamped to [1, T]."""
    wanted = F.lit(config.k) if k is None else k
    if config.minority_k > 0 and k is None:
        wanted = F.when(label, F.lit(config.minority_k)).otherwise(wanted)
    return F.least(F.greatest(wanted, F.lit(1)), F.lit(config.num_trees))


def assign_trees(samples: DataFrame, config: RunConfig, k: Column | None = None) -> DataFrame:
    """Add sorted ``tree_ids``. A narrow projection: no shuffle, no row growth."""
    if config.num_trees == 0:
        return samples.withColumn("tree_ids", F.array().cast("array<int>"))
    ranked = F.sort_array(F.expr(tree_ranks(config.seed, "sample_id", config.num_trees)))
    chosen = F.slice(ranked, F.lit(1), k_for(config, F.col("label"), k))
    return samples.withColumn("tree_ids", F.sort_array(chosen["tree_id"]))


def assignment(assigned: DataFrame) -> DataFrame:
    """The long form: one row per (sample, tree)."""
    return assigned.select("sample_id", F.explode("tree_ids").alias("tree_id"))


def tree_indices(long_form: DataFrame) -> DataFrame:
    """Sorted trees per sample from the long form (at most T per sample)."""
    return long_form.groupBy("sample_id").agg(F.sort_array(F.collect_set("tree_id")).alias("tree_ids"))


def tree_indices_of(ids: DataFrame, assigned: DataFrame) -> DataFrame:
    """Trees of the asked ids; unknown ids give an empty array."""
    return (
        ids.select("sample_id")
        .join(assigned.select("sample_id", "tree_ids"), "sample_id", "left")
        .select("sample_id", F.coalesce("tree_ids", F.array().cast("array<int>")).alias("tree_ids"))
    )


def oob_trees(assigned: DataFrame, num_trees: int) -> DataFrame:
    """Trees that do not hold the sample."""
    everything = F.sequence(F.lit(0), F.lit(num_trees - 1)) if num_trees else F.array().cast("array<int>")
    return assigned.select("sample_id", F.array_except(everything, "tree_ids").alias("oob_tree_ids"))


def tree_sizes(assigned: DataFrame) -> DataFrame:
    """Samples held by each tree."""
    return assignment(assigned).groupBy("tree_id").agg(F.count(F.lit(1)).alias("num_samples"))


def membership_summary(assigned: DataFrame, config: RunConfig) -> DataFrame:
    return assigned.agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.coalesce(F.sum(F.size("tree_ids")), F.lit(0)).alias("num_assignments"),
    ).select(
        "num_samples",
        "num_assignments",
        F.lit(config.num_trees).alias("num_trees"),
        F.lit(config.k).alias("k"),
    )
