"""Health figures of the sample buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ordering import with_rank
from ..sources.scratch import Scratch
from .selection import with_age

MIN_PAIRS = 3


def influence_coverage(buffer: DataFrame) -> DataFrame:
    return buffer.agg(
        F.count("influence").alias("with_influence"), F.count(F.lit(1)).alias("total")
    )


def registry_diagnostics(buffer: DataFrame, current_position: int) -> DataFrame:
    """Sizes, coverage and means over the rows with influence (0 below three of them)."""
    known = F.col("influence").isNotNull()
    enough = F.count("influence") >= MIN_PAIRS
    total = F.count(F.lit(1))
    return with_age(buffer, current_position).agg(
        total.alias("n_samples"),
        F.count(F.when(~F.col("label"), 1)).alias("n_benign"),
        F.count(F.when(F.col("label"), 1)).alias("n_attack"),
        F.count("influence").alias("n_with_influence"),
        F.when(total > 0, F.count("influence").cast("double") / total.cast("double"))
        .otherwise(0.0)
        .alias("influence_coverage"),
        F.when(enough, F.avg(F.when(known, F.col("age")))).otherwise(0.0).alias("mean_age"),
        F.when(enough, F.avg("influence")).otherwise(0.0).alias("mean_influence"),
    )


def age_influence_spearman(
    buffer: DataFrame, current_position: int, scratch: Scratch | None = None
) -> DataFrame:
    """Correlation of ordinal ranks of age and influence, ties ordered by sample id.

    NaN below three rows, 0 when a rank has no variance.
    """
    scratch = scratch or Scratch(buffer.sparkSession)
    pairs = with_age(buffer.where(F.col("influence").isNotNull()), current_position).select(
        "sample_id", "age", "influence"
    )
    by_age = with_rank(pairs, [F.col("age"), F.col("sample_id")], scratch, "age_rank")
    both = with_rank(by_age, [F.col("influence"), F.col("sample_id")], scratch, "influence_rank")
    return both.agg(
        F.when(F.count(F.lit(1)) < MIN_PAIRS, F.lit(float("nan")))
        .otherwise(F.coalesce(F.corr("age_rank", "influence_rank"), F.lit(0.0)))
        .alias("age_influence_spearman")
    )
