"""Selections from the sample buffer: filter, sort, take n, ties by sample id.

``buffer``: sample_id, position, label, influence, prev_influence, tree_ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ordering import top_n, with_rank
from ..sources.scratch import Scratch


def _take(df: DataFrame, order: list[Column], n: int | None, scratch: Scratch | None = None) -> DataFrame:
    order = [*order, F.col("sample_id")]
    if n is None:
        return df.orderBy(*order)
    return top_n(df, order, n, scratch or Scratch(df.sparkSession))


def of_class(buffer: DataFrame, label: bool) -> DataFrame:
    return buffer.where(F.col("label") == label)


def oldest(buffer: DataFrame, n: int, scratch: Scratch | None = None) -> DataFrame:
    return _take(buffer, [F.col("position")], n, scratch)


def newest(buffer: DataFrame, n: int, scratch: Scratch | None = None) -> DataFrame:
    return _take(buffer, [-F.col("position")], n, scratch)


def oldest_of_class(buffer: DataFrame, label: bool, n: int) -> DataFrame:
    return oldest(of_class(buffer, label), n)


def most_harmful(buffer: DataFrame, n: int | None) -> DataFrame:
    """Lowest known influence first."""
    return _take(buffer.where(F.col("influence").isNotNull()), [F.col("influence")], n)


def most_harmful_of_class(buffer: DataFrame, label: bool, n: int | None) -> DataFrame:
    return most_harmful(of_class(buffer, label), n)


def harmful_below(buffer: DataFrame, label: bool, n: int | None, threshold: float) -> DataFrame:
    """One class, influence strictly below the threshold."""
    return most_harmful(of_class(buffer, label).where(F.col("influence") < threshold), n)


def with_age(buffer: DataFrame, current_position: int) -> DataFrame:
    return buffer.withColumn(
        "age", F.greatest(F.lit(current_position) - F.col("position"), F.lit(0)).cast("bigint")
    )


def time_weighted_harmful(
    buffer: DataFrame, n: int | None, rate: float, current_position: int, label: bool | None = None
) -> DataFrame:
    """Lowest influence after a penalty per unit of age."""
    aged = with_age(buffer if label is None else of_class(buffer, label), current_position)
    weighted = aged.where(F.col("influence").isNotNull()).withColumn(
        "weighted", F.col("influence") - F.lit(rate) * F.col("age").cast("double")
    )
    return _take(weighted, [F.col("weighted")], n)


def age_prioritized(
    buffer: DataFrame, n: int | None, bracket_size: int, current_position: int
) -> DataFrame:
    """Oldest age bracket first, then lowest influence (unknown counts as 0)."""
    bracketed = with_age(buffer, current_position).withColumn(
        "bracket", F.expr(f"age div {max(bracket_size, 1)}")
    )
    return _take(bracketed, [-F.col("bracket"), F.coalesce("influence", F.lit(0.0))], n)


def longest_surviving(buffer: DataFrame, n: int | None, current_position: int) -> DataFrame:
    return _take(with_age(buffer, current_position), [-F.col("age")], n)


def influence_delta() -> Column:
    """Current minus previous influence; null if either is unknown."""
    return F.col("influence") - F.col("prev_influence")


def influence_degraded() -> Column:
    """Was helpful or neutral, is harmful now."""
    return F.coalesce((F.col("prev_influence") >= 0) & (F.col("influence") < 0), F.lit(False))


def degraded(buffer: DataFrame) -> DataFrame:
    return buffer.where(influence_degraded())


def rapidly_declining(buffer: DataFrame, min_delta: float) -> DataFrame:
    """Influence changes below ``min_delta``, steepest first."""
    changed = buffer.withColumn("delta", influence_delta())
    return _take(changed.where(F.col("delta") < min_delta), [F.col("delta")], None)


def uniform_subset(buffer: DataFrame, n: int, scratch: Scratch | None = None) -> DataFrame:
    """Every floor(N/n)-th row by position, first n; everything when n >= N."""
    total = buffer.count()
    if n >= total:
        return buffer
    if n <= 0:
        return buffer.limit(0)
    step = total // n
    ranked = with_rank(buffer, [F.col("position")], scratch or Scratch(buffer.sparkSession), "_rank")
    return ranked.where(
        (F.col("_rank") % step == 0) & (F.floor(F.col("_rank") / step) < n)
    ).drop("_rank")
