"""The bounded sample buffer: registration, eviction and its counters.

``buffer``: sample_id, position, label, tree_ids, influence, prev_influence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.draws import uniform
from ..sources.ordering import top_n, with_running_total
from ..sources.scratch import Scratch
from .selection import influence_degraded, influence_delta, newest

BUFFER_SCHEMA = (
    "sample_id BIGINT, position BIGINT, label BOOLEAN, tree_ids ARRAY<INT>, "
    "influence DOUBLE, prev_influence DOUBLE"
)
BASE_BYTES, TREE_BYTES, ENTRY_BYTES = 84, 8, 16

# Fixed values of the eviction score.
DEGRADED_BONUS = 0.3
DECLINE_BONUS = 0.15
DECLINE_DELTA = -0.1
MINORITY_PENALTY = -0.5
EXTREME_SHARE, EXTREME_PROTECTION = 0.05, 0.2
MODERATE_PROTECTION = 0.5
MIN_RANGE = 1e-9


@dataclass(frozen=True)
class Eviction:
    kept: DataFrame
    evicted: DataFrame


def empty_buffer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BUFFER_SCHEMA)


def entries(samples: DataFrame) -> DataFrame:
    """New buffer rows from assigned samples with a position."""
    unknown = F.lit(None).cast("double")
    return samples.select(
        "sample_id",
        "position",
        "label",
        "tree_ids",
        unknown.alias("influence"),
        unknown.alias("prev_influence"),
    )


def insert(buffer: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by id."""
    return buffer.join(new.select("sample_id"), "sample_id", "left_anti").unionByName(new)


def remove(buffer: DataFrame, ids: DataFrame) -> DataFrame:
    return buffer.join(ids.select("sample_id"), "sample_id", "left_anti")


def can_unlearn() -> Column:
    """A row can be unlearned while it is in some tree."""
    return F.size("tree_ids") > 0


def memory_bytes(history: str = "0", ranks: str = "0") -> Column:
    """Estimated bytes of a row; histories are given as entry counts."""
    return F.expr(
        f"CAST({BASE_BYTES} + {TREE_BYTES} * size(tree_ids) + {ENTRY_BYTES} * ({history} + {ranks}) AS BIGINT)"
    )


def buffer_totals(buffer: DataFrame) -> DataFrame:
    """Rows, bytes and megabytes."""
    return buffer.agg(
        F.count(F.lit(1)).alias("size"), F.coalesce(F.sum(memory_bytes()), F.lit(0)).alias("bytes")
    ).withColumn("memory_mb", F.col("bytes").cast("double") / F.lit(1048576.0))


def class_balance(buffer: DataFrame) -> DataFrame:
    """Counts per class, minority and majority label, imbalance ratio (infinite if one is empty)."""
    counted = buffer.agg(
        F.count(F.when(~F.col("label"), 1)).alias("n_neg"), F.count(F.when(F.col("label"), 1)).alias("n_pos")
    )
    smaller, larger = F.least("n_neg", "n_pos"), F.greatest("n_neg", "n_pos")
    return counted.select(
        "n_neg",
        "n_pos",
        (F.col("n_pos") < F.col("n_neg")).alias("minority_class"),
        (~(F.col("n_pos") < F.col("n_neg"))).alias("majority_class"),
        F.when(smaller == 0, F.lit(float("inf")))
        .otherwise(larger.cast("double") / smaller.cast("double"))
        .alias("imbalance_ratio"),
    )


def random_rank(config: RunConfig, current_position: int) -> Column:
    """A keyed draw per (sample, stream position)."""
    return F.expr(uniform(config.seed, "evict", "sample_id", f"{current_position}L"))


def eviction_scores(buffer: DataFrame, config: RunConfig, current_position: int) -> DataFrame:
    """Add ``score``: age, influence and class terms, higher is evicted first.

    The buffer-wide figures are one aggregation used as a scalar.
    """
    figures = buffer.agg(
        F.struct(
            F.greatest(F.lit(current_position) - F.min("position"), F.lit(1)).alias("max_age"),
            F.min("influence").alias("lo"),
            F.max("influence").alias("hi"),
            F.count(F.when(F.col("label"), 1)).alias("n_pos"),
            F.count(F.when(~F.col("label"), 1)).alias("n_neg"),
        ).alias("s")
    )
    known = buffer.withColumn("s", figures.scalar())
    age = F.greatest(F.lit(current_position) - F.col("position"), F.lit(0)).cast("double")
    age_signal = age / F.col("s.max_age").cast("double")
    if config.budget_class_aware_random:
        age_signal = random_rank(config, current_position)
    lo, hi = F.col("s.lo"), F.col("s.hi")
    influence = F.coalesce(F.col("influence"), (lo + hi) / 2.0)
    norm = F.when(lo.isNull(), 0.0).otherwise((hi - influence) / F.greatest(hi - lo, F.lit(MIN_RANGE)))
    bonus = (
        F.when(influence_degraded(), DEGRADED_BONUS)
        .when(influence_delta() < DECLINE_DELTA, DECLINE_BONUS)
        .otherwise(0.0)
    )
    is_minority = F.col("label") == (F.col("s.n_pos") < F.col("s.n_neg"))
    penalty = F.when(is_minority, MINORITY_PENALTY).otherwise(0.0)
    own = F.when(F.col("label"), F.col("s.n_pos")).otherwise(F.col("s.n_neg")).cast("double")
    share = own / (F.col("s.n_pos") + F.col("s.n_neg")).cast("double")
    protection = (
        F.when(share < EXTREME_SHARE, EXTREME_PROTECTION)
        .when(share < config.budget_minority_protection, MODERATE_PROTECTION)
        .otherwise(1.0)
    )
    raw = (
        F.lit(config.budget_age_weight) * age_signal
        + F.lit(config.budget_influence_weight) * (norm + bonus)
        + F.lit(config.budget_class_weight) * penalty
    )
    return known.withColumn("score", raw * protection).drop("s")


def eviction_order(
    buffer: DataFrame, config: RunConfig, current_position: int
) -> tuple[DataFrame, list[Column]]:
    """The buffer with its eviction key, and the order in which rows leave."""
    if config.budget_random_eviction:
        keyed = buffer.withColumn("score", random_rank(config, current_position))
        return keyed, [F.col("score"), F.col("sample_id")]
    scored = eviction_scores(buffer, config, current_position)
    return scored, [-F.col("score"), F.col("sample_id")]


def overflow(size: int, config: RunConfig) -> int:
    """Rows to evict: at least one eviction batch once the buffer is over budget."""
    if size <= config.budget_max_samples:
        return 0
    return max(size - config.budget_max_samples, config.budget_eviction_batch)


def budget_evict(
    buffer: DataFrame, config: RunConfig, current_position: int, scratch: Scratch
) -> Eviction:
    """Evict the highest scores when the buffer is over budget."""
    n = overflow(buffer.count(), config)
    if n == 0:
        return Eviction(buffer, buffer.limit(0))
    keyed, order = eviction_order(buffer, config, current_position)
    evicted = top_n(keyed, order, n, scratch).select(*buffer.columns)
    return Eviction(remove(buffer, evicted), evicted)


def fifo_evict(buffer: DataFrame, max_samples: int, scratch: Scratch) -> Eviction:
    """Keep the newest rows only."""
    kept = newest(buffer, max_samples, scratch)
    return Eviction(kept, remove(buffer, kept))


def memory_evict(
    buffer: DataFrame,
    max_bytes: int,
    scratch: Scratch,
    row_bytes: Column | None = None,
) -> Eviction:
    """Evict the oldest rows until the estimated bytes fit."""
    sized = buffer.withColumn("_bytes", memory_bytes() if row_bytes is None else row_bytes)
    newest_first = [F.col("position").desc(), F.col("sample_id")]
    running = with_running_total(sized, newest_first, "_bytes", scratch, "_running")
    running = running.withColumn("_fits", F.col("_running") <= max_bytes)
    return Eviction(
        running.where("_fits").select(*buffer.columns), running.where("NOT _fits").select(*buffer.columns)
    )


def eviction_log_rows(evicted: DataFrame, reason: str) -> DataFrame:
    return evicted.select(
        "sample_id", "label", "influence", influence_degraded().alias("degraded"), F.lit(reason).alias("reason")
    )


def eviction_stats(log: DataFrame) -> DataFrame:
    """Cumulative figures over budget evictions only."""
    return log.where(F.col("reason") == "budget").agg(
        F.count(F.lit(1)).alias("evicted_count"),
        F.count(F.when(~F.col("label"), 1)).alias("evicted_benign"),
        F.count(F.when(F.col("label"), 1)).alias("evicted_attack"),
        F.count(F.when(F.col("degraded"), 1)).alias("evicted_degraded"),
        F.count("influence").alias("evicted_with_influence"),
        F.coalesce(F.sum("influence"), F.lit(0.0)).alias("evicted_influence_sum"),
    )
