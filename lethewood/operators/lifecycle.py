"""Influence and removal-rank histories of buffered samples.

``influence_log``: sample_id, seq, position, score. ``rank_log``: sample_id, seq, position, rank.
Logs only grow; the newest 20 entries per sample are read through a row_number filter, which
Spark already limits per task before the shuffle, so a sample with a huge log stays cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 20


def newest_entries(log: DataFrame, keep: int = HISTORY) -> DataFrame:
    newest = Window.partitionBy("sample_id").orderBy(F.col("position").desc(), F.col("seq").desc())
    return log.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= keep).drop("_rn")


def record_influence(log: DataFrame, buffer: DataFrame, scores: DataFrame, position: int, seq: int) -> DataFrame:
    """Append scores of buffered samples. ``scores``: sample_id, score."""
    entries = scores.join(buffer.select("sample_id"), "sample_id", "left_semi").select(
        "sample_id",
        F.lit(seq).cast("bigint").alias("seq"),
        F.lit(position).cast("bigint").alias("position"),
        "score",
    )
    return log.unionByName(entries)


def record_ranks(log: DataFrame, buffer: DataFrame, ranked: DataFrame, position: int, seq: int) -> DataFrame:
    """Append ranks of buffered samples. ``ranked``: sample_id, rank (place in the removal list)."""
    entries = ranked.join(buffer.select("sample_id"), "sample_id", "left_semi").select(
        "sample_id",
        F.lit(seq).cast("bigint").alias("seq"),
        F.lit(position).cast("bigint").alias("position"),
        F.col("rank").cast("bigint").alias("rank"),
    )
    return log.unionByName(entries)


def history_stats(log: DataFrame) -> DataFrame:
    """Length, mean, population variance and trend of every history in one grouping.

    Trend is the mean of the later half minus the mean of the earlier half; an odd middle
    entry belongs to the later half.
    """
    per_sample = Window.partitionBy("sample_id")
    in_order = per_sample.orderBy("position", "seq")
    placed = (
        newest_entries(log)
        .withColumn("_at", F.row_number().over(in_order) - 1)
        .withColumn("_len", F.count(F.lit(1)).over(per_sample))
        .withColumn("_mean", F.avg("score").over(per_sample))
    )
    early = F.col("_at") < F.floor(F.col("_len") / 2)
    return placed.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("history_len"),
        F.first("_mean").alias("history_mean"),
        F.avg((F.col("score") - F.col("_mean")) * (F.col("score") - F.col("_mean"))).alias("variance"),
        (F.avg(F.when(~early, F.col("score"))) - F.avg(F.when(early, F.col("score")))).alias("trend"),
    )


def with_history(buffer: DataFrame, log: DataFrame) -> DataFrame:
    """Buffer rows with history_len, average, trend and variance."""
    return (
        buffer.join(history_stats(log), "sample_id", "left")
        .withColumn("history_len", F.coalesce("history_len", F.lit(0)))
        .withColumn("average", F.coalesce("history_mean", "influence"))
        .drop("history_mean")
    )


def risk_counts(buffer: DataFrame, rank_log: DataFrame, top_n: int) -> DataFrame:
    """Per buffered sample, how many kept ranks are inside the first ``top_n``."""
    hits = newest_entries(rank_log).groupBy("sample_id").agg(
        F.sum((F.col("rank") < top_n).cast("bigint")).alias("risk")
    )
    return buffer.join(hits, "sample_id", "left").withColumn("risk", F.coalesce("risk", F.lit(0)))


def core_concept(buffer: DataFrame, log: DataFrame, min_history: int, min_average: float) -> DataFrame:
    return with_history(buffer, log).where(
        (F.col("history_len") >= min_history) & (F.col("average") >= min_average)
    )


def declining(buffer: DataFrame, log: DataFrame, min_history: int) -> DataFrame:
    return (
        with_history(buffer, log)
        .where((F.col("history_len") >= min_history) & (F.col("trend") < 0))
        .orderBy("trend", "sample_id")
    )


def high_risk(buffer: DataFrame, rank_log: DataFrame, top_n: int, min_count: int) -> DataFrame:
    return (
        risk_counts(buffer, rank_log, top_n)
        .where(F.col("risk") >= min_count)
        .orderBy(F.col("risk").desc(), "sample_id")
    )


def stable(buffer: DataFrame, log: DataFrame, max_variance: float, min_history: int) -> DataFrame:
    return with_history(buffer, log).where(
        (F.col("history_len") >= max(min_history, 1)) & (F.col("variance") <= max_variance)
    )


def lifecycle(buffer: DataFrame, log: DataFrame, rank_log: DataFrame) -> DataFrame:
    """One nested record per buffered sample with both histories in order (at most 20 each)."""

    def collected(entries: DataFrame, value: str, name: str) -> DataFrame:
        item = F.struct("position", "seq", value)
        ordered = F.sort_array(F.collect_list(item))
        kept = F.transform(ordered, lambda e: F.struct(e["position"].alias("position"), e[value].alias(value)))
        return newest_entries(entries).groupBy("sample_id").agg(kept.alias(name))

    return (
        with_history(buffer, log)
        .join(collected(log, "score", "influence_history"), "sample_id", "left")
        .join(collected(rank_log, "rank", "rank_history"), "sample_id", "left")
        .select(
            "sample_id",
            "label",
            F.col("position").alias("insertion_position"),
            "influence_history",
            "rank_history",
            F.col("average").alias("average_influence"),
            F.col("trend").alias("influence_trend"),
        )
    )
