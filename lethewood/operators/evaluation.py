"""Confusion counts and the rates derived from them, cumulative and over sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ordering import top_n, with_rank
from ..sources.scratch import Scratch

COUNTS = ("tn", "fp", "fn", "tp")
METRICS = (
    "accuracy",
    "balanced_accuracy",
    "tpr",
    "tnr",
    "fpr",
    "fnr",
    "precision",
    "gmean",
    "f1_score",
    "kappa",
)
BLOCK_ROWS = 65536


def cell_flags() -> dict[str, Column]:
    """One 0/1 BIGINT per confusion cell of a row with ``label`` and ``pred``."""
    label, pred = F.col("label"), F.col("pred")
    cells = {"tn": ~label & ~pred, "fp": ~label & pred, "fn": label & ~pred, "tp": label & pred}
    return {name: cell.cast("bigint") for name, cell in cells.items()}


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    sums = [F.coalesce(F.sum(flag), F.lit(0)).alias(name) for name, flag in cell_flags().items()]
    counted = predictions.groupBy(*by).agg(*sums) if by else predictions.agg(*sums)
    return with_totals(counted)


def with_totals(counts: DataFrame) -> DataFrame:
    return counts.selectExpr(
        "*", "tn + fp + fn + tp AS total", "fn + tp AS actual_positive", "tn + fp AS actual_negative"
    )


def merge_confusions(matrices: DataFrame, *by: str) -> DataFrame:
    """Sum of confusion matrices."""
    sums = [F.sum(name).alias(name) for name in COUNTS]
    return with_totals(matrices.groupBy(*by).agg(*sums) if by else matrices.agg(*sums))


def subtract_confusion(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Counts of ``left`` minus those of ``right``, never below zero."""
    renamed = right.select(by, *[F.col(c).alias(f"_{c}") for c in COUNTS])
    kept = left.join(renamed, by, "left").selectExpr(
        by, *[f"greatest({c} - coalesce(_{c}, 0L), 0L) AS {c}" for c in COUNTS]
    )
    return with_totals(kept)


def _ratio(part: str, whole: str, empty: str) -> str:
    return f"(CASE WHEN {whole} = 0 THEN {empty} ELSE CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) END)"


TPR = _ratio("tp", "(tp + fn)", "1.0D")
TNR = _ratio("tn", "(tn + fp)", "1.0D")
PRECISION = _ratio("tp", "(tp + fp)", "1.0D")
ACCURACY = _ratio("(tp + tn)", "(tn + fp + fn + tp)", "0.0D")

RATES = {
    "accuracy": ACCURACY,
    "balanced_accuracy": f"(({TPR} + {TNR}) / 2.0D)",
    "tpr": TPR,
    "tnr": TNR,
    "fpr": f"(1.0D - {TNR})",
    "fnr": f"(1.0D - {TPR})",
    "precision": PRECISION,
    "gmean": f"(CASE WHEN {TPR} = 0 OR {TNR} = 0 THEN 0.0D ELSE sqrt({TPR} * {TNR}) END)",
    "f1_score": (
        f"(CASE WHEN {PRECISION} + {TPR} = 0 THEN 0.0D "
        f"ELSE 2.0D * {PRECISION} * {TPR} / ({PRECISION} + {TPR}) END)"
    ),
}

_TOTAL = "CAST(tn + fp + fn + tp AS DOUBLE)"
_CHANCE = (
    f"((CAST(tp + fp AS DOUBLE) / {_TOTAL}) * (CAST(tp + fn AS DOUBLE) / {_TOTAL})"
    f" + (CAST(tn + fn AS DOUBLE) / {_TOTAL}) * (CAST(tn + fp AS DOUBLE) / {_TOTAL}))"
)
KAPPA = (
    "(CASE WHEN tn + fp + fn + tp = 0 THEN 0.0D "
    f"WHEN abs(1.0D - {_CHANCE}) < 1e-10D THEN CASE WHEN abs({ACCURACY} - 1.0D) < 1e-10D THEN 1.0D ELSE 0.0D END "
    f"ELSE ({ACCURACY} - {_CHANCE}) / (1.0D - {_CHANCE}) END)"
)


def with_rates(counts: DataFrame) -> DataFrame:
    """All rates of a table of confusion counts."""
    rates = [f"{sql} AS {name}" for name, sql in RATES.items()]
    return counts.selectExpr("*", *rates, f"{KAPPA} AS kappa")


def cumulative_metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """All-time metrics in one aggregation."""
    return with_rates(confusion(predictions, *by))


def sliding_counts(
    predictions: DataFrame, window: int, scratch: Scratch, dense: bool = False
) -> DataFrame:
    """Confusion counts over the last ``window`` predictions, after every prediction.

    Rows are cut into blocks of consecutive positions; the window - 1 rows before a block
    are copied into it, so each block is a bounded, independent window group. Inside it the
    count is a difference of two running totals, linear in rows whatever the window.
    """
    ranked = (
        predictions.withColumn("rank", F.col("position"))
        if dense
        else with_rank(predictions, [F.col("position")], scratch, "rank")
    )
    size = max(window, BLOCK_ROWS)
    own = F.floor(F.col("rank") / size)
    reaches_next = F.col("rank") % size > size - window
    blocks = F.when(reaches_next, F.array(own, own + 1)).otherwise(F.array(own))
    copied = ranked.select("*", own.alias("_own"), F.explode(blocks).alias("_block"))
    in_order = Window.partitionBy("_block").orderBy("rank")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    running = {f"_{name}": F.sum(flag).over(so_far) for name, flag in cell_flags().items()}
    dropped = {name: F.lag(f"_{name}", window, 0).over(in_order) for name in COUNTS}
    counts = {name: F.col(f"_{name}") - dropped[name] for name in COUNTS}
    counted = copied.withColumns(running).withColumns(counts).where("_block = _own")
    return counted.drop("_own", "_block", "rank", *running)


def sliding_metrics(
    predictions: DataFrame, window: int, scratch: Scratch, dense: bool = False
) -> DataFrame:
    """Metrics after every prediction. A window of 0 keeps cumulative metrics only."""
    if window == 0:
        return cumulative_metrics(predictions)
    return with_rates(with_totals(sliding_counts(predictions, window, scratch, dense)))


def current_metrics(
    predictions: DataFrame, window: int, scratch: Scratch | None = None
) -> DataFrame:
    """Metrics over the newest ``window`` predictions, else cumulative."""
    recent = predictions
    if window > 0:
        scratch = scratch or Scratch(predictions.sparkSession)
        recent = top_n(predictions, [-F.col("position")], window, scratch)
    return cumulative_metrics(recent)
