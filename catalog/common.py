"""Fixtures shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewood.config import RunConfig
from lethewood.operators.assignment import assign_trees
from lethewood.plans.growth import Forest, fit
from lethewood.plans.maintenance import forget, resolve
from lethewood.sources import samples as src
from lethewood.sources.scratch import Scratch
from oracle import forest_sql as O
from oracle import tables as T

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


BASE = RunConfig(num_trees=8, k=3, max_depth=4, num_features=4, num_splits_to_try=5)
LINE = BASE
EVENT = BASE.with_(categorical_attrs=src.EVENT_CATEGORICAL)
DOC = BASE
VECTOR = BASE.with_(num_features=src.VECTOR_FEATURES, max_depth=3)

SOURCES: dict[str, tuple[RunConfig, Callable[[SparkSession, str], DataFrame], str]] = {
    "line": (LINE, src.line_samples, T.LINE),
    "event": (EVENT, src.event_samples, T.EVENT),
    "doc": (DOC, src.document_samples, T.DOC),
    "vec": (VECTOR, src.vector_samples, T.VECTOR),
}

# Samples to forget, some at every scale: for events, everything of one user in eleven; for
# order lines, large lines at the top tax rate.
FORGET_SQL = {
    "event": "forgotten AS (SELECT sample_id FROM event WHERE user_id % 11 = 3)",
    "line": "forgotten AS (SELECT sample_id FROM line WHERE f[4] >= 0.08 AND f[1] > 25)",
}


def forgotten(name: str, spark: SparkSession, folder: str) -> DataFrame:
    if name == "event":
        events = src.table(spark, folder, "events")
        return events.where(F.col("user_id") % 11 == 3).select(F.col("event_id").alias("sample_id"))
    lines = src.line_samples(spark, folder)
    return lines.where((F.col("features")[3] >= 0.08) & (F.col("features")[0] > 25)).select("sample_id")


def samples(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return SOURCES[name][1](spark, folder)


def assigned(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return assign_trees(samples(name, spark, folder), SOURCES[name][0])


_models: dict[tuple[str, str, str], Forest] = {}


def _cached(spark: SparkSession, folder: str, kind: str, build: Callable[[], Forest]) -> Forest:
    """Models are reused between queries of one session."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _models:
        _models[key] = build()
    return _models[key]


def clear_models() -> None:
    _models.clear()


def model(name: str, spark: SparkSession, folder: str) -> Forest:
    config = SOURCES[name][0]
    return _cached(spark, folder, name, lambda: fit(samples(name, spark, folder), config, Scratch(spark)))


def pending_model(name: str, spark: SparkSession, folder: str) -> Forest:
    """The fitted model after forgetting, rebuilds still pending."""
    return _cached(
        spark,
        folder,
        f"{name}-pending",
        lambda: forget(model(name, spark, folder), forgotten(name, spark, folder)).forest,
    )


def forgotten_model(name: str, spark: SparkSession, folder: str) -> Forest:
    return _cached(
        spark, folder, f"{name}-forgotten", lambda: resolve(pending_model(name, spark, folder))
    )


def fit_ctes(name: str, source: str | None = None, p: str = "m_") -> list[str]:
    config, _, cte = SOURCES[name]
    return [cte, *O.fit(config, source or name, p)]


def forget_ctes(name: str, p: str = "m_") -> list[str]:
    """The model trained from scratch without the forgotten samples."""
    config, _, cte = SOURCES[name]
    live = f"live AS (SELECT * FROM {name} WHERE sample_id NOT IN (SELECT sample_id FROM forgotten))"
    return [cte, FORGET_SQL[name], live, *O.fit(config, "live", p)]


def vote_ctes(name: str, queries: str | None = None) -> list[str]:
    return [*fit_ctes(name), *O.walk(SOURCES[name][0], queries or name, "m_", "q_")]


NODE_SQL = (
    "SELECT tree_id, node_id, depth, kind, attr, threshold, subset, base, n, n_pos FROM {p}nodes"
)


def node_columns(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        "tree_id", "node_id", "depth", "kind", "attr", "threshold", "subset", "base", "n", "n_pos"
    )


def joined_array(column: str) -> Column:
    return F.concat_ws(",", F.col(column).cast("array<string>"))
