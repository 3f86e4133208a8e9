"""Run configuration: one frozen record, also available as a one-row table."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

UNLIMITED_BYTES = 2**63 - 1
MEGABYTE = 1024 * 1024

INFLUENCE_STRATEGIES = (
    "none",
    "oob",
    "loss",
    "confidence",
    "conflict",
    "cumulative_oob",
    "feature_distance",
)


@dataclass(frozen=True)
class RunConfig:
    # Forest
    num_trees: int = 50
    k: int = 10
    minority_k: int = 0
    max_depth: int = 15
    num_features: int = 41
    seed: int = 42
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: int | None = None
    num_splits_to_try: int = 10
    categorical_attrs: tuple[int, ...] = ()

    # Stream
    warmup_samples: int = 1000
    metrics_window: int = 1000
    memory_max_bytes: int = 100 * MEGABYTE

    # Buffer budget
    budget_enabled: bool = False
    budget_max_samples: int = 10000
    budget_eviction_batch: int = 100
    budget_minority_protection: float = 0.1
    budget_age_weight: float = 0.4
    budget_influence_weight: float = 0.4
    budget_class_weight: float = 0.2
    budget_random_eviction: bool = False
    budget_class_aware_random: bool = False
    budget_skip_forest_forget: bool = False
    budget_rebuild_interval: int = 0
    budget_use_feature_distance: bool = False

    # Influence
    influence_tracking: bool = False
    influence_update_interval: int = 10
    influence_sample_count: int = 200
    influence_strategy: str = "none"
    feat_dist_update_interval: int = 2000

    # Execution
    broadcast_bytes: int = 64 * MEGABYTE
    rewrite_every: int = 6
    # A node with at most so many rows, holding at most so many values, is finished in one task.
    finish_rows: int = 1 << 19
    finish_values: int = 1 << 21
    # Change tables kept over a model table or a leaf map before they are folded into a new one.
    fold_after: int = 8
    # Whether the stateful surface stores a leaf map (a copy of a sample per tree that holds it).
    leaf_map: bool = False

    def __post_init__(self) -> None:
        if self.max_depth > 61:
            raise ValueError("max_depth above 61 does not fit heap-numbered BIGINT node ids")
        if self.num_trees < 0 or self.num_features < 0:
            raise ValueError("num_trees and num_features must not be negative")

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> RunConfig:
        """Missing keys take defaults; ``memory_limit_mb`` 0 means unlimited."""
        given = dict(values)
        limit = given.pop("memory_limit_mb", None)
        if limit is not None:
            given["memory_max_bytes"] = UNLIMITED_BYTES if limit == 0 else limit * MEGABYTE
        known = {f.name for f in fields(cls)}
        given = {name: value for name, value in given.items() if name in known}
        if "categorical_attrs" in given:
            given["categorical_attrs"] = tuple(given["categorical_attrs"])
        return cls(**given)

    def with_(self, **changes: Any) -> RunConfig:
        return replace(self, **changes)

    @property
    def trees_per_sample(self) -> int:
        return self.clamp_k(self.k)

    def clamp_k(self, k: int) -> int:
        return min(max(k, 1), self.num_trees)

    @property
    def features_per_split(self) -> int:
        wanted = self.max_features
        if wanted is None:
            wanted = math.ceil(math.sqrt(self.num_features))
        return min(wanted, self.num_features)

    @property
    def finish_limit(self) -> int:
        return min(self.finish_rows, self.finish_values // max(1, self.num_features))

    def to_table(self, spark: SparkSession) -> DataFrame:
        """The configuration as one row, one column per field."""
        values = asdict(self)
        types = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
        schema, row = [], []
        for name, value in values.items():
            if name == "categorical_attrs":
                schema.append(T.StructField(name, T.ArrayType(T.IntegerType())))
                row.append(list(value))
            elif value is None:
                schema.append(T.StructField(name, T.LongType()))
                row.append(None)
            else:
                schema.append(T.StructField(name, types[type(value)]))
                row.append(value)
        return spark.createDataFrame([tuple(row)], T.StructType(schema))
