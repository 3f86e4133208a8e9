"""Sample tables: look-up, membership, profile and feature kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lookup(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the wanted ids."""
    return samples.join(ids.select("sample_id").distinct(), "sample_id", "left_semi")


def membership(samples: DataFrame, ids: DataFrame) -> DataFrame:
    """Each asked id with a flag."""
    known = samples.select("sample_id", F.lit(True).alias("present"))
    return ids.select("sample_id").distinct().join(known, "sample_id", "left").fillna(
        False, ["present"]
    )


def remove(samples: DataFrame, ids: DataFrame) -> DataFrame:
    return samples.join(ids.select("sample_id"), "sample_id", "left_anti")


def profile(samples: DataFrame, num_features: int) -> DataFrame:
    """Rows, positives, negatives and the range of every attribute, in one aggregation.

    An empty table has range (0, 1) for every attribute.
    """
    value = [F.col("features")[i] for i in range(num_features)]
    totals = samples.agg(
        F.count(F.lit(1)).alias("num_records"),
        F.coalesce(F.sum(F.col("label").cast("bigint")), F.lit(0)).alias("num_plus"),
        *[F.min(v).alias(f"lo_{i}") for i, v in enumerate(value)],
        *[F.max(v).alias(f"hi_{i}") for i, v in enumerate(value)],
    )
    return totals.select(
        "num_records",
        "num_plus",
        (F.col("num_records") - F.col("num_plus")).alias("num_minus"),
        F.array(*[F.coalesce(f"lo_{i}", F.lit(0.0)) for i in range(num_features)]).alias("lows"),
        F.array(*[F.coalesce(f"hi_{i}", F.lit(1.0)) for i in range(num_features)]).alias("highs"),
    )


def attribute_ranges(profiled: DataFrame) -> DataFrame:
    """The profile with one row per attribute."""
    pairs = F.arrays_zip(F.col("lows").alias("lo"), F.col("highs").alias("hi"))
    return profiled.select(
        F.posexplode(pairs).alias("attr", "range"), "num_records", "num_plus", "num_minus"
    ).select("attr", "range.lo", "range.hi", "num_records", "num_plus", "num_minus")


def feature_spec(
    spark: SparkSession, names: Sequence[str], categorical_attrs: Sequence[int] = ()
) -> DataFrame:
    """attr, name, kind. Kinds default to numerical and are never inferred from data."""
    rows = [
        (i, name, "categorical" if i in set(categorical_attrs) else "numerical")
        for i, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, "attr INT, name STRING, kind STRING")
