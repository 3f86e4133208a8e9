"""Turning ordinary tables into labelled sample tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordering import with_rank
from .scratch import Scratch

SAMPLE_SCHEMA = "sample_id BIGINT, position BIGINT, features ARRAY<DOUBLE>, label BOOLEAN"


BAD_SAMPLE = "sample with missing, non-finite or miscounted features"


def _finite(value: Column) -> Column:
    """The value with -0.0 folded to 0.0; fails the job instead of dropping the row."""
    value = value.cast("double") + F.lit(0.0)
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(BAD_SAMPLE)).cast("double")).otherwise(value)


def feature_vector(columns: Sequence[Column]) -> Column:
    """An array of checked doubles; every input expression is evaluated once."""
    return F.transform(F.array(*[c.cast("double") for c in columns]), _finite)


def checked_array(values: Column, num_features: int) -> Column:
    complete = values.isNotNull() & (F.size(values) == num_features)
    return F.when(complete, F.transform(values, _finite)).otherwise(
        F.raise_error(F.lit(BAD_SAMPLE)).cast("array<double>")
    )


def samples_from(
    df: DataFrame,
    sample_id: Column,
    features: Sequence[Column] | Column,
    label: Column,
    num_features: int,
    position: Column | None = None,
) -> DataFrame:
    """One narrow projection: sample_id, position, features, label.

    The id stays a plain column, so filters on it reach the scan; its check runs with the
    features, which every training job reads.
    """
    if isinstance(features, Column):
        vector = checked_array(features, num_features)
    else:
        vector = feature_vector(features)
    sid = sample_id.cast("bigint")
    bad_id = F.raise_error(F.lit("sample ids must be non-negative")).cast("array<double>")
    return df.select(
        sid.alias("sample_id"),
        (position.cast("bigint") if position is not None else F.lit(None).cast("bigint")).alias(
            "position"
        ),
        F.when(sid.isNull() | (sid < 0), bad_id).otherwise(vector).alias("features"),
        label.cast("boolean").alias("label"),
    )


def assign_positions(
    samples: DataFrame, order: Sequence[Column], scratch: Scratch, start: int = 0
) -> DataFrame:
    """Dense stream positions from an order column; ``start`` is the stored offset."""
    ranked = with_rank(samples.drop("position"), list(order), scratch, "position")
    return ranked.withColumn("position", F.col("position") + F.lit(start))


def first_of_each_id(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per sample id, the smallest by ``order``, whatever order the rows come in.
    Columns beyond the id and ``order`` are dropped."""
    kept = rows.groupBy("sample_id").agg(F.min(F.struct(*order)).alias("_row"))
    return kept.select("sample_id", "_row.*")


def keep_latest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Register rows by id: a known id is replaced by the newer row."""
    return old.join(new.select("sample_id"), "sample_id", "left_anti").unionByName(new)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Sample tables over the star-schema, event, document and vector tables.

LINE_FEATURES = 4
EVENT_FEATURES = 4
EVENT_CATEGORICAL = (1, 2)
DOC_FEATURES = 4
VECTOR_FEATURES = 64


LINE_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
LINES_PER_ORDER = 1 << 20
ORDER_KEYS = 1 << 43


def line_samples(spark: SparkSession, folder: str, label: Column | None = None) -> DataFrame:
    """Order lines; of rows with equal keys the smallest (price, date, quantity) counts.

    The id is the order's key times 2**20 plus the line's place within its order: different
    lines never share one, and a key or an order too large for that fails the job. One shuffle
    on the order serves both steps.
    """
    lines = table(spark, folder, "lineitem")
    learnable = (F.col("l_discount") > 0.05) & (F.col("l_quantity") > 20)
    first = F.min(
        F.struct(
            "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag"
        )
    )
    unique = lines.repartition("l_orderkey").groupBy(*LINE_KEYS).agg(first.alias("row"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_KEYS[1:]))
    fits = F.col("l_orderkey").between(0, ORDER_KEYS - 1) & (F.col("_place") < LINES_PER_ORDER)
    sid = F.when(fits, F.col("l_orderkey") * LINES_PER_ORDER + F.col("_place")).otherwise(
        F.raise_error(F.lit("order key or number of lines out of range")).cast("bigint")
    )
    numbered = unique.withColumn("_place", place).select(sid.alias("sample_id"), "row.*")
    return samples_from(
        numbered,
        F.col("sample_id"),
        [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
        learnable if label is None else label,
        LINE_FEATURES,
    )


def event_samples(spark: SparkSession, folder: str, label: Column | None = None) -> DataFrame:
    """Events; hour of day and day of week are category codes."""
    return samples_from(
        table(spark, folder, "events"),
        F.col("event_id"),
        [
            F.col("value"),
            F.hour("ts"),
            F.dayofweek("ts") - 1,
            F.regexp_extract("props", '"k": ?([0-9]+)', 1),
        ],
        (F.col("value") > 40) & F.hour("ts").between(6, 17) if label is None else label,
        EVENT_FEATURES,
        F.col("event_id"),
    )


def document_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents described by length, word and digit statistics of the whole text."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    words = F.split(F.col("text"), " ")
    docs = table(spark, folder, "documents").join(labels, "doc_id")
    return samples_from(
        docs,
        F.col("doc_id"),
        [
            F.col("n_chars"),
            F.size(words),
            F.size(F.array_distinct(words)).cast("double") / F.size(words).cast("double"),
            (F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))).cast("double")
            / F.greatest(F.length("text"), F.lit(1)).cast("double"),
        ],
        F.col("toxic") == 1,
        DOC_FEATURES,
        F.col("doc_id"),
    )


def vector_samples(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return samples_from(
        vectors,
        F.col("vec_id"),
        F.col("embedding"),
        F.col("label") >= 5,
        VECTOR_FEATURES,
        F.col("vec_id"),
    )
