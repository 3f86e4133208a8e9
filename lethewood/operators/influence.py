"""Influence of training samples on test predictions, from per-tree votes.

A sample's influence depends only on the set of trees holding it, and a test row counts
only through its votes and label. Both are packed into bit words, equal ones are merged
with their multiplicity, and the merged test side is handed around in bounded chunks. No
(train, test) pair is ever a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..plans.growth import Forest
from ..sources.ordering import top_n
from ..sources.scratch import Scratch
from .scoring import predict, tree_votes
from .selection import newest, uniform_subset

WORD_TREES = 62
CHUNK_PATTERNS = 4096
PROBA_FLOOR = 1e-7
EMA_NEW = 0.3
CENTROID_ROWS = 1000


def words_of(num_trees: int) -> range:
    return range(max(1, math.ceil(num_trees / WORD_TREES)))


def vote_words(votes: DataFrame, num_trees: int) -> DataFrame:
    """One row per test sample: its votes as bit words w0, w1, ..."""
    words = [
        F.expr(
            f"sum(CASE WHEN vote AND tree_id div {WORD_TREES} = {w} "
            f"THEN shiftleft(1L, tree_id % {WORD_TREES}) ELSE 0L END) AS w{w}"
        )
        for w in words_of(num_trees)
    ]
    return votes.groupBy("sample_id", "label").agg(*words)


def with_masks(assigned: DataFrame, num_trees: int) -> DataFrame:
    """Add the sample's trees as bit words m0, m1, ..."""
    return assigned.selectExpr(
        "*",
        *[
            f"aggregate(filter(tree_ids, t -> t div {WORD_TREES} = {w}), 0L, "
            f"(word, t) -> word | shiftleft(1L, t % {WORD_TREES})) AS m{w}"
            for w in words_of(num_trees)
        ],
    )


def _tallies(num_trees: int, pattern: str = "") -> tuple[str, str, str, str]:
    """In-bag votes, in-bag trees, out-of-bag votes, out-of-bag trees."""
    words = words_of(num_trees)
    inside = "(" + " + ".join(f"bit_count({pattern}w{w} & m{w})" for w in words) + ")"
    size = "(" + " + ".join(f"bit_count(m{w})" for w in words) + ")"
    total = "(" + " + ".join(f"bit_count({pattern}w{w})" for w in words) + ")"
    return inside, size, f"({total} - {inside})", f"({num_trees} - {size})"


def oob_score(num_trees: int, pattern: str = "") -> str:
    """In-bag majority right minus out-of-bag majority right: -1, 0 or 1."""
    inside, size, outside, rest = _tallies(num_trees, pattern)
    label = f"{pattern}label"
    return (
        f"(CAST((2 * {inside} > {size}) = {label} AS BIGINT)"
        f" - CAST((2 * {outside} > {rest}) = {label} AS BIGINT))"
    )


def loss_score(num_trees: int, pattern: str = "") -> str:
    """Cross entropy out of bag minus in bag."""
    inside, size, outside, rest = _tallies(num_trees, pattern)

    def entropy(votes: str, trees: str) -> str:
        proba = f"CAST({votes} AS DOUBLE) / CAST({trees} AS DOUBLE)"
        clamped = f"least(greatest({proba}, {PROBA_FLOOR}D), 1.0D - {PROBA_FLOOR}D)"
        return f"(-(CASE WHEN {pattern}label THEN ln({clamped}) ELSE ln(1.0D - {clamped}) END))"

    return f"({entropy(outside, rest)} - {entropy(inside, size)})"


def _defined(num_trees: int) -> str:
    _, size, _, rest = _tallies(num_trees)
    return f"({size} > 0 AND {rest} > 0)"


def pair_influence(forest: Forest, tests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both scores for given (sample_id, test_id) pairs; null without in- or out-of-bag trees."""
    trees = forest.config.num_trees
    words = vote_words(tree_votes(forest, tests), trees).withColumnRenamed("sample_id", "test_id")
    masks = with_masks(forest.samples.select("sample_id", "tree_ids"), trees)
    joined = pairs.join(words, "test_id").join(masks, "sample_id", "left")
    defined = f"tree_ids IS NOT NULL AND {_defined(trees)}"
    return joined.selectExpr(
        "sample_id",
        "test_id",
        f"CASE WHEN {defined} THEN CAST({oob_score(trees)} AS DOUBLE) END AS oob_influence",
        f"CASE WHEN {defined} THEN {loss_score(trees)} END AS loss_influence",
    )


def test_patterns(votes: DataFrame, num_trees: int) -> DataFrame:
    """Distinct (votes, label) of the test side with multiplicity."""
    words = [f"w{w}" for w in words_of(num_trees)]
    return vote_words(votes, num_trees).groupBy(*words, "label").agg(F.count(F.lit(1)).alias("times"))


def mean_influences(
    assigned: DataFrame, patterns: DataFrame, config: RunConfig, scratch: Scratch, loss: bool = False
) -> DataFrame:
    """Mean score of every assigned sample over all test rows; null where undefined."""
    trees = config.num_trees
    masks = [f"m{w}" for w in words_of(trees)]
    words = [f"w{w}" for w in words_of(trees)]
    patterns = scratch.write(patterns, "patterns")
    total, count = patterns.agg(
        F.coalesce(F.sum("times"), F.lit(0)), F.count(F.lit(1))
    ).first()
    chunks = max(1, math.ceil(count / CHUNK_PATTERNS))
    chunk = F.pmod(F.xxhash64(*words, "label"), F.lit(chunks)).cast("int").alias("chunk")
    chunked = patterns.groupBy(chunk).agg(F.collect_list(F.struct(*words, "label", "times")).alias("tests"))
    if count * (16 + 8 * len(words)) <= config.broadcast_bytes:
        chunked = F.broadcast(chunked)
    masked = with_masks(assigned.select("sample_id", "tree_ids"), trees)
    distinct = masked.select(*masks).distinct().where(_defined(trees))
    spread = distinct.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    score, zero = (loss_score, "0.0D") if loss else (oob_score, "0L")
    part = f"aggregate(tests, {zero}, (acc, x) -> acc + {score(trees, 'x.')} * x.times) AS part"
    scored = (
        spread.join(chunked, "chunk")
        .selectExpr(*masks, part)
        .groupBy(*masks)
        .agg((F.sum("part").cast("double") / F.lit(float(max(total, 1)))).alias("influence"))
    )
    scored = scratch.write(scored, "scored")
    if scored.count() * (16 + 8 * len(masks)) <= config.broadcast_bytes:
        scored = F.broadcast(scored)  # few tree sets, each shared by many samples
    return masked.join(scored, masks, "left").select("sample_id", "influence")


def all_influences(forest: Forest, tests: DataFrame, loss: bool = False) -> DataFrame:
    """Influence of every live sample on a whole test table."""
    patterns = test_patterns(tree_votes(forest, tests), forest.config.num_trees)
    return mean_influences(forest.samples, patterns, forest.config, forest.scratch, loss)


def harmful(influences: DataFrame, k: int | None = None) -> DataFrame:
    """Samples with negative influence, worst first."""
    negative = influences.where(F.col("influence") < 0)
    order = [F.col("influence"), F.col("sample_id")]
    if k is None:
        return negative.orderBy(*order)
    return top_n(negative, order, k, Scratch(influences.sparkSession))


# Scores written into the buffer.


def confidence_influence() -> Column:
    """Minus the probability of the true class (``proba``, ``label``)."""
    return -F.when(F.col("label"), F.col("proba")).otherwise(1.0 - F.col("proba"))


def conflict_influence() -> Column:
    """Disagreement: minus the confidence; agreement: confidence above one half."""
    predicted = F.col("proba") > 0.5
    confidence = F.when(predicted, F.col("proba")).otherwise(1.0 - F.col("proba"))
    agrees = F.when(F.col("label"), F.col("proba")).otherwise(1.0 - F.col("proba"))
    return F.when(predicted != F.col("label"), -confidence).otherwise(agrees - 0.5)


def ema_influence(new: Column, old: Column) -> Column:
    return F.lit(EMA_NEW) * new + F.lit(1.0 - EMA_NEW) * F.coalesce(old, F.lit(0.0))


def centroid(rows: DataFrame, num_features: int, scratch: Scratch | None = None) -> DataFrame:
    """Mean feature vector of the newest rows, as one row."""
    recent = newest(rows, CENTROID_ROWS, scratch)
    means = [F.avg(F.col("features")[i]) for i in range(num_features)]
    return recent.agg(F.array(*means).alias("centroid"))


def feature_distance(rows: DataFrame, num_features: int, scratch: Scratch | None = None) -> DataFrame:
    """Minus the Euclidean distance to the centroid of the newest rows."""
    center = centroid(rows, num_features, scratch).scalar()
    squares = F.zip_with("features", "_center", lambda v, c: (v - c) * (v - c))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, v: total + v))
    centered = rows.withColumn("_center", center)
    return centered.select("sample_id", (-distance).alias("influence"))


def set_influence(buffer: DataFrame, scores: DataFrame, tracking: bool = True) -> DataFrame:
    """Write known scores; the old value moves to prev_influence only while tracking."""
    renamed = scores.select("sample_id", F.col("influence").alias("_new"))
    joined = buffer.join(renamed, "sample_id", "left")
    changed = F.col("_new").isNotNull()
    previous = F.when(changed, F.col("influence")).otherwise(F.col("prev_influence"))
    return (
        joined.withColumn("prev_influence", previous if tracking else F.col("prev_influence"))
        .withColumn("influence", F.coalesce("_new", "influence"))
        .select(*buffer.columns)
    )


def clear_influence(buffer: DataFrame) -> DataFrame:
    empty = F.lit(None).cast("double")
    return buffer.withColumn("influence", empty).withColumn("prev_influence", empty)


def strategy_scores(
    strategy: str, forest: Forest, buffer: DataFrame, features: DataFrame, tests: DataFrame
) -> DataFrame | None:
    """Scores of one update; None when the strategy writes nothing.

    ``features``: sample_id, features of buffered rows. ``tests``: the latest batch.
    """
    config, scratch = forest.config, forest.scratch
    count = config.influence_sample_count
    if strategy in ("oob", "loss", "cumulative_oob"):
        subset = uniform_subset(buffer, count, scratch)
        chosen = forest.samples.join(subset.select("sample_id"), "sample_id", "left_semi")
        patterns = test_patterns(tree_votes(forest, tests), config.num_trees)
        scores = mean_influences(chosen, patterns, config, scratch, loss=strategy == "loss")
        scores = scores.where(F.col("influence").isNotNull())
        if strategy != "cumulative_oob":
            return scores
        old = buffer.select("sample_id", F.col("influence").alias("_old"))
        return scores.join(old, "sample_id").select(
            "sample_id", ema_influence(F.col("influence"), F.col("_old")).alias("influence")
        )
    if strategy in ("confidence", "conflict"):
        chosen = uniform_subset(buffer, count, scratch) if strategy == "confidence" else buffer
        scored = predict(forest, chosen.select("sample_id", "label").join(features, "sample_id"))
        value = confidence_influence() if strategy == "confidence" else conflict_influence()
        return scored.select("sample_id", value.alias("influence"))
    return None
