"""The steps of one tree level, each a query over (tree, node) groups.

``rows``       tree_id, node_id, sample_id, label, features: samples standing at a node
``open``       tree_id, node_id, depth, n, n_pos, attrs: nodes to split
``candidates`` one row per (tree, node, attribute) with its value range and cut points
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions.draws import bits63, uniform
from ..functions.impurity import split_score

NODE_KEYS = ["tree_id", "node_id"]
CONSTANT_WIDTH = 1.1920929e-07  # single-precision epsilon: narrower ranges are constant
MAX_CATEGORIES = 63
HOT_SHARES = 64
CUTS_TYPE = "array<struct<threshold:double,subset:bigint,n_left:bigint,n_left_pos:bigint>>"


def stop_rule(config: RunConfig) -> Column:
    """True for a node that must stay a leaf whatever its values are."""
    n, n_pos = F.col("n"), F.col("n_pos")
    return (
        (F.col("depth") >= config.max_depth)
        | (n < config.min_samples_split)
        | (n_pos == 0)
        | (n_pos == n)
    )


def with_attrs(nodes: DataFrame, config: RunConfig) -> DataFrame:
    """Attributes considered at each node: a keyed draw without replacement."""
    every = f"sequence(0, {config.num_features - 1})"
    if config.features_per_split >= config.num_features:
        return nodes.withColumn("attrs", F.expr(every))
    u = uniform(config.seed, "attr", "tree_id", "node_id", "a")
    ranked = f"sort_array(transform({every}, a -> struct({u} AS u, a AS attr)))"
    chosen = f"sort_array(slice({ranked}, 1, {config.features_per_split}).attr)"
    return nodes.withColumn("attrs", F.expr(chosen))


def attach(
    rows: DataFrame, nodes: DataFrame, node_bytes: int, config: RunConfig, how: str = "inner"
) -> DataFrame:
    """Join rows to node records on (tree, node).

    Small node tables are broadcast. Larger ones shuffle; nodes holding more than 1/64 of all
    rows that this table's nodes of their tree hold (fewer than 64 per tree, whatever the
    table's size) still go by broadcast, and the rows they serve are spread over dummy keys so
    no task gets a hot node.
    """
    if node_bytes <= config.broadcast_bytes:
        return rows.join(F.broadcast(nodes), NODE_KEYS, how)
    fields = [c for c in nodes.columns if c not in NODE_KEYS]
    sized, is_hot = with_hot(nodes)
    hot = sized.where(is_hot).select(*NODE_KEYS, F.struct(*fields).alias("_hot"))
    cold = sized.where(~is_hot).select(
        F.col("tree_id").alias("_t"), F.col("node_id").alias("_v"), F.struct(*fields).alias("_cold")
    )
    marked = rows.join(F.broadcast(hot), NODE_KEYS, "left")
    spread = -1 - F.pmod(F.xxhash64("sample_id"), F.lit(1 << 20))
    marked = marked.withColumn(
        "_v", F.when(F.col("_hot").isNull(), F.col("node_id")).otherwise(spread)
    ).withColumn("_t", F.col("tree_id"))
    joined = marked.join(cold, ["_t", "_v"], "left").withColumn(
        "_got", F.coalesce("_hot", "_cold")
    )
    if how == "inner":
        joined = joined.where(F.col("_got").isNotNull())
    return joined.select(*rows.columns, *[F.col(f"_got.{f}").alias(f) for f in fields])


def with_hot(nodes: DataFrame) -> tuple[DataFrame, Column]:
    """Nodes with their tree's total, and whether one is hot: it has over 1/64 of the total, so
    fewer than 64 nodes of a tree are."""
    tree_total = nodes.groupBy("tree_id").agg(F.sum("n").alias("_tree_n"))
    sized = nodes.join(F.broadcast(tree_total), "tree_id")
    return sized, F.col("n") * HOT_SHARES > F.col("_tree_n")


ATTR_VALUE = "element_at(features, attr + 1)"


def node_ranges(rows: DataFrame, open_nodes: DataFrame, node_bytes: int, config: RunConfig) -> DataFrame:
    """Smallest and largest value of each considered attribute over the node's own rows."""
    at_node = attach(
        rows.select(*NODE_KEYS, "sample_id", "features"),
        open_nodes.select(*NODE_KEYS, "n", "attrs"),
        node_bytes,
        config,
    )
    return (
        at_node.select(*NODE_KEYS, F.explode("attrs").alias("attr"), "features")
        .groupBy(*NODE_KEYS, "attr")
        .agg(F.expr(f"min({ATTR_VALUE}) AS lo"), F.expr(f"max({ATTR_VALUE}) AS hi"))
    )


def is_categorical(config: RunConfig) -> str:
    if not config.categorical_attrs:
        return "false"
    return f"attr IN ({', '.join(map(str, config.categorical_attrs))})"


def numeric_threshold(config: RunConfig, draw: int) -> str:
    u = uniform(config.seed, "cut", "tree_id", "node_id", "attr", draw)
    varies = f"abs(hi - lo) >= {CONSTANT_WIDTH}D"
    return f"CASE WHEN NOT ({is_categorical(config)}) AND {varies} THEN lo + {u} * (hi - lo) END"


def category_subset(config: RunConfig, draw: int) -> str:
    """A non-empty set of categories as bits; bit b stands for category lo + b."""
    if not config.categorical_attrs:
        return "CAST(NULL AS BIGINT)"
    count = "CAST(hi - lo + 1 AS INT)"
    every = (
        f"CASE WHEN {count} >= {MAX_CATEGORIES} THEN {2**63 - 1}L "
        f"ELSE shiftleft(1L, least({count}, 62)) - 1 END"
    )
    bits = bits63(config.seed, "set", "tree_id", "node_id", "attr", draw)
    kind = is_categorical(config)
    return (
        f"CASE WHEN {kind} AND hi - lo >= {MAX_CATEGORIES} "
        f"THEN CAST(raise_error('more than {MAX_CATEGORIES} categories in one node') AS BIGINT) "
        f"WHEN {kind} AND hi > lo THEN {bits} % ({every}) + 1 END"
    )


def draws(config: RunConfig) -> range:
    return range(config.num_splits_to_try)


def with_cut_columns(ranges: DataFrame, config: RunConfig) -> DataFrame:
    """Cut points as plain columns t0.. and s0.. so counting stays in generated code."""
    cuts = [f"{numeric_threshold(config, j)} AS t{j}" for j in draws(config)]
    cuts += [f"{category_subset(config, j)} AS s{j}" for j in draws(config)]
    return ranges.selectExpr("*", *cuts)


def cut_columns_of(candidates: DataFrame, config: RunConfig) -> DataFrame:
    """The same columns taken from stored candidates."""
    cuts = [f"get(cuts, {j}).threshold AS t{j}" for j in draws(config)]
    cuts += [f"get(cuts, {j}).subset AS s{j}" for j in draws(config)]
    return candidates.selectExpr("*", *cuts).drop("cuts", "lo_n", "hi_n")


def goes_left(value: str, threshold: str, subset: str, base: str, config: RunConfig) -> str:
    """value <= threshold, or membership of the category bit. Null when there is no cut."""
    if not config.categorical_attrs:
        return f"({value} <= {threshold})"
    offset = f"CAST(least(greatest({value} - {base}, -1.0D), {MAX_CATEGORIES}.0D) AS INT)"
    member = f"({offset} BETWEEN 0 AND {MAX_CATEGORIES - 1} AND shiftright({subset}, {offset}) & 1L = 1L)"
    return (
        f"(CASE WHEN {threshold} IS NOT NULL THEN {value} <= {threshold} "
        f"WHEN {subset} IS NOT NULL THEN {member} END)"
    )


def count_cuts(
    rows: DataFrame,
    cuts: DataFrame,
    cut_bytes: int,
    config: RunConfig,
    weight: str | None = None,
) -> DataFrame:
    """Rows and positives left of every cut, plus rows sitting on the range ends.

    One hash aggregation with fixed-width counters: partial sums per task, then a shuffle
    of a single short row per (tree, node, attribute). With ``weight`` the counts are
    signed, which is how additions and removals update stored candidates.
    """
    w = weight or "1L"
    keep = [*NODE_KEYS, "sample_id", "features", "label"] + ([weight] if weight else [])
    joined = attach(rows.select(*keep), cuts, cut_bytes, config).withColumn(
        "value", F.expr(ATTR_VALUE)
    )
    counters = [
        "first(lo) AS lo",
        "first(hi) AS hi",
        f"sum(CASE WHEN value = lo THEN {w} ELSE 0L END) AS lo_n",
        f"sum(CASE WHEN value = hi THEN {w} ELSE 0L END) AS hi_n",
    ]
    if weight:
        counters.append(f"max({w} > 0 AND (value < lo OR value > hi)) AS outside")
    for j in draws(config):
        left = goes_left("value", f"t{j}", f"s{j}", "lo", config)
        counters.append(f"sum(CASE WHEN {left} THEN {w} ELSE 0L END) AS l{j}")
        counters.append(f"sum(CASE WHEN {left} AND label THEN {w} ELSE 0L END) AS p{j}")
    return joined.groupBy(*NODE_KEYS, "attr").agg(*map(F.expr, counters))


def pack_candidates(counted: DataFrame, config: RunConfig) -> DataFrame:
    """Fold the counter columns into one array per (tree, node, attribute)."""
    cuts = ", ".join(
        f"struct(t{j} AS threshold, s{j} AS subset, l{j} AS n_left, p{j} AS n_left_pos)"
        for j in draws(config)
    )
    usable = "t0 IS NOT NULL OR s0 IS NOT NULL" if config.num_splits_to_try else "false"
    return with_cut_columns(counted, config).selectExpr(
        *NODE_KEYS,
        "attr",
        "lo",
        "hi",
        "lo_n",
        "hi_n",
        f"CAST(CASE WHEN {usable} THEN array({cuts}) ELSE array() END AS {CUTS_TYPE}) AS cuts",
    )


def candidate_rows(candidates: DataFrame) -> DataFrame:
    """Long form: one row per cut, with its draw number."""
    return candidates.select(
        *NODE_KEYS, "attr", "lo", "hi", "lo_n", "hi_n", F.posexplode("cuts").alias("draw", "cut")
    ).select(*NODE_KEYS, "attr", "draw", "lo", "hi", "lo_n", "hi_n", "cut.*")


def scored_candidates(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cuts with their integer score at the node's current counts."""
    totals = nodes.select(*NODE_KEYS, "n", "n_pos")
    score = split_score("n", "n_pos", "n_left", "n_left_pos")
    return candidate_rows(candidates).join(totals, NODE_KEYS).selectExpr("*", f"{score} AS score")


def best_splits(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Highest positive score per node; ties go to the lowest (attribute, draw)."""
    chosen = "struct(attr, threshold, subset, lo AS base, n_left, n_left_pos, score, draw)"
    return (
        scored_candidates(nodes, candidates)
        .where("score > 0")
        .groupBy(*NODE_KEYS)
        .agg(F.expr(f"max_by({chosen}, struct(score, -attr, -draw)) AS best"))
        .selectExpr(*NODE_KEYS, "best.*")
        .withColumn("base", F.expr("CASE WHEN subset IS NOT NULL THEN base END"))
    )


def veto_small_sides(best: DataFrame, nodes: DataFrame, config: RunConfig) -> DataFrame:
    """Reject the best split when a side is below min_samples_leaf; no second choice."""
    n_right = F.col("n") - F.col("n_left")
    enough = (F.col("n_left") >= config.min_samples_leaf) & (n_right >= config.min_samples_leaf)
    return best.join(nodes.select(*NODE_KEYS, "n"), NODE_KEYS).where(enough).drop("n")


def decided_nodes(frontier: DataFrame, candidates: DataFrame, config: RunConfig) -> DataFrame:
    """Every frontier node as internal or leaf."""
    open_nodes = frontier.where(~stop_rule(config))
    best = veto_small_sides(best_splits(open_nodes, candidates), open_nodes, config).drop("score", "draw")
    return (
        frontier.join(best, NODE_KEYS, "left")
        .withColumn("kind", F.when(F.col("attr").isNull(), "leaf").otherwise("internal"))
        .withColumn("tag", F.lit("clean"))
        .select(
            *NODE_KEYS,
            "depth",
            "kind",
            "attr",
            "threshold",
            "subset",
            "base",
            "n",
            "n_pos",
            "tag",
            "n_left",
            "n_left_pos",
        )
    )


def children(nodes: DataFrame) -> DataFrame:
    """Both children of every internal node with their counts."""
    sides = (
        "inline(array("
        "struct(node_id * 2 AS node_id, n_left AS n, n_left_pos AS n_pos), "
        "struct(node_id * 2 + 1 AS node_id, n - n_left AS n, n_pos - n_left_pos AS n_pos)))"
    )
    return (
        nodes.where("kind = 'internal'")
        .selectExpr("tree_id", "depth + 1 AS depth", sides)
        .select("tree_id", "node_id", "depth", "n", "n_pos")
    )


def step_down(config: RunConfig) -> Column:
    """Next node id for a row joined to its split; unchanged where there is no split."""
    left = goes_left(ATTR_VALUE, "threshold", "subset", "base", config)
    return F.expr(
        f"CASE WHEN attr IS NULL THEN node_id WHEN {left} THEN node_id * 2 ELSE node_id * 2 + 1 END"
    )
