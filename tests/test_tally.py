"""Levels counted by blocks of samples, against the joins that serve levels with many nodes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lethewood.config import RunConfig
from lethewood.operators import splits as S
from lethewood.operators import tally
from lethewood.operators.assignment import assign_trees
from lethewood.plans import growth
from lethewood.sources.scratch import Scratch

CONFIG = RunConfig(
    num_trees=2, k=1, max_depth=3, num_features=3, max_features=2, num_splits_to_try=4, categorical_attrs=(1,), finish_rows=12
)
CANDIDATE = ["tree_id", "node_id", "attr", "lo", "hi", "lo_n", "hi_n", "cuts"]


def table(spark, rows=150):
    features = "array(double(id * 37 % 101) / 7, double(id * 13 % 9), double(id % 4))"
    return spark.range(rows).selectExpr("id AS sample_id", f"{features} AS features", "id * 37 % 101 > id % 60 AS label")


def as_set(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_trees_are_the_same_by_blocks_and_by_joins(spark, monkeypatch):
    """Also where the nodes become too many after a level. Without that limit no level reads the samples' lists
    again, as every level did."""
    found, by_joins = [], []
    old = growth.level_candidates
    monkeypatch.setattr(growth, "level_candidates", lambda *given: by_joins.append(most) or old(*given))
    for most in (4096, 3, 0):
        monkeypatch.setattr(tally, "MOST_NODES", most)
        forest = growth.fit(table(spark), CONFIG, Scratch(spark))
        found.append((as_set(forest.nodes, growth.NODE_COLUMNS), as_set(forest.candidates, CANDIDATE)))
    assert len(found[0][0]) > 12
    assert found[0] == found[1] == found[2]
    assert set(by_joins) == {3, 0}


@pytest.mark.parametrize("packed", [True, False])
def test_missing_values_count_as_in_sql(spark, packed):
    """Values that are missing or not a number, missing labels, an attribute without any value."""
    scratch = Scratch(spark)
    rows = table(spark, 60).withColumn(
        "features",
        F.expr(
            "CASE WHEN sample_id % 7 = 3 THEN array(NULL, features[1], NULL) WHEN sample_id % 11 = 5 THEN "
            "array(double('NaN'), features[1], NULL) WHEN sample_id = 20 THEN NULL "
            "ELSE array(features[0], features[1], NULL) END"
        ),
    ).withColumn("label", F.expr("CASE WHEN sample_id % 5 <> 1 THEN label END"))
    held = scratch.write(assign_trees(rows, CONFIG), "samples")
    walked = growth.rows_at_roots(held)
    open_nodes = scratch.write(growth.root_frontier(walked), "frontier")
    config = CONFIG.with_(max_features=3)
    blocked = scratch.write(tally.blocks(held if packed else walked, config), "blocks")
    by_blocks = growth.tallied_candidates(blocked, {}, open_nodes, config)
    by_joins = growth.level_candidates(walked, open_nodes, 2, config)
    assert as_set(by_blocks, CANDIDATE) == as_set(by_joins, CANDIDATE)


def test_rows_walk_to_the_nodes_asked_for(spark):
    scratch = Scratch(spark)
    held = scratch.write(assign_trees(table(spark, 90), CONFIG), "samples")
    blocked = scratch.write(tally.blocks(held, CONFIG), "blocks")
    splits = {tree: {1: (0, 6.5, None, None), 3: (1, None, 5, 0.0)} for tree in range(2)}
    tops = spark.createDataFrame([(t, n) for t in range(1) for n in (2, 7)], "tree_id INT, node_id BIGINT")
    got = tally.rows_at(blocked, splits, tops, CONFIG)
    node = F.expr("CASE WHEN features[0] <= 6.5 THEN 2 WHEN features[1] IN (0, 2) THEN 6 ELSE 7 END").cast("bigint")
    want = growth.rows_at_roots(held).withColumn("node_id", node).where("tree_id < 1 AND node_id <> 6")
    columns = [*S.NODE_KEYS, "label", "features"]
    assert as_set(got, columns) == as_set(want, columns) and got.count() > 0


def test_no_rows(spark):
    forest = growth.fit(table(spark, 0), CONFIG, Scratch(spark))
    assert forest.nodes.count() == 0
