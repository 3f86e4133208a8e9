"""Descending by arrays gives what one join per depth gives, in code that the JVM compiles."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lethewood.config import RunConfig
from lethewood.operators import scoring, splits
from lethewood.operators.routing import walk
from lethewood.plans import growth
from lethewood.sources.scratch import Scratch

# HotSpot compiles no longer methods.
HUGE_METHOD = 8000
CONFIG = RunConfig(num_trees=4, k=2, max_depth=6, num_features=2, num_splits_to_try=3, categorical_attrs=(1,))
NODES = [
    # A set of categories 3 and 5 (bits 0 and 2 from 3), then a cut, in tree 0; a cut whose value is met in tree 1.
    (0, 1, 0, "internal", 1, None, 5, 3.0, 8, 3, "clean"),
    (0, 2, 1, "internal", 0, 0.5, None, None, 4, 3, "clean"),
    (0, 3, 1, "leaf", None, None, None, None, 4, 0, "clean"),
    (0, 4, 2, "leaf", None, None, None, None, 2, 2, "clean"),
    (0, 5, 2, "leaf", None, None, None, None, 2, 1, "clean"),
    (1, 1, 0, "internal", 0, 2.0, None, None, 8, 3, "clean"),
    (1, 2, 1, "leaf", None, None, None, None, 5, 3, "clean"),
    (1, 3, 1, "leaf", None, None, None, None, 3, 0, "clean"),
]
VALUES = [[0.5, 3.0], [0.6, 5.0], [2.0, 4.0], [2.1, 2.5], [-0.0, 99.0], [None, None], None]


@pytest.fixture(scope="module")
def rows(spark):
    found = [(tree, node, sample, True, v) for tree in (0, 1, 2) for node in (1, 2, 3) for sample, v in enumerate(VALUES)]
    return spark.createDataFrame(found, "tree_id INT, node_id BIGINT, sample_id BIGINT, label BOOLEAN, features ARRAY<DOUBLE>")


def reached(rows, nodes, config, depths):
    return sorted(tuple(r) for r in walk(rows, nodes, depths, config).drop("features").collect())


@pytest.mark.parametrize("depths", [{0: 2, 1: 1}, {0: 2}, {1: 1}])
def test_arrays_equal_joins(spark, rows, depths):
    nodes = spark.createDataFrame(NODES, growth.NODES_SCHEMA)
    got = reached(rows, nodes, CONFIG, depths)
    assert got == reached(rows, nodes, CONFIG.with_(broadcast_bytes=0), depths)
    assert len(got) == rows.count()


def test_votes_of_arrays(spark, rows):
    nodes = spark.createDataFrame(NODES, growth.NODES_SCHEMA)
    empty = growth.empty_forest(spark, CONFIG, Scratch(spark))
    queries = rows.where("tree_id = 0 AND node_id = 1")
    by_arrays = scoring.predict(empty.with_(nodes=nodes), queries)
    by_joins = scoring.predict(empty.with_(nodes=nodes, config=CONFIG.with_(broadcast_bytes=0)), queries)
    assert sorted(map(tuple, by_arrays.collect())) == sorted(map(tuple, by_joins.collect()))
    weighted = scoring.predict_subset(empty.with_(nodes=nodes), queries, [0, 1, 1, 9]).orderBy("sample_id").collect()
    # Tree 0: 2 of 2 votes at node 4 only; tree 1, taken twice, votes left of 2.0.
    assert [r.proba for r in weighted] == [0.75, 0.5, 0.5, 0.0, 0.5, 0.0, 0.0]


def test_missing_feature_fails(spark, rows):
    nodes = spark.createDataFrame(NODES, growth.NODES_SCHEMA)
    short = rows.withColumn("features", F.slice("features", 1, 1)).where("sample_id = 0")
    with pytest.raises(Exception, match="fewer features"):
        walk(short, nodes, {0: 2}, CONFIG).collect()


def method_sizes(df):
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_generated_methods_stay_compilable(spark, monkeypatch):
    """Six levels, none finished in one task: the scans' methods must not grow with the depth."""
    drawn = "array(CAST(xxhash64(id, 1) % 1000 AS DOUBLE), CAST(pmod(xxhash64(id, 2), 9) AS DOUBLE)) AS features"
    table = spark.range(400).selectExpr("id AS sample_id", drawn, "xxhash64(id, 3) % 2 = 0 AS label")
    sizes, count_cuts = [], splits.count_cuts

    def counted(*args, **kwargs):
        found = count_cuts(*args, **kwargs)
        sizes.extend(method_sizes(found))
        return found

    monkeypatch.setattr(splits, "count_cuts", counted)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        forest = growth.fit(table, CONFIG.with_(finish_rows=0))
        assert max(forest.depth_counts) >= 4
        at_leaf = walk(growth.rows_at_roots(forest.samples), forest.nodes, forest.depth_counts, CONFIG)
        sizes.extend(method_sizes(at_leaf))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(sizes) < HUGE_METHOD
