"""Plan shapes that matter at scale."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from catalog.buffer_queries import influence_log
from catalog.common import LINE, assigned
from lethewood.config import RunConfig
from lethewood.operators import lifecycle, scoring
from lethewood.operators import splits as S
from lethewood.operators.assignment import assign_trees
from lethewood.operators.evaluation import sliding_counts
from lethewood.plans import growth
from lethewood.sources import ordering
from lethewood.sources import samples as src
from lethewood.sources.scratch import Scratch


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_level_shuffles_only_counters(spark, data):
    scratch = Scratch(spark)
    base = scratch.write(assigned("line", spark, data), "samples")
    rows = growth.rows_at_roots(base)
    frontier = scratch.write(growth.root_frontier(rows), "frontier")
    text = plan(growth.level_candidates(rows, frontier.where(~S.stop_rule(LINE)), 8, LINE))
    assert "SortMergeJoin" not in text and "SortAggregate" not in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert "partial_sum" in text and "partial_min" in text


def test_votes_need_no_shuffle(spark, data):
    scratch = Scratch(spark)
    forest = growth.fit(src.document_samples(spark, data), LINE.with_(max_depth=1), scratch)
    queries = scratch.write(src.document_samples(spark, data), "queries")
    text = plan(scoring.tree_votes(forest, queries))
    assert "hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_history_is_limited_before_the_shuffle(spark, data):
    text = plan(lifecycle.newest_entries(influence_log(spark, data)))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_sliding_windows_have_bounded_groups(spark):
    rows = spark.range(100).selectExpr("id AS position", "id % 2 = 0 AS label", "true AS pred")
    text = plan(sliding_counts(rows, 10, Scratch(spark), dense=True))
    assert "hashpartitioning(_block" in text and "SinglePartition" not in text


def test_scan_reads_only_needed_columns(spark, data):
    events = src.event_samples(spark, data).select("sample_id", "label").where(F.col("sample_id") > 5)
    text = plan(events)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "user_id" not in schema and "props" not in schema
    assert "GreaterThan(event_id,5)" in text


def test_predictions_need_no_exchange_and_keep_every_row(spark, data):
    scratch = Scratch(spark)
    forest = growth.fit(src.document_samples(spark, data), LINE.with_(max_depth=2), scratch)
    once = scratch.write(src.document_samples(spark, data), "queries")
    twice = once.unionByName(once)
    narrow = scoring.predict(forest, twice)
    assert "Exchange" not in plan(narrow).split("Subquery")[0]
    assert narrow.count() == 2 * once.count()
    joined = scoring.predict(forest.with_(config=forest.config.with_(broadcast_bytes=0)), twice)
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, joined.collect()))
    picks = scoring.predict_subset(forest, once, [0, 0, 3, 99])
    votes = scoring.tree_votes(forest, once).where("tree_id IN (0, 3)")
    want = {}
    for r in votes.collect():
        want[r.sample_id] = want.get(r.sample_id, 0) + r.vote * (2 if r.tree_id == 0 else 1)
    assert {r.sample_id: r.proba for r in picks.collect()} == {s: v / 4 for s, v in want.items()}


def test_hot_nodes_stay_few(spark):
    """Equal nodes are never hot, however many; one large node is."""
    level = spark.range(1000).selectExpr("CAST(0 AS INT) AS tree_id", "id AS node_id", "10L AS n")
    sized, is_hot = S.with_hot(level)
    assert sized.where(is_hot).count() == 0
    sized, is_hot = S.with_hot(level.selectExpr("tree_id", "node_id", "IF(node_id = 3, 5000L, n) AS n"))
    assert [r.node_id for r in sized.where(is_hot).collect()] == [3]


@pytest.mark.parametrize("n", [0, 1, 10, 700, 2000, 2999, 3000, 5000])
def test_selection_equals_sorting(spark, monkeypatch, n):
    """Ties, a skewed key and a falling key, in several rounds."""
    monkeypatch.setattr(ordering, "LOCAL_ROWS", 50)
    rows = spark.range(3000).selectExpr("id AS sample_id", "CAST(floor(pow(1.01, (id * 7919) % 1500)) AS DOUBLE) AS v", "id % 3 AS c")
    rows = rows.repartition(5)
    order = [-F.col("c"), F.col("v"), F.col("sample_id")]
    got = ordering.top_n(rows, order, n, Scratch(spark))
    want = sorted(map(tuple, rows.collect()), key=lambda r: (-r[2], r[1], r[0]))[:n]
    assert [tuple(r) for r in got.collect()] == want


def test_selection_sorts_few_rows(spark):
    rows = Scratch(spark).write(spark.range(200000).selectExpr("id AS sample_id", "id % 97 AS v"), "rows")
    got = ordering.top_n(rows, [F.col("v"), F.col("sample_id")], 100, Scratch(spark))
    text = plan(got)
    assert text.count("rangepartitioning") == 1 and "TakeOrderedAndProject" in text
    assert [r.v for r in got.collect()] == [0] * 100


@pytest.mark.parametrize("n", [1, 30, 900, 39000])
@pytest.mark.parametrize("value", ["CAST((id * 7919) % 40009 AS DOUBLE)", "9007199254740993L + (id * 7919) % 40009"])
def test_selection_takes_few_rounds(spark, monkeypatch, n, value):
    """A cut nearer to an end of the pool than the sketch can tell, and values too close for doubles,
    do not lead to a round for every row."""
    monkeypatch.setattr(ordering, "LOCAL_ROWS", 20)
    monkeypatch.setattr(ordering, "ACCURACY", 100)
    rounds = []
    sketch = ordering.F.percentile_approx
    monkeypatch.setattr(ordering.F, "percentile_approx", lambda *args: rounds.append(1) or sketch(*args))
    rows = Scratch(spark).write(spark.range(40000).selectExpr("id AS sample_id", f"{value} AS v"), "rows")
    got = [r.v for r in ordering.top_n(rows, [F.col("v"), F.col("sample_id")], n, Scratch(spark)).collect()]
    assert got == sorted(r.v for r in rows.select("v").collect())[:n]
    assert len(rounds) <= 20


def test_tree_ranks_are_generated_code(spark):
    """Ranks written out choose the same trees as those made by lambdas, which are interpreted."""
    from lethewood.functions import draws

    ids = spark.range(500).selectExpr("id * 1000003 AS sample_id", "id % 2 = 0 AS label")
    for trees, k in ((1, 1), (8, 3), (13, 13), (64, 5)):
        config = RunConfig(num_trees=trees, k=k, num_features=4)
        assigned = assign_trees(ids, config)
        written = {r.sample_id: r.tree_ids for r in assigned.collect()}
        assert "lambda" not in plan(assigned)
        most, draws.WRITTEN_OUT = draws.WRITTEN_OUT, 0
        try:
            assert {r.sample_id: r.tree_ids for r in assign_trees(ids, config).collect()} == written
        finally:
            draws.WRITTEN_OUT = most


def test_first_level_prepares_samples_once(spark, data):
    """The rows and the open nodes of a level read one table, not the raw rows twice."""
    from catalog import forest_queries

    text = plan(forest_queries.Q["node_ranges"].run(spark, data))
    assert "lineitem" not in text
