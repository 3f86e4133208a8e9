"""Small fixtures with values worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lethewood.config import UNLIMITED_BYTES, RunConfig
from lethewood.functions.draws import uniform
from lethewood.functions.impurity import gini, split_score
from lethewood.operators import buffer as B
from lethewood.operators import diagnostics, evaluation, lifecycle, selection
from lethewood.operators.assignment import assign_trees, k_for, oob_trees
from lethewood.operators.samples import attribute_ranges, profile
from lethewood.sources.ordering import top_n, with_rank, with_running_total
from lethewood.sources.samples import samples_from
from lethewood.sources.scratch import Scratch

from .brute_force import trees_for
from .brute_force import uniform as plain_uniform


def counts(spark, tn, fp, fn, tp):
    return evaluation.with_rates(
        evaluation.with_totals(spark.createDataFrame([(tn, fp, fn, tp)], "tn LONG, fp LONG, fn LONG, tp LONG"))
    ).first()


def test_rates(spark):
    row = counts(spark, 80, 20, 30, 70)
    assert (row.tpr, row.tnr, row.accuracy, row.balanced_accuracy) == pytest.approx((0.7, 0.8, 0.75, 0.75))


def test_gmean_is_zero_when_a_rate_is_zero(spark):
    row = counts(spark, 9900, 0, 100, 0)
    assert row.accuracy == pytest.approx(0.99) and row.tpr == 0 and row.gmean == 0


def test_kappa_perfect_and_empty(spark):
    assert counts(spark, 100, 0, 0, 100).kappa == pytest.approx(1.0)
    assert counts(spark, 100, 0, 0, 0).kappa == 1.0
    assert counts(spark, 0, 0, 0, 0).kappa == 0.0


def test_window_replaces_history(spark):
    rows = spark.range(200).select(
        F.col("id").alias("position"), F.lit(True).alias("label"), (F.col("id") < 100).alias("pred")
    )
    last = evaluation.sliding_metrics(rows, 100, Scratch(spark)).where("position = 199").first()
    assert last.accuracy == 0.0
    assert evaluation.cumulative_metrics(rows).first().accuracy == 0.5


def test_window_of_one_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK_ROWS", 7)
    rows = spark.range(50).selectExpr("id AS position", "id % 3 = 0 AS label", "id % 2 = 0 AS pred")
    for window in (1, 5, 7, 20):
        got = {r.position: (r.tn, r.fp, r.fn, r.tp) for r in evaluation.sliding_counts(rows, window, Scratch(spark)).collect()}
        for at in range(50):
            seen = [(i % 3 == 0, i % 2 == 0) for i in range(max(0, at - window + 1), at + 1)]
            cells = [(False, False), (False, True), (True, False), (True, True)]
            assert got[at] == tuple(seen.count(c) for c in cells)


def test_gini_values(spark):
    row = spark.range(1).selectExpr(
        f"{gini('0', '100')} a", f"{gini('50', '100')} b", f"{gini('25', '100')} c", f"{gini('0', '0')} d",
        f"{split_score('6L', '3L', '3L', '2L')} s", f"{split_score('6L', '3L', '6L', '3L')} one_sided",
    ).first()
    assert (row.a, row.b, row.c, row.d) == (0.0, 0.5, 0.375, 0.0)
    assert row.s > 0 and row.one_sided is None


def test_draws_equal_plain_python(spark):
    rows = spark.range(50).selectExpr("id", f"{uniform(42, 'cut', 3, 'id', 1, 0)} AS u").collect()
    assert all(r.u == plain_uniform(42, "cut", 3, r.id, 1, 0) for r in rows)


@pytest.mark.parametrize("k, trees, expected", [(0, 10, 1), (100, 10, 10), (3, 10, 3), (5, 70, 5)])
def test_every_sample_is_in_exactly_k_trees(spark, k, trees, expected):
    config = RunConfig(num_trees=trees, k=k)
    rows = assign_trees(spark.range(40).selectExpr("id AS sample_id", "true AS label"), config).collect()
    for row in rows:
        assert len(set(row.tree_ids)) == expected
        assert list(row.tree_ids) == trees_for(row.sample_id, config)


def test_minority_k_and_oob(spark):
    config = RunConfig(num_trees=20, k=5, minority_k=9)
    base = spark.range(20).selectExpr("id AS sample_id", "id % 2 = 0 AS label")
    rows = oob_trees(assign_trees(base, config), 20).join(base, "sample_id").collect()
    assert all(len(r.oob_tree_ids) == (11 if r.label else 15) for r in rows)
    assert spark.range(1).select(k_for(config, F.lit(False))).first()[0] == 5


def test_profile_of_nothing(spark):
    empty = spark.createDataFrame([], "features ARRAY<DOUBLE>, label BOOLEAN")
    rows = attribute_ranges(profile(empty, 2)).collect()
    assert [(r.lo, r.hi, r.num_records) for r in rows] == [(0.0, 1.0, 0)] * 2


def test_bad_features_fail_and_negative_zero_folds(spark):
    good = spark.createDataFrame([(1, -0.0, True)], "id LONG, x DOUBLE, y BOOLEAN")
    row = samples_from(good, F.col("id"), [F.col("x")], F.col("y"), 1).first()
    assert math.copysign(1, row.features[0]) == 1
    for value in (None, float("nan"), float("inf")):
        bad = spark.createDataFrame([(1, value, True)], "id LONG, x DOUBLE, y BOOLEAN")
        with pytest.raises(Exception, match="non-finite"):
            samples_from(bad, F.col("id"), [F.col("x")], F.col("y"), 1).collect()


def make_buffer(spark, rows):
    """(id, label, influence, prev)."""
    data = [(i, at, label, [0], inf, prev) for at, (i, label, inf, prev) in enumerate(rows)]
    return spark.createDataFrame(data, B.BUFFER_SCHEMA)


def test_most_harmful(spark):
    rows = [(i, False, v, None) for i, v in enumerate([-0.5, 0.2, -0.8, 0.1, -0.3])]
    picked = selection.most_harmful(make_buffer(spark, rows), 3).collect()
    assert [r.sample_id for r in picked] == [2, 0, 4]


def test_degraded_and_delta(spark):
    buffer = make_buffer(spark, [(0, False, -0.3, 0.5), (1, False, 0.3, 0.5), (2, True, None, 0.5)])
    assert [r.sample_id for r in selection.degraded(buffer).collect()] == [0]
    assert buffer.select(selection.influence_delta()).first()[0] == pytest.approx(-0.8)


def test_minority_survives_eviction(spark):
    rows = [(i, False, None, None) for i in range(5)] + [(5, True, None, None)] + [(i, False, None, None) for i in range(6, 10)]
    config = RunConfig(budget_enabled=True, budget_max_samples=8, budget_eviction_batch=2)
    eviction = B.budget_evict(make_buffer(spark, rows), config, 10, Scratch(spark))
    assert sorted(r.sample_id for r in eviction.evicted.collect()) == [0, 1]
    within = B.budget_evict(make_buffer(spark, rows[:8]), config, 8, Scratch(spark))
    assert within.evicted.count() == 0 and within.kept.count() == 8


def test_memory_eviction_drops_oldest(spark):
    buffer = make_buffer(spark, [(i, False, None, None) for i in range(10)])
    eviction = B.memory_evict(buffer, 92 * 4 + 10, Scratch(spark))
    assert sorted(r.sample_id for r in eviction.kept.collect()) == [6, 7, 8, 9]


def test_history_keeps_newest_twenty(spark):
    log = spark.range(31).selectExpr("1L AS sample_id", "id AS seq", "id AS position", "CAST(id AS DOUBLE) AS score")
    buffer = make_buffer(spark, [(1, False, 0.5, None), (2, False, 0.25, None)])
    rows = {r.sample_id: r for r in lifecycle.with_history(buffer, log).collect()}
    assert rows[1].history_len == 20 and rows[1].average == pytest.approx(20.5)
    assert rows[1].trend == pytest.approx(10.0)
    assert rows[2].history_len == 0 and rows[2].average == 0.25 and rows[2].trend is None


def test_spearman_edges(spark):
    two = make_buffer(spark, [(0, False, 0.1, None), (1, False, 0.2, None)])
    assert math.isnan(diagnostics.age_influence_spearman(two, 5).first()[0])
    falling = make_buffer(spark, [(i, False, i / 10, None) for i in range(6)])
    assert diagnostics.age_influence_spearman(falling, 9).first()[0] == pytest.approx(-1.0)


def test_global_rank_with_one_heavy_value(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id % 3 = 0, 7L, id) AS v")
    scratch = Scratch(spark)
    got = with_rank(rows, [F.col("v"), F.col("id")], scratch).orderBy("rank").collect()
    want = sorted((7 if i % 3 == 0 else i, i) for i in range(5000))
    assert [r.rank for r in got] == list(range(5000)) and [(r.v, r.id) for r in got] == want
    running = with_running_total(rows, [F.col("id")], "id", scratch, "total")
    assert running.where("id = 4999").first().total == sum(range(5000))


def test_top_n_is_ordered_whatever_n(spark):
    for n in (0, 25, 1500, 5000):
        rows = top_n(spark.range(3000), [F.col("id").desc()], n, Scratch(spark)).collect()
        assert [r.id for r in rows] == list(range(2999, -1, -1))[:n]


def test_config_from_dict(spark):
    config = RunConfig.from_dict({"num_trees": 7, "memory_limit_mb": 0, "unknown": 1})
    assert config.num_trees == 7 and config.k == 10 and config.memory_max_bytes == UNLIMITED_BYTES
    assert config.to_table(spark).first()["num_trees"] == 7


def test_ema_counts_every_batch(spark):
    """600 batches in three blocks, only the first with positives: nothing is cut off."""
    from lethewood.streaming.prequential import class_ratio_ema

    rows = [(b, 10, 10 if b == 0 else 0) for b in range(600)]
    got = {r.batch_id: r.ema for r in class_ratio_ema(spark.createDataFrame(rows, "batch_id BIGINT, rows BIGINT, positives BIGINT")).collect()}
    want = 0.5
    for b, n, p in rows:
        want = 0.8 * want + 0.2 * p / n
        assert got[b] == pytest.approx(want, rel=1e-9)
    assert len(got) == 600 and got[599] > 0


def test_line_ids_never_clash(spark, tmp_path):
    """Keys whose digits would run into each other are different samples."""
    from lethewood.sources.samples import line_samples

    keys = [(1, 1, 1000, 1), (1, 2, 0, 1), (1, 100_000, 1, 1), (2, 0, 1, 1), (2, 0, 1, 1), (9_000_000_000, 5, 5, 7)]
    spark.createDataFrame(
        [(*k, 10.0 + i, 30.0, 0.06, 0.01, "R", "1995-01-01") for i, k in enumerate(keys)],
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, "
        "l_quantity DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_shipdate STRING",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = line_samples(spark, str(tmp_path)).collect()
    assert len({r.sample_id for r in rows}) == len(rows) == 5
    assert sorted(r.features[1] for r in rows) == [10.0, 11.0, 12.0, 13.0, 15.0]


def test_registered_rows_are_joined_once(spark, tmp_path):
    """Eviction reads the buffer it was given as written, instead of joining it anew in every pass."""
    from catalog.buffer_queries import _registered

    kinds = "CASE WHEN id % 5 = 0 THEN 'signup' ELSE 'view' END AS event_type"
    events = spark.range(400).selectExpr("id AS event_id", kinds, "CAST(id % 90 AS DOUBLE) AS value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    kept = _registered(spark, str(tmp_path)).kept
    assert kept.count() == 240
    assert not any("events.parquet" in file for file in kept.inputFiles())
