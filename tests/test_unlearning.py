"""Whole models against the row-at-a-time twin, and forgetting against retraining."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lethewood.api import UnlearningForest
from lethewood.config import RunConfig
from lethewood.operators import influence, scoring
from lethewood.operators import model as M
from lethewood.plans import growth, maintenance
from lethewood.sources.scratch import Scratch

from .brute_force import fit as brute_fit

CONFIG = RunConfig(
    num_trees=5, k=2, max_depth=4, num_features=3, num_splits_to_try=3, categorical_attrs=(2,)
)
SCHEMA = "sample_id BIGINT, features ARRAY<DOUBLE>, label BOOLEAN"


def make_rows(count: int, seed: int = 1, start: int = 0):
    rng = random.Random(seed)
    rows = []
    for i in range(start, start + count):
        x = [rng.uniform(-5, 5), rng.uniform(-5, 5), float(rng.randrange(6))]
        rows.append((i, x, x[0] > 0 and x[2] > 1))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "sample_id BIGINT")


def as_dict(forest):
    return {
        (r.tree_id, r.node_id): (r.kind, r["attr"], r.threshold, r.subset, r.n, r.n_pos)
        for r in forest.nodes.collect()
    }


@pytest.fixture(scope="module")
def rows():
    return make_rows(120)


@pytest.fixture(scope="module")
def forest(spark, rows):
    return growth.fit(table(spark, rows), CONFIG, Scratch(spark))


def test_fit_equals_brute_force(forest, rows):
    assert as_dict(forest) == brute_fit(rows, CONFIG)


def test_shuffled_joins_give_the_same_model(spark, rows):
    """No broadcast allowed, rows rewritten every level."""
    config = CONFIG.with_(broadcast_bytes=0, rewrite_every=1)
    forest = growth.fit(table(spark, rows), config, Scratch(spark))
    assert as_dict(forest) == brute_fit(rows, CONFIG)


def test_forget_add_and_settle(spark, forest, rows):
    """Forget the row with the smallest first value and others; add new rows beyond the range."""
    smallest = min(rows, key=lambda r: r[1][0])[0]
    gone = {smallest, 3, 14, 15, 92, 65}
    after = maintenance.forget(forest, ids(spark, [*gone, 9999]))
    assert after.forest.samples.count() == len(rows) - len(gone)
    more = [*make_rows(15, 7, 1000), (2000, [50.0, -50.0, 9.0], True)]
    added = maintenance.add(after.forest, table(spark, [*more, rows[0]]))
    live = [r for r in rows if r[0] not in gone] + more
    settled = maintenance.resolve(added.forest)
    assert as_dict(settled) == brute_fit(live, CONFIG)
    assert not settled.has_pending
    assert maintenance.resolve(settled) is settled
    again = maintenance.forget(settled, ids(spark, gone))
    assert M.node_difference(again.forest.nodes, settled.nodes).count() == 0


def test_forget_everything(spark, forest, rows):
    gone = maintenance.forget(forest, ids(spark, [r[0] for r in rows]))
    empty = maintenance.resolve(gone.forest)
    assert empty.nodes.count() == 0 and empty.candidates.count() == 0
    scored = scoring.predict(empty, table(spark, rows[:5])).collect()
    assert all(not r.pred and r.proba == 0.0 for r in scored)


def test_only_the_query_path_is_settled(spark, forest, rows):
    pending = maintenance.forget(forest, ids(spark, [r[0] for r in rows[:40]])).forest
    assert pending.has_pending
    probe = table(spark, rows[40:42])
    lazy = maintenance.resolve(pending, scoring.query_path(pending, probe))
    eager = maintenance.resolve(pending)
    want = {r.sample_id: r.votes for r in scoring.predict(eager, probe).collect()}
    assert {r.sample_id: r.votes for r in scoring.predict(lazy, probe).collect()} == want


def test_empty_inputs(spark):
    forest = growth.fit(table(spark, []), CONFIG, Scratch(spark))
    assert forest.nodes.count() == 0
    none = RunConfig(num_trees=0, num_features=3)
    scored = scoring.predict(growth.empty_forest(spark, none), table(spark, make_rows(2))).collect()
    assert [r.proba for r in scored] == [0.5, 0.5]
    subset = scoring.predict_subset(forest, table(spark, make_rows(2)), []).collect()
    assert all(r.pred is None for r in subset)


def test_influence_equals_pairs(spark, forest, rows, monkeypatch):
    """Merged tree sets and vote sets, in several chunks, against every single pair."""
    monkeypatch.setattr(influence, "CHUNK_PATTERNS", 3)
    tests = table(spark, rows[:30])
    got = {r.sample_id: r.influence for r in influence.all_influences(forest, tests).collect()}
    votes: dict[int, dict[int, bool]] = {}
    for r in scoring.tree_votes(forest, tests).collect():
        votes.setdefault(r.sample_id, {})[r.tree_id] = r.vote
    held = {r.sample_id: set(r.tree_ids) for r in forest.samples.collect()}
    for sid, trees in held.items():
        total = 0
        for tid, _, label in rows[:30]:
            inside = sum(v for t, v in votes[tid].items() if t in trees) * 2 > len(trees)
            outside = sum(v for t, v in votes[tid].items() if t not in trees) * 2 > 5 - len(trees)
            total += (inside == label) - (outside == label)
        assert got[sid] == pytest.approx(total / 30)
    scores = influence.all_influences(forest, tests)
    worst = [r.sample_id for r in influence.harmful(scores, 4).collect()]
    assert worst == sorted((s for s in got if got[s] < 0), key=lambda s: (got[s], s))[:4]


def test_no_out_of_bag_tree_gives_null(spark, rows):
    config = CONFIG.with_(k=5, max_depth=1)
    forest = growth.fit(table(spark, rows[:20]), config, Scratch(spark))
    scores = influence.all_influences(forest, table(spark, rows[:5])).collect()
    assert len(scores) == 20 and all(r.influence is None for r in scores)


def test_stream_with_budget_forgets_what_it_evicts(spark, tmp_path):
    config = CONFIG.with_(
        max_depth=2,
        budget_enabled=True,
        budget_max_samples=50,
        budget_eviction_batch=5,
        warmup_samples=30,
        influence_update_interval=1,
        influence_strategy="oob",
        influence_tracking=True,
    )
    model = UnlearningForest(spark, config, str(tmp_path))
    model.fit(table(spark, make_rows(40)))
    model.stream_batch(table(spark, make_rows(20, 3, 100)))
    assert model.registry_size() == 50 and model.total_samples() == 60
    assert model.total_budget_evicted() == 10
    assert model.get_influence_coverage().first()["with_influence"] > 0
    kept = {r.sample_id for r in model.buffer.collect()}
    assert kept == {r.sample_id for r in model.forest.samples.collect()}
    live = [r for r in make_rows(40) + make_rows(20, 3, 100) if r[0] in kept]
    assert as_dict(maintenance.resolve(model.forest)) == brute_fit(live, config)

    victim = sorted(kept)[0]
    assert model.forget_samples(ids(spark, [victim, 424242])) == 1
    assert model.buffer.where(F.col("sample_id") == victim).count() == 0
    version = model.counters.version
    reopened = UnlearningForest(spark, config, str(tmp_path))
    reopened.load(version)
    assert reopened.registry_size() == 49
    assert M.node_difference(reopened.forest.nodes, model.forest.nodes).count() == 0
    reopened.record_influence_batch(reopened.buffer.selectExpr("sample_id", "-0.25D AS score"))
    before = reopened.memory_mb()
    reopened.counters.position += 1
    reopened.record_influence_batch(reopened.buffer.selectExpr("sample_id", "0.5D AS score"))
    assert reopened.memory_mb() * 2**20 == pytest.approx(before * 2**20 + 49 * 16)
    life = reopened.get_lifecycle_data().first()
    assert [h.score for h in life.influence_history] == [-0.25, 0.5]
    assert life.influence_trend == pytest.approx(0.75) and life.rank_history is None
    figures = reopened.get_registry_diagnostics().first()
    assert figures.n_with_influence == 49 and figures.mean_influence == pytest.approx(0.5)
    reopened.reset()
    assert reopened.registry_size() == 0 and reopened.position() == 0


def test_rebuild_arm_refits_from_the_buffer(spark, tmp_path):
    """The model stays frozen until the interval, then equals one trained on the buffer."""
    config = CONFIG.with_(
        max_depth=2, budget_enabled=True, budget_max_samples=30, budget_rebuild_interval=40,
        influence_update_interval=0,
    )
    model = UnlearningForest(spark, config, str(tmp_path))
    first, second = make_rows(30, 5), make_rows(20, 6, 500)
    model.stream_batch(table(spark, first))
    assert model.forest.nodes.count() == 0
    model.stream_batch(table(spark, second))
    kept = {r.sample_id for r in model.buffer.collect()}
    assert as_dict(model.forest) == brute_fit([r for r in first + second if r[0] in kept], config)


def test_distance_scores_need_capacity_and_interval(spark, tmp_path):
    config = CONFIG.with_(
        max_depth=1, budget_enabled=True, budget_max_samples=40, budget_use_feature_distance=True,
        feat_dist_update_interval=30, influence_update_interval=0,
    )
    model = UnlearningForest(spark, config, str(tmp_path))
    model.stream_batch(table(spark, make_rows(25, 5)))
    assert model.get_influence_coverage().first()["with_influence"] == 0
    model.stream_batch(table(spark, make_rows(10, 6, 500)))
    row = model.get_influence_coverage().first()
    assert (row["with_influence"], row["total"]) == (25, 35)
    assert model.buffer.where("influence > 0").count() == 0


def test_forgetting_and_pretraining_survive_the_stream(spark, tmp_path):
    """Train, stream, forget, replay the batch, stream on, reopen: as if trained on what is left."""
    from lethewood.streaming.prequential import batch_handler

    config = CONFIG.with_(max_depth=2)
    first, second, third = make_rows(30), make_rows(20, 3, 100), make_rows(15, 4, 300)
    model = UnlearningForest(spark, config, str(tmp_path))
    model.fit(table(spark, first))
    handle = batch_handler(model, "a")
    handle(table(spark, second), 0)
    assert model.total_samples() == 50 and model.is_pretrained()
    gone = [first[0][0], first[5][0], second[1][0], second[2][0]]
    assert model.forget_samples(ids(spark, gone)) == 4
    handle(table(spark, second), 0)
    assert model.forest.samples.count() == 46 and model.total_samples() == 50
    other = UnlearningForest(spark, config, str(tmp_path))
    batch_handler(other, "a")(table(spark, third), 1)
    live = [r for r in first + second + third if r[0] not in gone]
    assert as_dict(maintenance.resolve(other.forest)) == brute_fit(live, config)
    with pytest.raises(ValueError):
        batch_handler(other, "a")(table(spark, second), 0)
    batch_handler(other, "b")(table(spark, make_rows(5, 9, 900)), 0)
    assert other.forest.samples.count() == len(live) + 5


def test_repeated_ids_in_a_batch_keep_the_smallest_row(spark, forest):
    new = [(900, [9.0, 1.0, 1.0], True), (900, [2.0, 1.0, 1.0], False), (901, [5.0, 0.0, 2.0], True)]
    for rows in (new, new[::-1]):
        added = maintenance.resolve(maintenance.add(forest, table(spark, rows)).forest)
        kept = {r.sample_id: r.features[0] for r in added.samples.where("sample_id >= 900").collect()}
        assert kept == {900: 2.0, 901: 5.0}


@pytest.mark.parametrize("finish_rows", [0, 7, 40])
def test_finished_subtrees_equal_the_level_loop(spark, finish_rows):
    """Nodes, candidates and all, however many rows one task may finish."""
    rows = make_rows(300, 4)
    config = CONFIG.with_(max_depth=9, min_samples_leaf=2, max_features=2)
    whole = growth.fit(table(spark, rows), config.with_(finish_rows=finish_rows), Scratch(spark))
    other = growth.fit(table(spark, rows), config, Scratch(spark))
    assert as_dict(whole) == as_dict(other) == brute_fit(rows, config)
    for name in ("nodes", "candidates"):
        left, right = getattr(whole, name), getattr(other, name)
        assert left.columns == right.columns
        assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))
