"""The stored leaf map, and changes kept over the model tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lethewood.api import UnlearningForest
from lethewood.operators import scoring
from lethewood.plans import growth, maintenance
from lethewood.sources.layers import Layered
from lethewood.sources.scratch import Scratch
from lethewood.streaming.prequential import batch_handler

from .brute_force import fit as brute_fit
from .test_unlearning import CONFIG, as_dict, ids, make_rows, table


def placed(forest):
    return sorted(map(tuple, scoring.leaf_map(forest).select("tree_id", "sample_id", "node_id").collect()))


@pytest.mark.parametrize("changes", [dict(), dict(finish_rows=0, fold_after=2)])
def test_the_map_follows_the_model(spark, changes):
    """Forget, add, settle on a path, settle all, in turn: the map stays what a walk would give."""
    config = CONFIG.with_(max_depth=6, **changes)
    rows = make_rows(160, 8)
    forest = maintenance.with_leaves(growth.fit(table(spark, rows), config, Scratch(spark)))
    assert placed(forest) == placed(forest.with_(leaves=None))
    smallest = min(rows, key=lambda r: r[1][0])[0]
    live = {r[0]: r for r in rows}
    for step, gone in enumerate([{smallest}, set(range(20, 60)), {100, 101}]):
        forest = maintenance.forget(forest, ids(spark, gone)).forest
        live = {i: r for i, r in live.items() if i not in gone}
        more = make_rows(6, 50 + step, 1000 * (step + 1))
        more += [(rows[25][0], [40.0 + step, 1.0, 2.0], True)] if step == 2 else []  # comes back, changed
        forest = maintenance.add(forest, table(spark, more)).forest
        live |= {r[0]: r for r in more}
        if step == 1:
            probe = table(spark, rows[70:72])
            forest = maintenance.resolve(forest, scoring.query_path(forest, probe))
        if step == 2:
            forest = maintenance.resolve(forest)
        assert placed(forest) == placed(forest.with_(leaves=None))
    assert as_dict(forest) == brute_fit(list(live.values()), config) and not forest.has_pending
    nothing = maintenance.forget(forest, ids(spark, live)).forest
    assert placed(maintenance.resolve(nothing)) == [] and nothing.nodes.count() == 0


def test_one_stale_node_reads_few_files(spark):
    """Below a node of depth 3 of one tree: that tree's files only, and a filter on its range."""
    config = CONFIG.with_(num_trees=8, k=4, max_depth=6)
    forest = maintenance.with_leaves(growth.fit(table(spark, make_rows(800, 3)), config, Scratch(spark)))
    node = forest.nodes.where("depth = 3 AND kind = 'internal'").orderBy("tree_id", "node_id").limit(1)
    rows = forest.leaves.below(spark, node, [3])
    text = rows._jdf.queryExecution().executedPlan().toString()
    tree, number, n = node.select("tree_id", "node_id", "n").first()
    assert re.search(rf"PartitionFilters: \[[^\]]*tree_id#\d+ (IN \({tree}\)|= {tree})", text)
    low, high = number << 58, (number + 1) << 58
    assert re.search(rf"place#\d+L >= {low}\)", text) and re.search(rf"place#\d+L < {high}\)", text)
    assert re.search(r"PushedFilters: \[[^\]]*place", text)
    files = spark.read.parquet(forest.leaves.parts[0]).select(F.input_file_name().alias("f")).distinct().count()
    used = rows.select(F.input_file_name().alias("f")).distinct().count()
    assert used * 4 <= files
    assert rows.where(F.col("node_id") == number).count() == n == rows.count()


def test_forgetting_one_sample_writes_its_paths_only(spark):
    """Changed rows: at most k x (depth + 1) nodes, and their candidates."""
    config = CONFIG.with_(max_depth=6)
    forest = growth.fit(table(spark, make_rows(400, 2)), config, Scratch(spark))
    after = maintenance.forget(forest, ids(spark, [7])).forest
    nodes, candidates = after.layered()
    assert nodes.base is forest.nodes and candidates.base is forest.candidates
    written = nodes.changes[-1].count()
    assert 0 < written <= config.k * 7 < forest.nodes.count()
    assert candidates.changes[-1].count() <= config.k * 7 * config.features_per_split


def test_layers(spark):
    schema = "k INT, v STRING"
    scratch = Scratch(spark)
    layer = Layered(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema), ("k",))
    steps = [[(1, "x", False), (4, "d", False)], [(2, None, True), (1, "y", False)], [(2, "back", False), (4, None, True)]]
    wanted = [{1: "x", 2: "b", 3: "c", 4: "d"}, {1: "y", 3: "c", 4: "d"}, {1: "y", 2: "back", 3: "c"}]
    for step, want in zip(steps, wanted, strict=True):
        layer = layer.changed(spark.createDataFrame(step, f"{schema}, gone BOOLEAN"), scratch, "t", fold_after=3)
        assert {r.k: r.v for r in layer.view.collect()} == want
    assert layer.changes == ()


def held(spark, model):
    """Sample ids met in any file of the run."""
    reader = spark.read.schema("sample_id BIGINT").option("recursiveFileLookup", True)
    files = reader.option("pathGlobFilter", "*.parquet").parquet(*model.run_folders())
    return files.where("sample_id IS NOT NULL").select("sample_id").distinct()


def test_erased_rows_are_in_no_file(spark, tmp_path):
    """Pre-train, stream, forget, erase; replay the batch, stream on, reopen."""
    config = CONFIG.with_(
        max_depth=3, leaf_map=True, budget_enabled=True, budget_max_samples=70, budget_eviction_batch=5,
        influence_update_interval=0,
    )
    first, second, third = make_rows(60), make_rows(20, 3, 100), make_rows(10, 4, 300)
    model = UnlearningForest(spark, config, str(tmp_path))
    model.fit(table(spark, first))
    handle = batch_handler(model, "a")
    handle(table(spark, second), 0)
    kept = {r.sample_id for r in model.buffer.collect()}
    gone = sorted(kept)[::9]
    assert model.forget_samples(ids(spark, gone)) == len(gone)
    before = model.cumulative_metrics().first()
    assert held(spark, model).join(ids(spark, gone), "sample_id").count() == len(gone)
    assert model.erase() > 0
    assert held(spark, model).join(ids(spark, gone), "sample_id").count() == 0
    assert model.cumulative_metrics().first() == before and model.total_budget_evicted() == 10
    assert len(model.manifests.versions()) == 1
    handle(table(spark, second), 0)
    assert model.forest.samples.count() == len(kept) - len(gone)
    other = UnlearningForest(spark, config, str(tmp_path))
    batch_handler(other, "a")(table(spark, third), 1)
    now = {r.sample_id for r in other.buffer.collect()}
    assert not now & set(gone)
    live = [r for r in first + second + third if r[0] in now]
    settled = maintenance.resolve(other.forest)
    assert as_dict(settled) == brute_fit(live, config)
    assert placed(settled) == placed(settled.with_(leaves=None))
    assert other.retain(1) > 0 and other.forest.samples.count() == len(live)
    assert UnlearningForest(spark, config, str(tmp_path)).erase() >= 0


def test_only_files_with_removed_rows_are_written_anew(spark, tmp_path):
    from lethewood.sources.state import SampleParts

    scratch = Scratch(spark, str(tmp_path))
    schema = "sample_id BIGINT, v INT"
    rows = scratch.write(spark.range(100).selectExpr("id AS sample_id", "1 AS v").repartitionByRange(4, "sample_id"), "samples")
    parts = SampleParts(schema).changed(0, scratch, rows, None)
    parts = parts.changed(1, scratch, None, ids(spark, [3, 5, 99]))
    parts = parts.changed(2, scratch, spark.createDataFrame([(5, 2)], schema), None)
    old = {path.rsplit("/", 1)[1] for path in rows.inputFiles()}
    clean = parts.without_removed(scratch)
    assert clean.removed == () and sorted(map(tuple, clean.live(spark).collect())) == sorted(map(tuple, parts.live(spark).collect()))
    same = {path.rsplit("/", 1)[1] for path in clean.added[0][1]} & old
    assert len(old) == 4 and len(same) == 2
    assert clean.without_removed(scratch) is clean


def test_logs_stay_few_parts(spark, tmp_path):
    """Sixty batches: parts grow with the logarithm, the window reads those that reach it."""
    model = UnlearningForest(spark, CONFIG, str(tmp_path))
    names = "sample_id BIGINT, position BIGINT, label BOOLEAN, pred BOOLEAN, proba DOUBLE, batch_id INT"
    for batch in range(60):
        rows = [(i, i, i % 2 == 0, i % 3 == 0, 0.5, batch) for i in range(batch * 3, batch * 3 + 3)]
        model._append("predictions", spark.createDataFrame(rows, names).coalesce(1), batch * 3, batch * 3 + 2)
    assert [part.tier for part in model.logs["predictions"]] == [1] * 7 + [0] * 4
    assert sorted(r.position for r in model.log("predictions").collect()) == list(range(180))
    read = {r.position for r in model.log("predictions", 170).collect()}
    assert set(range(170, 180)) <= read and len(read) <= 12
