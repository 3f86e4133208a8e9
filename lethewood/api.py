"""The stateful surface: one object per run, methods taking and returning DataFrames."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .config import MEGABYTE, RunConfig
from .operators import buffer as B
from .operators import diagnostics, evaluation, influence, lifecycle, selection
from .operators.assignment import assign_trees
from .operators.scoring import predict, query_path
from .plans.growth import ASSIGNED_SCHEMA, CANDIDATES_SCHEMA, NODES_SCHEMA, Forest, fit
from .plans.leaves import LeafMap
from .plans.maintenance import apply_delta, known_samples, resolve, with_leaves
from .sources.layers import Layered
from .sources.ordering import with_rank
from .sources.samples import first_of_each_id
from .sources.scratch import Scratch, shared_folder
from .sources.state import ERASED, Counters, LogPart, Manifest, Manifests, SampleParts, merged

PREDICTION_SCHEMA = "batch_id INT, position BIGINT, sample_id BIGINT, label BOOLEAN, pred BOOLEAN, proba DOUBLE"
EVICTION_SCHEMA = "sample_id BIGINT, label BOOLEAN, influence DOUBLE, degraded BOOLEAN, reason STRING"
INFLUENCE_LOG_SCHEMA = "sample_id BIGINT, seq BIGINT, position BIGINT, score DOUBLE"
FORGET_LOG_SCHEMA = "sample_id BIGINT, version BIGINT"
RANK_LOG_SCHEMA = "sample_id BIGINT, seq BIGINT, position BIGINT, rank BIGINT"
RESULT_SCHEMA = (
    "batch_id INT, rows BIGINT, registry_size BIGINT, memory_mb DOUBLE, total_samples BIGINT, "
    "budget_evicted BIGINT, tn BIGINT, fp BIGINT, fn BIGINT, tp BIGINT, "
    + ", ".join(f"{name} DOUBLE" for name in evaluation.METRICS)
)
LOG_SCHEMAS = {
    "predictions": PREDICTION_SCHEMA,
    "evictions": EVICTION_SCHEMA,
    "influences": INFLUENCE_LOG_SCHEMA,
    "ranks": RANK_LOG_SCHEMA,
    "results": RESULT_SCHEMA,
    "forgets": FORGET_LOG_SCHEMA,
}
TABLE_SCHEMAS = {
    "nodes": NODES_SCHEMA,
    "candidates": CANDIDATES_SCHEMA,
    "buffer": B.BUFFER_SCHEMA,
    "store": ASSIGNED_SCHEMA,
    "last_batch": "sample_id BIGINT, features ARRAY<DOUBLE>, label BOOLEAN",
}
MODEL_KEYS = {"nodes": ("tree_id", "node_id"), "candidates": ("tree_id", "node_id", "attr")}


class UnlearningForest:
    """Test-then-train learning with exact forgetting over a bounded buffer.

    Batches are DataFrames with ``features`` and ``label``, a ``sample_id`` (the stream position
    is taken when there is none), and an optional ``position`` that orders the batch. Of rows
    with one id in a batch the first by (position, features, label) counts.
    """

    def __init__(self, spark: SparkSession, config: RunConfig, path: str | None = None):
        self.spark, self.config = spark, config
        self.scratch = Scratch(spark, path or shared_folder(spark))
        self.manifests = Manifests(spark, path or self.scratch.root)
        self.reset()

    # State

    def reset(self) -> None:
        """Start over with the same configuration; tables of the old run stay untouched."""
        self.counters = Counters()
        self._committed = -1
        self._settled = True
        self.parts = SampleParts(ASSIGNED_SCHEMA)
        self.tables: dict[str, DataFrame] = {
            name: self.spark.createDataFrame([], schema) for name, schema in TABLE_SCHEMAS.items()
        }
        self.layers = {name: Layered(self.tables[name], keys) for name, keys in MODEL_KEYS.items()}
        self.leaves = LeafMap(()) if self.config.leaf_map else None
        self.logs: dict[str, list[LogPart]] = {name: [] for name in LOG_SCHEMAS}

    @property
    def forest(self) -> Forest:
        return Forest(
            self.config,
            self.parts.live(self.spark),
            self.layers["nodes"].view,
            self.layers["candidates"].view,
            self.scratch,
            self.leaves,
            self.layers["nodes"],
            self.layers["candidates"],
        )

    @property
    def buffer(self) -> DataFrame:
        return self.tables["buffer"]

    def _set_forest(self, forest: Forest) -> None:
        self.layers = dict(zip(MODEL_KEYS, forest.layered(), strict=True))
        self.leaves = forest.leaves

    def log(self, name: str, since: int | None = None) -> DataFrame:
        """A log; with ``since`` only parts that reach that stream position."""
        parts = [part for part in self.logs[name] if since is None or part.high >= since]
        return self._read_log(name, [part.path for part in parts])

    def _read_log(self, name: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], LOG_SCHEMAS[name])
        return self.spark.read.schema(LOG_SCHEMAS[name]).parquet(*paths)

    def _append(self, name: str, rows: DataFrame, low: int = 0, high: int = 0) -> None:
        """One more part, which spans some stream positions; now and then parts are merged, in order."""
        columns = [c.split()[0] for c in LOG_SCHEMAS[name].split(", ")]
        order = next(c for c in ("position", "batch_id", "sample_id") if c in columns)

        def merge(paths: list[str]) -> str:
            rows = self._read_log(name, paths).repartitionByRange(order).sortWithinPartitions(order)
            return self.scratch.save(rows, name)

        part = LogPart(self.scratch.save(rows.select(*columns), name), 0, low, high)
        self.logs[name] = merged([*self.logs[name], part], merge)

    def commit(self) -> None:
        """Make the current state a version that ``load`` can return to."""
        self.counters.version += 1
        stored = self.tables | {name: layered.base for name, layered in self.layers.items()}
        tables = {name: self.scratch.saved(df, f"state-{name}") for name, df in stored.items()}
        changes = {
            name: [self.scratch.saved(df, f"{name}-changes") for df in layered.changes]
            for name, layered in self.layers.items()
        }
        self._open(tables, changes)
        leaves = None if self.leaves is None else list(self.leaves.parts)
        logs = {name: list(paths) for name, paths in self.logs.items()}
        self.manifests.write(Manifest(replace(self.counters), self.parts, tables, logs, changes, leaves))
        self._committed, self._settled = self.counters.version, True

    def _open(self, tables: dict[str, str], changes: dict[str, list[str]]) -> None:
        self.tables = {name: self.scratch.open(path, TABLE_SCHEMAS[name]) for name, path in tables.items()}
        self.layers = {
            name: Layered(
                self.tables[name],
                keys,
                tuple(self.scratch.open(path, f"{TABLE_SCHEMAS[name]}, gone BOOLEAN") for path in changes[name]),
            )
            for name, keys in MODEL_KEYS.items()
        }

    def load(self, version: int) -> None:
        if version < 0:
            self.reset()
            return
        manifest = self.manifests.read(version)
        self.counters, self.parts, self.logs = manifest.counters, manifest.samples, manifest.logs
        self.leaves = None if manifest.leaves is None else LeafMap(tuple(manifest.leaves))
        self._committed, self._settled = version, True
        self._open(manifest.tables, manifest.changes)

    # Learning

    def _positioned(self, batch: DataFrame) -> DataFrame:
        """The batch written once, with dense stream positions after the current one."""
        order = [F.col("position")] if "position" in batch.columns else []
        numbered = "sample_id" in batch.columns
        if numbered:
            batch = first_of_each_id(batch, [*(["position"] if order else []), "features", "label"])
        else:
            batch = batch.withColumn("sample_id", F.monotonically_increasing_id())
        ranked = with_rank(batch, [*order, F.col("sample_id")], self.scratch, "_at")
        position = F.col("_at") + self.counters.position
        placed = ranked.select(
            (F.col("sample_id") if numbered else position).alias("sample_id"),
            position.alias("position"),
            "features",
            "label",
        )
        return self.scratch.write(placed, "batch")

    def fit(self, samples: DataFrame) -> DataFrame:
        """Pre-train on history, fill the buffer first-in-first-out, score the training rows."""
        placed = self._positioned(samples)
        rows = placed.count()
        if rows == 0:
            return self.current_metrics()
        forest = self._fitted(placed)
        self._set_forest(forest)
        held = assign_trees(placed, self.config)
        buffer = B.insert(self.buffer, B.entries(held))
        if self.config.budget_enabled:
            buffer = B.fifo_evict(buffer, self.config.budget_max_samples, self.scratch).kept
        self.tables["buffer"] = self.scratch.write(buffer, "buffer")
        self.counters.position += rows
        self.counters.total_registered += rows
        self.counters.total_samples = rows
        self.counters.warmed_up = self.counters.pretrained = True
        self._record_predictions(placed, -1, self.counters.position - rows, rows)
        self.commit()
        return self.current_metrics()

    def _fitted(self, samples: DataFrame) -> Forest:
        """A model trained from scratch, whose samples are the only ones from now on."""
        forest = fit(samples, self.config, self.scratch)
        self.parts = SampleParts(ASSIGNED_SCHEMA).changed(
            self.counters.version + 1, self.scratch, forest.samples, None
        )
        return with_leaves(forest) if self.config.leaf_map else forest

    def join_stream(self, stream_id: str) -> None:
        """Prepare for a batch of a stream. A new object on an old path goes on from the newest
        version there; what a failed batch left behind is dropped; a stream other than the
        last one counts its batches anew."""
        if self.counters.version < 0 and (latest := self.manifests.latest()) >= 0:
            self.load(latest)
        elif not self._settled:
            self.load(self._committed)
        if self.counters.stream_id != stream_id:
            self.counters.stream_id, self.counters.last_batch = stream_id, -1

    def replay_batch(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Process the last batch again, on the version it started from. Versions keep growing,
        and ids forgotten since that version are forgotten again in the same commit. Where that
        version was erased, the batch is in the state already and nothing is left to do."""
        if self.counters.batch_parent == ERASED:
            return self.log("predictions").where(F.col("batch_id") == batch_id)
        newest, parent, stream_id = self.counters.version, self.counters.batch_parent, self.counters.stream_id
        forgets = self.logs["forgets"]
        later = self.log("forgets").where(F.col("version") > parent).select("sample_id").distinct()
        self.load(parent)
        self.counters.version, self.counters.stream_id = newest, stream_id
        self.logs["forgets"] = forgets
        return self.stream_batch(batch, batch_id, parent, later)

    def stream_batch(
        self,
        batch: DataFrame,
        batch_id: int | None = None,
        parent: int | None = None,
        forgets: DataFrame | None = None,
    ) -> DataFrame:
        """Predict, update metrics, then train. Returns the batch's predictions."""
        batch_id = self.counters.last_batch + 1 if batch_id is None else batch_id
        parent = self.counters.version if parent is None else parent
        self._settled = False
        placed = self._positioned(batch)
        rows, positives = placed.agg(
            F.count(F.lit(1)), F.coalesce(F.sum(F.col("label").cast("bigint")), F.lit(0))
        ).first()
        self.counters.last_batch, self.counters.batch_parent = batch_id, parent
        if rows == 0:
            if forgets is not None:
                self._forget(forgets)
            self.commit()
            return self.log("predictions").where("false")
        if self.config.budget_enabled and self.config.influence_update_interval > 0:
            self.tables["last_batch"] = placed.drop("position")
        scored = self._record_predictions(placed, batch_id, self.counters.position, rows)
        evicted = self.add_batch(placed, rows, positives)
        self._maintain(rows)
        self._record_result(batch_id, rows, evicted)
        if forgets is not None:
            self._forget(forgets)
        self.commit()
        return scored

    def _record_predictions(self, placed: DataFrame, batch_id: int, start: int, rows: int) -> DataFrame:
        """Score rows at the positions from ``start`` on, log them, and count them in."""
        self._resolve(placed)
        scored = self.scratch.write(predict(self.forest, placed, keep=("position",)), "scored")
        cells = evaluation.confusion(scored).first()
        for name in evaluation.COUNTS:
            setattr(self.counters, name, getattr(self.counters, name) + cells[name])
        self._append("predictions", scored.withColumn("batch_id", F.lit(batch_id)), start, start + rows - 1)
        return self.log("predictions", start).where(F.col("batch_id") == batch_id)

    def _resolve(self, queries: DataFrame) -> None:
        """Settle only the pending nodes these queries meet."""
        forest = self.forest
        if forest.has_pending:
            self._set_forest(resolve(forest, query_path(forest, queries)))

    @property
    def _rebuild_mode(self) -> bool:
        return self.config.budget_enabled and self.config.budget_rebuild_interval > 0

    def add_batch(self, placed: DataFrame, rows: int, positives: int) -> int:
        """Add, register, evict and forget what was evicted. Returns budget evictions."""
        config, counters, scratch = self.config, self.counters, self.scratch
        counters.positive_ema = 0.8 * counters.positive_ema + 0.2 * positives / rows
        forest = self.forest
        assigned = scratch.write(assign_trees(placed, config), "assigned")
        if self._rebuild_mode:
            held = assigned.withColumn("tree_ids", F.array().cast("array<int>"))
            store = self.tables["store"].join(placed.select("sample_id"), "sample_id", "left_anti")
            self.tables["store"] = scratch.write(
                store.unionByName(held.select(*store.columns)), "store"
            )
        else:
            held = assigned
        if config.budget_use_feature_distance and config.budget_enabled:
            self._update_distances(rows, assigned)
        counters.position += rows
        counters.total_registered += rows
        buffer = scratch.write(B.insert(self.buffer, B.entries(held)), "buffer")
        evicted_parts, budget_evicted = [], 0
        if config.budget_enabled:
            eviction = B.budget_evict(buffer, config, counters.position, scratch)
            gone = scratch.write(eviction.evicted, "evicted")
            budget_evicted = gone.count()
            if budget_evicted:
                evicted_parts.append(("budget", gone))
                buffer = scratch.write(B.remove(buffer, gone), "buffer")
        sized = self._sized(buffer)
        if self._buffer_bytes(sized) > config.memory_max_bytes:
            eviction = B.memory_evict(sized, config.memory_max_bytes, scratch, F.col("row_bytes"))
            gone = scratch.write(eviction.evicted.select(*buffer.columns), "evicted")
            evicted_parts.append(("memory", gone))
            buffer = scratch.write(eviction.kept.select(*buffer.columns), "buffer")
        self.tables["buffer"] = buffer
        for reason, gone in evicted_parts:
            self._append("evictions", B.eviction_log_rows(gone, reason))
        evicted = (
            reduce(DataFrame.unionByName, [gone for _, gone in evicted_parts]) if evicted_parts else None
        )
        if self._rebuild_mode:
            self._rebuild_if_due(rows, evicted)
        else:
            self._update_forest(forest, assigned, None if config.budget_skip_forest_forget else evicted)
        return budget_evicted

    def _sized(self, buffer: DataFrame) -> DataFrame:
        """Buffer rows with their estimated bytes, histories included."""
        lengths = []
        for name in ("influences", "ranks"):
            if self.logs[name]:
                held = lifecycle.newest_entries(self._history(name, buffer))
                counted = held.groupBy("sample_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
                buffer = buffer.join(counted, "sample_id", "left")
                lengths.append(f"coalesce(n_{name}, 0L)")
            else:
                lengths.append("0")
        return buffer.withColumn("row_bytes", B.memory_bytes(*lengths)).drop("n_influences", "n_ranks")

    @staticmethod
    def _buffer_bytes(sized: DataFrame) -> int:
        return sized.agg(F.coalesce(F.sum("row_bytes"), F.lit(0))).first()[0]

    def _history(self, name: str, buffer: DataFrame | None = None) -> DataFrame:
        """Log entries made since each buffered sample was last registered."""
        held = (self.buffer if buffer is None else buffer).select(
            "sample_id", F.col("position").alias("_since")
        )
        log = self.log(name)
        return log.join(held, "sample_id").where(F.col("position") > F.col("_since")).drop("_since")

    def _update_forest(
        self, forest: Forest, assigned: DataFrame | None, evicted: DataFrame | None
    ) -> None:
        """One signed update: new ids in, evicted ids out."""
        scratch, added, removed = self.scratch, None, None
        if assigned is not None:
            known = known_samples(forest.samples.select("sample_id"), assigned)
            fresh = assigned.join(scratch.write(known, "known"), "sample_id", "left_anti")
            if evicted is not None:
                fresh = fresh.join(evicted.select("sample_id"), "sample_id", "left_anti")
            added = scratch.write(fresh.select(*forest.samples.columns), "added")
        if evicted is not None:
            removed = scratch.write(known_samples(forest.samples, evicted), "removed")
        delta = apply_delta(forest, added, removed)
        self._set_forest(delta.forest)
        self.parts = self.parts.changed(self.counters.version + 1, scratch, added, removed)
        marks = delta.marks.first()
        self.counters.add_marks += marks["add_marks"]
        self.counters.forget_marks += marks["forget_marks"]

    def _rebuild_if_due(self, rows: int, evicted: DataFrame | None) -> None:
        """Frozen model between rebuilds; refit from the buffer every N rows."""
        if evicted is not None:
            store = self.tables["store"].join(evicted.select("sample_id"), "sample_id", "left_anti")
            self.tables["store"] = self.scratch.write(store, "store")
        self.counters.rebuild_rows += rows
        if self.counters.rebuild_rows < self.config.budget_rebuild_interval:
            return
        known = self.forest.samples.join(self.tables["store"].select("sample_id"), "sample_id", "left_anti")
        everything = self.tables["store"].unionByName(known)
        kept = everything.join(self.buffer.select("sample_id"), "sample_id", "left_semi")
        forest = self._fitted(kept.drop("tree_ids"))
        self._set_forest(forest)
        held = forest.samples.select("sample_id", F.col("tree_ids").alias("_trees"))
        refreshed = self.buffer.join(held, "sample_id", "left").withColumn(
            "tree_ids", F.coalesce("_trees", "tree_ids")
        )
        self.tables["buffer"] = self.scratch.write(refreshed.drop("_trees"), "buffer")
        self.counters.rebuild_rows = 0

    def _stored_features(self) -> DataFrame:
        forest_rows = self.forest.samples.select("sample_id", "features")
        stored = self.tables["store"].select("sample_id", "features")
        return stored.unionByName(
            forest_rows.join(stored.select("sample_id"), "sample_id", "left_anti")
        )

    def _update_distances(self, rows: int, incoming: DataFrame) -> None:
        """Distance scores for buffered rows, throttled and only near capacity."""
        self.counters.distance_rows += rows
        if self.counters.distance_rows < self.config.feat_dist_update_interval:
            return
        stored = self._stored_features()
        arriving = incoming.select("sample_id", "features")
        size = stored.count() + arriving.join(stored, "sample_id", "left_anti").count()
        if size <= self.config.budget_max_samples * 4 // 5:
            return
        held = self.buffer.select("sample_id", "position").join(stored, "sample_id")
        if not held.isEmpty():
            scores = influence.feature_distance(held, self.config.num_features, self.scratch)
            self.tables["buffer"] = self.scratch.write(
                influence.set_influence(self.buffer, scores, tracking=False), "buffer"
            )
        self.counters.distance_rows = 0

    def _maintain(self, rows: int) -> None:
        """Periodic influence updates once warm, then the warm-up check."""
        config, counters = self.config, self.counters
        if counters.warmed_up and config.budget_enabled and config.influence_update_interval > 0:
            counters.influence_batches += 1
            if counters.influence_batches % config.influence_update_interval == 0:
                self.update_influences()
        counters.total_samples += rows
        if counters.total_samples >= config.warmup_samples:
            counters.warmed_up = True

    def update_influences(self) -> None:
        """Run the configured strategy on a settled model."""
        forest = resolve(self.forest)
        self._set_forest(forest)
        tests = self.tables["last_batch"]
        if self.config.influence_strategy in ("oob", "loss", "cumulative_oob") and tests.isEmpty():
            return
        scores = influence.strategy_scores(
            self.config.influence_strategy, forest, self.buffer, self._stored_features(), tests
        )
        if scores is not None:
            updated = influence.set_influence(self.buffer, scores, self.config.influence_tracking)
            self.tables["buffer"] = self.scratch.write(updated, "buffer")

    def _record_result(self, batch_id: int, rows: int, evicted: int) -> None:
        totals = self._sized(self.buffer).agg(
            F.count(F.lit(1)).alias("registry_size"),
            (F.coalesce(F.sum("row_bytes"), F.lit(0)) / F.lit(float(MEGABYTE))).alias("memory_mb"),
        )
        metrics = self.current_metrics().select("tn", "fp", "fn", "tp", *evaluation.METRICS)
        result = totals.withColumn("_k", F.lit(1)).join(metrics.withColumn("_k", F.lit(1)), "_k")
        self._append(
            "results",
            result.select(
                F.lit(batch_id).alias("batch_id"),
                F.lit(rows).cast("bigint").alias("rows"),
                "registry_size",
                "memory_mb",
                F.lit(self.counters.total_samples).cast("bigint").alias("total_samples"),
                F.lit(evicted).cast("bigint").alias("budget_evicted"),
                "tn",
                "fp",
                "fn",
                "tp",
                *evaluation.METRICS,
            ),
        )

    # Scoring and forgetting

    def predict_batch(self, queries: DataFrame) -> DataFrame:
        """Predictions and probabilities; metrics and training state are not touched."""
        self._resolve(queries)
        return predict(self.forest, queries).select("sample_id", "pred", "proba")

    def predict_proba_batch(self, queries: DataFrame) -> DataFrame:
        return self.predict_batch(queries).select("sample_id", "proba")

    def forget_samples(self, ids: DataFrame) -> int:
        """Forget in the model, the buffer and the sample table. Returns samples forgotten. The
        ids are logged, so a replayed batch cannot bring them back."""
        self._settled = False
        wanted = self.scratch.write(ids.select("sample_id").distinct(), "ids")
        self._append("forgets", wanted.withColumn("version", F.lit(self.counters.version + 1).cast("bigint")))
        known = self._forget(wanted)
        self.commit()
        return known

    def _forget(self, wanted: DataFrame) -> int:
        wanted = self.scratch.write(wanted, "ids")
        forest = self.forest
        known = forest.samples.join(wanted, "sample_id", "left_semi").count()
        if known:
            self._update_forest(forest, None, wanted)
        self.tables["buffer"] = self.scratch.write(B.remove(self.buffer, wanted), "buffer")
        store = self.tables["store"].join(wanted, "sample_id", "left_anti")
        self.tables["store"] = self.scratch.write(store, "store")
        last = self.tables["last_batch"].join(wanted, "sample_id", "left_anti")
        self.tables["last_batch"] = self.scratch.write(last, "last_batch")
        return known

    def erase(self) -> int:
        """Take what was forgotten out of the storage: afterwards no file of the run holds a row of it.

        The model is settled, so that no value range remembers a forgotten sample. Sample files that
        hold removed rows are written anew, the leaf map is folded, and log rows of forgotten ids
        lose their id (predictions and evictions, which metrics and totals count) or go
        (histories). Older versions go, with every file only they need; the last batch of a stream is
        settled then, and a replay of it changes nothing. Returns how many tables and files were
        deleted."""
        self._set_forest(resolve(self.forest))
        gone = self.scratch.write(self.log("forgets").select("sample_id").distinct(), "forgotten")
        back = self.scratch.write(known_samples(self.forest.samples.select("sample_id"), gone), "back")
        gone = self.scratch.write(gone.join(back, "sample_id", "left_anti"), "forgotten")
        self.parts = self.parts.without_removed(self.scratch)
        if self.leaves is not None:
            self.leaves = self.leaves.folded(self.scratch)
        for name in ("predictions", "evictions"):
            self._rewrite_log(name, self._nameless(self.log(name), gone))
        for name in ("influences", "ranks"):
            self._rewrite_log(name, self.log(name).join(gone, "sample_id", "left_anti"))
        self.logs["forgets"] = []
        self.layers = {name: Layered(layered.view, layered.keys) for name, layered in self.layers.items()}
        self.counters.batch_parent = ERASED
        self.commit()
        return self.retain(1)

    def _nameless(self, log: DataFrame, gone: DataFrame) -> DataFrame:
        marked = log.join(gone.withColumn("_gone", F.lit(True)), "sample_id", "left")
        return marked.withColumn("sample_id", F.when(F.col("_gone").isNull(), F.col("sample_id"))).drop("_gone")

    def _rewrite_log(self, name: str, rows: DataFrame) -> None:
        if self.logs[name]:
            columns = [c.split()[0] for c in LOG_SCHEMAS[name].split(", ")]
            parts = self.logs[name]
            tier, low, high = max(p.tier for p in parts), min(p.low for p in parts), max(p.high for p in parts)
            self.logs[name] = [LogPart(self.scratch.save(rows.select(*columns), name), tier, low, high)]

    def retain(self, versions: int) -> int:
        """Keep the newest versions; delete the others, what only they need, and what unfinished work
        left behind."""
        if not self._settled:
            self.load(self._committed)
        return self.manifests.retain(versions, self.run_folders())

    def run_folders(self) -> list[str]:
        """The folders of all runs on this path."""
        if self.manifests.path == self.scratch.root:
            return [self.scratch.root]
        return [path for path in self.manifests._children(self.manifests.path) if path.rsplit("/", 1)[1].startswith("run-")]

    # Metrics and counters

    def current_metrics(self) -> DataFrame:
        """Metrics of the newest predictions. Positions are dense, so the window says which parts of
        the log to read, and is a filter their scan can use."""
        window = self.config.metrics_window
        if window <= 0:
            return self.cumulative_metrics()
        since = self.counters.position - window
        return evaluation.cumulative_metrics(self.log("predictions", since).where(F.col("position") >= since))

    def cumulative_metrics(self) -> DataFrame:
        """Metrics of all predictions, from the counts kept with the state."""
        cells = tuple(getattr(self.counters, name) for name in evaluation.COUNTS)
        schema = ", ".join(f"{name} BIGINT" for name in evaluation.COUNTS)
        return evaluation.with_rates(evaluation.with_totals(self.spark.createDataFrame([cells], schema)))

    def total_samples(self) -> int:
        return self.counters.total_samples

    def position(self) -> int:
        return self.counters.position

    def registry_size(self) -> int:
        return self.buffer.count()

    def memory_mb(self) -> float:
        return self._buffer_bytes(self._sized(self.buffer)) / MEGABYTE

    def is_warmed_up(self) -> bool:
        return self.counters.warmed_up

    def is_pretrained(self) -> bool:
        return self.counters.pretrained

    def budget_enabled(self) -> bool:
        return self.config.budget_enabled

    def set_budget_max_samples(self, max_samples: int) -> None:
        """Takes effect at the next registration."""
        self.config = self.config.with_(budget_max_samples=max_samples)

    def rebuild_mark_counts(self) -> tuple[int, int]:
        return self.counters.add_marks, self.counters.forget_marks

    # Buffer views

    def get_budget_eviction_stats(self) -> Row:
        return B.eviction_stats(self.log("evictions")).first()

    get_budget_eviction_stats_extended = get_budget_eviction_stats

    def total_budget_evicted(self) -> int:
        return self.get_budget_eviction_stats()["evicted_count"]

    def get_influence_coverage(self) -> DataFrame:
        return diagnostics.influence_coverage(self.buffer)

    def get_cached_influences(self) -> DataFrame:
        return self.buffer.where("influence IS NOT NULL").select("sample_id", "influence")

    def influence_tracking_enabled(self) -> bool:
        return self.config.influence_tracking

    def influence_degraded_count(self) -> int:
        return selection.degraded(self.buffer).count()

    def get_class_distribution(self) -> DataFrame:
        return B.class_balance(self.buffer).select("n_neg", "n_pos")

    def get_imbalance_ratio(self) -> float:
        return B.class_balance(self.buffer).first()["imbalance_ratio"]

    def get_registry_diagnostics(self) -> DataFrame:
        """Sizes, coverage, means and the age-influence rank correlation, as one row."""
        at = self.counters.position
        figures = diagnostics.registry_diagnostics(self.buffer, at)
        correlation = diagnostics.age_influence_spearman(self.buffer, at, self.scratch)
        return figures.withColumn("age_influence_spearman", correlation.scalar())

    # Histories

    def record_influence_batch(self, scores: DataFrame) -> None:
        """``scores``: sample_id, score. The previous influence always moves along."""
        scores = self.scratch.write(scores.select("sample_id", "score"), "scores")
        entries = lifecycle.record_influence(
            self.log("influences").where("false"), self.buffer, scores, self.counters.position, self.counters.log_seq
        )
        self._append("influences", entries)
        renamed = scores.select("sample_id", F.col("score").alias("influence"))
        updated = influence.set_influence(self.buffer, renamed, tracking=True)
        self.tables["buffer"] = self.scratch.write(updated, "buffer")
        self.counters.log_seq += 1

    def record_removal_ranks(self, ranked: DataFrame) -> None:
        """``ranked``: sample_id, rank."""
        entries = lifecycle.record_ranks(
            self.log("ranks").where("false"), self.buffer, ranked, self.counters.position, self.counters.log_seq
        )
        self._append("ranks", entries)
        self.counters.log_seq += 1

    def get_lifecycle_data(self) -> DataFrame:
        return lifecycle.lifecycle(self.buffer, self._history("influences"), self._history("ranks"))

    def get_core_concept_samples(self, min_history: int, min_average: float) -> DataFrame:
        return lifecycle.core_concept(self.buffer, self._history("influences"), min_history, min_average)

    def get_declining_samples(self, min_history: int) -> DataFrame:
        return lifecycle.declining(self.buffer, self._history("influences"), min_history)

    def get_longest_surviving(self, n: int) -> DataFrame:
        return selection.longest_surviving(self.buffer, n, self.counters.position)

    def get_high_risk_samples(self, top_n: int, min_count: int) -> DataFrame:
        return lifecycle.high_risk(self.buffer, self._history("ranks"), top_n, min_count)

    def get_stable_samples(self, max_variance: float, min_history: int) -> DataFrame:
        return lifecycle.stable(self.buffer, self._history("influences"), max_variance, min_history)
