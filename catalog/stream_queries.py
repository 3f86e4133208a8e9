"""Test-then-train streams over the event table (group M)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewood.api import UnlearningForest
from lethewood.config import RunConfig
from lethewood.plans.maintenance import resolve
from lethewood.sources.scratch import Scratch
from lethewood.streaming.prequential import batch_handler, class_ratio_ema, run_stream, sliced_source
from oracle import forest_sql as O
from oracle import tables as T

from .buffer_queries import BUDGET, CELLS, buffer, budget, rounded, score_sql, sql_rates
from .common import EVENT, FORGET_SQL, NODE_SQL, Query, forgotten, node_columns, samples

Q: dict[str, Query] = {}

STREAM = EVENT.with_(max_depth=3, warmup_samples=6000, metrics_window=1000)

_runs: dict[tuple[str, str, str], UnlearningForest] = {}


def clear_runs() -> None:
    _runs.clear()


def _cuts(rows: int) -> list[int]:
    """Three micro-batches: a half and two quarters of the table."""
    return [0, rows // 2, rows * 3 // 4, rows]


def _run(
    spark: SparkSession, d: str, kind: str, configure: Callable[[int], RunConfig]
) -> UnlearningForest:
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _runs:
        events = samples("event", spark, d)
        rows = events.count()
        scratch = Scratch(spark)
        model = UnlearningForest(spark, configure(rows))
        stream = sliced_source(spark, events, _cuts(rows), scratch.path("slices"))
        query = run_stream(model, stream, scratch.path("checkpoint"))
        query.awaitTermination()
        _runs[key] = model
    return _runs[key]


def streamed(spark: SparkSession, d: str) -> UnlearningForest:
    """No budget: everything seen so far is learned."""
    return _run(spark, d, "all", lambda rows: STREAM)


def bounded(spark: SparkSession, d: str) -> UnlearningForest:
    """Budget of half the table: whatever is evicted is forgotten by the model."""
    return _run(
        spark,
        d,
        "bounded",
        lambda rows: STREAM.with_(
            budget_enabled=True, budget_max_samples=rows // 2, influence_update_interval=0
        ),
    )


def pretrained(spark: SparkSession, d: str) -> UnlearningForest:
    key = (spark.sparkContext.applicationId, d, "pretrained")
    if key not in _runs:
        events = samples("event", spark, d)
        model = UnlearningForest(
            spark, STREAM.with_(budget_enabled=True, budget_max_samples=events.count() // 2)
        )
        model.fit(events)
        _runs[key] = model
    return _runs[key]


TOTAL = "(SELECT count(*) FROM event)"
SLICED = (
    f"sliced AS (SELECT *, CASE WHEN position < {TOTAL} // 2 THEN 0 WHEN position < {TOTAL} * 3 // 4 THEN 1 ELSE 2 END AS batch_id FROM event)"
)
# Each later batch is scored by a model trained from scratch on everything before it.
STREAM_CTES = [T.EVENT, SLICED]
for _b in (1, 2):
    STREAM_CTES += [
        f"seen{_b} AS (SELECT * FROM sliced WHERE batch_id < {_b})",
        f"next{_b} AS (SELECT * FROM sliced WHERE batch_id = {_b})",
        *O.fit(STREAM, f"seen{_b}", f"a{_b}_"),
        *O.walk(STREAM, f"next{_b}", f"a{_b}_", f"b{_b}_"),
    ]
STREAM_CTES.append(
    "pr AS (SELECT 0 AS batch_id, position, label, false AS pred, 0.0::DOUBLE AS proba FROM sliced WHERE batch_id = 0"
    + "".join(
        f" UNION ALL SELECT {b} AS batch_id, sample_id AS position, label, sum(vote::INT) * 2 > 8 AS pred, "
        f"sum(vote::INT)::DOUBLE / 8.0::DOUBLE AS proba FROM b{b}_votes GROUP BY sample_id, label"
        for b in (1, 2)
    )
    + ")"
)
Q["prequential_stream"] = Query(
    lambda spark, d: streamed(spark, d).log("predictions").select("batch_id", "position", "label", "pred", "proba"),
    O.query(STREAM_CTES, "SELECT batch_id, position, label, pred, proba FROM pr"),
)
LIMITS = "lim AS (SELECT batch_id, count(*) AS n, max(position) + 1 AS upto FROM sliced GROUP BY 1)"
Q["batch_results"] = Query(
    lambda spark, d: rounded(streamed(spark, d).log("results").withColumn("memory_mb", F.round("memory_mb", 9))),
    O.query(
        [
            *STREAM_CTES,
            LIMITS,
            "snap AS (SELECT l.batch_id, any_value(n) AS rows, any_value(upto) AS registry_size, "
            "round(any_value(upto) * (84 + 8 * 3)::DOUBLE / 1048576.0::DOUBLE, 9) AS memory_mb, any_value(upto) AS total_samples, "
            f"0::BIGINT AS budget_evicted, {CELLS} FROM lim l JOIN pr ON position < upto AND position >= upto - 1000 GROUP BY 1)",
        ],
        "SELECT * EXCLUDE (total, actual_positive, actual_negative) FROM ("
        + sql_rates(
            "SELECT * FROM snap", "batch_id, rows, registry_size, memory_mb, total_samples, budget_evicted,"
        )
        + ")",
    ),
)
Q["stream_metrics"] = Query(
    lambda spark, d: rounded(streamed(spark, d).cumulative_metrics()),
    O.query(STREAM_CTES, sql_rates(f"SELECT {CELLS} FROM pr")),
)
Q["warmup_state"] = Query(
    lambda spark, d: streamed(spark, d).log("results").select(
        "batch_id", "total_samples", (F.col("total_samples") >= STREAM.warmup_samples).alias("warmed_up")
    ),
    O.query(
        [T.EVENT, SLICED, LIMITS],
        "SELECT batch_id, upto AS total_samples, upto >= 6000 AS warmed_up FROM lim",
    ),
)

# The bounded stream: buffer after each batch in SQL, then a model trained on the last one.
BOUNDED_CTES = [T.EVENT, SLICED, "kept0 AS (SELECT sample_id, position, label FROM sliced WHERE batch_id = 0)"]
for _b in (1, 2):
    BOUNDED_CTES += [
        f"held{_b} AS (SELECT * FROM kept{_b - 1} UNION ALL SELECT sample_id, position, label FROM sliced WHERE batch_id = {_b})",
        f"aged{_b} AS (SELECT *, (SELECT max(position) + 1 FROM held{_b}) - position AS age, NULL::DOUBLE AS influence, "
        f"NULL::DOUBLE AS prev_influence FROM held{_b})",
        score_sql(f"aged{_b}").replace("scored AS", f"scored{_b} AS"),
        f"kept{_b} AS (SELECT sample_id, position, label FROM scored{_b} QUALIFY row_number() OVER (ORDER BY score DESC, sample_id) > "
        f"(CASE WHEN (SELECT count(*) FROM held{_b}) > {TOTAL} // 2 THEN greatest((SELECT count(*) FROM held{_b}) - {TOTAL} // 2, 100) ELSE 0 END))",
    ]
Q["stream_add"] = Query(
    lambda spark, d: bounded(spark, d).buffer.select("sample_id", "position", "label"),
    O.query(BOUNDED_CTES, "SELECT sample_id, position, label FROM kept2"),
)
Q["stream_add_model"] = Query(
    lambda spark, d: node_columns(resolve(bounded(spark, d).forest).nodes),
    O.query(
        [*BOUNDED_CTES, "live AS (SELECT * FROM event WHERE sample_id IN (SELECT sample_id FROM kept2))", *O.fit(STREAM, "live", "m_")],
        NODE_SQL.format(p="m_"),
    ),
)
Q["pretrain"] = Query(
    lambda spark, d: rounded(pretrained(spark, d).current_metrics()),
    O.query(
        [
            T.EVENT,
            *O.fit(STREAM, "event", "m_"),
            *O.walk(STREAM, "event", "m_", "q_"),
            "pr AS (SELECT sample_id AS position, label, sum(vote::INT) * 2 > 8 AS pred FROM q_votes GROUP BY 1, 2)",
        ],
        sql_rates(f"SELECT {CELLS} FROM (SELECT * FROM pr ORDER BY position DESC LIMIT 1000)"),
    ),
)
Q["pretrain_buffer"] = Query(
    lambda spark, d: pretrained(spark, d).buffer.select("sample_id", "position"),
    O.query(
        [T.EVENT],
        f"SELECT sample_id, position FROM event QUALIFY row_number() OVER (ORDER BY position DESC) <= {TOTAL} // 2",
    ),
)


def _forgetting(spark: SparkSession, d: str) -> DataFrame:
    """Train, then forget through the stateful surface, and look for the ids everywhere."""
    events = samples("event", spark, d)
    gone = forgotten("event", spark, d)
    model = UnlearningForest(spark, STREAM.with_(budget_enabled=True, budget_max_samples=events.count()))
    model.fit(events)
    known = model.forget_samples(gone)
    held = {"in_model": model.forest.samples, "in_buffer": model.buffer, "in_store": model.tables["store"]}
    left = model.forest.samples.agg(F.count(F.lit(1)).alias("samples_left"))
    for name, table in held.items():
        count = table.join(gone, "sample_id", "left_semi").count()
        left = left.withColumn(name, F.lit(count).cast("bigint"))
    return left.withColumn("forgotten", F.lit(known).cast("bigint"))


Q["forget_samples"] = Query(
    _forgetting,
    O.query(
        [T.EVENT, FORGET_SQL["event"]],
        "SELECT count(*) FILTER (sample_id NOT IN (SELECT sample_id FROM forgotten)) AS samples_left, 0::BIGINT AS in_model, "
        "0::BIGINT AS in_buffer, 0::BIGINT AS in_store, count(*) FILTER (sample_id IN (SELECT sample_id FROM forgotten)) AS forgotten FROM event",
    ),
)


def _pretrained_stream(spark: SparkSession, d: str) -> DataFrame:
    """Train on the first half, then stream the rest."""
    events = samples("event", spark, d)
    cuts = _cuts(events.count())
    scratch = Scratch(spark)
    model = UnlearningForest(spark, STREAM)
    model.fit(events.where(F.col("position") < cuts[1]))
    stream = sliced_source(spark, events, cuts[1:], scratch.path("slices"))
    run_stream(model, stream, scratch.path("checkpoint")).awaitTermination()
    return node_columns(resolve(model.forest).nodes)


Q["pretrain_then_stream"] = Query(
    _pretrained_stream, O.query([T.EVENT, *O.fit(STREAM, "event", "m_")], NODE_SQL.format(p="m_"))
)


def _forget_between(spark: SparkSession, d: str) -> DataFrame:
    """Two batches, forget, the second batch once more, then the third."""
    events = samples("event", spark, d)
    cuts = _cuts(events.count())
    scratch = Scratch(spark)
    folder, checkpoint = scratch.path("slices"), scratch.path("checkpoint")
    model = UnlearningForest(spark, STREAM)
    run_stream(model, sliced_source(spark, events, cuts[:3], folder), checkpoint).awaitTermination()
    model.forget_samples(forgotten("event", spark, d))
    second = events.where((F.col("position") >= cuts[1]) & (F.col("position") < cuts[2]))
    batch_handler(model, checkpoint)(second, 1)
    run_stream(model, sliced_source(spark, events, cuts[2:], folder), checkpoint).awaitTermination()
    return node_columns(resolve(model.forest).nodes)


# Ids that come again after they were forgotten are new samples.
Q["forget_between_batches"] = Query(
    _forget_between,
    O.query(
        [
            T.EVENT,
            FORGET_SQL["event"],
            f"live AS (SELECT * FROM event WHERE position >= {TOTAL} * 3 // 4 OR sample_id NOT IN (SELECT sample_id FROM forgotten))",
            *O.fit(STREAM, "live", "m_"),
        ],
        NODE_SQL.format(p="m_"),
    ),
)


def _rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """The frozen-model arm through the stateful surface: nodes after the first batch (none: the interval
    is not over), then a model refitted on the all that the buffer holds by then."""
    events = samples("event", spark, d)
    size = events.count()
    config = EVENT.with_(
        budget_enabled=True, budget_max_samples=size, budget_rebuild_interval=size, influence_update_interval=0
    )
    model = UnlearningForest(spark, config)
    model.stream_batch(events.where(F.col("position") < size // 2))
    before = model.forest.nodes.count()
    model.stream_batch(events.where(F.col("position") >= size // 2))
    return node_columns(model.forest.nodes).withColumn("nodes_before", F.lit(before).cast("bigint"))


Q["rebuild_arm"] = Query(
    _rebuilt,
    O.query(
        [T.EVENT, *O.fit(EVENT, "event", "m_")],
        f"SELECT *, 0::BIGINT AS nodes_before FROM ({NODE_SQL.format(p='m_')})",
    ),
)


def _erased(spark: SparkSession, d: str) -> DataFrame:
    """Pre-train, stream the rest, forget, erase: then read every file of the run. Ids met there, with
    the forgotten among them, before and after; and the model's live samples."""
    events = samples("event", spark, d)
    size = events.count()
    model = UnlearningForest(spark, EVENT.with_(max_depth=2, leaf_map=True, influence_update_interval=0))
    model.fit(events.where(F.col("position") < size // 2))
    model.stream_batch(events.where(F.col("position") >= size // 2))
    gone = forgotten("event", spark, d)
    model.forget_samples(gone)

    def met(name: str) -> DataFrame:
        reader = spark.read.schema("sample_id BIGINT").option("recursiveFileLookup", True)
        files = reader.option("pathGlobFilter", "*.parquet").parquet(*model.run_folders())
        ids = files.where("sample_id IS NOT NULL").distinct().join(gone.withColumn("gone", F.lit(1)), "sample_id", "left")
        return ids.agg(F.count("sample_id").alias(f"ids_{name}"), F.count("gone").alias(f"forgotten_{name}"))

    before = model.scratch.write(met("before"), "before")
    figures = before.first()
    model.erase()
    return met("after").select(
        F.lit(figures["ids_before"]).alias("ids_before"),
        F.lit(figures["forgotten_before"]).alias("forgotten_before"),
        "ids_after",
        "forgotten_after",
        F.lit(model.forest.samples.count()).cast("bigint").alias("live"),
    )


Q["erase_forgotten"] = Query(
    _erased,
    O.query(
        [T.EVENT, FORGET_SQL["event"]],
        "SELECT count(*) AS ids_before, count(*) FILTER (sample_id IN (FROM forgotten)) AS forgotten_before, "
        "count(*) FILTER (sample_id NOT IN (FROM forgotten)) AS ids_after, 0::BIGINT AS forgotten_after, "
        "count(*) FILTER (sample_id NOT IN (FROM forgotten)) AS live FROM event",
    ),
)
EMA_BATCH = 20


def _ema(spark: SparkSession, d: str) -> DataFrame:
    batches = samples("event", spark, d).groupBy(F.expr(f"position div {EMA_BATCH}").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("label").cast("bigint")).alias("positives")
    )
    return class_ratio_ema(batches).select("batch_id", F.round("ema", 9).alias("ema"))


Q["class_ratio_ema"] = Query(
    _ema,
    "WITH RECURSIVE "
    + T.EVENT.strip()
    + f", sh AS (SELECT position // {EMA_BATCH} AS batch_id, avg(label::INT)::DOUBLE AS share FROM event GROUP BY 1), "
    "walk(batch_id, ema) AS (SELECT -1::BIGINT, 0.5::DOUBLE UNION ALL SELECT w.batch_id + 1, 0.8::DOUBLE * ema + 0.2::DOUBLE * share "
    "FROM walk w JOIN sh ON sh.batch_id = w.batch_id + 1) SELECT batch_id, round(ema, 9) AS ema FROM walk WHERE batch_id >= 0",
)


def _reset(spark: SparkSession, d: str) -> DataFrame:
    """Rows a used run holds before and after starting over."""
    used = streamed(spark, d)
    fresh = UnlearningForest(spark, used.config)
    fresh.load(-1)
    fresh.counters.total_samples, fresh.parts, fresh.tables = 1, used.parts, dict(used.tables)
    fresh.reset()
    before = used.forest.samples.agg(F.count(F.lit(1)).alias("samples_before"))
    after = fresh.forest.samples.agg(F.count(F.lit(1)).alias("samples_after"))
    return before.withColumn("_k", F.lit(1)).join(after.withColumn("_k", F.lit(1)), "_k").select(
        "samples_before",
        "samples_after",
        F.lit(fresh.counters.total_samples + fresh.registry_size()).cast("bigint").alias("counters_after"),
    )


Q["run_reset"] = Query(
    _reset,
    "SELECT count(*) AS samples_before, 0::BIGINT AS samples_after, 0::BIGINT AS counters_after FROM events",
)
Q["run_config"] = Query(
    lambda spark, d: budget(buffer(spark, d)).to_table(spark).select(
        "num_trees", "k", "max_depth", "seed", "metrics_window", "budget_enabled", "budget_max_samples", "influence_strategy"
    ),
    "SELECT 50::BIGINT AS num_trees, 10::BIGINT AS k, 15::BIGINT AS max_depth, 42::BIGINT AS seed, 1000::BIGINT AS metrics_window, "
    "true AS budget_enabled, count(*) * 6 // 10 AS budget_max_samples, 'none' AS influence_strategy FROM events",
)
assert BUDGET.num_trees == 50
