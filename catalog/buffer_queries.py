"""Buffer, influence, selection, history, diagnostics and evaluation (groups G to L)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewood.config import RunConfig
from lethewood.operators import buffer as B
from lethewood.operators import diagnostics as D
from lethewood.operators import evaluation as E
from lethewood.operators import influence as I
from lethewood.operators import lifecycle as L
from lethewood.operators import scoring
from lethewood.operators import selection as X
from lethewood.plans import growth
from lethewood.sources import samples as src
from lethewood.sources.scratch import Scratch
from oracle import forest_sql as O
from oracle import tables as T

from .common import EVENT, LINE, NODE_SQL, Query, joined_array, model, node_columns, samples, vote_ctes

Q: dict[str, Query] = {}

BUDGET = RunConfig(budget_enabled=True)

# The events as a buffer: influences, tree lists and histories follow from the event id.

INFLUENCE = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST((event_id * 7919) % 2001 - 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END"
PREVIOUS = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST((event_id * 104729) % 2001 - 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END"
LABEL = "event_type = 'purchase' AND value > 50"
SCORE = "CAST((sample_id * 31 + j * 17) % 201 - 100 AS DOUBLE) / CAST(100 AS DOUBLE)"

BUF = f"""buf AS (SELECT event_id AS sample_id, event_id AS position, ({LABEL}) AS label,
  1 + event_id % 10 AS n_trees, {INFLUENCE} AS influence, {PREVIOUS} AS prev_influence FROM events)"""
CUR = "cur AS (SELECT max(position) + 1 AS now FROM buf)"
AGED = "aged AS (SELECT buf.*, now - position AS age, now FROM buf, cur)"
BASE = [BUF, CUR, AGED]
HIST = f"hist AS (SELECT sample_id, j AS seq, sample_id + 10 * j AS position, {SCORE} AS score FROM buf, range(25) r(j) WHERE j <= sample_id % 25)"
RANKS = "ranks AS (SELECT sample_id, j AS seq, sample_id + 10 * j AS position, (sample_id * 13 + j * 7) % 500 AS rank FROM buf, range(22) r(j) WHERE j <= sample_id % 22)"


def newest_sql(log: str) -> str:
    return f"SELECT * FROM {log} QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY position DESC, seq DESC) <= 20"


def buffer(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "events").selectExpr(
        "event_id AS sample_id",
        "event_id AS position",
        f"({LABEL}) AS label",
        "sequence(0, CAST(event_id % 10 AS INT)) AS tree_ids",
        f"{INFLUENCE} AS influence",
        f"{PREVIOUS} AS prev_influence",
    )


def position_now(rows: DataFrame) -> int:
    return rows.agg(F.max("position") + 1).first()[0]


def influence_log(spark: SparkSession, d: str) -> DataFrame:
    entries = buffer(spark, d).selectExpr("sample_id", "explode(sequence(0L, sample_id % 25)) AS j")
    return entries.selectExpr("sample_id", "j AS seq", "sample_id + 10 * j AS position", f"{SCORE} AS score")


def rank_log(spark: SparkSession, d: str) -> DataFrame:
    entries = buffer(spark, d).selectExpr("sample_id", "explode(sequence(0L, sample_id % 22)) AS j")
    return entries.selectExpr(
        "sample_id", "j AS seq", "sample_id + 10 * j AS position", "(sample_id * 13 + j * 7) % 500 AS rank"
    )


def budget(rows: DataFrame) -> RunConfig:
    """Keep six tenths of the table."""
    return BUDGET.with_(budget_max_samples=rows.count() * 6 // 10)


def score_sql(source: str, age: str = "age::DOUBLE / max_age::DOUBLE") -> str:
    """The eviction score in SQL over ``source`` (with age)."""
    return f"""scored AS (
  SELECT s.*, (0.4::DOUBLE * ({age})
    + 0.4::DOUBLE * ((CASE WHEN lo IS NULL THEN 0.0 ELSE (hi - coalesce(influence, (lo + hi) / 2.0)) / greatest(hi - lo, 1e-9) END)
      + (CASE WHEN prev_influence >= 0 AND influence < 0 THEN 0.3 WHEN influence - prev_influence < -0.1 THEN 0.15 ELSE 0.0 END)::DOUBLE)
    + 0.2::DOUBLE * (CASE WHEN label = (n_pos < n_neg) THEN -0.5 ELSE 0.0 END)::DOUBLE)
    * (CASE WHEN share < 0.05 THEN 0.2 WHEN share < 0.1 THEN 0.5 ELSE 1.0 END)::DOUBLE AS score
  FROM (SELECT a.*, g.*, (CASE WHEN label THEN n_pos ELSE n_neg END)::DOUBLE / (n_pos + n_neg)::DOUBLE AS share FROM {source} a,
    (SELECT greatest(max(age), 1) AS max_age, min(influence) AS lo, max(influence) AS hi,
       count(*) FILTER (label) AS n_pos, count(*) FILTER (NOT label) AS n_neg FROM {source}) g) s)"""


EVICT_COUNT = "greatest((SELECT count(*) - count(*) * 6 // 10 FROM {source}), 100)"


def out_sql(order: str, source: str = "aged") -> str:
    count = EVICT_COUNT.format(source=source)
    return f"out AS (SELECT * FROM scored QUALIFY row_number() OVER (ORDER BY {order}) <= {count})"


# G. Buffer


def _registered(spark: SparkSession, d: str) -> B.Eviction:
    """Sign-ups register again at new positions, then the budget is enforced once."""
    rows = buffer(spark, d)
    now = position_now(rows)
    again = src.table(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").alias("sample_id"))
    new = B.entries(rows.join(again, "sample_id", "left_semi").withColumn("position", F.col("position") + now))
    scratch = Scratch(spark)
    everything = scratch.write(B.insert(rows, new), "buffer")
    return B.budget_evict(everything, budget(everything), position_now(everything), scratch)


Q["buffer_register"] = Query(
    lambda spark, d: _registered(spark, d).kept.select("sample_id", "position", "influence"),
    O.query(
        [
            BUF,
            CUR,
            "old AS (SELECT * FROM buf)",
            "fresh AS (SELECT * FROM buf WHERE sample_id IN (SELECT event_id FROM events WHERE event_type = 'signup'))",
            "reg AS (SELECT * FROM old WHERE sample_id NOT IN (SELECT sample_id FROM fresh) UNION ALL "
            "SELECT sample_id, position + now, label, n_trees, NULL, NULL FROM fresh, cur)",
            "aged AS (SELECT reg.*, m.now - position AS age FROM reg, (SELECT max(position) + 1 AS now FROM reg) m)",
            score_sql("aged"),
            out_sql("score DESC, sample_id"),
        ],
        "SELECT sample_id, position, influence FROM reg WHERE sample_id NOT IN (SELECT sample_id FROM out)",
    ),
)
Q["buffer_fifo"] = Query(
    lambda spark, d: B.fifo_evict(
        buffer(spark, d), budget(buffer(spark, d)).budget_max_samples, Scratch(spark)
    ).kept.select("sample_id", "position"),
    O.query(
        BASE,
        "SELECT sample_id, position FROM buf QUALIFY row_number() OVER (ORDER BY position DESC) <= (SELECT count(*) * 6 // 10 FROM buf)",
    ),
)


def _evicted(spark: SparkSession, d: str, **changes: object) -> DataFrame:
    rows = buffer(spark, d)
    return B.budget_evict(rows, budget(rows).with_(**changes), position_now(rows), Scratch(spark)).evicted


Q["budget_evict"] = Query(
    lambda spark, d: _evicted(spark, d).select("sample_id"),
    O.query([*BASE, score_sql("aged"), out_sql("score DESC, sample_id")], "SELECT sample_id FROM out"),
)
Q["eviction_score"] = Query(
    lambda spark, d: B.eviction_scores(buffer(spark, d), BUDGET, position_now(buffer(spark, d))).select(
        "sample_id", F.round("score", 9).alias("score")
    ),
    O.query([*BASE, score_sql("aged")], "SELECT sample_id, round(score, 9) AS score FROM scored"),
)
DRAW = O.uniform(42, "evict", "sample_id", "now")
Q["evict_random"] = Query(
    lambda spark, d: _evicted(spark, d, budget_random_eviction=True).select("sample_id"),
    O.query(
        [*BASE, f"scored AS (SELECT *, {DRAW} AS score FROM aged)", out_sql("score, sample_id")],
        "SELECT sample_id FROM out",
    ),
)
Q["evict_class_aware_random"] = Query(
    lambda spark, d: _evicted(spark, d, budget_class_aware_random=True).select("sample_id"),
    O.query([*BASE, score_sql("aged", DRAW), out_sql("score DESC, sample_id")], "SELECT sample_id FROM out"),
)
BYTES = "84 + 8 * n_trees + 16 * (least(1 + sample_id % 25, 20) + least(1 + sample_id % 22, 20))"


def _memory(spark: SparkSession, d: str) -> DataFrame:
    rows = buffer(spark, d)
    history = L.newest_entries(influence_log(spark, d)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("h"))
    ranks = L.newest_entries(rank_log(spark, d)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("r"))
    sized = rows.join(history, "sample_id").join(ranks, "sample_id")
    size = B.memory_bytes("h", "r")
    cap = sized.agg(F.sum(size)).first()[0] * 6 // 10
    return B.memory_evict(sized, cap, Scratch(spark), size).kept.select("sample_id", size.alias("bytes"))


Q["memory_evict"] = Query(
    _memory,
    O.query(
        [*BASE, f"sized AS (SELECT sample_id, position, ({BYTES})::BIGINT AS bytes FROM buf)"],
        "SELECT sample_id, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY position DESC) AS running FROM sized) "
        "WHERE running <= (SELECT sum(bytes) * 6 // 10 FROM sized)",
    ),
)
Q["buffer_totals"] = Query(
    lambda spark, d: B.buffer_totals(buffer(spark, d)),
    O.query(
        BASE,
        "SELECT count(*) AS size, sum(84 + 8 * n_trees)::BIGINT AS bytes, sum(84 + 8 * n_trees)::DOUBLE / 1048576.0 AS memory_mb FROM buf",
    ),
)


def _eviction_stats(spark: SparkSession, d: str) -> DataFrame:
    log = B.eviction_log_rows(_evicted(spark, d), "budget").unionByName(
        B.eviction_log_rows(buffer(spark, d).where("label"), "memory")
    )
    return B.eviction_stats(log).withColumn("evicted_influence_sum", F.round("evicted_influence_sum", 6))


Q["eviction_stats"] = Query(
    _eviction_stats,
    O.query(
        [*BASE, score_sql("aged"), out_sql("score DESC, sample_id")],
        "SELECT count(*) AS evicted_count, count(*) FILTER (NOT label) AS evicted_benign, count(*) FILTER (label) AS evicted_attack, "
        "count(*) FILTER (prev_influence >= 0 AND influence < 0) AS evicted_degraded, count(influence) AS evicted_with_influence, "
        "round(coalesce(sum(influence), 0.0), 6) AS evicted_influence_sum FROM out",
    ),
)


def _by_user(spark: SparkSession, d: str) -> DataFrame:
    errors = src.table(spark, d, "events").where("event_type = 'error'")
    return errors.select(F.col("event_id").alias("sample_id"))


Q["buffer_remove"] = Query(
    lambda spark, d: B.remove(buffer(spark, d), _by_user(spark, d)).select("sample_id"),
    "SELECT event_id AS sample_id FROM events WHERE event_type <> 'error'",
)
Q["buffer_get"] = Query(
    lambda spark, d: buffer(spark, d).join(_by_user(spark, d), "sample_id", "left_semi").select(
        "sample_id", "label", joined_array("tree_ids").alias("tree_ids"), B.can_unlearn().alias("can_unlearn")
    ),
    O.query(
        BASE,
        "SELECT sample_id, label, array_to_string(range(n_trees), ',') AS tree_ids, n_trees > 0 AS can_unlearn "
        "FROM buf WHERE sample_id IN (SELECT event_id FROM events WHERE event_type = 'error')",
    ),
)
Q["class_balance"] = Query(
    lambda spark, d: B.class_balance(buffer(spark, d)),
    O.query(
        [*BASE, "c AS (SELECT count(*) FILTER (NOT label) AS n_neg, count(*) FILTER (label) AS n_pos FROM buf)"],
        "SELECT n_neg, n_pos, n_pos < n_neg AS minority_class, n_pos >= n_neg AS majority_class, "
        "CASE WHEN least(n_neg, n_pos) = 0 THEN 'inf'::DOUBLE ELSE greatest(n_neg, n_pos)::DOUBLE / least(n_neg, n_pos)::DOUBLE END AS imbalance_ratio FROM c",
    ),
)


def _resized(spark: SparkSession, d: str) -> DataFrame:
    """The budget shrinks between two enforcement rounds."""
    rows, scratch = buffer(spark, d), Scratch(spark)
    wide = budget(rows)
    first = scratch.write(B.budget_evict(rows, wide, position_now(rows), scratch).kept, "kept")
    narrow = wide.with_(budget_max_samples=wide.budget_max_samples // 2)
    return B.budget_evict(first, narrow, position_now(rows), scratch).kept.select("sample_id")


Q["budget_resize"] = Query(
    _resized,
    O.query(
        [
            *BASE,
            score_sql("aged"),
            out_sql("score DESC, sample_id"),
            "left_over AS (SELECT * FROM aged WHERE sample_id NOT IN (SELECT sample_id FROM out))",
            score_sql("left_over").replace("scored AS", "scored2 AS"),
            "out2 AS (SELECT * FROM scored2 QUALIFY row_number() OVER (ORDER BY score DESC, sample_id) <= "
            "greatest((SELECT count(*) FROM left_over) - (SELECT count(*) * 6 // 10 // 2 FROM buf), 100))",
        ],
        "SELECT sample_id FROM left_over WHERE sample_id NOT IN (SELECT sample_id FROM out2)",
    ),
)
Q["buffer_counters"] = Query(
    lambda spark, d: buffer(spark, d).agg(
        F.count(F.lit(1)).alias("total_registered"), (F.max("position") + 1).alias("current_position")
    ),
    O.query(BASE, "SELECT count(*) AS total_registered, max(position) + 1 AS current_position FROM buf"),
)

# H. Influence


def _self_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every sample as its own test row."""
    forest = model("line", spark, d)
    pairs = forest.samples.select("sample_id", F.col("sample_id").alias("test_id"))
    return I.pair_influence(forest, forest.samples, pairs)


def entropy(votes: str, trees: str) -> str:
    p = f"least(greatest({votes}::DOUBLE / {trees}::DOUBLE, 1e-7::DOUBLE), 1.0::DOUBLE - 1e-7::DOUBLE)"
    return f"(-(CASE WHEN label THEN ln({p}) ELSE ln(1.0::DOUBLE - {p}) END))"


TALLY = (
    "tally AS (SELECT v.sample_id, any_value(v.label) AS label, count(*) FILTER (a.tree_id IS NOT NULL AND vote) AS iv, "
    "count(*) FILTER (a.tree_id IS NULL AND vote) AS ov FROM q_votes v LEFT JOIN m_asg a USING (sample_id, tree_id) GROUP BY 1)"
)
OOB = "((2 * iv > 3) = label)::INT::DOUBLE - ((2 * ov > 5) = label)::INT::DOUBLE"
Q["oob_influence"] = Query(
    lambda spark, d: _self_pairs(spark, d).select("sample_id", "oob_influence"),
    O.query([*vote_ctes("line"), TALLY], f"SELECT sample_id, {OOB} AS oob_influence FROM tally"),
)
Q["loss_influence"] = Query(
    lambda spark, d: _self_pairs(spark, d).select("sample_id", F.round("loss_influence", 9).alias("loss_influence")),
    O.query(
        [*vote_ctes("line"), TALLY],
        f"SELECT sample_id, round({entropy('ov', '5')} - {entropy('iv', '3')}, 9) AS loss_influence FROM tally",
    ),
)


def mean_ctes(name: str) -> list[str]:
    """Mean influence of every sample over the whole table, through distinct tree sets and vote sets."""
    return [
        *vote_ctes(name),
        "pat AS (SELECT mask, label, count(*) AS times FROM (SELECT sample_id, label, sum((vote::INT) << tree_id)::BIGINT AS mask "
        "FROM q_votes GROUP BY 1, 2) GROUP BY 1, 2)",
        "held AS (SELECT sample_id, sum(1 << tree_id)::BIGINT AS trees FROM m_asg GROUP BY 1)",
        "cell AS (SELECT trees, label, times, bit_count(mask & trees) AS iv, bit_count(mask) - bit_count(mask & trees) AS ov "
        "FROM (SELECT DISTINCT trees FROM held), pat)",
        f"mean AS (SELECT trees, sum(({OOB}) * times) / sum(times) AS oob, "
        f"sum(({entropy('ov', '5')} - {entropy('iv', '3')}) * times) / sum(times) AS loss FROM cell GROUP BY 1)",
    ]


def _means(spark: SparkSession, d: str, name: str, loss: bool = False) -> DataFrame:
    return I.all_influences(model(name, spark, d), samples(name, spark, d), loss)


Q["oob_influence_avg"] = Query(
    lambda spark, d: _means(spark, d, "doc").select("sample_id", F.round("influence", 9).alias("influence")),
    O.query(mean_ctes("doc"), "SELECT sample_id, round(oob, 9) AS influence FROM held JOIN mean USING (trees)"),
)
Q["loss_influence_avg"] = Query(
    lambda spark, d: _means(spark, d, "event", True).select("sample_id", F.round("influence", 8).alias("influence")),
    O.query(mean_ctes("event"), "SELECT sample_id, round(loss, 8) AS influence FROM held JOIN mean USING (trees)"),
)
Q["all_influences"] = Query(
    lambda spark, d: _means(spark, d, "line").select("sample_id", F.round("influence", 9).alias("influence")),
    O.query(mean_ctes("line"), "SELECT sample_id, round(oob, 9) AS influence FROM held JOIN mean USING (trees)"),
)
Q["harmful_samples"] = Query(
    lambda spark, d: I.harmful(_means(spark, d, "vec")).select("sample_id", F.round("influence", 9).alias("influence")),
    O.query(
        mean_ctes("vec"), "SELECT sample_id, round(oob, 9) AS influence FROM held JOIN mean USING (trees) WHERE oob < 0"
    ),
)


def _scored(spark: SparkSession, d: str, column: Callable[[], Column]) -> DataFrame:
    scored = scoring.predict(model("event", spark, d), samples("event", spark, d))
    return scored.select("sample_id", column().alias("influence"))


PROBA = "p AS (SELECT sample_id, label, sum(vote::INT)::DOUBLE / 8.0::DOUBLE AS proba FROM q_votes GROUP BY 1, 2)"
Q["confidence_influence"] = Query(
    lambda spark, d: _scored(spark, d, I.confidence_influence),
    O.query(
        [*vote_ctes("event"), PROBA],
        "SELECT sample_id, -(CASE WHEN label THEN proba ELSE 1.0::DOUBLE - proba END) AS influence FROM p",
    ),
)
Q["conflict_influence"] = Query(
    lambda spark, d: _scored(spark, d, I.conflict_influence),
    O.query(
        [*vote_ctes("event"), PROBA],
        "SELECT sample_id, CASE WHEN (proba > 0.5) <> label THEN -(CASE WHEN proba > 0.5 THEN proba ELSE 1.0::DOUBLE - proba END) "
        "ELSE (CASE WHEN label THEN proba ELSE 1.0::DOUBLE - proba END) - 0.5::DOUBLE END AS influence FROM p",
    ),
)


def _cumulative(spark: SparkSession, d: str) -> DataFrame:
    new = _means(spark, d, "event").where("influence IS NOT NULL").withColumnRenamed("influence", "new")
    rows = buffer(spark, d).join(new, "sample_id")
    value = I.ema_influence(F.col("new"), F.col("influence"))
    return rows.select("sample_id", F.round(value, 9).alias("influence"))


Q["cumulative_oob"] = Query(
    _cumulative,
    O.query(
        [*mean_ctes("event"), BUF],
        "SELECT sample_id, round(0.3::DOUBLE * oob + (1.0::DOUBLE - 0.3::DOUBLE) * coalesce(influence, 0.0::DOUBLE), 9) AS influence "
        "FROM buf JOIN held USING (sample_id) JOIN mean USING (trees)",
    ),
)
Q["feature_distance"] = Query(
    lambda spark, d: I.feature_distance(samples("vec", spark, d), 64, Scratch(spark)).select(
        "sample_id", F.round("influence", 8).alias("influence")
    ),
    O.query(
        [
            T.VECTOR,
            "recent AS (SELECT * FROM vec QUALIFY row_number() OVER (ORDER BY position DESC) <= 1000)",
            "center AS (SELECT a, avg(f[a + 1]) AS c FROM recent, range(64) r(a) GROUP BY a)",
        ],
        "SELECT sample_id, round(-sqrt(sum((f[a + 1] - c) * (f[a + 1] - c))), 8) AS influence FROM vec, center GROUP BY 1",
    ),
)
SUBSET = 400
SUBSET_SQL = (
    "sub AS (SELECT sample_id FROM (SELECT sample_id, row_number() OVER (ORDER BY position) - 1 AS rn, count(*) OVER () AS total FROM buf) "
    f"WHERE {SUBSET} >= total OR (rn % (total // {SUBSET}) = 0 AND rn // (total // {SUBSET}) < {SUBSET}))"
)
Q["uniform_subset"] = Query(
    lambda spark, d: X.uniform_subset(buffer(spark, d), SUBSET, Scratch(spark)).select("sample_id"),
    O.query([BUF, SUBSET_SQL], "SELECT sample_id FROM sub"),
)


def _update(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    """One influence update of the whole buffer, all events as the test batch."""
    forest = model("event", spark, d)
    forest = forest.with_(config=forest.config.with_(influence_sample_count=SUBSET))
    rows = buffer(spark, d)
    tests = samples("event", spark, d)
    scores = I.strategy_scores(strategy, forest, rows, tests.select("sample_id", "features"), tests)
    updated = rows if scores is None else I.set_influence(rows, scores, tracking=True)
    return updated.select(
        "sample_id", F.round("influence", 8).alias("influence"), F.round("prev_influence", 8).alias("prev_influence")
    )


def updated_sql(value: str) -> str:
    return (
        f"SELECT sample_id, round(CASE WHEN s.sample_id IS NULL THEN influence ELSE {value} END, 8) AS influence, "
        "round(CASE WHEN s.sample_id IS NULL THEN prev_influence ELSE influence END, 8) AS prev_influence "
        "FROM buf JOIN held USING (sample_id) JOIN mean USING (trees) LEFT JOIN sub s USING (sample_id)"
    )


Q["oob_update"] = Query(
    lambda spark, d: _update(spark, d, "oob"),
    O.query([*mean_ctes("event"), BUF, SUBSET_SQL], updated_sql("oob")),
)
Q["loss_update"] = Query(
    lambda spark, d: _update(spark, d, "loss"),
    O.query([*mean_ctes("event"), BUF, SUBSET_SQL], updated_sql("loss")),
)
Q["influence_dispatch"] = Query(
    lambda spark, d: _update(spark, d, "cumulative_oob"),
    O.query(
        [*mean_ctes("event"), BUF, SUBSET_SQL],
        updated_sql("0.3::DOUBLE * oob + (1.0::DOUBLE - 0.3::DOUBLE) * coalesce(influence, 0.0::DOUBLE)"),
    ),
)
Q["influence_dispatch_unknown"] = Query(
    lambda spark, d: _update(spark, d, "no such strategy"),
    O.query([BUF], "SELECT sample_id, round(influence, 8) AS influence, round(prev_influence, 8) AS prev_influence FROM buf"),
)


def _set_state(spark: SparkSession, d: str) -> DataFrame:
    events = src.table(spark, d, "events").where("value > 50")
    scores = events.select(F.col("event_id").alias("sample_id"), (F.col("value") / 1000.0).alias("influence"))
    return I.set_influence(buffer(spark, d), scores, tracking=True).where("influence IS NOT NULL").select(
        "sample_id", "influence", "prev_influence"
    )


Q["influence_state"] = Query(
    _set_state,
    O.query(
        [BUF],
        "SELECT sample_id, CASE WHEN value > 50 THEN value / 1000.0::DOUBLE ELSE influence END AS influence, "
        "CASE WHEN value > 50 THEN influence ELSE prev_influence END AS prev_influence "
        "FROM buf JOIN events ON event_id = sample_id WHERE value > 50 OR influence IS NOT NULL",
    ),
)
Q["influence_delta"] = Query(
    lambda spark, d: buffer(spark, d).select("sample_id", X.influence_delta().alias("delta")),
    O.query([BUF], "SELECT sample_id, influence - prev_influence AS delta FROM buf"),
)
Q["influence_degraded"] = Query(
    lambda spark, d: X.degraded(buffer(spark, d)).select("sample_id"),
    O.query([BUF], "SELECT sample_id FROM buf WHERE prev_influence >= 0 AND influence < 0"),
)

# I. Selection

TOP = 100


def selected(
    name: str, pick: Callable[[DataFrame, int], DataFrame], where: str, order: str | None, limit: int = TOP
) -> None:
    """A selection query and its SQL: filter, order, take."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = buffer(spark, d)
        return pick(rows, position_now(rows)).select("sample_id")

    tail = f" ORDER BY {order}, sample_id" + (f" LIMIT {limit}" if limit else "") if order else ""
    Q[name] = Query(run, O.query(BASE, f"SELECT sample_id FROM aged WHERE {where}{tail}"))


KNOWN = "influence IS NOT NULL"
selected("oldest", lambda b, now: X.oldest(b, TOP), "true", "position")
selected("oldest_many", lambda b, now: X.oldest(b, 2500), "true", "position", 2500)
selected("newest", lambda b, now: X.newest(b, TOP), "true", "position DESC")
selected("by_class", lambda b, now: X.of_class(b, True), "label", None)
selected("oldest_by_class", lambda b, now: X.oldest_of_class(b, True, TOP), "label", "position")
selected("most_harmful", lambda b, now: X.most_harmful(b, TOP), KNOWN, "influence")
selected("most_harmful_by_class", lambda b, now: X.most_harmful_of_class(b, True, TOP), f"label AND {KNOWN}", "influence")
selected(
    "harmful_below_threshold",
    lambda b, now: X.harmful_below(b, False, TOP, -0.9),
    "NOT label AND influence < -0.9",
    "influence",
)
selected(
    "time_weighted_harmful",
    lambda b, now: X.time_weighted_harmful(b, TOP, 0.001, now),
    KNOWN,
    "influence - 0.001::DOUBLE * age::DOUBLE",
)
selected(
    "time_weighted_harmful_by_class",
    lambda b, now: X.time_weighted_harmful(b, TOP, 0.001, now, True),
    f"label AND {KNOWN}",
    "influence - 0.001::DOUBLE * age::DOUBLE",
)
selected(
    "age_prioritized",
    lambda b, now: X.age_prioritized(b, TOP, 500, now),
    "true",
    "age // 500 DESC, coalesce(influence, 0.0)",
)
selected("longest_surviving", lambda b, now: X.longest_surviving(b, TOP, now), "true", "age DESC")
selected(
    "rapidly_declining", lambda b, now: X.rapidly_declining(b, -0.5), "influence - prev_influence < -0.5::DOUBLE", None
)

# J. Histories



def _append_influences(spark: SparkSession, d: str) -> DataFrame:
    """Record today's known influences, and one of an id that is not buffered, on top of the log."""
    rows = buffer(spark, d)
    scores = rows.where("influence IS NOT NULL").select("sample_id", F.col("influence").alias("score"))
    scores = scores.unionByName(spark.range(1).select((F.col("id") - 1).alias("sample_id"), F.lit(0.5).alias("score")))
    now = position_now(rows)
    return L.newest_entries(L.record_influence(influence_log(spark, d), rows, scores, now * 100, 99)).select(
        "sample_id", "position", "score"
    )


Q["record_influence"] = Query(
    _append_influences,
    O.query(
        [
            *BASE,
            HIST,
            "more AS (SELECT sample_id, 99 AS seq, (SELECT now * 100 FROM cur) AS position, influence AS score "
            "FROM buf WHERE influence IS NOT NULL)",
            "every AS (SELECT sample_id, seq, position, score FROM hist UNION ALL SELECT sample_id, seq, position, score FROM more)",
        ],
        f"SELECT sample_id, position, score FROM ({newest_sql('every')})",
    ),
)


def _append_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Record today's most harmful list on top of the rank log."""
    rows = buffer(spark, d)
    now = position_now(rows)
    listed = X.most_harmful(rows, TOP).select("sample_id", "influence")
    ranked = listed.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("influence", "sample_id"))).alias("list")
    ).selectExpr("posexplode(list) AS (rank, item)").selectExpr("item.sample_id AS sample_id", "rank")
    return L.newest_entries(L.record_ranks(rank_log(spark, d), rows, ranked, now * 100, 99)).select(
        "sample_id", "position", "rank"
    )


Q["record_ranks"] = Query(
    _append_ranks,
    O.query(
        [
            *BASE,
            RANKS,
            "more AS (SELECT sample_id, 99 AS seq, (SELECT now * 100 FROM cur) AS position, "
            "row_number() OVER (ORDER BY influence, sample_id) - 1 AS rank FROM "
            f"(SELECT * FROM buf WHERE influence IS NOT NULL ORDER BY influence, sample_id LIMIT {TOP}))",
            "every AS (SELECT * FROM ranks UNION ALL SELECT * FROM more)",
        ],
        f"SELECT sample_id, position, rank FROM ({newest_sql('every')})",
    ),
)
STATS = [
    BUF,
    HIST,
    f"kept AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY position, seq) - 1 AS i, "
    f"count(*) OVER (PARTITION BY sample_id) AS len, avg(score) OVER (PARTITION BY sample_id) AS mean FROM ({newest_sql('hist')}))",
    "st AS (SELECT sample_id, count(*) AS history_len, any_value(mean) AS mean, avg((score - mean) * (score - mean)) AS variance, "
    "avg(score) FILTER (i >= len // 2) - avg(score) FILTER (i < len // 2) AS trend FROM kept GROUP BY 1)",
    "full_st AS (SELECT buf.*, coalesce(history_len, 0) AS history_len, coalesce(mean, influence) AS average, variance, trend "
    "FROM buf LEFT JOIN st USING (sample_id))",
]


def _history(spark: SparkSession, d: str) -> DataFrame:
    return L.with_history(buffer(spark, d), influence_log(spark, d))


Q["average_influence"] = Query(
    lambda spark, d: _history(spark, d).select("sample_id", (F.round("average", 9) + 0.0).alias("average")),
    O.query(STATS, "SELECT sample_id, round(average, 9) + 0.0 AS average FROM full_st"),
)
Q["influence_trend"] = Query(
    lambda spark, d: _history(spark, d).select("sample_id", (F.round("trend", 9) + 0.0).alias("trend")),
    O.query(STATS, "SELECT sample_id, round(trend, 9) + 0.0 AS trend FROM full_st"),
)
RISK = f"risk AS (SELECT sample_id, count(*) FILTER (rank < 100) AS risk FROM ({newest_sql('ranks')}) GROUP BY 1)"
Q["risk_count"] = Query(
    lambda spark, d: L.risk_counts(buffer(spark, d), rank_log(spark, d), 100).select("sample_id", "risk"),
    O.query([BUF, RANKS, RISK], "SELECT sample_id, coalesce(risk, 0) AS risk FROM buf LEFT JOIN risk USING (sample_id)"),
)
Q["core_concept"] = Query(
    lambda spark, d: L.core_concept(buffer(spark, d), influence_log(spark, d), 5, 0.1003).select("sample_id"),
    O.query(STATS, "SELECT sample_id FROM full_st WHERE history_len >= 5 AND average >= 0.1003"),
)
Q["declining"] = Query(
    # In whole hundredths, so that equal halves have a trend of exactly zero in both engines.
    lambda spark, d: L.declining(
        buffer(spark, d), influence_log(spark, d).withColumn("score", F.round(F.col("score") * 100)), 6
    ).select("sample_id", "history_len"),
    O.query(
        [cte.replace("avg(score)", "avg(round(score * 100))") for cte in STATS],
        "SELECT sample_id, history_len FROM full_st WHERE history_len >= 6 AND trend < 0",
    ),
)
Q["high_risk"] = Query(
    lambda spark, d: L.high_risk(buffer(spark, d), rank_log(spark, d), 100, 3).select("sample_id", "risk"),
    O.query([BUF, RANKS, RISK], "SELECT sample_id, risk FROM buf JOIN risk USING (sample_id) WHERE risk >= 3"),
)
Q["stable"] = Query(
    lambda spark, d: L.stable(buffer(spark, d), influence_log(spark, d), 0.2003, 3).select("sample_id"),
    O.query(STATS, "SELECT sample_id FROM full_st WHERE history_len >= 3 AND variance <= 0.2003"),
)


def _lifecycle(spark: SparkSession, d: str) -> DataFrame:
    data = L.lifecycle(buffer(spark, d), influence_log(spark, d), rank_log(spark, d))

    def text(column: str, value: str) -> Column:
        return F.concat_ws(",", F.transform(column, lambda e: F.concat_ws(":", e["position"], F.round(e[value] * 100).cast("int"))))

    return data.select(
        "sample_id",
        "label",
        "insertion_position",
        text("influence_history", "score").alias("influence_history"),
        text("rank_history", "rank").alias("rank_history"),
        (F.round("average_influence", 9) + 0.0).alias("average_influence"),
        (F.round("influence_trend", 9) + 0.0).alias("influence_trend"),
    )


Q["lifecycle"] = Query(
    _lifecycle,
    O.query(
        [*STATS, RANKS],
        "SELECT s.sample_id, label, position AS insertion_position, h.t AS influence_history, r.t AS rank_history, "
        "round(average, 9) + 0.0 AS average_influence, round(trend, 9) + 0.0 AS influence_trend FROM full_st s JOIN "
        f"(SELECT sample_id, string_agg(position || ':' || round(score * 100)::INT, ',' ORDER BY position, seq) AS t FROM ({newest_sql('hist')}) GROUP BY 1) h USING (sample_id) JOIN "
        f"(SELECT sample_id, string_agg(position || ':' || (rank * 100), ',' ORDER BY position, seq) AS t FROM ({newest_sql('ranks')}) GROUP BY 1) r USING (sample_id)",
    ),
)

# K. Diagnostics

Q["influence_coverage"] = Query(
    lambda spark, d: D.influence_coverage(buffer(spark, d)),
    O.query([BUF], "SELECT count(influence) AS with_influence, count(*) AS total FROM buf"),
)
Q["registry_diagnostics"] = Query(
    lambda spark, d: D.registry_diagnostics(buffer(spark, d), position_now(buffer(spark, d)))
    .withColumn("mean_influence", F.round("mean_influence", 9))
    .withColumn("mean_age", F.round("mean_age", 6)),
    O.query(
        BASE,
        "SELECT count(*) AS n_samples, count(*) FILTER (NOT label) AS n_benign, count(*) FILTER (label) AS n_attack, "
        "count(influence) AS n_with_influence, count(influence)::DOUBLE / count(*)::DOUBLE AS influence_coverage, "
        "round(avg(age) FILTER (influence IS NOT NULL), 6) AS mean_age, round(avg(influence), 9) AS mean_influence FROM aged",
    ),
)
Q["age_influence_spearman"] = Query(
    lambda spark, d: D.age_influence_spearman(buffer(spark, d), position_now(buffer(spark, d)), Scratch(spark)).select(
        F.round("age_influence_spearman", 8).alias("age_influence_spearman")
    ),
    O.query(
        [*BASE, "rk AS (SELECT row_number() OVER (ORDER BY age, sample_id) AS a, row_number() OVER (ORDER BY influence, sample_id) AS b "
        "FROM aged WHERE influence IS NOT NULL)"],
        "SELECT round(corr(a, b), 8) AS age_influence_spearman FROM rk",
    ),
)

# L. Evaluation

PRED = "pr AS (SELECT event_id AS sample_id, event_id AS position, event_type, user_id, (value > 40 AND hour(ts) BETWEEN 6 AND 17) AS label, value > 30 AS pred FROM events)"
CELLS = (
    "count(*) FILTER (NOT label AND NOT pred) AS tn, count(*) FILTER (NOT label AND pred) AS fp, "
    "count(*) FILTER (label AND NOT pred) AS fn, count(*) FILTER (label AND pred) AS tp"
)
TOTALS = "tn + fp + fn + tp AS total, fn + tp AS actual_positive, tn + fp AS actual_negative"


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return src.table(spark, d, "events").select(
        F.col("event_id").alias("sample_id"),
        F.col("event_id").alias("position"),
        "event_type",
        "user_id",
        ((F.col("value") > 40) & F.hour("ts").between(6, 17)).alias("label"),
        (F.col("value") > 30).alias("pred"),
    )


def sql_rates(source: str, columns: str = "") -> str:
    """All rates over a relation with tn, fp, fn, tp."""
    return f"""SELECT {columns} tn, fp, fn, tp, total, actual_positive, actual_negative,
  round(acc, 9) AS accuracy, round((tpr + tnr) / 2, 9) AS balanced_accuracy, round(tpr, 9) AS tpr, round(tnr, 9) AS tnr,
  round(1 - tnr, 9) AS fpr, round(1 - tpr, 9) AS fnr, round(prec, 9) AS "precision",
  round(CASE WHEN tpr = 0 OR tnr = 0 THEN 0 ELSE sqrt(tpr * tnr) END, 9) AS gmean,
  round(CASE WHEN prec + tpr = 0 THEN 0 ELSE 2 * prec * tpr / (prec + tpr) END, 9) AS f1_score,
  round(CASE WHEN total = 0 THEN 0 WHEN abs(1 - pe) < 1e-10 THEN CASE WHEN abs(acc - 1) < 1e-10 THEN 1 ELSE 0 END ELSE (acc - pe) / (1 - pe) END, 9) AS kappa
FROM (SELECT *, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS tpr,
  CASE WHEN tn + fp = 0 THEN 1.0::DOUBLE ELSE tn::DOUBLE / (tn + fp)::DOUBLE END AS tnr,
  CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS prec,
  CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE (tp + tn)::DOUBLE / total::DOUBLE END AS acc,
  (tp + fp)::DOUBLE / total::DOUBLE * ((tp + fn)::DOUBLE / total::DOUBLE) + (tn + fn)::DOUBLE / total::DOUBLE * ((tn + fp)::DOUBLE / total::DOUBLE) AS pe
  FROM (SELECT *, {TOTALS} FROM ({source})))"""


def rounded(metrics: DataFrame) -> DataFrame:
    return metrics.withColumns({m: F.round(m, 9) for m in E.METRICS})


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Per-user matrices merged per type, minus the matrices of one user range."""
    rows = predicted(spark, d)
    merged = E.merge_confusions(E.confusion(rows, "event_type", "user_id"), "event_type")
    return E.subtract_confusion(merged, E.confusion(rows.where("label"), "event_type"), "event_type")


Q["confusion"] = Query(
    _merged,
    O.query(
        [PRED],
        f"SELECT event_type, tn, fp, 0::BIGINT AS fn, 0::BIGINT AS tp, tn + fp AS total, 0::BIGINT AS actual_positive, "
        f"tn + fp AS actual_negative FROM (SELECT event_type, {CELLS} FROM pr GROUP BY 1)",
    ),
)
Q["rates"] = Query(
    lambda spark, d: rounded(E.cumulative_metrics(predicted(spark, d), "user_id")).drop("kappa"),
    O.query(
        [PRED],
        f'SELECT * EXCLUDE (kappa) FROM ({sql_rates(f"SELECT user_id, {CELLS} FROM pr GROUP BY 1", "user_id,")})',
    ),
)
Q["kappa"] = Query(
    lambda spark, d: rounded(E.cumulative_metrics(predicted(spark, d), "user_id")).select("user_id", "kappa"),
    O.query([PRED], f'SELECT user_id, kappa FROM ({sql_rates(f"SELECT user_id, {CELLS} FROM pr GROUP BY 1", "user_id,")})'),
)
WINDOW = 1000
FRAME = f"OVER (ORDER BY position ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)"
SLIDING = (
    f"SELECT position, sum((NOT label AND NOT pred)::INT) {FRAME}::BIGINT AS tn, sum((NOT label AND pred)::INT) {FRAME}::BIGINT AS fp, "
    f"sum((label AND NOT pred)::INT) {FRAME}::BIGINT AS fn, sum((label AND pred)::INT) {FRAME}::BIGINT AS tp FROM pr"
)
SLIDING = SLIDING.replace(f"{FRAME}::BIGINT", f"{FRAME}")
Q["sliding_metrics"] = Query(
    lambda spark, d: rounded(E.sliding_metrics(predicted(spark, d), WINDOW, Scratch(spark))).drop(
        "sample_id", "event_type", "user_id", "label", "pred"
    ),
    O.query(
        [
            PRED,
            f"sl AS (SELECT position, tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp FROM ({SLIDING}))",
        ],
        sql_rates("SELECT * FROM sl", "position,"),
    ),
)
Q["cumulative_metrics"] = Query(
    lambda spark, d: rounded(E.cumulative_metrics(predicted(spark, d))),
    O.query([PRED], sql_rates(f"SELECT {CELLS} FROM pr")),
)
Q["metrics_from_predictions"] = Query(
    lambda spark, d: rounded(
        E.cumulative_metrics(scoring.predict(model("line", spark, d), samples("line", spark, d)))
    ),
    O.query(
        [*vote_ctes("line"), "pr AS (SELECT sample_id, label, sum(vote::INT) * 2 > 8 AS pred FROM q_votes GROUP BY 1, 2)"],
        sql_rates(f"SELECT {CELLS} FROM pr"),
    ),
)
Q["current_metrics"] = Query(
    lambda spark, d: rounded(E.current_metrics(predicted(spark, d), WINDOW)),
    O.query(
        [PRED],
        sql_rates(f"SELECT {CELLS} FROM (SELECT * FROM pr ORDER BY position DESC LIMIT {WINDOW})"),
    ),
)

# The frozen-model arm: refit from what the first-in-first-out buffer holds.


def _sliding_rebuild(spark: SparkSession, d: str) -> DataFrame:
    rows = buffer(spark, d)
    scratch = Scratch(spark)
    kept = B.fifo_evict(rows, budget(rows).budget_max_samples, scratch).kept
    held = samples("event", spark, d).join(kept.select("sample_id"), "sample_id", "left_semi")
    return node_columns(growth.fit(held, EVENT, scratch).nodes)


Q["sliding_rebuild"] = Query(
    _sliding_rebuild,
    O.query(
        [
            T.EVENT,
            "live AS (SELECT * FROM event QUALIFY row_number() OVER (ORDER BY position DESC) <= (SELECT count(*) * 6 // 10 FROM event))",
            *O.fit(EVENT, "live", "m_"),
        ],
        NODE_SQL.format(p="m_"),
    ),
)
assert LINE.k == 3 and LINE.num_trees == 8  # the SQL tallies above count 3 in-bag and 5 other trees
