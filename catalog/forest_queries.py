"""Samples, assignment, training, scoring, forgetting and adding (groups A to F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewood.functions.impurity import gini, weighted_child_gini
from lethewood.operators import assignment as A
from lethewood.operators import model as M
from lethewood.operators import routing, scoring
from lethewood.operators import samples as P
from lethewood.operators import splits as S
from lethewood.plans import growth, maintenance
from lethewood.sources import samples as src
from lethewood.sources.scratch import Scratch
from oracle import forest_sql as O
from oracle import tables as T

from .common import (
    EVENT,
    FORGET_SQL,
    LINE,
    NODE_SQL,
    Query,
    SOURCES,
    assigned,
    fit_ctes,
    forget_ctes,
    forgotten,
    forgotten_model,
    joined_array,
    model,
    node_columns,
    pending_model,
    samples,
    vote_ctes,
)

KEYS = ["tree_id", "node_id"]
Q: dict[str, Query] = {}


# A. Samples


def _samples(spark: SparkSession, d: str) -> DataFrame:
    rows = samples("line", spark, d)
    return rows.select("sample_id", "label", *[F.col("features")[i].alias(f"f{i}") for i in range(4)])


Q["samples"] = Query(
    _samples,
    O.query([T.LINE], "SELECT sample_id, label, f[1] AS f0, f[2] AS f1, f[3] AS f2, f[4] AS f3 FROM line"),
)
Q["samples_documents"] = Query(
    lambda spark, d: samples("doc", spark, d).select(
        "sample_id", "label", *[F.round(F.col("features")[i], 9).alias(f"f{i}") for i in range(4)]
    ),
    O.query(
        [T.DOC],
        "SELECT sample_id, label, round(f[1], 9) AS f0, round(f[2], 9) AS f1, round(f[3], 9) AS f2, "
        "round(f[4], 9) AS f3 FROM doc",
    ),
)
Q["sample_positions"] = Query(
    lambda spark, d: src.assign_positions(
        samples("line", spark, d), [F.col("sample_id")], Scratch(spark)
    ).select("sample_id", "position"),
    O.query([T.LINE], "SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS position FROM line"),
)


def _replaced(spark: SparkSession, d: str) -> DataFrame:
    old = samples("event", spark, d)
    new = samples("doc", spark, d)
    last = old.agg(F.max("position") + 1).scalar()
    moved = new.withColumn("position", new["position"] + last)
    return src.keep_latest(old, moved).select("sample_id", "position", "label")


Q["sample_replace"] = Query(
    _replaced,
    O.query(
        [T.EVENT, T.DOC],
        "SELECT sample_id, position, label FROM event WHERE sample_id NOT IN (SELECT sample_id FROM doc) "
        "UNION ALL SELECT sample_id, position + (SELECT max(position) + 1 FROM event), label FROM doc",
    ),
)
Q["sample_lookup"] = Query(
    lambda spark, d: P.membership(
        samples("event", spark, d).select("sample_id"),
        src.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id")),
    ),
    O.query(
        [T.EVENT],
        "SELECT DISTINCT l_orderkey AS sample_id, l_orderkey IN (SELECT sample_id FROM event) AS present FROM lineitem",
    ),
)
Q["sample_remove"] = Query(
    lambda spark, d: P.remove(samples("event", spark, d), forgotten("event", spark, d)).agg(
        F.count(F.lit(1)).alias("remaining"), F.sum("sample_id").alias("id_sum")
    ),
    O.query(
        [T.EVENT, FORGET_SQL["event"]],
        "SELECT count(*) AS remaining, sum(sample_id)::BIGINT AS id_sum FROM event "
        "WHERE sample_id NOT IN (SELECT sample_id FROM forgotten)",
    ),
)
Q["dataset_profile"] = Query(
    lambda spark, d: P.attribute_ranges(P.profile(samples("line", spark, d), 4)),
    O.query(
        [T.LINE],
        "SELECT a::INTEGER AS attr, min(f[a + 1]) AS lo, max(f[a + 1]) AS hi, count(*) AS num_records, "
        "sum(label::INT)::BIGINT AS num_plus, sum((NOT label)::INT)::BIGINT AS num_minus "
        "FROM line, range(4) r(a) GROUP BY a",
    ),
)


def _feature_spec(spark: SparkSession, d: str) -> DataFrame:
    spec = P.feature_spec(spark, ["value", "hour", "weekday", "k"], EVENT.categorical_attrs)
    ranges = P.attribute_ranges(P.profile(samples("event", spark, d), 4))
    return spec.join(F.broadcast(ranges), "attr").select("attr", "name", "kind", "lo", "hi")


Q["feature_spec"] = Query(
    _feature_spec,
    O.query(
        [T.EVENT],
        "SELECT s.attr, s.name, s.kind, min(f[s.attr + 1]) AS lo, max(f[s.attr + 1]) AS hi FROM event, "
        "(VALUES (0, 'value', 'numerical'), (1, 'hour', 'categorical'), (2, 'weekday', 'categorical'), "
        "(3, 'k', 'numerical')) s(attr, name, kind) GROUP BY 1, 2, 3",
    ),
)

# B. Assignment

Q["occ_assign"] = Query(
    lambda spark, d: A.assignment(assigned("line", spark, d)),
    O.query([T.LINE, O.assignment(LINE, "line", "asg")], "SELECT sample_id, tree_id FROM asg"),
)
MINORITY = EVENT.with_(minority_k=6)
Q["occ_assign_minority"] = Query(
    lambda spark, d: A.assignment(A.assign_trees(samples("event", spark, d), MINORITY)),
    O.query([T.EVENT, O.assignment(MINORITY, "event", "asg")], "SELECT sample_id, tree_id FROM asg"),
)
Q["occ_assign_per_sample_k"] = Query(
    lambda spark, d: A.assignment(
        A.assign_trees(samples("event", spark, d), EVENT, (F.col("sample_id") % 11).cast("int"))
    ),
    O.query([T.EVENT, O.assignment(EVENT, "event", "asg", "sample_id % 11")], "SELECT sample_id, tree_id FROM asg"),
)
_TREES = (
    "SELECT sample_id, array_to_string(list(tree_id ORDER BY tree_id), ',') AS tree_ids FROM asg GROUP BY 1"
)
Q["tree_indices"] = Query(
    lambda spark, d: A.tree_indices(A.assignment(assigned("event", spark, d))).select(
        "sample_id", joined_array("tree_ids").alias("tree_ids")
    ),
    O.query([T.EVENT, O.assignment(EVENT, "event", "asg")], _TREES),
)
Q["tree_indices_unknown"] = Query(
    lambda spark, d: A.tree_indices_of(
        src.table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id")),
        assigned("event", spark, d),
    ).select("sample_id", joined_array("tree_ids").alias("tree_ids")),
    O.query(
        [T.EVENT, O.assignment(EVENT, "event", "asg"), f"t AS ({_TREES})"],
        "SELECT o_orderkey AS sample_id, coalesce(tree_ids, '') AS tree_ids "
        "FROM orders LEFT JOIN t ON o_orderkey = sample_id",
    ),
)
Q["oob_trees"] = Query(
    lambda spark, d: A.oob_trees(assigned("event", spark, d), EVENT.num_trees).select(
        "sample_id", joined_array("oob_tree_ids").alias("oob_tree_ids")
    ),
    O.query(
        [T.EVENT, O.assignment(EVENT, "event", "asg")],
        "SELECT sample_id, array_to_string(list(t::INTEGER ORDER BY t), ',') AS oob_tree_ids "
        "FROM event, range(8) r(t) WHERE NOT EXISTS (SELECT 1 FROM asg WHERE asg.sample_id = event.sample_id AND tree_id = t) "
        "GROUP BY 1",
    ),
)
Q["forest_membership"] = Query(
    lambda spark, d: A.membership_summary(assigned("line", spark, d), LINE),
    O.query(
        [T.LINE, O.assignment(LINE, "line", "asg")],
        "SELECT count(DISTINCT sample_id) AS num_samples, count(*) AS num_assignments, "
        "8 AS num_trees, 3 AS k FROM asg",
    ),
)
Q["tree_sizes"] = Query(
    lambda spark, d: A.tree_sizes(assigned("line", spark, d)),
    O.query([T.LINE, O.assignment(LINE, "line", "asg")], "SELECT tree_id, count(*) AS num_samples FROM asg GROUP BY 1"),
)

# C. Training


def _root(spark: SparkSession, d: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows and open nodes of the first level. The samples are written once, as both read them."""
    held = assigned(name, spark, d).select("sample_id", "features", "label", "tree_ids")
    rows = growth.rows_at_roots(Scratch(spark).write(held, "samples"))
    config = SOURCES[name][0]
    frontier = growth.root_frontier(rows)
    return rows, frontier.where(~S.stop_rule(config))


def _root_ranges(spark: SparkSession, d: str, name: str) -> DataFrame:
    config = SOURCES[name][0]
    rows, open_nodes = _root(spark, d, name)
    return S.node_ranges(
        rows, S.with_attrs(open_nodes, config), growth.open_bytes(config.num_trees, config), config
    )


def _root_cuts(spark: SparkSession, d: str, name: str) -> DataFrame:
    config = SOURCES[name][0]
    cuts = S.with_cut_columns(_root_ranges(spark, d, name), config)
    long = ", ".join(f"struct({j} AS draw, t{j} AS threshold, s{j} AS subset)" for j in S.draws(config))
    return cuts.selectExpr(*KEYS, "attr", f"inline(array({long}))")


Q["node_features"] = Query(
    lambda spark, d: S.with_attrs(model("vec", spark, d).nodes.where("kind = 'internal'"), SOURCES["vec"][0]).select(
        *KEYS, F.explode("attrs").alias("attr")
    ),
    O.query(
        fit_ctes("vec"),
        "SELECT a.tree_id, a.node_id, a.attr FROM ("
        + " UNION ALL ".join(f"SELECT * FROM m_at{i}" for i in range(4))
        + ") a JOIN m_nodes n USING (tree_id, node_id) WHERE kind = 'internal'",
    ),
)
Q["node_ranges"] = Query(
    lambda spark, d: _root_ranges(spark, d, "line"),
    O.query(fit_ctes("line"), "SELECT tree_id, node_id, attr, lo, hi FROM m_rg0"),
)
Q["numeric_candidates"] = Query(
    lambda spark, d: _root_cuts(spark, d, "line").where("threshold IS NOT NULL").drop("subset"),
    O.query(fit_ctes("line"), "SELECT tree_id, node_id, attr, draw, threshold FROM m_cu0"),
)
Q["categorical_candidates"] = Query(
    lambda spark, d: _root_cuts(spark, d, "event").where("subset IS NOT NULL").drop("threshold"),
    O.query(fit_ctes("event"), "SELECT tree_id, node_id, attr, draw, subset FROM m_cu0 WHERE subset IS NOT NULL"),
)
_CAND = "tree_id, node_id, attr, draw, lo, hi, lo_n, hi_n, threshold, subset, n_left, n_left_pos"


def _candidates(forest: growth.Forest) -> DataFrame:
    return S.candidate_rows(forest.candidates).selectExpr(*_CAND.split(", "))


Q["split_counts"] = Query(
    lambda spark, d: _candidates(model("line", spark, d)),
    O.query(fit_ctes("line"), f"SELECT {_CAND} FROM m_cands"),
)
Q["gini"] = Query(
    lambda spark, d: model("line", spark, d).nodes.selectExpr(*KEYS, f"{gini('n_pos', 'n')} AS gini"),
    O.query(fit_ctes("line"), f"SELECT tree_id, node_id, {O.gini('n_pos', 'n')} AS gini FROM m_nodes"),
)
Q["gini_gain"] = Query(
    lambda spark, d: S.scored_candidates(
        model("event", spark, d).nodes, model("event", spark, d).candidates
    ).select(*KEYS, "attr", "draw", "score"),
    O.query(fit_ctes("event"), "SELECT tree_id, node_id, attr, draw, score FROM m_cands"),
)
Q["best_split"] = Query(
    lambda spark, d: S.best_splits(
        model("event", spark, d).nodes, model("event", spark, d).candidates
    ).select(*KEYS, "attr", "draw", "threshold", "subset", "score"),
    O.query(
        fit_ctes("event"),
        "SELECT tree_id, node_id, attr, draw, threshold, subset, score FROM m_nodes WHERE kind = 'internal'",
    ),
)
Q["stop_rule"] = Query(
    lambda spark, d: model("event", spark, d).nodes.select(*KEYS, S.stop_rule(EVENT).alias("stopped")),
    O.query(
        fit_ctes("event"),
        "SELECT tree_id, node_id, (depth >= 4 OR n < 2 OR n_pos = 0 OR n_pos = n) AS stopped FROM m_nodes",
    ),
)
VETO = EVENT.with_(min_samples_leaf=120)


def _veto(spark: SparkSession, d: str) -> DataFrame:
    return node_columns(growth.fit(samples("event", spark, d), VETO, Scratch(spark)).nodes)


Q["min_leaf_veto"] = Query(
    _veto, O.query([T.EVENT, *O.fit(VETO, "event", "m_")], NODE_SQL.format(p="m_"))
)
Q["route"] = Query(
    lambda spark, d: routing.walk(
        growth.rows_at_roots(model("event", spark, d).samples),
        model("event", spark, d).nodes,
        {0: 8},
        EVENT,
    ).select("tree_id", "sample_id", "node_id"),
    O.query(
        fit_ctes("event"),
        "SELECT tree_id, sample_id, node_id FROM m_r1 UNION ALL SELECT tree_id, sample_id, node_id "
        "FROM m_r0 JOIN (SELECT tree_id, node_id FROM m_nd0 WHERE kind = 'leaf') USING (tree_id, node_id)",
    ),
)
for _name in ("line", "event", "doc", "vec"):
    Q["forest_fit" if _name == "line" else f"forest_fit_{_name}"] = Query(
        lambda spark, d, name=_name: node_columns(model(name, spark, d).nodes),
        O.query(fit_ctes(_name), NODE_SQL.format(p="m_")),
    )
Q["leaf_map"] = Query(
    lambda spark, d: scoring.leaf_map(model("event", spark, d)),
    O.query(fit_ctes("event"), "SELECT tree_id, sample_id, node_id FROM m_leaf"),
)
Q["leaf_members"] = Query(
    lambda spark, d: scoring.leaf_members(model("line", spark, d)),
    O.query(fit_ctes("line"), "SELECT tree_id, node_id, n, n_pos FROM m_nodes WHERE kind = 'leaf'"),
)
Q["tree_stats"] = Query(
    lambda spark, d: M.tree_stats(
        model("event", spark, d).nodes, spark.range(EVENT.num_trees).select(F.col("id").cast("int").alias("tree_id"))
    ),
    O.query(
        fit_ctes("event"),
        "SELECT count(*) AS num_trees, min(depth) AS min_depth, max(depth) AS max_depth, avg(depth) AS avg_depth, "
        "sum(num_nodes)::BIGINT AS total_nodes, avg(num_nodes) AS avg_nodes FROM (SELECT t, coalesce(max(depth), 0) AS depth, "
        "count(depth) AS num_nodes FROM range(8) r(t) LEFT JOIN m_nodes ON tree_id = t GROUP BY t)",
    ),
)
Q["node_counts"] = Query(
    lambda spark, d: M.node_counts(model("event", spark, d).nodes),
    O.query(
        fit_ctes("event"),
        "SELECT tree_id, kind, 'clean' AS tag, count(*) AS num_nodes, sum(n)::BIGINT AS n, sum(n_pos)::BIGINT AS n_pos "
        "FROM m_nodes GROUP BY 1, 2",
    ),
)
Q["splittable_leaves"] = Query(
    lambda spark, d: M.splittable_leaves(model("event", spark, d).nodes, EVENT),
    O.query(
        fit_ctes("event"),
        "SELECT tree_id, node_id, depth, n, n_pos FROM m_nodes WHERE kind = 'leaf' AND n >= 2 AND n_pos > 0 AND n_pos < n",
    ),
)

# D. Scoring

Q["tree_votes"] = Query(
    lambda spark, d: scoring.tree_votes(model("event", spark, d), samples("event", spark, d)),
    O.query(vote_ctes("event"), "SELECT sample_id, tree_id, label, vote FROM q_votes"),
)
_PREDICT = (
    "SELECT sample_id, sum(vote::INT) * 2 > 8 AS pred, sum(vote::INT)::DOUBLE / 8.0::DOUBLE AS proba "
    "FROM q_votes GROUP BY 1"
)
Q["predict"] = Query(
    lambda spark, d: scoring.predict(model("line", spark, d), samples("line", spark, d)).select("sample_id", "pred"),
    O.query(vote_ctes("line"), f"SELECT sample_id, pred FROM ({_PREDICT})"),
)
Q["predict_proba"] = Query(
    lambda spark, d: scoring.predict(model("event", spark, d), samples("event", spark, d)).select("sample_id", "proba"),
    O.query(vote_ctes("event"), f"SELECT sample_id, proba FROM ({_PREDICT})"),
)
Q["predict_subset"] = Query(
    lambda spark, d: scoring.predict_subset(model("event", spark, d), samples("event", spark, d), [0, 2, 5, 7, 11]),
    O.query(
        vote_ctes("event"),
        "SELECT sample_id, sum(vote::INT) FILTER (tree_id IN (0, 2, 5, 7, 11)) * 2 > 5 AS pred, "
        "(sum(vote::INT) FILTER (tree_id IN (0, 2, 5, 7, 11)))::DOUBLE / 5.0::DOUBLE AS proba FROM q_votes GROUP BY 1",
    ),
)


def _lazy(spark: SparkSession, d: str) -> DataFrame:
    """Score the forgotten users' events after settling only what those events meet."""
    pending = pending_model("event", spark, d)
    queries = samples("event", spark, d).join(forgotten("event", spark, d), "sample_id", "left_semi")
    settled = maintenance.resolve(pending, scoring.query_path(pending, queries))
    return scoring.predict(settled, queries)


_LAZY_CTES = [
    *forget_ctes("event"),
    "asked AS (SELECT * FROM event WHERE sample_id IN (SELECT sample_id FROM forgotten))",
    *O.walk(EVENT, "asked", "m_", "q_"),
]
Q["predict_lazy"] = Query(
    lambda spark, d: _lazy(spark, d).select("sample_id", "pred"),
    O.query(_LAZY_CTES, f"SELECT sample_id, pred FROM ({_PREDICT})"),
)
Q["predict_proba_lazy"] = Query(
    lambda spark, d: _lazy(spark, d).select("sample_id", "proba"),
    O.query(_LAZY_CTES, f"SELECT sample_id, proba FROM ({_PREDICT})"),
)

# E. Forgetting


def _forget_one(spark: SparkSession, d: str) -> DataFrame:
    """Forget the event with the largest value."""
    top = samples("event", spark, d).orderBy(F.col("features")[0].desc(), "sample_id").limit(1)
    updated = maintenance.forget(model("event", spark, d), top.select("sample_id"))
    return node_columns(maintenance.resolve(updated.forest).nodes)


Q["forget_one"] = Query(
    _forget_one,
    O.query(
        [
            T.EVENT,
            "live AS (SELECT * FROM event WHERE sample_id <> (SELECT sample_id FROM event ORDER BY f[1] DESC, sample_id LIMIT 1))",
            *O.fit(EVENT, "live", "m_"),
        ],
        NODE_SQL.format(p="m_"),
    ),
)
Q["forget_batch"] = Query(
    lambda spark, d: node_columns(forgotten_model("event", spark, d).nodes),
    O.query(forget_ctes("event"), NODE_SQL.format(p="m_")),
)
Q["forget_batch_line"] = Query(
    lambda spark, d: node_columns(forgotten_model("line", spark, d).nodes),
    O.query(forget_ctes("line"), NODE_SQL.format(p="m_")),
)


def _delta(spark: SparkSession, d: str, name: str = "event") -> tuple[growth.Forest, DataFrame]:
    forest = model(name, spark, d)
    removed = forest.samples.join(forgotten(name, spark, d), "sample_id", "left_semi")
    return forest, maintenance.delta_at_leaves(forest, maintenance.delta_rows(removed, -1))


_ANCESTORS = (
    "path AS MATERIALIZED (SELECT l.tree_id, l.sample_id, (l.node_id >> u)::BIGINT AS node_id, s.label, s.f FROM m_leaf l "
    "JOIN forgotten USING (sample_id) JOIN event s USING (sample_id), range(6) r(u) WHERE (l.node_id >> u) > 0)"
)
_OLD = [*fit_ctes("event"), FORGET_SQL["event"], _ANCESTORS]
Q["forget_path_counts"] = Query(
    lambda spark, d: maintenance.path_deltas(_delta(spark, d)[1]),
    O.query(
        _OLD,
        "SELECT tree_id, node_id, (-count(*))::BIGINT AS dn, (-sum(label::INT))::BIGINT AS dn_pos FROM path GROUP BY 1, 2",
    ),
)


def _decremented(spark: SparkSession, d: str) -> DataFrame:
    forest, at_leaves = _delta(spark, d)
    return maintenance.updated_candidates(
        forest.candidates, maintenance.candidate_deltas(forest, at_leaves), forest
    )


_LEFT = O.left("f[attr + 1]", EVENT)
_LEFT_PATH = _LEFT.replace("threshold", "c.threshold").replace("subset", "c.subset").replace("base", "c.base")
# What goes, per node, attribute and value; a candidate meets a handful of values of its own node.
_GONE_VALUES = (
    "gone_values AS MATERIALIZED (SELECT tree_id, node_id, attr::INTEGER AS attr, f[attr + 1] AS value, count(*) AS c, "
    "sum(label::INT)::BIGINT AS cp FROM path, range(4) a(attr) GROUP BY 1, 2, 3, 4)"
)
_VALUE_LEFT = O.left("value", EVENT)
_DECREMENTED = (
    "dec AS MATERIALIZED (SELECT c.tree_id, c.node_id, c.attr, c.draw, "
    f"coalesce(sum(g.c) FILTER ({_VALUE_LEFT}), 0)::BIGINT AS gone, "
    f"coalesce(sum(g.cp) FILTER ({_VALUE_LEFT}), 0)::BIGINT AS gone_pos, "
    "coalesce(sum(g.c) FILTER (value = c.lo), 0)::BIGINT AS gone_lo, coalesce(sum(g.c) FILTER (value = c.hi), 0)::BIGINT AS gone_hi "
    "FROM m_cands c LEFT JOIN gone_values g USING (tree_id, node_id, attr) GROUP BY 1, 2, 3, 4)"
)
Q["candidate_decrement"] = Query(
    lambda spark, d: _decremented(spark, d).selectExpr(*KEYS, "attr", "posexplode(cuts) AS (draw, cut)", "lo_n", "hi_n", "invalid")
    .selectExpr(*KEYS, "attr", "draw", "cut.n_left AS n_left", "cut.n_left_pos AS n_left_pos", "lo_n", "hi_n", "invalid"),
    O.query(
        [*_OLD, _GONE_VALUES, _DECREMENTED],
        "SELECT tree_id, node_id, attr, draw, n_left - gone AS n_left, n_left_pos - gone_pos AS n_left_pos, "
        "lo_n - gone_lo AS lo_n, hi_n - gone_hi AS hi_n, (gone_lo + gone_hi > 0 AND (lo_n = gone_lo OR hi_n = gone_hi)) AS invalid "
        "FROM m_cands JOIN dec USING (tree_id, node_id, attr, draw)",
    ),
)


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """Per touched internal node: does the best remaining cut differ from its split?"""
    forest, at_leaves = _delta(spark, d)
    nodes = maintenance.updated_nodes(forest.nodes, maintenance.path_deltas(at_leaves))
    candidates = _decremented(spark, d)
    best = S.best_splits(nodes, candidates).select(*KEYS, F.col("attr").alias("b_attr"), F.col("draw").alias("b_draw"))
    old = S.best_splits(forest.nodes, forest.candidates).select(*KEYS, "attr", "draw")
    same = "attr <=> b_attr AND draw <=> b_draw"
    return (
        nodes.where("touched AND kind = 'internal'").select(*KEYS).join(old, KEYS).join(best, KEYS, "left")
        .selectExpr(*KEYS, f"NOT ({same}) AS changed")
    )


_RESCORED = (
    "resc AS (SELECT c.tree_id, c.node_id, c.attr, c.draw, c.n - g.dn AS n, c.n_pos - g.dp AS n_pos, "
    "n_left - gone AS n_left, n_left_pos - gone_pos AS n_left_pos FROM m_cands c JOIN dec USING (tree_id, node_id, attr, draw) "
    "JOIN (SELECT tree_id, node_id, count(*) AS dn, sum(label::INT)::BIGINT AS dp FROM path GROUP BY 1, 2) g USING (tree_id, node_id))"
)
Q["split_changed"] = Query(
    _changed,
    O.query(
        [
            *_OLD,
            _GONE_VALUES,
            _DECREMENTED,
            _RESCORED,
            f"best AS (SELECT * FROM (SELECT *, {O.score('n', 'n_pos', 'n_left', 'n_left_pos')} AS s FROM resc) WHERE s > 0 "
            "QUALIFY row_number() OVER (PARTITION BY tree_id, node_id ORDER BY s DESC, attr, draw) = 1)",
        ],
        "SELECT m.tree_id, m.node_id, (b.attr IS DISTINCT FROM m.attr OR b.draw IS DISTINCT FROM m.draw) AS changed "
        "FROM m_nodes m LEFT JOIN best b USING (tree_id, node_id) "
        "WHERE m.kind = 'internal' AND (m.tree_id, m.node_id) IN (SELECT tree_id, node_id FROM path)",
    ),
)
Q["candidate_quality"] = Query(
    lambda spark, d: S.candidate_rows(model("line", spark, d).candidates)
    .join(model("line", spark, d).nodes.select(*KEYS, "n", "n_pos"), KEYS)
    .selectExpr(*KEYS, "attr", "draw", f"{weighted_child_gini('n', 'n_pos', 'n_left', 'n_left_pos')} AS quality"),
    O.query(
        fit_ctes("line"),
        "SELECT tree_id, node_id, attr, draw, CASE WHEN n_left > 0 AND n_left < n THEN "
        f"{O.children_gini('n', 'n_pos', 'n_left', 'n_left_pos')} ELSE 1.7976931348623157e308::DOUBLE END AS quality FROM m_cands",
    ),
)


# Which nodes an update makes stale, worked out from the counts that are left: ``raw`` before nodes
# under a rebuild are passed over, ``tagged`` after.
_STAY = f"(g.n < {EVENT.min_samples_split} OR g.n_pos = 0 OR g.n_pos = g.n OR g.depth >= {EVENT.max_depth})"
_TAGS = [
    *_OLD,
    _GONE_VALUES,
    _DECREMENTED,
    _RESCORED,
    "left_over AS (SELECT m.tree_id, m.node_id, m.depth, m.kind, m.attr, m.threshold, m.subset, m.n - dn AS n, m.n_pos - dp AS n_pos "
    "FROM m_nodes m JOIN (SELECT tree_id, node_id, count(*) AS dn, sum(label::INT)::BIGINT AS dp FROM path GROUP BY 1, 2) USING (tree_id, node_id))",
    "moved AS (SELECT tree_id, node_id, bool_or(gone_lo > 0 AND lo_n = gone_lo OR gone_hi > 0 AND hi_n = gone_hi) AS moved "
    "FROM m_cands JOIN dec USING (tree_id, node_id, attr, draw) GROUP BY 1, 2)",
    f"chosen AS (SELECT r.tree_id, r.node_id, c.attr, c.threshold, c.subset FROM (SELECT *, {O.score('n', 'n_pos', 'n_left', 'n_left_pos')} AS s FROM resc) r "
    "JOIN m_cands c USING (tree_id, node_id, attr, draw) WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY r.tree_id, r.node_id ORDER BY s DESC, c.attr, c.draw) = 1)",
    f"raw AS (SELECT g.tree_id, g.node_id, CASE WHEN {_STAY} THEN CASE WHEN g.kind = 'internal' THEN 'rebuild' ELSE 'clean' END "
    "WHEN coalesce(moved, false) THEN 'dirty' WHEN c.attr IS NOT DISTINCT FROM g.attr AND c.threshold IS NOT DISTINCT FROM g.threshold "
    "AND c.subset IS NOT DISTINCT FROM g.subset THEN 'clean' ELSE 'rebuild' END AS tag "
    "FROM left_over g LEFT JOIN moved USING (tree_id, node_id) LEFT JOIN chosen c USING (tree_id, node_id))",
    "shadowed AS (SELECT DISTINCT r.tree_id, r.node_id FROM raw r, range(1, 6) up(u) "
    "WHERE (r.tree_id, r.node_id >> u) IN (SELECT tree_id, node_id FROM raw WHERE tag = 'rebuild'))",
    "tagged AS (SELECT tree_id, node_id, tag FROM raw WHERE (tree_id, node_id) NOT IN (SELECT tree_id, node_id FROM shadowed))",
]
Q["mark_pending"] = Query(
    lambda spark, d: pending_model("event", spark, d).nodes.select(*KEYS, "n", "tag"),
    O.query(
        _TAGS,
        "SELECT m.tree_id, m.node_id, coalesce(g.n, m.n) AS n, coalesce(t.tag, 'clean') AS tag FROM m_nodes m "
        "LEFT JOIN left_over g USING (tree_id, node_id) LEFT JOIN tagged t USING (tree_id, node_id)",
    ),
)


def _on_path(spark: SparkSession, d: str) -> DataFrame:
    """After settling the query path: pending nodes left on it, and what settling again changes."""
    pending = pending_model("event", spark, d)
    queries = samples("event", spark, d).join(forgotten("event", spark, d), "sample_id", "left_semi")
    once = maintenance.resolve(pending, scoring.query_path(pending, queries))
    path = scoring.query_path(once, queries)
    twice = maintenance.resolve(once, path)
    left = once.nodes.where("tag <> 'clean'").join(path, KEYS, "left_semi").count()
    return M.node_difference(once.nodes, twice.nodes).agg(
        F.lit(left).cast("bigint").alias("pending_on_path"), F.count(F.lit(1)).alias("changed_again")
    )


Q["resolve_on_path"] = Query(_on_path, "SELECT 0::BIGINT AS pending_on_path, 0::BIGINT AS changed_again")
Q["rebuild_subtree"] = Query(
    lambda spark, d: _candidates(forgotten_model("event", spark, d)),
    O.query(forget_ctes("event"), f"SELECT {_CAND} FROM m_cands"),
)


Q["rebuild_marks"] = Query(
    lambda spark, d: maintenance.forget(model("event", spark, d), forgotten("event", spark, d)).marks,
    O.query(
        _TAGS,
        "SELECT 0::BIGINT AS add_marks, count(DISTINCT (tree_id, sample_id)) AS forget_marks FROM path "
        "WHERE (tree_id, node_id) IN (SELECT tree_id, node_id FROM raw WHERE tag <> 'clean')",
    ),
)


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    """The stored leaf map after forgetting half on a path, settling, and adding some back."""
    forest = maintenance.with_leaves(model("event", spark, d))
    gone = forgotten("event", spark, d)
    forest = maintenance.forget(forest, gone).forest
    probe = samples("event", spark, d).join(gone, "sample_id", "left_semi")
    forest = maintenance.resolve(forest, scoring.query_path(forest, probe))
    back = probe.where("sample_id % 2 = 0").drop("position")
    return scoring.leaf_map(maintenance.resolve(maintenance.add(forest, back).forest))


_PARTLY = (
    "live AS (SELECT * FROM event WHERE sample_id % 2 = 0 OR sample_id NOT IN (SELECT sample_id FROM forgotten))"
)
Q["leaf_map_kept"] = Query(
    _mapped,
    O.query(
        [SOURCES["event"][2], FORGET_SQL["event"], _PARTLY, *O.fit(EVENT, "live", "m_")],
        "SELECT tree_id, sample_id, node_id FROM m_leaf",
    ),
)


def retrain_equivalence(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Nodes and leaf assignments that differ between forgetting and retraining: none."""
    config = SOURCES[name][0]
    kept = P.remove(samples(name, spark, d), forgotten(name, spark, d))
    retrained = growth.fit(kept, config, Scratch(spark))
    updated = forgotten_model(name, spark, d)
    leaves = scoring.leaf_map(updated).exceptAll(scoring.leaf_map(retrained)).count()
    return M.node_difference(updated.nodes, retrained.nodes).agg(
        F.count(F.lit(1)).alias("node_differences"), F.lit(leaves).cast("bigint").alias("leaf_differences")
    )


Q["retrain_equivalence"] = Query(
    lambda spark, d: retrain_equivalence(spark, d, "event"),
    "SELECT 0::BIGINT AS node_differences, 0::BIGINT AS leaf_differences",
)

# F. Adding


def _readd(spark: SparkSession, d: str) -> DataFrame:
    """Forget, then add the same samples again: the first model must come back."""
    back = maintenance.add(forgotten_model("event", spark, d), samples("event", spark, d).drop("position"))
    return node_columns(maintenance.resolve(back.forest).nodes)


Q["add_samples"] = Query(_readd, O.query(fit_ctes("event"), NODE_SQL.format(p="m_")))


def _grow_from_nothing(spark: SparkSession, d: str) -> DataFrame:
    """A model started empty and fed by additions equals one trained at once."""
    start = growth.empty_forest(spark, SOURCES["doc"][0])
    fed = maintenance.add(start, samples("doc", spark, d).drop("position"))
    return node_columns(maintenance.resolve(fed.forest).nodes)


Q["add_samples_from_empty"] = Query(_grow_from_nothing, O.query(fit_ctes("doc"), NODE_SQL.format(p="m_")))


def _frozen(spark: SparkSession, d: str) -> DataFrame:
    back = maintenance.add(
        forgotten_model("event", spark, d), samples("event", spark, d).drop("position"), review=False
    )
    return back.forest.nodes.select(*KEYS, "kind", "n", "n_pos")


Q["add_frozen"] = Query(
    _frozen,
    O.query(
        [
            *forget_ctes("event"),
            *O.walk(EVENT, "event", "m_", "q_"),
            O.assignment(EVENT, "event", "every"),
            "got AS (SELECT tree_id, node_id, label FROM q_votes JOIN every USING (sample_id, tree_id))",
            "path AS (SELECT tree_id, (node_id >> u)::BIGINT AS node_id, label FROM got, range(6) r(u) WHERE (node_id >> u) > 0)",
        ],
        "SELECT tree_id, node_id, kind, c.n, c.n_pos FROM (SELECT tree_id, node_id, count(*) AS n, "
        "sum(label::INT)::BIGINT AS n_pos FROM path GROUP BY 1, 2) c JOIN (SELECT tree_id, node_id, kind FROM m_nodes) "
        "USING (tree_id, node_id)",
    ),
)


def _incremented(spark: SparkSession, d: str) -> DataFrame:
    """Stored candidates after adding documents' feature-shifted events back."""
    forest = forgotten_model("event", spark, d)
    fresh = samples("event", spark, d).join(forest.samples.select("sample_id"), "sample_id", "left_anti")
    at_leaves = maintenance.delta_at_leaves(
        forest, maintenance.delta_rows(A.assign_trees(fresh, EVENT), 1)
    )
    return maintenance.updated_candidates(
        forest.candidates, maintenance.candidate_deltas(forest, at_leaves), forest
    )


_ADDED = [
    *forget_ctes("event"),
    "asked AS (SELECT * FROM event WHERE sample_id IN (SELECT sample_id FROM forgotten))",
    *O.walk(EVENT, "asked", "m_", "q_"),
    O.assignment(EVENT, "event", "every"),
    "path AS (SELECT v.tree_id, (v.node_id >> u)::BIGINT AS node_id, e.label, e.f FROM q_votes v "
    "JOIN every USING (sample_id, tree_id) JOIN event e USING (sample_id), range(6) r(u) WHERE (v.node_id >> u) > 0)",
    "inc AS (SELECT c.tree_id, c.node_id, c.attr, c.draw, "
    f"count(*) FILTER ({_LEFT_PATH} AND p.f IS NOT NULL) AS more, count(*) FILTER ({_LEFT_PATH} AND p.label) AS more_pos, "
    "count(*) FILTER (p.f[attr + 1] = c.lo) AS more_lo, count(*) FILTER (p.f[attr + 1] = c.hi) AS more_hi, "
    "count(*) FILTER (p.f[attr + 1] < c.lo OR p.f[attr + 1] > c.hi) AS outside "
    "FROM m_cands c LEFT JOIN path p USING (tree_id, node_id) GROUP BY 1, 2, 3, 4)",
]
Q["candidate_increment"] = Query(
    lambda spark, d: _incremented(spark, d).selectExpr(*KEYS, "attr", "posexplode(cuts) AS (draw, cut)", "lo_n", "hi_n", "invalid")
    .selectExpr(*KEYS, "attr", "draw", "cut.n_left AS n_left", "cut.n_left_pos AS n_left_pos", "lo_n", "hi_n", "invalid"),
    O.query(
        _ADDED,
        "SELECT tree_id, node_id, attr, draw, n_left + more AS n_left, n_left_pos + more_pos AS n_left_pos, "
        "lo_n + more_lo AS lo_n, hi_n + more_hi AS hi_n, outside > 0 AS invalid "
        "FROM m_cands JOIN inc USING (tree_id, node_id, attr, draw)",
    ),
)
Q["candidate_stats"] = Query(
    lambda spark, d: _candidates(model("doc", spark, d)),
    O.query(fit_ctes("doc"), f"SELECT {_CAND} FROM m_cands"),
)
Q["maintenance_stats"] = Query(
    lambda spark, d: M.maintenance_stats(model("doc", spark, d).candidates),
    O.query(
        fit_ctes("doc"),
        "SELECT count(DISTINCT tree_id) AS num_trees, count(*) AS num_nodes FROM "
        "(SELECT tree_id, node_id FROM m_nodes WHERE depth < 4 AND n >= 2 AND n_pos > 0 AND n_pos < n)",
    ),
)
