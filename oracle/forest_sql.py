"""A whole forest trained in plain SQL, used to check the Spark engine.

The chain of common table expressions restates the definition of the model level by
level from raw rows. It never updates anything, so it is also the answer that adding and
forgetting samples must reproduce.
"""

from __future__ import annotations

from lethewood.config import RunConfig


def _draw(text: str, start: int = 1, length: int = 13) -> str:
    return f"('0x' || substr({text}, {start}, {length}))::BIGINT"


def _md5(seed: int, kind: str, *keys: object) -> str:
    parts = " || ':' || ".join(f"({key})::VARCHAR" for key in keys)
    return f"md5('{seed}:{kind}:' || {parts})"


def uniform(seed: int, kind: str, *keys: object) -> str:
    return f"({_draw(_md5(seed, kind, *keys))} / 4503599627370496.0)"


def bits63(seed: int, kind: str, *keys: object) -> str:
    text = _md5(seed, kind, *keys)
    return f"({_draw(text, 1, 8)} * 2147483648 + {_draw(text, 9, 8)} % 2147483648)"


def gini(n_pos: str, n: str) -> str:
    share = f"(({n_pos})::DOUBLE / ({n})::DOUBLE)"
    return f"(CASE WHEN ({n}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {share} * (1.0::DOUBLE - {share}) END)"


def children_gini(n: str, n_pos: str, nl: str, nlp: str) -> str:
    nr, nrp = f"({n} - {nl})", f"({n_pos} - {nlp})"
    return (
        f"({nl}::DOUBLE / {n}::DOUBLE * {gini(nlp, nl)}"
        f" + {nr}::DOUBLE / {n}::DOUBLE * {gini(nrp, nr)})"
    )


def score(n: str, n_pos: str, nl: str, nlp: str) -> str:
    gain = f"({gini(n_pos, n)} - {children_gini(n, n_pos, nl, nlp)})"
    return f"(CASE WHEN {nl} > 0 AND {nl} < {n} THEN floor({gain} * 1000000000000.0::DOUBLE)::BIGINT END)"


def assignment(config: RunConfig, source: str, name: str, k: str | None = None) -> str:
    key = f"substr({_md5(config.seed, 'tree', 'sample_id', 't // 4')}, (8 * (t % 4) + 1)::BIGINT, 8)"
    if k is None:
        k = str(config.k)
        if config.minority_k > 0:
            k = f"CASE WHEN label THEN {config.minority_k} ELSE {config.k} END"
    k = f"least(greatest({k}, 1), {config.num_trees})"
    return f"""
{name} AS (
  SELECT sample_id, t::INTEGER AS tree_id FROM (
    SELECT sample_id, t, {k} AS k,
           row_number() OVER (PARTITION BY sample_id ORDER BY {key}, t) AS rn
    FROM {source}, range({config.num_trees}) r(t)) WHERE rn <= k
)"""


def left(value: str, config: RunConfig) -> str:
    if not config.categorical_attrs:
        return f"{value} <= threshold"
    bit = f"(subset >> ({value} - base)::INTEGER) & 1 = 1"
    return (
        f"(CASE WHEN threshold IS NOT NULL THEN {value} <= threshold"
        f" ELSE {value} - base BETWEEN 0 AND 62 AND {bit} END)"
    )


def _stop(config: RunConfig, depth: int) -> str:
    if depth >= config.max_depth:
        return "true"
    return f"(n < {config.min_samples_split} OR n_pos = 0 OR n_pos = n)"


def level(config: RunConfig, p: str, d: int) -> list[str]:
    s = config.seed
    cat = ", ".join(map(str, config.categorical_attrs)) or "-1"
    u = uniform(s, "cut", "tree_id", "node_id", "attr", "draw")
    bits = bits63(s, "set", "tree_id", "node_id", "attr", "draw")
    count = "(hi - lo + 1)::INTEGER"
    every = f"(CASE WHEN {count} >= 63 THEN 9223372036854775807 ELSE (1::BIGINT << least({count}, 62)) - 1 END)"
    ctes = [
        f"""
{p}fr{d} AS (
  SELECT tree_id, node_id, count(*) AS n, sum(label::INT)::BIGINT AS n_pos
  FROM {p}r{d} GROUP BY 1, 2
)""",
        f"{p}op{d} AS (SELECT * FROM {p}fr{d} WHERE NOT {_stop(config, d)})",
        f"""
{p}at{d} AS (
  SELECT tree_id, node_id, attr::INTEGER AS attr FROM (
    SELECT tree_id, node_id, attr, row_number() OVER (
      PARTITION BY tree_id, node_id ORDER BY {uniform(s, "attr", "tree_id", "node_id", "attr")}, attr) AS rn
    FROM {p}op{d}, range({config.num_features}) a(attr)) WHERE rn <= {config.features_per_split}
)""",
        f"""
{p}rg{d} AS (
  SELECT tree_id, node_id, attr, min(f[attr + 1]) AS lo, max(f[attr + 1]) AS hi
  FROM {p}r{d} JOIN {p}at{d} USING (tree_id, node_id) GROUP BY 1, 2, 3
)""",
        f"""
{p}cu{d} AS (
  SELECT tree_id, node_id, attr, draw::INTEGER AS draw, lo, hi,
    CASE WHEN attr NOT IN ({cat}) THEN lo + {u} * (hi - lo) END AS threshold,
    CASE WHEN attr IN ({cat}) THEN {bits} % {every} + 1 END AS subset,
    CASE WHEN attr IN ({cat}) THEN lo END AS base
  FROM {p}rg{d}, range({config.num_splits_to_try}) g(draw)
  WHERE (attr NOT IN ({cat}) AND abs(hi - lo) >= 1.1920929e-7) OR (attr IN ({cat}) AND hi > lo)
)""",
        f"""
{p}ct{d} AS (
  SELECT tree_id, node_id, attr, draw, any_value(lo) AS lo, any_value(hi) AS hi,
    any_value(threshold) AS threshold, any_value(subset) AS subset, any_value(base) AS base,
    count(*) FILTER ({left("f[attr + 1]", config)}) AS n_left,
    count(*) FILTER ({left("f[attr + 1]", config)} AND label) AS n_left_pos,
    count(*) FILTER (f[attr + 1] = lo) AS lo_n, count(*) FILTER (f[attr + 1] = hi) AS hi_n
  FROM {p}r{d} JOIN {p}cu{d} USING (tree_id, node_id) GROUP BY 1, 2, 3, 4
)""",
        f"""
{p}sc{d} AS (
  SELECT *, {score("n", "n_pos", "n_left", "n_left_pos")} AS score
  FROM {p}ct{d} JOIN {p}op{d} USING (tree_id, node_id)
)""",
        f"""
{p}bs{d} AS (
  SELECT * FROM (SELECT * FROM {p}sc{d} WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY tree_id, node_id ORDER BY score DESC, attr, draw) = 1)
  WHERE n_left >= {config.min_samples_leaf} AND n - n_left >= {config.min_samples_leaf}
)""",
        f"""
{p}nd{d} AS (
  SELECT fr.tree_id, fr.node_id, {d} AS depth,
    CASE WHEN bs.attr IS NULL THEN 'leaf' ELSE 'internal' END AS kind,
    bs.attr, bs.threshold, bs.subset, bs.base, fr.n, fr.n_pos, bs.score, bs.draw
  FROM {p}fr{d} fr LEFT JOIN {p}bs{d} bs USING (tree_id, node_id)
)""",
    ]
    if d < config.max_depth:
        ctes.append(
            f"""
{p}r{d + 1} AS (
  SELECT tree_id, CASE WHEN {left("f[attr + 1]", config)} THEN node_id * 2 ELSE node_id * 2 + 1 END AS node_id,
    sample_id, f, label
  FROM {p}r{d} r JOIN (SELECT tree_id, node_id, attr, threshold, subset, base FROM {p}bs{d}) USING (tree_id, node_id)
)"""
        )
    return ctes


def fit(config: RunConfig, source: str, p: str, k: str | None = None) -> list[str]:
    """CTEs {p}asg, {p}nodes, {p}cands, {p}leaf for the samples in ``source``."""
    ctes = [
        assignment(config, source, f"{p}asg", k),
        f"""
{p}r0 AS (
  SELECT tree_id, 1::BIGINT AS node_id, sample_id, f, label FROM {p}asg JOIN {source} USING (sample_id)
)""",
    ]
    depths = range(config.max_depth + 1)
    for d in depths:
        ctes += level(config, p, d)
    ctes.append(
        f"{p}nodes AS ("
        + " UNION ALL ".join(f"SELECT * FROM {p}nd{d}" for d in depths)
        + ")"
    )
    ctes.append(
        f"{p}cands AS ("
        + " UNION ALL ".join(f"SELECT *, {d} AS depth FROM {p}sc{d}" for d in depths)
        + ")"
    )
    ctes.append(
        f"{p}leaf AS ("
        + " UNION ALL ".join(
            f"SELECT tree_id, sample_id, node_id FROM {p}r{d} JOIN "
            f"(SELECT tree_id, node_id FROM {p}nd{d} WHERE kind = 'leaf') USING (tree_id, node_id)"
            for d in depths
        )
        + ")"
    )
    return ctes


def walk(config: RunConfig, queries: str, p: str, q: str) -> list[str]:
    """CTE {q}votes: one vote per (sample of ``queries``, tree) from the nodes of ``p``."""
    ctes = [
        f"""
{q}w0 AS (
  SELECT sample_id, t::INTEGER AS tree_id, 1::BIGINT AS node_id, f, label
  FROM {queries}, range({config.num_trees}) r(t)
)"""
    ]
    for d in range(config.max_depth):
        ctes.append(
            f"""
{q}w{d + 1} AS (
  SELECT sample_id, tree_id,
    CASE WHEN attr IS NULL THEN node_id WHEN {left("f[attr + 1]", config)} THEN node_id * 2
         ELSE node_id * 2 + 1 END AS node_id, f, label
  FROM {q}w{d} LEFT JOIN (SELECT tree_id, node_id, attr, threshold, subset, base FROM {p}nodes
                          WHERE kind = 'internal') USING (tree_id, node_id)
)"""
        )
    ctes.append(
        f"""
{q}votes AS (
  SELECT w.sample_id, w.tree_id, w.label, w.node_id, coalesce(2 * n_pos > n, false) AS vote
  FROM {q}w{config.max_depth} w LEFT JOIN {p}nodes USING (tree_id, node_id)
)"""
    )
    return ctes


def query(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()
