"""Whole subtrees in one task, for nodes with few rows.

Wide levels are grown level by level, where only counters are shuffled. Once a node's rows fit a
fixed budget, one task gets them all and grows everything below the node, with the same
keyed draws and the same floating-point steps, so the model does not show which way a node was
grown. Groups are bounded by a row count known beforehand; there are as many tasks as nodes.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import splits as S
from ..operators.routing import NODE_BYTES

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CANDIDATE_FIELDS = f"attr:int,lo:double,hi:double,lo_n:bigint,hi_n:bigint,cuts:{S.CUTS_TYPE}"
FINISHED_SCHEMA = (
    "tree_id INT, node_id BIGINT, depth INT, kind STRING, attr INT, threshold DOUBLE, subset BIGINT, "
    "base DOUBLE, n BIGINT, n_pos BIGINT, tag STRING, "
    f"candidates array<struct<{CANDIDATE_FIELDS}>>"
)
_CUT = pa.struct([("threshold", pa.float64()), ("subset", pa.int64()), ("n_left", pa.int64()), ("n_left_pos", pa.int64())])
_CANDIDATE = pa.struct(
    [("attr", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("lo_n", pa.int64()), ("hi_n", pa.int64()), ("cuts", pa.list_(_CUT))]
)
_NODE = pa.schema(
    [
        ("tree_id", pa.int32()), ("node_id", pa.int64()), ("depth", pa.int32()), ("kind", pa.string()), ("attr", pa.int32()),
        ("threshold", pa.float64()), ("subset", pa.int64()), ("base", pa.float64()), ("n", pa.int64()), ("n_pos", pa.int64()),
        ("tag", pa.string()), ("candidates", pa.list_(_CANDIDATE)),
    ]
)


@dataclass(frozen=True)
class Rules:
    """What of a run's configuration decides a tree's shape."""

    seed: int
    num_features: int
    features_per_split: int
    draws: int
    max_depth: int
    min_split: int
    min_leaf: int
    categorical: tuple[int, ...]

    @classmethod
    def of(cls, config: RunConfig) -> Rules:
        return cls(
            config.seed, config.num_features, config.features_per_split, config.num_splits_to_try, config.max_depth,
            config.min_samples_split, config.min_samples_leaf, tuple(config.categorical_attrs),
        )

    def digest(self, kind: str, *keys: int) -> str:
        return hashlib.md5(":".join([f"{self.seed}:{kind}", *map(str, keys)]).encode()).hexdigest()

    def uniform(self, kind: str, *keys: int) -> float:
        return int(self.digest(kind, *keys)[:13], 16) / 4503599627370496.0

    def bits(self, kind: str, *keys: int) -> int:
        text = self.digest(kind, *keys)
        return int(text[:8], 16) * 2147483648 + int(text[8:16], 16) % 2147483648

    def attrs(self, tree: int, node: int) -> list[int]:
        every = range(self.num_features)
        if self.features_per_split >= self.num_features:
            return list(every)
        ranked = sorted((self.uniform("attr", tree, node, a), a) for a in every)
        return sorted(a for _, a in ranked[: self.features_per_split])

    def cut(self, tree: int, node: int, attr: int, draw: int, lo: float, hi: float) -> tuple[float | None, int | None] | None:
        """(threshold, category set), or nothing where the values do not vary."""
        if attr not in self.categorical:
            if abs(hi - lo) < S.CONSTANT_WIDTH:
                return None
            return lo + self.uniform("cut", tree, node, attr, draw) * (hi - lo), None
        if hi - lo >= S.MAX_CATEGORIES:
            raise ValueError(f"more than {S.MAX_CATEGORIES} categories in one node")
        if hi <= lo:
            return None
        every = (1 << min(int(hi - lo + 1), 62)) - 1 if int(hi - lo + 1) < S.MAX_CATEGORIES else 2**63 - 1
        return None, self.bits("set", tree, node, attr, draw) % every + 1


def _gini(n_pos: int, n: int) -> float:
    if n == 0:
        return 0.0
    share = float(n_pos) / float(n)
    return 2.0 * share * (1.0 - share)


def _score(n: int, n_pos: int, left: int, left_pos: int) -> int | None:
    if not 0 < left < n:
        return None
    right, right_pos = n - left, n_pos - left_pos
    children = float(left) / float(n) * _gini(left_pos, left) + float(right) / float(n) * _gini(right_pos, right)
    return math.floor((_gini(n_pos, n) - children) * 1000000000000.0)


def _goes_left(values: np.ndarray, threshold: float | None, subset: int | None, base: float) -> np.ndarray:
    if subset is None:
        return values <= threshold
    offset = np.clip(values - base, -1.0, float(S.MAX_CATEGORIES)).astype(np.int64)
    inside = (offset >= 0) & (offset < S.MAX_CATEGORIES)
    return inside & ((np.int64(subset) >> np.where(inside, offset, 0)) & 1 == 1)


def _grown(rules: Rules, tree: int, top: int, x: np.ndarray, label: np.ndarray) -> Iterator[dict]:
    """Every node at and below ``top``."""
    stack = [(top, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        depth, own = node.bit_length() - 1, label[rows]
        n, n_pos = len(rows), int(own.sum())
        out: dict = dict(
            tree_id=tree, node_id=node, depth=depth, kind="leaf", attr=None, threshold=None, subset=None,
            base=None, n=n, n_pos=n_pos, tag="clean", candidates=None,
        )
        best: tuple | None = None
        if depth < rules.max_depth and n >= rules.min_split and 0 < n_pos < n:
            out["candidates"] = []
            for attr in rules.attrs(tree, node):
                values = x[rows, attr]
                lo, hi = float(values.min()), float(values.max())
                cuts = []
                for draw in range(rules.draws):
                    cut = rules.cut(tree, node, attr, draw, lo, hi)
                    if cut is None:
                        break
                    goes = _goes_left(values, *cut, lo)
                    left, left_pos = int(goes.sum()), int((goes & own).sum())
                    cuts.append(dict(threshold=cut[0], subset=cut[1], n_left=left, n_left_pos=left_pos))
                    score = _score(n, n_pos, left, left_pos)
                    if score is not None and score > 0 and (best is None or (score, -attr, -draw) > best[0]):
                        best = (score, -attr, -draw), attr, *cut, lo, left
                counts = int((values == lo).sum()), int((values == hi).sum())
                out["candidates"].append(dict(attr=attr, lo=lo, hi=hi, lo_n=counts[0], hi_n=counts[1], cuts=cuts))
        if best is None or min(best[5], n - best[5]) < rules.min_leaf:
            yield out
            continue
        _, attr, threshold, subset, lo, _ = best
        out |= dict(kind="internal", attr=attr, threshold=threshold, subset=subset, base=None if subset is None else lo)
        goes = _goes_left(x[rows, attr], threshold, subset, lo)
        stack += [(node * 2, rows[goes]), (node * 2 + 1, rows[~goes])]
        yield out


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def at_tops(rows: DataFrame, tops: DataFrame, top_count: int, config: RunConfig) -> DataFrame:
    """tree_id, node_id, label, features: of rows that stand at their node, those at ``tops`` (tree_id,
    node_id, n)."""
    own = rows.select(*S.NODE_KEYS, "label", "features", "sample_id")
    standing = S.attach(own, tops.select(*S.NODE_KEYS, "n"), top_count * NODE_BYTES, config)
    return standing.drop("n", "sample_id")


def finish(standing: DataFrame, config: RunConfig) -> DataFrame:
    """The nodes that rows stand at and all below them, each with its candidates."""
    rules = Rules.of(config)

    def grow(group: pa.Table) -> pa.Table:
        tree, top = group.column("tree_id")[0].as_py(), group.column("node_id")[0].as_py()
        features = _flat(group.column("features"))
        x = features.flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, rules.num_features)
        label = _flat(group.column("label")).fill_null(False).to_numpy(zero_copy_only=False)
        return pa.Table.from_pylist(list(_grown(rules, tree, top, x, label)), _NODE)

    return standing.groupBy(*S.NODE_KEYS).applyInArrow(grow, FINISHED_SCHEMA)


def finished_candidates(finished: DataFrame) -> DataFrame:
    listed = finished.where("candidates IS NOT NULL").select(*S.NODE_KEYS, F.explode("candidates").alias("c"))
    return listed.select(*S.NODE_KEYS, "c.*")
