"""Descending trees for whole Arrow batches, with the model's nodes in arrays.

A chain of joins, one per depth, ends up in one generated method, which the JVM no longer
compiles from four depths on. Here every depth is a few vector steps, whatever the trees' depth.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_FIELDS = ["tree_id", "node_id", "attr", "threshold", "subset", "base"]


@dataclass(frozen=True)
class Tables:
    """Nodes by seat, sorted by tree and node. ``attr`` is -1 where no split is, a cut's missing part
    is NaN or 0, and a child that is not among the nodes has seat -1."""

    tree: np.ndarray
    node: np.ndarray
    attr: np.ndarray
    threshold: np.ndarray
    subset: np.ndarray
    base: np.ndarray
    left: np.ndarray
    right: np.ndarray
    spans: dict[int, tuple[int, int]]
    max_categories: int
    positive: np.ndarray | None

    @classmethod
    def of(cls, nodes: DataFrame, max_categories: int) -> Tables:
        """The driver reads the nodes, which the caller knows to fit a broadcast. A column ``vote`` says
        how a node votes."""
        votes = [name for name in ("vote",) if name in nodes.columns]
        table = nodes.select(*NODE_FIELDS, *votes).toArrow().sort_by([("tree_id", "ascending"), ("node_id", "ascending")])

        def column(name: str, missing: float, dtype: type) -> np.ndarray:
            return table.column(name).fill_null(missing).to_numpy().astype(dtype)

        tree, node = column("tree_id", -1, np.int64), column("node_id", 0, np.int64)
        attr = column("attr", -1, np.int64)
        trees, starts = np.unique(tree, return_index=True)
        spans = dict(zip(trees.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(tree)]), strict=True))
        sides = []
        for child in (node * 2, node * 2 + 1):
            seats = np.full(len(tree), -1, np.int64)
            for low, high in spans.values():
                seats[low:high] = _found(node, low, high, child[low:high])
            sides.append(seats)
        cuts = [column("threshold", np.nan, np.float64), column("subset", 0, np.int64), column("base", 0.0, np.float64)]
        positive = column("vote", False, np.bool_) if votes else None
        return cls(tree, node, attr, *cuts, *sides, spans, max_categories, positive)

    def seats(self, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Where rows stand that are at a node of a tree."""
        out = np.full(len(tree), -1, np.int64)
        for number, (low, high) in self.spans.items():
            own = np.flatnonzero(tree == number)
            out[own] = _found(self.node, low, high, node[own])
        return out

    def steps(self, seat: np.ndarray, values: Values) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Depth by depth: the rows that go on, whether they go left, and their seats after it."""
        rows = np.flatnonzero(seat >= 0)
        at = seat[rows]
        while True:
            inner = self.attr[at] >= 0
            rows, at = rows[inner], at[inner]
            if not len(rows):
                return
            value = values.at(rows, self.attr[at])
            left = value <= self.threshold[at]
            by_set = np.flatnonzero(np.isnan(self.threshold[at]))
            if len(by_set):
                left[by_set] = self._member(value[by_set], at[by_set])
            at = np.where(left, self.left[at], self.right[at])
            yield rows, left, at
            there = at >= 0
            rows, at = rows[there], at[there]

    def _member(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        offset = np.clip(value - self.base[at], -1.0, float(self.max_categories))
        offset = np.where(np.isnan(offset), -1.0, offset).astype(np.int64)
        inside = (offset >= 0) & (offset < self.max_categories)
        return inside & ((self.subset[at] >> np.where(inside, offset, 0)) & 1 == 1)


def _found(node: np.ndarray, low: int, high: int, wanted: np.ndarray) -> np.ndarray:
    """Seats of nodes of one tree, which has the seats from ``low`` to ``high``; -1 for others."""
    place = np.minimum(np.searchsorted(node[low:high], wanted) + low, high - 1)
    return np.where(node[place] == wanted, place, -1)


class Values:
    """The feature lists of a batch. A missing list or value is NaN, which goes right."""

    def __init__(self, features: pa.Array):
        self._flat = features.values.to_numpy(zero_copy_only=False)
        self._starts = features.offsets.to_numpy()[:-1].astype(np.int64)
        self._sizes = features.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)

    def at(self, rows: np.ndarray, attr: np.ndarray) -> np.ndarray:
        sizes = self._sizes[rows]
        if ((attr >= sizes) & (sizes >= 0)).any():
            raise ValueError("a row has fewer features than the model")
        if (sizes >= 0).all():
            return self._flat[self._starts[rows] + attr]
        there = sizes >= 0
        out = np.full(len(rows), np.nan)
        out[there] = self._flat[self._starts[rows[there]] + attr[there]]
        return out


def node_reached(tables: Tables) -> Column:
    """The deepest node a row's path reaches from its (tree_id, node_id)."""

    def reached(tree: pa.Array, node: pa.Array, features: pa.Array) -> pa.Array:
        numbers = node.to_numpy(zero_copy_only=False).astype(np.int64)
        seat = tables.seats(tree.to_numpy(zero_copy_only=False), numbers)
        for rows, left, _ in tables.steps(seat, Values(features)):
            numbers[rows] = numbers[rows] * 2 + ~left
        return pa.array(numbers)

    # Else an inferred filter on the node would be a second descent.
    return F.arrow_udf(reached, "bigint").asNondeterministic()("tree_id", "node_id", "features")


def vote_count(tables: Tables, weights: Mapping[int, int] | None = None) -> Column:
    """Positive votes of all trees from their roots, each counted as often as ``weights`` says (once
    without it). Where a child is missing, its parent votes."""
    roots = {tree: low for tree, (low, _) in tables.spans.items()}

    def votes(features: pa.Array) -> pa.Array:
        values, total = Values(features), np.zeros(len(features), np.int64)
        for tree, root in roots.items():
            times = 1 if weights is None else weights.get(tree, 0)
            if times:
                seat = np.full(len(features), root, np.int64)
                for rows, _, at in tables.steps(seat, values):
                    seat[rows] = np.where(at >= 0, at, seat[rows])
                total += np.where(tables.positive[seat], times, 0)
        return pa.array(total)

    return F.arrow_udf(votes, "bigint").asNondeterministic()("features")
