"""Ranges and cut counts of one tree level for whole blocks of samples.

A task walks its blocks' rows down the splits found so far, node by node, and hands on one short row per (tree,
node, attribute). The values are those of ``splits.node_ranges`` and ``splits.count_cuts``, which serve
levels with too many nodes for this.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Container, Iterable, Iterator
from dataclasses import dataclass
from math import isnan

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RunConfig
from .descent import Values
from .splits import MAX_CATEGORIES, NODE_KEYS, with_cut_columns

# Workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Beyond so many nodes a task's steps from node to node cost more than its rows.
MOST_NODES = 4096
# Batches are put together up to so many values.
CHUNK_VALUES = 1 << 19
BLOCK_SCHEMA = "size INT, features BINARY, missing BINARY, label BINARY, tops BINARY, own BINARY"
_BLOCK = pa.schema(
    [("size", pa.int32()), *((name, pa.binary()) for name in ("features", "missing", "label", "tops", "own"))]
)
RANGE_SCHEMA = "tree_id INT, node_id BIGINT, attr INT, lo DOUBLE, hi DOUBLE"

Split = tuple[int, float | None, int | None, float | None]
Splits = dict[int, dict[int, Split]]
Key = tuple[int, int, int]


def splits_of(nodes: DataFrame) -> Splits:
    """Internal nodes, at most ``MOST_NODES``, by tree and node: attribute, threshold, category set, its base."""
    found: Splits = {}
    columns = [*NODE_KEYS, "attr", "threshold", "subset", "base"]
    for tree, node, *split in nodes.where("kind = 'internal'").select(*columns).collect():
        found.setdefault(tree, {})[node] = tuple(split)
    return found


def goes_left(values: np.ndarray, threshold: float | None, subset: int | None, base: float | None) -> np.ndarray:
    if threshold is not None:
        # Not a number is larger than any other, as in SQL.
        return np.ones(len(values), np.bool_) if isnan(threshold) else values <= threshold
    if subset is None:
        return np.zeros(len(values), np.bool_)
    offset = np.clip(values - base, -1.0, float(MAX_CATEGORIES))
    offset = np.where(np.isnan(offset), -1.0, offset).astype(np.int64)
    inside = (offset >= 0) & (offset < MAX_CATEGORIES)
    return inside & ((np.int64(subset) >> np.where(inside, offset, 0)) & 1 == 1)


@dataclass(frozen=True)
class Standing:
    """Rows at an open node. ``values`` are a block's features by attribute, ``missing`` says which are not
    there (they are NaN), if any."""

    tree: int
    node: int
    rows: np.ndarray
    values: np.ndarray
    missing: np.ndarray | None
    label: np.ndarray

    def at(self, attr: int) -> tuple[np.ndarray, np.ndarray]:
        """The values that are there, and their labels."""
        rows = self.rows if self.missing is None else self.rows[~self.missing[attr][self.rows]]
        return self.values[attr][rows], self.label[rows]


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, values = [], 0
    for batch in batches:
        held.append(batch)
        values += len(batch.column("features").values) + batch.num_rows
        if values >= CHUNK_VALUES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, values = [], 0
    if values:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _by_node(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree, node and row of every row that comes at a node, sorted by tree and node. Samples with
    ``tree_ids`` come at the roots."""
    if "tree_ids" in table.column_names:
        trees = _column(table, "tree_ids")
        tree = trees.flatten().to_numpy(zero_copy_only=False)
        sizes = trees.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(table.num_rows, dtype=np.int32), sizes)
        # Two bytes are sorted by counting.
        short = len(tree) and tree.max() < 1 << 15
        order = np.argsort(tree.astype(np.int16) if short else tree, kind="stable")
        return tree[order], np.ones(len(tree), np.int64), rows[order]
    tree, node = table.column("tree_id").to_numpy(), table.column("node_id").to_numpy()
    order = np.lexsort((node, tree))
    return tree[order], node[order], order


def _by_attribute(features: pa.Array, count: int) -> np.ndarray:
    """One row of values per attribute, NaN where one is missing."""
    sizes = features.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if (sizes == count).all():
        flat = features.flatten().to_numpy(zero_copy_only=False)
        return np.ascontiguousarray(flat.reshape(len(features), count).T)
    known, every = Values(features), np.arange(len(features))
    return np.stack([known.at(every, np.full(len(every), attr)) for attr in range(count)])


def blocks(rows: DataFrame, config: RunConfig) -> DataFrame:
    """Samples as blocks of bounded size, one array a column: features by attribute, labels, and rows by the
    node they come at. Every level reads them, at a fraction of what rows with lists cost."""
    count = config.num_features

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches):
            features = _column(table, "features")
            size = table.num_rows
            values, missing = _by_attribute(features, count), b""
            if features.null_count or features.values.null_count:
                listed = features.to_pylist()
                lacks = [[x is None or x[attr] is None for x in listed] for attr in range(count)]
                missing = np.array(lacks, np.bool_).tobytes()
            label = _column(table, "label").fill_null(False).to_numpy(zero_copy_only=False)
            tree, node, own = _by_node(table)
            starts = np.flatnonzero(np.r_[len(tree) > 0, (np.diff(tree) != 0) | (np.diff(node) != 0)][: len(tree)])
            ends = np.r_[starts[1:], len(tree)][: len(starts)]
            tops = np.stack([tree[starts], node[starts], starts, ends]).astype(np.int64)
            row = (size, values.tobytes(), missing, label.astype(np.bool_).tobytes(), tops.tobytes(), own.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, row, strict=True))], _BLOCK)

    where = ["tree_ids"] if "tree_ids" in rows.columns else NODE_KEYS
    return rows.select(*where, "label", "features").mapInArrow(pack, BLOCK_SCHEMA)


def _standing(
    batches: Iterable[pa.RecordBatch], splits: Splits, wanted: Container[tuple[int, int]], count: int
) -> Iterator[Standing]:
    for block in (row for batch in batches for row in batch.to_pylist()):
        size = block["size"]
        values = np.frombuffer(block["features"]).reshape(count, size)
        missing = np.frombuffer(block["missing"], np.bool_).reshape(count, size) if block["missing"] else None
        label = np.frombuffer(block["label"], np.bool_)
        own = np.frombuffer(block["own"], np.int32)
        for tree, top, start, end in np.frombuffer(block["tops"], np.int64).reshape(4, -1).T.tolist():
            inner = splits.get(tree, {})
            stack = [(top, own[start:end])]
            while stack:
                node, rows = stack.pop()
                if not len(rows):
                    continue
                if node not in inner:
                    if (tree, node) in wanted:
                        yield Standing(tree, node, rows, values, missing, label)
                    continue
                attr, *cut = inner[node]
                left = goes_left(values[attr][rows], *cut)
                stack += [(node * 2, rows[left]), (node * 2 + 1, rows[~left])]


def rows_at(blocked: DataFrame, splits: Splits, tops: DataFrame, config: RunConfig) -> DataFrame:
    """tree_id, node_id, label, features: the rows that stand at ``tops``, at most ``MOST_NODES``."""
    wanted, count = {(tree, node) for tree, node in tops.select(*NODE_KEYS).collect()}, config.num_features
    arrow = pa.schema(
        [("tree_id", pa.int32()), ("node_id", pa.int64()), ("label", pa.bool_()), ("features", pa.list_(pa.float64()))]
    )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in _standing(batches, splits, wanted, count):
            size = len(at.rows)
            offsets = pa.array(np.arange(size + 1) * count, pa.int32())
            features = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(at.values[:, at.rows].T).ravel()))
            columns = [np.full(size, at.tree, np.int32), np.full(size, at.node, np.int64), at.label[at.rows]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), features], schema=arrow)

    return blocked.mapInArrow(task, "tree_id INT, node_id BIGINT, label BOOLEAN, features ARRAY<DOUBLE>")


def _tallied(blocked: DataFrame, tally: Callable[[Iterator[pa.RecordBatch]], list[tuple]], schema: str) -> DataFrame:
    """What every task found."""
    names = [part.split()[0] for part in schema.split(", ")]
    types = {"INT": pa.int32(), "BIGINT": pa.int64(), "DOUBLE": pa.float64()}
    arrow = pa.schema([(name, types[part.split()[1]]) for name, part in zip(names, schema.split(", "), strict=True)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in tally(batches)], arrow)

    return blocked.mapInArrow(task, schema)


def node_ranges(blocked: DataFrame, splits: Splits, open_nodes: DataFrame, config: RunConfig) -> DataFrame:
    """Smallest and largest value of each of a node's ``attrs`` over the node's own rows."""
    attrs = {(tree, node): listed for tree, node, listed in open_nodes.select(*NODE_KEYS, "attrs").collect()}
    count = config.num_features

    def tally(batches: Iterator[pa.RecordBatch]) -> list[tuple]:
        found: dict[Key, tuple[float | None, float | None]] = {}
        for at in _standing(batches, splits, attrs, count):
            for attr in attrs[at.tree, at.node]:
                key, (values, _) = (at.tree, at.node, attr), at.at(attr)
                lo, hi = found.get(key, (None, None))
                if len(values):
                    # Not a number is larger than any other, as in SQL.
                    low, high = float(np.fmin.reduce(values)), float(values.max())
                    lo = low if lo is None else float(np.fmin(lo, low))
                    hi = high if hi is None else float(np.maximum(hi, high))
                found[key] = lo, hi
        return [(*key, *ends) for key, ends in found.items()]

    return _tallied(blocked, tally, RANGE_SCHEMA).groupBy(*NODE_KEYS, "attr").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def _equal(values: np.ndarray, end: float | None) -> int:
    if end is None:
        return 0
    return int(np.count_nonzero(np.isnan(values) if isnan(end) else values == end))


def count_cuts(blocked: DataFrame, splits: Splits, ranges: DataFrame, config: RunConfig) -> DataFrame:
    """Rows and positives left of every cut that the ranges give, and rows on the range ends."""
    draws, count = range(config.num_splits_to_try), config.num_features
    cuts: dict[tuple[int, int], list[tuple]] = {}
    for row in with_cut_columns(ranges, config).collect():
        listed = [(row[f"t{j}"], row[f"s{j}"]) for j in draws]
        cuts.setdefault((row["tree_id"], row["node_id"]), []).append((row["attr"], row["lo"], row["hi"], listed))

    def tally(batches: Iterator[pa.RecordBatch]) -> list[tuple]:
        found: dict[Key, np.ndarray] = {}
        ends: dict[Key, tuple] = {}
        for at in _standing(batches, splits, cuts, count):
            for attr, lo, hi, listed in cuts[at.tree, at.node]:
                values, label = at.at(attr)
                counts = [_equal(values, lo), _equal(values, hi)]
                for threshold, subset in listed:
                    if threshold is None and subset is None:
                        counts += [0, 0]
                        continue
                    left = goes_left(values, threshold, subset, lo)
                    counts += [np.count_nonzero(left), np.count_nonzero(left & label)]
                key = at.tree, at.node, attr
                ends[key] = lo, hi
                found[key] = found[key] + np.array(counts) if key in found else np.array(counts)
        return [(*key, *ends[key], *counts.tolist()) for key, counts in found.items()]

    counters = ["lo_n", "hi_n", *(f"{side}{j}" for j in draws for side in "lp")]
    schema = ", ".join([RANGE_SCHEMA, *(f"{name} BIGINT" for name in counters)])
    sums = [F.sum(name).alias(name) for name in counters]
    return _tallied(blocked, tally, schema).groupBy(*NODE_KEYS, "attr").agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), *sums
    )
