"""Global ranks and running totals without a single-task window.

Rows are range-partitioned on the full sort key (made unique by its last column, so
equal leading values still spread), numbered inside each partition, and written once.
Only one row per partition is then needed to turn local numbers into global ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _ranged(df: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_seat", F.monotonically_increasing_id())
    )
    return scratch.write(numbered, "ranged").withColumn(
        "_part", F.shiftright("_seat", LOCAL_BITS)
    )


def _offsets(ranged: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Totals of all earlier partitions: one row per partition, bounded by their number."""
    per_part = ranged.groupBy("_part").agg(*[v.alias(name) for name, v in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "_part", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums]
    )


def with_rank(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "rank") -> DataFrame:
    """Add a dense 0-based global rank. ``order`` must end in a unique column."""
    ranged = _ranged(df, order, scratch)
    offsets = _offsets(ranged, {"_before": F.count(F.lit(1))})
    local = F.col("_seat") - F.shiftleft(F.col("_part"), LOCAL_BITS)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + local).cast("bigint"))
        .drop("_seat", "_part", "_before")
    )


def with_running_total(
    df: DataFrame, order: list[Column], value: str, scratch: Scratch, name: str
) -> DataFrame:
    """Add the inclusive running sum of a BIGINT column in global order."""
    ranged = _ranged(df, order, scratch)
    offsets = _offsets(ranged, {"_before": F.sum(value)})
    within = Window.partitionBy("_part").orderBy("_seat").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_before") + F.sum(value).over(within)).cast("bigint"))
        .drop("_seat", "_part", "_before")
    )


# A pool of so many rows is sorted by one task.
LOCAL_ROWS = 1 << 16
ACCURACY = 10_000


@dataclass(frozen=True)
class Cut:
    """Rows surely among the first n; and a pool, after them all, that gives the first ``missing`` of
    its own."""

    taken: Column
    pool: Column
    missing: int


def find_cut(df: DataFrame, keys: list[Column], n: int) -> Cut:
    """Where the first ``n`` rows end. ``keys`` ascend and the last one is unique.

    Every round takes three values of the pool from a mergeable sketch: one near the wanted rank and one
    surely on either side of it, counts exactly what lies before, at and between them, and goes on
    with the part the cut is in. A part is a few thousandths of the pool or one value; rows of one value
    are told apart by the next key. Conditions hold a key's two bounds, however many rounds it takes. No
    row moves.
    """
    taken, pool = F.lit(False), F.lit(True)
    for key in keys:
        before, held = taken, pool
        if n <= 0:
            break
        total, low, high = df.where(pool).agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
        if total <= n:
            return Cut(taken | pool, F.lit(False), 0)
        above, under = F.lit(True), F.lit(True)
        while total > LOCAL_ROWS and low != high:
            marks = _marks(df.where(pool), key, n / total)
            parts = _parts(key, marks)
            counts = df.where(pool).agg(*[F.count(F.when(part.inside, 1)) for part in parts]).first()
            if max(counts) == total:  # a key's values may be too close for the sketch's doubles
                parts = _parts(key, [low + (high - low) // 2])
                counts = df.where(pool).agg(*[F.count(F.when(part.inside, 1)) for part in parts]).first()
            at = 0
            while n > counts[at]:
                n, at = n - counts[at], at + 1
            total = counts[at]
            above = above if parts[at].above is None else parts[at].above
            under = under if parts[at].under is None else parts[at].under
            taken, pool = before | (held & ~above), held & above & under
            if total > LOCAL_ROWS:
                low, high = df.where(pool).agg(F.min(key), F.max(key)).first()
        if total <= n:
            return Cut(taken | pool, F.lit(False), 0)
        if total <= LOCAL_ROWS:
            return Cut(taken, pool, n)
    return Cut(taken, pool, n)


@dataclass(frozen=True)
class Part:
    """A range of a key between two neighbouring marks, or one mark: its bounds, where it has some."""

    above: Column | None
    under: Column | None

    @property
    def inside(self) -> Column:
        bounds = [bound for bound in (self.above, self.under) if bound is not None]
        return reduce(Column.__and__, bounds)


def _marks(rows: DataFrame, key: Column, share: float) -> list:
    """Values at and on both sides of a share of the rows. The sketch errs by one in ``ACCURACY`` of
    the rows, and gives the smallest or largest value for a share nearer than that to an end."""
    shares = [max(0.0, share - 2 / ACCURACY), share, min(1.0, share + 2 / ACCURACY)]
    return sorted(set(rows.agg(F.percentile_approx(key, shares, ACCURACY)).first()[0]))


def _parts(key: Column, marks: list) -> list[Part]:
    """The ranges before, at, between and after ``marks``, in order."""
    parts = [Part(None, key < marks[0])]
    for mark, following in zip(marks, [*marks[1:], None], strict=True):
        parts.append(Part(key >= mark, key <= mark))
        parts.append(Part(key > mark, None if following is None else key < following))
    return parts


def ascending(order: Column) -> Column:
    """A numeric sort order as a key that ascends: a falling one is negated."""
    node = order._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return order
    jvm = SparkSession.active()._jvm
    key = type(order)(jvm.org.apache.spark.sql.Column(node.child()))
    return -key if "Descending" in node.sortDirection().toString() else key


def top_n(df: DataFrame, order: list[Column], n: int, scratch: Scratch) -> DataFrame:
    """First ``n`` rows, in order, whatever ``n`` is. ``order`` holds numeric keys that are never null, the
    last of them unique.

    The rows are written as they come, the cut is found by counting, and only what is returned is
    sorted: nothing is exchanged for the rest."""
    if n <= 0:
        return df.limit(0)
    keys = [ascending(column).alias(f"_key{i}") for i, column in enumerate(order)]
    keyed = scratch.write(df.select("*", *keys), "rows")
    names = [F.col(f"_key{i}") for i in range(len(order))]
    cut = find_cut(keyed, names, n)
    first = keyed.where(cut.taken)
    if cut.missing:
        first = first.unionByName(keyed.where(cut.pool).orderBy(*names).limit(cut.missing))
    return first.orderBy(*names).select(*df.columns)
