"""Merge on read: a written table and small tables of changed rows over it.

A change replaces the row with its key, or removes it. Reading takes the newest change of each key
and the rows of the base that none touches. After some changes they are folded into a new base.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


@dataclass(frozen=True)
class Layered:
    base: DataFrame
    keys: tuple[str, ...]
    changes: tuple[DataFrame, ...] = ()

    @property
    def view(self) -> DataFrame:
        if not self.changes:
            return self.base
        columns = self.base.columns
        if len(self.changes) == 1:
            newest = self.changes[0]
        else:
            every = [t.withColumn("_v", F.lit(v)) for v, t in enumerate(self.changes)]
            rest = [c for c in [*columns, "gone"] if c not in self.keys]
            grouped = reduce(DataFrame.unionByName, every).groupBy(*self.keys)
            newest = grouped.agg(F.max_by(F.struct(*rest), "_v").alias("_row")).select(*self.keys, "_row.*")
        untouched = self.base.join(newest.select(*self.keys), list(self.keys), "left_anti")
        return untouched.select(*columns).unionByName(newest.where("NOT gone").select(*columns))

    def changed(self, rows: DataFrame, scratch: Scratch, name: str, fold_after: int) -> Layered:
        """``rows``: the base's columns and ``gone``. Only they are written, or, now and then, all."""
        written = scratch.write(rows.select(*self.base.columns, "gone"), f"{name}-changes")
        layered = Layered(self.base, self.keys, (*self.changes, written))
        if len(layered.changes) < fold_after:
            return layered
        return Layered(scratch.write(layered.view, f"model-{name}"), self.keys)
