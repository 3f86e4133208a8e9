"""Versioned state of a run: immutable tables plus one small manifest per version.

Samples are append-only: a version adds a part with new rows and a part with removed ids.
Everything a version needs is reachable from its manifest. Versions only grow; which stream
batch a version belongs to, and the version that batch started from, are kept beside it.

Removed rows leave the storage in two steps: files that hold some are written anew without them,
and a retention pass deletes what no kept manifest reaches.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

COMPACT_PARTS = 16
MERGE_PARTS = 8
# The version a batch started from, when that was erased after the batch.
ERASED = -2
Part = tuple[int, tuple[str, ...]]


@dataclass(frozen=True)
class SampleParts:
    """Live samples as (version, paths) lists of additions and removals; a path is a table's folder or
    one of its files."""

    schema: str
    added: tuple[Part, ...] = ()
    removed: tuple[Part, ...] = ()

    def live(self, spark: SparkSession) -> DataFrame:
        """Rows not removed in or after the version that added them."""
        if not self.added:
            return spark.createDataFrame([], self.schema)

        rows = _union(spark, self.added, self.schema)
        if self.removed:
            rows = rows.join(self._gone(spark), "sample_id", "left").where("_gone IS NULL OR _gone < _v").drop("_gone")
        return rows.drop("_v")

    def _gone(self, spark: SparkSession) -> DataFrame:
        """The newest version that removed an id."""
        return _union(spark, self.removed, "sample_id BIGINT").groupBy("sample_id").agg(F.max("_v").alias("_gone"))

    def without_removed(self, scratch: Scratch) -> SampleParts:
        """The same live samples, in files that hold no other rows. Ids alone are read to find the files
        that hold removed ones; only those are written anew."""
        if not self.removed:
            return self
        spark = scratch.spark
        gone = scratch.write(self._gone(spark), "gone")
        added: list[Part] = []
        for version, paths in self.added:
            dead = gone.where(F.col("_gone") >= version).select("sample_id")
            table = spark.read.schema(self.schema).parquet(*paths)
            ids = table.select("sample_id", F.col("_metadata.file_path").alias("_file"))
            held = {r["_file"] for r in ids.join(dead, "sample_id", "left_semi").select("_file").distinct().collect()}
            if held:
                touched = {_plain(path) for path in held}
                whole = tuple(path for path in table.inputFiles() if _plain(path) not in touched)
                rest = spark.read.schema(self.schema).parquet(*sorted(held)).join(dead, "sample_id", "left_anti")
                paths = (*whole, scratch.save(rest, "samples"))
            added.append((version, paths))
        return SampleParts(self.schema, tuple(added))

    def changed(
        self, version: int, scratch: Scratch, added: DataFrame | None, removed: DataFrame | None
    ) -> SampleParts:
        """Append tables with (at least) the columns of the schema."""
        parts = self
        if added is not None:
            path = scratch.saved(added, "samples")
            parts = SampleParts(self.schema, (*parts.added, (version, (path,))), parts.removed)
        if removed is not None:
            path = scratch.saved(removed, "removed")
            parts = SampleParts(self.schema, parts.added, (*parts.removed, (version, (path,))))
        if len(parts.added) + len(parts.removed) > COMPACT_PARTS:
            path = scratch.save(parts.live(scratch.spark), "samples")
            parts = SampleParts(self.schema, ((version, (path,)),))
        return parts


def _plain(uri: str) -> str:
    """A path without its scheme, which is spelled in several ways."""
    return unquote(urlparse(uri).path)


def _union(spark: SparkSession, parts: tuple[Part, ...], schema: str) -> DataFrame:
    tables = [
        spark.read.schema(schema).parquet(*paths).withColumn("_v", F.lit(version)) for version, paths in parts
    ]
    return reduce(DataFrame.unionByName, tables)


@dataclass(frozen=True)
class LogPart:
    """A part of a log: how often it was merged, and the stream positions it spans."""

    path: str
    tier: int = 0
    low: int = 0
    high: int = 0


def merged(parts: list[LogPart], merge: Callable[[list[str]], str]) -> list[LogPart]:
    """Whenever the last ``MERGE_PARTS`` are of one tier, ``merge`` makes them one part of the next. A
    log of n entries has some ``MERGE_PARTS`` * log n parts, and an entry is rewritten log n times."""
    while len(parts) >= MERGE_PARTS and len({part.tier for part in parts[-MERGE_PARTS:]}) == 1:
        last = parts[-MERGE_PARTS:]
        path = merge([part.path for part in last])
        whole = LogPart(path, last[0].tier + 1, min(p.low for p in last), max(p.high for p in last))
        parts = [*parts[:-MERGE_PARTS], whole]
    return parts


@dataclass
class Counters:
    """Scalars of a run; a new run starts all of them at zero. The last four count predictions."""

    version: int = -1
    position: int = 0
    total_samples: int = 0
    total_registered: int = 0
    warmed_up: bool = False
    pretrained: bool = False
    influence_batches: int = 0
    distance_rows: int = 0
    rebuild_rows: int = 0
    positive_ema: float = 0.5
    add_marks: int = 0
    forget_marks: int = 0
    log_seq: int = 0
    stream_id: str = ""
    last_batch: int = -1
    batch_parent: int = -1
    tn: int = 0
    fp: int = 0
    fn: int = 0
    tp: int = 0


@dataclass
class Manifest:
    counters: Counters
    samples: SampleParts
    tables: dict[str, str]
    logs: dict[str, list[LogPart]] = field(default_factory=dict)
    # Change tables over some of ``tables``, and the parts of the leaf map if there is one.
    changes: dict[str, list[str]] = field(default_factory=dict)
    leaves: list[str] | None = None

    def paths(self) -> set[str]:
        """Every folder and file the version needs."""
        parts = (*self.samples.added, *self.samples.removed)
        lists = [paths for _, paths in parts] + [*self.changes.values(), self.leaves or []]
        logs = [part.path for log in self.logs.values() for part in log]
        return {*self.tables.values(), *logs, *(path for paths in lists for path in paths)}

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        parts = raw["samples"]
        return cls(
            Counters(**raw["counters"]),
            SampleParts(
                parts["schema"],
                tuple((v, tuple(p)) for v, p in parts["added"]),
                tuple((v, tuple(p)) for v, p in parts["removed"]),
            ),
            raw["tables"],
            {name: [LogPart(**part) for part in log] for name, log in raw["logs"].items()},
            raw["changes"],
            raw["leaves"],
        )


class Manifests:
    """Manifest files under ``<path>/manifest/v=N``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, manifest: Manifest) -> None:
        row = self.spark.createDataFrame([(manifest.to_json(),)], "value STRING").coalesce(1)
        row.write.mode("overwrite").text(f"{self.path}/manifest/v={manifest.counters.version}")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        files = self._files(path)
        if not files.exists(self._path(path)):
            return []
        return [status.getPath().toString() for status in files.listStatus(self._path(path))]

    def versions(self) -> list[int]:
        """All versions written under this path, in order."""
        names = [child.rsplit("/", 1)[1] for child in self._children(f"{self.path}/manifest")]
        return sorted(int(name[2:]) for name in names if name.startswith("v="))

    def latest(self) -> int:
        """The newest version written under this path, -1 if there is none."""
        return max(self.versions(), default=-1)

    def read(self, version: int) -> Manifest:
        rows = self.spark.read.text(f"{self.path}/manifest/v={version}", wholetext=True)
        return Manifest.from_json(rows.first()["value"])

    def retain(self, keep: int, folders: list[str]) -> int:
        """Keep the newest ``keep`` versions, at least one, and the one a replay of the newest's batch would
        start from; delete the others, and from the tables in ``folders`` every file that none of the
        kept reaches. Returns how many tables and files went. Nothing may be writing there meanwhile."""
        versions = self.versions()
        if not versions:
            return 0
        parent = self.read(versions[-1]).counters.batch_parent
        kept = [v for v in versions if v in versions[-max(1, keep) :] or v == parent]
        reached = {self._uri(path) for version in kept for path in self.read(version).paths()}
        whole_or_part = {path.rsplit("/", 1)[0] for path in reached}
        deleted = 0
        for version in set(versions) - set(kept):
            self._delete(f"{self.path}/manifest/v={version}")
        for table in (child for folder in folders for child in self._children(folder)):
            table_uri = self._uri(table)
            if table_uri in reached or table_uri.rsplit("/", 1)[1] == "manifest":
                continue
            if table_uri not in whole_or_part:
                self._delete(table)
                deleted += 1
                continue
            for file in self._children(table):
                if self._uri(file) not in reached:
                    self._delete(file)
                    deleted += 1
        return deleted

    def _uri(self, path: str) -> str:
        """One spelling for every path."""
        return self._files(path).makeQualified(self._path(path)).toUri().getPath()

    def _delete(self, path: str) -> None:
        self._files(path).delete(self._path(path), True)
