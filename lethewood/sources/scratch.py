"""Intermediate tables in the folder the cluster shares.

Iterative jobs cut their lineage by writing a table and reading it back, so a lost
executor costs a re-read and never a recomputation of earlier levels.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTING = "spark.checkpoint.dir"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only for local masters."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="lethewood-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scratch:
    """A private sub-folder for the tables of one run. ``free_shuffles``: the shuffle files of a write go
    with its end; else they stay until the driver happens to collect its garbage."""

    def __init__(self, spark: SparkSession, folder: str | None = None, free_shuffles: bool = False):
        self.spark = spark
        self.free_shuffles = free_shuffles
        self.root = f"{folder or shared_folder(spark)}/run-{uuid.uuid4().hex}"
        self._paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str) -> str:
        path = self.path(name)
        if not self.free_shuffles:
            df.write.parquet(path)
            return path
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(FREE_SHUFFLES)
            else:
                self.spark.conf.set(FREE_SHUFFLES, before)
        return path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write once, read back with a known schema."""
        return self.open(self.save(df, name), df.schema)

    def open(self, path: str, schema: StructType | str) -> DataFrame:
        """A table written before; ``saved`` knows where it is."""
        table = self.spark.read.schema(schema).parquet(path)
        self._paths[table] = path
        return table

    def saved(self, df: DataFrame, name: str) -> str:
        """Path of a table; one that ``write`` or ``open`` returned is not written again."""
        return self._paths.get(df) or self.save(df, name)

    def drop(self, df: DataFrame) -> None:
        """Delete a table this run wrote, once nothing reads it any more."""
        folder = self._paths.get(df)
        if folder is not None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
