"""Test-then-train over a stream: a micro-batch is one version of the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import UnlearningForest



def batch_handler(
    model: UnlearningForest, stream_id: str = "stream"
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function.

    Batch ids belong to one stream and are kept apart from the run's versions, so training,
    forgetting and other streams may come between two batches. A replayed batch is processed
    on the version that it met the first time, and what was forgotten since stays forgotten.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        model.join_stream(stream_id)
        if batch_id == model.counters.last_batch:
            model.replay_batch(batch, batch_id)
        elif batch_id < model.counters.last_batch:
            raise ValueError(f"batch {batch_id} is older than the last one")
        else:
            model.stream_batch(batch, batch_id)

    return handle


def run_stream(model: UnlearningForest, stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Process everything available, one micro-batch per trigger of the source. The checkpoint
    names the stream: a run that goes on from it goes on in the model too."""
    return (
        stream.writeStream.foreachBatch(batch_handler(model, checkpoint))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


FILE_ROWS = 1000


def sliced_source(
    spark: SparkSession, samples: DataFrame, cuts: list[int], folder: str
) -> DataFrame:
    """A file stream whose n-th micro-batch holds the positions of the n-th interval.

    Slices are appended in order, so modification times follow positions. Every slice is
    range-partitioned into the same number of files, and a micro-batch takes that many.
    """
    sizes = [high - low for low, high in zip(cuts[:-1], cuts[1:], strict=True)]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = min(tasks, max(1, min(sizes) // FILE_ROWS))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        rows = samples.where((F.col("position") >= low) & (F.col("position") < high))
        rows.repartitionByRange(files, "position").write.mode("append").parquet(folder)
    reader = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


EMA_OLD, EMA_NEW, EMA_START = 0.8, 0.2, 0.5
EMA_BLOCK = 256  # batches folded by one task; the blocks are then chained


def class_ratio_ema(batches: DataFrame) -> DataFrame:
    """Moving positive share after every batch, from (batch_id, rows, positives).

    0.8 * old + 0.2 * batch share, starting at 0.5. A step is affine, so every block of batches
    is folded from zero by itself; one pair (decay, value) per block is then chained to give
    each block its start. No batch is left out, however old. ``batch_id`` counts from 0
    without gaps.
    """
    share = F.col("positives").cast("double") / F.col("rows").cast("double")
    entry = F.struct("batch_id", share.alias("share"))
    zero = F.struct(
        F.lit(0.0).alias("value"),
        F.array().cast("array<struct<batch_id:bigint,power:double,value:double>>").alias("steps"),
    )

    def step(state: Column, batch: Column) -> Column:
        value = F.lit(EMA_OLD) * state["value"] + F.lit(EMA_NEW) * batch["share"]
        made = F.struct(
            batch["batch_id"].alias("batch_id"),
            F.pow(F.lit(EMA_OLD), F.size(state["steps"]) + 1).alias("power"),
            value.alias("value"),
        )
        return F.struct(value.alias("value"), F.concat(state["steps"], F.array(made)).alias("steps"))

    blocks = (
        batches.select("batch_id", entry.alias("entry"))
        .groupBy(F.expr(f"batch_id div {EMA_BLOCK}").alias("block"))
        .agg(F.sort_array(F.collect_list("entry")).alias("entries"))
        .select("block", F.aggregate("entries", zero, step)["steps"].alias("steps"))
    )
    last = F.element_at("steps", -1)
    links = F.sort_array(F.collect_list(F.struct("block", last["power"].alias("power"), last["value"].alias("value"))))
    start = F.struct(
        F.lit(EMA_START).alias("value"),
        F.array().cast("array<struct<block:bigint,start:double>>").alias("starts"),
    )

    def chain(state: Column, link: Column) -> Column:
        made = F.struct(link["block"].alias("block"), state["value"].alias("start"))
        value = link["power"] * state["value"] + link["value"]
        return F.struct(value.alias("value"), F.concat(state["starts"], F.array(made)).alias("starts"))

    starts = blocks.agg(F.inline(F.aggregate(links, start, chain)["starts"]))
    return (
        blocks.select("block", F.explode("steps").alias("step"))
        .join(starts, "block")
        .select(
            F.col("step.batch_id").alias("batch_id"),
            (F.col("step.power") * F.col("start") + F.col("step.value")).alias("ema"),
        )
    )
