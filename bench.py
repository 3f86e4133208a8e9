"""Headline timings: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import buffer_queries as BQ  # noqa: E402
from catalog.common import EVENT, LINE, forgotten, samples  # noqa: E402
from lethewood.api import UnlearningForest  # noqa: E402
from lethewood.operators import evaluation, influence, scoring  # noqa: E402
from lethewood.operators import model as M  # noqa: E402
from lethewood.plans import growth, maintenance  # noqa: E402
from lethewood.sources.scratch import Scratch  # noqa: E402

HEADLINE = (
    "budget_evict",
    "memory_evict",
    "sliding_metrics",
    "lifecycle",
    "age_influence_spearman",
    "feature_distance",
)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lethewood-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        result = work()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    lines = samples("line", spark, folder)
    scratch = Scratch(spark)
    gone = forgotten("line", spark, folder)
    timed("samples", lambda: drain(lines))
    forest = timed("forest_fit", lambda: growth.fit(lines, LINE, scratch))
    timed("predict", lambda: drain(scoring.predict(forest, lines)))
    one = scratch.write(gone.orderBy("sample_id").limit(1), "one")
    few = timed("forget_one", lambda: maintenance.forget(forest, one))
    timed("resolve_one", lambda: maintenance.resolve(few.forest))
    delta = timed("forget_batch", lambda: maintenance.forget(forest, gone))
    settled = timed("resolve_all", lambda: maintenance.resolve(delta.forest))
    kept = lines.join(gone, "sample_id", "left_anti")
    retrained = timed("retrain", lambda: growth.fit(kept, LINE, scratch))
    differences = M.node_difference(settled.nodes, retrained.nodes).count()
    mapped = timed("with_leaves", lambda: maintenance.with_leaves(forest))
    under = mapped.nodes.where("depth = 3").orderBy("tree_id", "node_id").limit(1)
    stale = scratch.write(under.select("tree_id", "node_id", "depth"), "stale")
    timed("rows_below_one_node", lambda: drain(mapped.leaves.below(spark, stale, [3])))
    added = timed("add_samples", lambda: maintenance.add(settled, lines.drop("position")))
    timed("resolve_after_add", lambda: maintenance.resolve(added.forest))
    timed("all_influences", lambda: drain(influence.all_influences(forest, lines)))
    timed(
        "metrics_from_predictions",
        lambda: evaluation.cumulative_metrics(scoring.predict(forest, lines)).collect(),
    )
    events = samples("event", spark, folder)
    run = UnlearningForest(spark, EVENT.with_(max_depth=2))
    run.fit(events.where("position < 20000"))
    batch = scratch.write(events.where("position >= 20000 AND position < 21000"), "batch")
    timed("stream_batch_1000", lambda: run.stream_batch(batch))
    for name in HEADLINE:
        timed(name, lambda name=name: drain(BQ.Q[name].run(spark, folder)))
    rows = lines.agg(F.count(F.lit(1))).first()[0]
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "forget_vs_retrain_node_differences": differences,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
