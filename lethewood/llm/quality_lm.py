"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of bytes.

Counts of byte n-grams of the trusted texts are gathered by a shuffle (combined per task), and
the model is made of joins of count tables that are sharded by n-gram: continuation counts from
the next order, discounts from counts of counts, and each order's probabilities from a join
with the order below. A document's score is the sum over its bytes; the model goes to the
scoring tasks in shards by the last byte of the context, as many as its measured size asks
for, each a pass whose partial sums are added per document.

Documents are kept when their mean loss, shrunk to their language's mean as if ``PRIOR_BYTES``
more bytes had been read, is at most ``SLACK`` above the language's quantile among trusted
documents. One trusted document in ``CALIBRATION`` sets the quantile, the others teach the model,
so the limit is not taken from texts that the model knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethewood.sources.scratch import Scratch

ORDER = 5
PRIOR_BYTES = 200
QUANTILE = 0.995
CALIBRATION = 5
SLACK = 0.02
SHARD_ROWS = 8_000_000
BATCH_BYTES = 8_000_000


def _padded(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each behind ``order - 1`` line breaks; which are real; the owner."""
    blobs = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"".join(b"\n" * (order - 1) + b for b in blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs], np.int64)
    real = np.ones(len(data), bool)
    first = np.cumsum(sizes + order - 1) - sizes - (order - 1)
    for step in range(order - 1):
        real[first + step] = False
    return data, real, np.repeat(np.arange(len(sizes)), sizes + order - 1)


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """(gram bigint, n): byte n-grams of the column ``text``, packed big-endian."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                data, real, _ = _padded(batch.column(0).slice(at, 1000).to_pylist(), order)
                packed = np.zeros(len(data), np.int64)
                for back in range(order):
                    packed[back:] |= data[: len(data) - back].astype(np.int64) << (8 * back)
                some, n = np.unique(packed[real], return_counts=True)
                both = np.concatenate([grams, some])
                grams, where = np.unique(both, return_inverse=True)
                counts = np.bincount(where, np.concatenate([counts, n]), len(grams)).astype(np.int64)
                if len(grams) > SHARD_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "n"])
                    grams, counts = grams[:0], counts[:0]
        if len(grams):
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], names=["gram", "n"])

    counted = texts.select("text").mapInArrow(scan, "gram bigint, n bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times; where these are too few
    for the estimate, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = counts
    if not all(counts):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), k) for k, d in enumerate(found, 1)]


@dataclass
class Level:
    """One order: (gram, p) of all seen n-grams and (context, weight) of their contexts."""

    grams: DataFrame
    contexts: DataFrame


def estimate(top: DataFrame, order: int, scratch: Scratch) -> list[Level]:
    """Interpolated probabilities, order 1 first; order 0 is uniform over the 256 bytes."""
    counts = {order: scratch.write(top, "grams")}
    for k in range(order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))
        counts[k] = scratch.write(
            counts[k + 1].groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams"
        )
    levels: list[Level] = []
    for k in range(1, order + 1):
        ones = [F.count(F.when(F.col("n") == i, 1)) for i in range(1, 5)]
        d = discounts(list(counts[k].agg(*ones).first()))
        n = F.col("n")
        cut = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        table = counts[k].withColumns({"context": F.shiftright("gram", 8), "cut": cut})
        contexts = table.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight"))
        joined = table.join(contexts, "context")
        direct = (F.col("n") - F.col("cut")) / F.col("total")
        if k == 1:
            grams = joined.select("gram", (direct + F.col("weight") / 256).alias("p"))
        else:
            below = levels[-1].grams.select(F.col("gram").alias("short"), F.col("p").alias("lower"))
            short = F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))
            grams = joined.withColumn("short", short).join(below, "short").select(
                "gram", (direct + F.col("weight") * F.col("lower")).alias("p")
            )
        levels.append(Level(scratch.write(grams, "level"), scratch.write(contexts.select("context", "weight"), "contexts")))
    return levels


class Shard:
    """Log probabilities of the next byte after every context that ends in certain bytes, as
    dense rows, and the suffix trie that leads from a context to its longest known suffix."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], last: set[int] | None):
        # Code 0 is for bytes that are neither predicted nor a context.
        known = levels[0][0]
        leftmost = [contexts >> (8 * k) for k, (_, _, contexts, _) in enumerate(levels[1:])]
        seen = np.union1d(known, np.concatenate([known[:0], *leftmost]))
        self.codes = np.zeros(256, np.int64)
        self.codes[seen] = np.arange(1, len(seen) + 1)
        width = len(seen) + 1
        uniform = (levels[0][3][0] if len(levels[0][3]) else 1) / 256
        rows = np.full((1, width), uniform)
        rows[0, self.codes[known]] = levels[0][1]
        self.last = np.ones(256, bool)
        if last is not None:
            self.last = np.isin(np.arange(256), list(last))
        tables, self.links = [rows], []
        ids = np.zeros(1, np.int64)
        before = np.zeros(1, np.int64)
        start = 0
        for k, (grams, p, contexts, weights) in enumerate(levels[1:], 1):
            order = np.argsort(contexts)
            contexts, weights = contexts[order], weights[order]
            shorter = contexts & ((1 << (8 * (k - 1))) - 1)
            parent = np.searchsorted(before, shorter)
            rows = weights[:, None] * tables[-1][parent]
            rows[np.searchsorted(contexts, grams >> 8), self.codes[grams & 255]] = p
            # From the id of a suffix, one more byte to the left.
            link = np.full((start + len(before), width), -1, np.int32) if k > 1 else np.full((1, width), -1, np.int32)
            base = start + len(before)
            link[(start + parent), self.codes[contexts >> (8 * (k - 1))]] = base + np.arange(len(contexts))
            self.links.append(link[start:])
            tables.append(rows)
            start, before = base, contexts
        self.starts = np.cumsum([0, *(len(t) for t in tables[:-1])])
        self.table = np.log(np.concatenate(tables)).astype(np.float32)

    def log_sums(self, data: np.ndarray, real: np.ndarray, owner: np.ndarray, documents: int) -> np.ndarray:
        """Sum of log probabilities of each document's bytes whose context is in this shard."""
        codes = self.codes[data]
        at = np.flatnonzero(real)
        if not self.last.all():
            at = at[self.last[data[at - 1]]]
        state = np.zeros(len(at), np.int64)
        best = state.copy()
        alive = np.ones(len(at), bool)
        for back, link in enumerate(self.links, 1):
            if not len(link):
                break
            step = link[np.where(alive, best - self.starts[back - 1], 0), codes[at - back]]
            alive &= step >= 0
            best = np.where(alive, step, best)
        return np.bincount(owner[at], self.table[best, codes[at]], documents).astype(np.float64)


def _shards(levels: list[Level]) -> Iterator[tuple[list, set[int] | None]]:
    """The model in pieces of about ``SHARD_ROWS`` probabilities, by the last context byte; each
    also has the orders without a context byte."""

    def table(k: int, last: set[int] | None) -> tuple[np.ndarray, ...]:
        grams, contexts = levels[k].grams, levels[k].contexts
        if last is not None and k:
            grams = grams.where(F.shiftright("gram", 8).bitwiseAND(F.lit(255)).isin(*last))
            contexts = contexts.where(F.col("context").bitwiseAND(F.lit(255)).isin(*last))
        g, c = grams.orderBy("gram").toArrow(), contexts.orderBy("context").toArrow()
        return tuple(t.column(i).to_numpy() for t in (g, c) for i in (0, 1))

    byte = F.col("context").bitwiseAND(F.lit(255))
    sizes: dict[int, int] = {}
    for level in levels[1:]:
        for r in level.contexts.groupBy(byte.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            sizes[r["b"]] = sizes.get(r["b"], 0) + r["n"] * 128
    if sum(sizes.values()) <= SHARD_ROWS:
        yield [table(k, None) for k in range(len(levels))], None
        return
    # Bytes that are no context are looked for in the first shard, and not found.
    group = set(range(256)) - set(sizes)
    for b, n in sorted(sizes.items(), key=lambda e: (-e[1], e[0])):
        if group and sum(sizes.get(x, 0) for x in group) + n > SHARD_ROWS:
            yield [table(k, group) for k in range(len(levels))], group
            group = set()
        group = group | {b}
    yield [table(k, group) for k in range(len(levels))], group


def losses(docs: DataFrame, levels: list[Level], order: int) -> DataFrame:
    """(doc_id, lang, n_bytes, loss): negative log likelihood of each text. ``docs`` has doc_id,
    lang and text."""
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, row bigint, n_bytes bigint, loss double"
    passes: list[DataFrame] = []
    for tables, last in _shards(levels):
        shard = Shard(tables, last)

        def scan(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    texts = batch.column(3).to_pylist()
                    data, real, owner = _padded(texts, order)
                    sums = shard.log_sums(data, real, owner, len(texts))
                    sizes = np.bincount(owner, real, len(texts)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:3], pa.array(sizes), pa.array(-sums)],
                        names=["doc_id", "lang", "row", "n_bytes", "loss"],
                    )

        # Equal texts have equal losses, so the text's hash tells rows of one id apart.
        rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("row"), "text")
        passes.append(rows.mapInArrow(scan, schema))
    if len(passes) == 1:
        return passes[0].drop("row")
    total = passes[0].withColumn("part", F.lit(0))
    for part, more in enumerate(passes[1:], 1):
        total = total.unionByName(more.withColumn("part", F.lit(part)))
    copies = F.count(F.when(F.col("part") == 0, 1))
    return (
        total.groupBy("doc_id", "lang", "row")
        .agg(F.max("n_bytes").alias("n_bytes"), (F.sum("loss") / copies).alias("loss"), copies.alias("copies"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "lang", "n_bytes", "loss")
    )


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    order: int = ORDER,
    quantile: float = QUANTILE,
) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, keep), one row per row of ``docs`` (doc_id,
    lang, text). ``trusted``: (doc_id) of the texts to learn from.

    Perplexity is per byte. Null and empty texts have a null perplexity and are not kept. A
    language without trusted texts, and the null language if it has none, is judged by the
    quantile over all languages; without any trusted text every other document is kept.
    Repeated rows are judged each; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text")
    good = trusted.select("doc_id").dropna().distinct()
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0
    taught = rows.join(good.where(~aside).hint("shuffle_hash"), "doc_id", "left_semi")
    levels = estimate(count_grams(taught, order), order, scratch)
    scored = scratch.write(losses(rows, levels, order), "losses")
    mean = F.col("loss") / F.col("n_bytes")
    known = scored.where("n_bytes > 0").join(good.where(aside), "doc_id", "left_semi")
    whole = known.agg(F.sum("loss") / F.sum("n_bytes")).first()[0]
    usual = known.groupBy("lang").agg((F.sum("loss") / F.sum("n_bytes")).alias("usual"))

    def shrunk(usual_loss: Column) -> Column:
        return (F.col("loss") + PRIOR_BYTES * usual_loss) / (F.col("n_bytes") + PRIOR_BYTES)

    same = F.col("lang").eqNullSafe(F.col("of"))
    usual = usual.withColumnRenamed("lang", "of")
    table = known.join(usual, same).withColumn("shrunk", shrunk(F.col("usual")))
    limit = F.percentile_approx("shrunk", F.lit(quantile), F.lit(100_000)) * (1 + SLACK)
    limits = table.groupBy("of", "usual").agg(limit.alias("limit"))
    overall = table.agg(limit).first()[0]
    judged = scored.join(limits, same, "left")
    usual_or_all = F.coalesce("usual", F.lit(whole))
    limit_or_all = F.coalesce("limit", F.lit(overall), F.lit(float("inf")))
    some = F.col("n_bytes") > 0
    return judged.select(
        "doc_id",
        "lang",
        "n_bytes",
        F.when(some, F.exp(mean)).alias("perplexity"),
        F.exp(limit_or_all).alias("threshold"),
        (some & F.coalesce(shrunk(usual_or_all) <= limit_or_all, F.lit(True))).alias("keep"),
    )
