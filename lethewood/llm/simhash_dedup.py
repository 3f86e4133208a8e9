"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Two
fingerprints that differ in at most two bits have a common neighbour at distance one or less
from both, so every distinct fingerprint emits itself and its 64 one-bit variants, and one
shuffle on the variant brings all close fingerprints together. A group is described by one
64-bit mask (which bit each member flipped), so its buffer has a fixed size, partial
aggregation applies, and no group is ever collected. Members of a group lie within two bits of
each other by the triangle inequality; they are linked to the group's smallest member, the
links are made distinct and their distance is checked again, and components follow.

``similar_groups`` starts from these components and adds pairs by the similarity of their shingle
sets: texts meet in the groups of their rarest shingles, and pairs are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethewood.llm.graph import connected_components
from lethewood.llm.rolling import Rolling
from lethewood.sources.scratch import Scratch

SEED = 42
BITS = 64
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Majority fingerprint of one text, as a signed 64-bit integer. Only A-Z are lower-cased;
    words are separated by ASCII white space. Fewer words than a shingle: the whole sequence
    is the only shingle. No words, or null: zero."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        pieces: Iterator[bytes] = iter([b" ".join(words)])
        total = 1
    else:
        total = len(words) - shingle + 1
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(piece, SEED) for piece in pieces), np.uint64, total)
    ones = np.zeros(BITS, np.int64)
    for start in range(0, total, _CHUNK):
        octets = hashes[start : start + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > total, bitorder="little")
    return int(majority.view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp bigint), one row per row of ``docs``; only the two columns are read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"]
            )

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(scan, "id bigint, fp bigint")


def _flip(value: Column, bit: Column) -> Column:
    return value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))


def close_pairs(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (table, u, v) among the distinct fingerprints in (table, fp), of ``bits`` bits:
    enough of the pairs at distance 1 or 2 within a table that components of the links are
    components of all such pairs."""
    one = F.lit(1).cast("bigint")
    flips = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("bit")
    # Dealt out first, to a fixed number of tasks: a fingerprint becomes ``bits + 1`` rows, too
    # many for the few tasks that the small table of distinct fingerprints would get.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = fps.repartition(tasks, "table", "fp").select("table", "fp", flips).select(
        "table",
        F.when(F.col("bit") < bits, _flip(F.col("fp"), F.col("bit"))).otherwise(F.col("fp")).alias("variant"),
        F.when(F.col("bit") < bits, F.call_function("shiftleft", one, F.col("bit")))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("flipped"),
    )
    groups = (
        variants.groupBy("table", "variant")
        .agg(
            F.bit_or("flipped").alias("mask"),
            F.max((F.col("flipped") == 0).cast("int")).alias("itself"),
        )
        .where(F.bit_count("mask") + F.col("itself") >= 2)
    )
    flipped = F.filter(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        lambda i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(one) == 1,
    )
    members = F.concat(
        F.transform(flipped, lambda i: _flip(F.col("variant"), i)),
        F.when(F.col("itself") == 1, F.array("variant")).otherwise(F.array().cast("array<bigint>")),
    )
    return (
        groups.select("table", members.alias("members"))
        .select("table", F.array_min("members").alias("u"), F.explode("members").alias("v"))
        .where("u <> v")
        .distinct()
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2)
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """(doc_id, fp bigint, fingerprint hex string, component_id), one row per row of ``docs``.

    Documents are linked when their fingerprints differ in at most two bits; component_id is
    the smallest id reachable, a document's own id included. Null and empty texts have
    fingerprint zero and are linked like any other. Rows with a null id are linked too but are
    nobody's smallest id: a component of null ids only has a null component_id. Repeated rows
    are kept. Other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession, free_shuffles=True)
    rows = scratch.write(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct")
    links = close_pairs(distinct.withColumn("table", F.lit(0)))
    labels = connected_components(links, scratch).withColumnRenamed("node", "fp")
    smallest = labels.join(distinct, "fp").groupBy("label").agg(F.min("first_id").alias("reach"))
    reach = scratch.write(
        distinct.join(labels.join(smallest, "label").select("fp", "reach"), "fp", "left").select(
            "fp", F.coalesce("reach", "first_id").alias("component_id")
        ),
        "components",
    )
    return rows.join(reach, "fp").select(
        F.col("id").alias("doc_id"),
        "fp",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


# Shingle sets: texts of a slice at a time; the shingles a task adds up before it sends them on,
# the text bytes whose shingles are counted in one group, and how many counts go to the tasks.
SLICE_ROWS = 200
FLUSH_SHINGLES = 1 << 21
COUNT_BYTES = 16_000_000
KNOWN = 1 << 20
# Counts are told apart in so many steps per doubling.
STEPS = 8
# A cell's side: so many texts and, on average, so many shingles.
CELL_TEXTS = 1024
CELL_SHINGLES = 1 << 18
# Cells are compared in rounds; those of one round hold so many bytes of shingles for each byte of text,
# and this many in any case.
ROUND_SHARE = 0.5
ROUND_BYTES = 64_000_000
_ROUNDING = 1e-9


def shingle_sets(texts: list[str | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of each text. Words as in ``fingerprint``; a text
    of fewer words than a shingle has one shingle, one without words has none."""
    words = [text.encode().lower().split() if text else [] for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for ws in words for w in ws), np.uint64, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    rolling = Rolling(hashes).windows(shingle)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(rolling)]
    inside = (starts + sizes)[owner] - np.arange(len(rolling)) >= shingle
    short = np.flatnonzero((sizes > 0) & (sizes < shingle))
    owner = np.concatenate([owner[inside], short])
    whole = [Rolling(hashes[starts[i] : starts[i] + sizes[i]]).windows(int(sizes[i]))[0] for i in short]
    shingles = np.concatenate([rolling[inside], np.array(whole, np.uint64)])
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (np.diff(owner) != 0) | (np.diff(shingles) != 0)
    return owner[new], shingles[new]


def rare_shingles(
    texts: list[str | None], shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray], mask: int = (1 << 64) - 1
) -> tuple[np.ndarray, pa.Array]:
    """Number of distinct shingles of each text, and the first of them (eight bytes each) in the
    order of (``common`` count, hash): so many that a text which shares none of them has less
    than ``similarity`` of the shingles in common. ``common`` knows the bits in ``mask``."""
    owner, shingles = shingle_sets(texts, shingle)
    known, times = common
    count = np.zeros(len(shingles), np.int64)
    if len(known):
        asked = shingles & np.uint64(mask)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        count = np.where(known[at] == asked, times[at], 0)
    order = np.lexsort((shingles, count, owner))
    n = np.bincount(owner, minlength=len(texts))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    most = np.where(n > 0, n - np.ceil(similarity * n - _ROUNDING).astype(np.int64) + 1, 0)
    first = np.ascontiguousarray(shingles[order][place < most[owner]])
    offsets = np.zeros(len(texts) + 1, np.int32)
    np.cumsum(most * 8, out=offsets[1:])
    return n, pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(first)])


def _shingle_set(text: str, shingle: int) -> set[bytes]:
    words = text.encode().lower().split()
    if len(words) <= shingle:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))


def _common_shingles(source: DataFrame, shingle: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles that several texts hold, sorted, with the step of their count, and the bits of a
    shingle that are kept. All texts are counted: tasks add up what they read and send on packed
    arrays, by the shingle's upper bits, so that a group stays at ``COUNT_BYTES`` of text. At
    most ``KNOWN`` are returned, the most frequent ones, cut between two steps. Only the cost of
    the search depends on these counts, not what it finds."""
    total = source.agg(F.sum(F.col("text_size").cast("bigint"))).first()[0] or 0
    bits = min(31, int(total // COUNT_BYTES).bit_length())
    mask = ((1 << bits) - 1) << (64 - bits) | 0xFFFFFFFF

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        part = found >> np.uint64(64 - bits) if bits else np.zeros(len(found), np.uint64)
        parts, starts = np.unique(part, return_index=True)
        ends = np.append(starts[1:], len(found))
        low, times = found.astype(np.uint32), times.astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(parts.astype(np.int64)),
                *(pa.array([x[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for x in (low, times)),
            ],
            names=["part", "low", "times"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                held.append(shingle_sets(whole.column(0).slice(at, SLICE_ROWS).to_pylist(), shingle)[1])
                size += len(held[-1])
                if size >= FLUSH_SHINGLES:
                    yield packed(held)
                    held, size = [], 0
        if size:
            yield packed(held)

    def add_up(rows: pa.Table) -> pa.Table:
        low, times = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint32) for c in ("low", "times"))
        order = np.argsort(low)
        low, times = low[order], times[order]
        starts = np.flatnonzero(np.append(True, np.diff(low) != 0))
        n = np.add.reduceat(times.astype(np.int64), starts)
        upper = np.uint64(rows.column("part")[0].as_py() << (64 - bits) if bits else 0)
        found = (low[starts[n > 1]].astype(np.uint64) | upper).view(np.int64)
        step = np.floor(STEPS * np.log2(n[n > 1])).astype(np.int32)
        return pa.table({"shingle": pa.array(found), "step": pa.array(step)})

    parts = source.select("text").mapInArrow(count, "part bigint, low binary, times binary")
    counts = scratch.write(parts.groupBy("part").applyInArrow(add_up, "shingle bigint, step int"), "counts")
    left, least = KNOWN, 1 << 30
    for row in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        left -= row["count"]
        if left < 0:
            break
        least = row["step"]
    seen = counts.where(F.col("step") >= least).toArrow()
    known, steps = seen.column(0).to_numpy().view(np.uint64), seen.column(1).to_numpy().astype(np.int16)
    scratch.drop(counts)
    order = np.argsort(known)
    return known[order], steps[order], mask


def _may_be_alike(similarity: float) -> Column:
    """Whether texts that meet at places ``u_place`` and ``v_place`` (from 0) of their orders
    have enough shingles left there."""
    left = 1 + F.least(F.col("u_n") - F.col("u_place") - 1, F.col("v_n") - F.col("v_place") - 1)
    return left >= similarity / (1 + similarity) * (F.col("u_n") + F.col("v_n")) - _ROUNDING


def _cell_links(cell: pa.Table, similarity: float) -> pa.Table:
    """Links between alike texts of one cell: as many as join the components that alike texts
    bring together, not all pairs. A cell without a second side is compared with itself."""
    side = cell.column("side").to_numpy()
    node, label = cell.column("node").to_numpy(), cell.column("label").to_numpy().copy()
    sets = [np.frombuffer(blob, np.uint64) for blob in cell.column("shingles").to_pylist()]
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    other = other if len(other) else own
    # Where each shingle occurs on the second side: places start[i] to start[i + 1] of ``holder``.
    held = np.concatenate([sets[i] for i in other])
    order = np.argsort(held, kind="stable")
    holder = np.repeat(np.arange(len(other)), n[other])[order]
    known, start = np.unique(held[order], return_index=True)
    start = np.append(start, len(held))
    us, vs = [], []
    for a in own:
        if not (label[other] != label[a]).any():
            continue
        mine = sets[a]
        at = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
        at = at[known[at] == mine] if len(known) else at[:0]
        times = start[at + 1] - start[at]
        steps = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        both = np.bincount(holder[np.repeat(start[at], times) + steps], minlength=len(other))
        alike = both >= similarity * (n[a] + n[other] - both) - _ROUNDING
        hits = other[alike & (label[other] != label[a])]
        # One link to each component is enough; what it joins has one label from then on.
        joined, first = np.unique(label[hits], return_index=True)
        us += np.minimum(node[a], node[hits[first]]).tolist()
        vs += np.maximum(node[a], node[hits[first]]).tolist()
        if len(joined):
            label[np.isin(label, joined)] = label[a]
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """(text_hash, text_size, component): groups of texts joined by fingerprints within two bits, as
    ``near_duplicates`` finds them, and by pairs with a shingle similarity of ``similarity`` or
    more. ``component`` identifies the group.

    The components of the fingerprints come first. Then every text lists its rarest shingles, so many that two texts at the similarity share one of
    them whatever the size of the table; texts that share one meet in its group. Each group's
    members are compared with its smallest one first. Where this leaves a group in more than one
    component, all its pairs across components are compared, in cells of bounded size that hold
    the shingle sets and answer with the links that join components; pairs are never rows. Such a pair
    counts only by the exact similarity of its texts. All empty and null texts are one text. Null and repeated ids do not matter here.
    """
    scratch = Scratch(docs.sparkSession, free_shuffles=True)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(
        F.col(id_col).cast("string").alias("id"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("text_size"), text.alias("text")
    )
    known, steps, mask = _common_shingles(source, shingle, scratch)

    def list_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                n, rare = rare_shingles(batch.column(2).to_pylist(), shingle, similarity, (known, steps), mask)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), rare], names=["text_hash", "text_size", "n", "rare"]
                )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                blobs = batch.column(2).to_pylist()
                sizes = np.array([len(b) // 8 for b in blobs], np.int64)
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns = [np.frombuffer(b"".join(blobs), np.int64), *(batch.column(c).to_numpy()[row] for c in (0, 1)), place]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "node", "n", "place"])

    # Nodes are texts; one 64-bit number stands for (hash, size).
    node = F.xxhash64("text_hash", "text_size").alias("node")
    listed = source.select("text_hash", "text_size", "text").mapInArrow(list_rare, "text_hash bigint, text_size int, n bigint, rare binary")
    nodes = scratch.write(listed.distinct().select("*", node), "nodes")
    places = nodes.select("node", "n", "rare").mapInArrow(spread, "shingle bigint, node bigint, n bigint, place bigint")
    groups = scratch.write(
        places.groupBy("shingle").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1"), "groups"
    )
    met = scratch.write(places.join(groups, "shingle"), "met")

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, held = [], (None, set())
            for u, x, y, a, b in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True):
                if held[0] != u:
                    held = (u, set(memoryview(a).cast("q")))
                most = len(held[1].intersection(memoryview(b).cast("q"))) + max(x - len(a) // 8, y - len(b) // 8)
                keep.append(most >= similarity / (1 + similarity) * (x + y) - _ROUNDING)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, held = [], (None, set())
            for a, b, one, other in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if held[0] != a:
                    held = (a, _shingle_set(one, shingle))
                more = _shingle_set(other, shingle)
                both = len(held[1] & more)
                keep.append(both >= similarity * (len(held[1]) + len(more) - both) - _ROUNDING)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        # Texts are moved only for pairs whose rarest shingles leave the similarity possible.
        lists = [nodes.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("rare").alias(f"{end}_rare")) for end in "uv"]
        listed = pairs.distinct().join(lists[0], "u").join(lists[1], "v").select("u", "v", "u_n", "v_n", "u_rare", "v_rare")
        pairs = scratch.write(listed.mapInArrow(sieve, "u bigint, v bigint"), "candidates")
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        texts = source.select(node, "text").join(wanted, "node", "left_semi").dropDuplicates(["node"])
        texts = scratch.write(texts, "texts")
        ends = [texts.select(F.col("node").alias(end), F.col("text").alias(f"{end}_text")) for end in "uv"]
        rows = pairs.join(ends[0], "u").join(ends[1], "v").select("u", "v", "u_text", "v_text")
        links = scratch.write(rows.mapInArrow(check, "u bigint, v bigint"), "links")
        scratch.drop(texts)
        return links

    def side(rows: DataFrame, end: str) -> DataFrame:
        return rows.select("shingle", *(F.col(c).alias(f"{end}_{c}") for c in rows.columns if c in ("node", "n", "place", "label")))

    ordered = [f("u_node", "v_node").alias(end) for f, end in ((F.least, "u"), (F.greatest, "v"))]
    alike = _may_be_alike(similarity)
    stars = side(met.where("node = first"), "u").join(side(met.where("node <> first"), "v"), "shingle").where(alike)
    prints = near_duplicates(source.select(node, "text"), "node", "text")
    bound = prints.select(F.col("component_id").alias("u"), F.col("doc_id").alias("v")).where("u <> v").distinct()
    bound = scratch.write(bound, "bound").select(F.col("v").alias("node"), F.col("u").alias("label"))

    def joined(names: DataFrame, links: DataFrame) -> DataFrame:
        """``names`` (node, label) when its groups are joined by ``links`` (u, v) as well. A group's label is one
        of its nodes; a node without a row is a group of its own. Only links between groups are followed."""
        ends = [names.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")).hint("merge") for end in "uv"]
        sides = [F.coalesce(f"{end}_label", end).alias(end) for end in "uv"]
        between = scratch.write(links.join(ends[0], "u", "left").join(ends[1], "v", "left").select(*sides).where("u <> v"), "between")
        if between.isEmpty():
            return names
        found = connected_components(between, scratch)
        first = found.groupBy("label").agg(F.min("node").alias("name"))
        renamed = scratch.write(found.join(first.hint("merge"), "label").select(F.col("node").alias("label"), "name"), "renamed")
        moved = names.join(renamed.hint("merge"), "label", "left").select("node", F.coalesce("name", "label").alias("label"))
        alone = renamed.select(F.col("label").alias("node"), F.col("name").alias("label"))
        return scratch.write(moved.unionByName(alone).where("node <> label").distinct(), "named")

    # Groups of two are settled by their one pair; labels are nodes, so that they never collide.
    named = joined(bound, verified(stars.select(*ordered)))
    larger = scratch.write(
        met.where("members > 2").join(named, "node", "left").select("shingle", "node", "n", "place", "members", F.coalesce("label", "node").alias("label")),
        "larger",
    )
    scratch.drop(met)
    # The shingles of one passage bring the same texts together: the first of them stands for all.
    traits = [F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", "n")), F.sum("n")]
    same = [name.alias(f"trait_{i}") for i, name in enumerate(traits)]
    open_groups = larger.groupBy("shingle", "members").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("place", "node").alias("first_place"), *same
    )
    chosen = (
        open_groups.where("low <> high")
        .groupBy("members", "trait_0", "trait_1", "trait_2")
        .agg(F.min_by("shingle", F.struct("first_place", "shingle")).alias("shingle"))
        .select("shingle")
    )
    # Alike texts lie in one size class or in two neighbouring ones; a band holds a class and the
    # next. Bands without a member of their own class repeat pairs of the next band.
    size_class = F.floor(F.log("n") / (np.log(1 / similarity) + 1e-6)).cast("int").alias("size_class")
    banded = larger.join(chosen, "shingle").select("shingle", "node", "n", "place", "label", size_class)
    banded = scratch.write(banded.withColumn("band", F.explode(F.array(F.col("size_class"), F.col("size_class") - 1))), "banded")
    # A pair is compared where its first common shingle is; a member that comes too late in its own
    # order to be alike even to the smallest text it meets there has its pairs in other groups.
    smallest = banded.groupBy("shingle", "band").agg(F.min("n").alias("smallest"))
    partner = F.greatest(F.col("smallest").cast("double"), similarity * F.col("n"))
    early = F.col("n") - F.col("place") >= similarity / (1 + similarity) * (F.col("n") + partner) - _ROUNDING
    banded = scratch.write(banded.join(smallest, ["shingle", "band"]).where(early).drop("smallest", "place"), "early")
    chunks = F.ceil(F.greatest(F.count(F.lit(1)) / CELL_TEXTS, F.sum("n") / CELL_SHINGLES)).cast("int").alias("chunks")
    bands = (
        banded.groupBy("shingle", "band")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("size_class").alias("least"), chunks)
        .where("low <> high and least = band")
        .select("shingle", "band", "chunks")
    )
    unsettled = scratch.write(banded.join(bands, ["shingle", "band"]).select("shingle", "band", "node", "n", "label", "chunks"), "unsettled")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                owner, shingles = shingle_sets(batch.column(1).to_pylist(), shingle)
                ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                blobs = [shingles[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    # Written first, so that its size is known before texts are moved to meet it.
    wanted = scratch.write(unsettled.select("node").distinct(), "wanted")
    texts = source.select(node, "text").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    sets = scratch.write(texts.mapInArrow(whole_sets, "node bigint, shingles binary"), "sets")
    own = F.pmod(F.xxhash64(F.lit(1), F.col("node")), F.col("chunks")).cast("int")
    first = F.transform(F.sequence(F.col("own"), F.col("chunks") - 1), lambda i: F.struct(F.lit(0).alias("side"), F.col("own").alias("a"), i.alias("b")))
    second = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: F.struct(F.lit(1).alias("side"), i.alias("a"), F.col("own").alias("b")))
    dealt = unsettled.withColumn("own", own).withColumn("cell", F.explode(F.when(F.col("own") > 0, F.concat(first, second)).otherwise(first)))
    dealt = dealt.select("shingle", "band", "node", "label", "cell.*")
    # A text goes to as many cells as its group has chunks, so all cells together may be far larger than
    # the input: they are dealt out to rounds, and the next one starts when the last one's files are gone.
    moved = unsettled.agg(F.sum(8 * F.col("n") * F.col("chunks"))).first()[0] or 0
    room = max(ROUND_BYTES, ROUND_SHARE * (nodes.agg(F.sum(F.col("text_size").cast("bigint"))).first()[0] or 0))
    rounds = max(1, ceil(moved / room))
    round_ = F.pmod(F.xxhash64("shingle", "band", "a", "b"), F.lit(rounds))
    joining = None
    for i in range(rounds):
        cells = dealt.where(round_ == i).join(sets, "node")
        found = cells.groupBy("shingle", "band", "a", "b").applyInArrow(lambda table: _cell_links(table, similarity), "u bigint, v bigint")
        found = scratch.write(found.distinct(), "joining")
        joining = found if joining is None else joining.unionByName(found)
    scratch.drop(sets)
    named = joined(named, verified(joining))
    groups = nodes.join(named, "node", "left").select("text_hash", "text_size", F.coalesce("label", "node").alias("component"))
    groups = scratch.write(groups, "components")
    scratch.drop(nodes)
    return groups


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document of each group of ``similar_groups``: the one with
    the smallest id (null ids last), of equal ids the one with the smallest text hash, of
    repeated rows any one. Columns are unchanged, whatever their names."""
    groups = similar_groups(docs, id_col, text_col, shingle, similarity)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {
        "no_id": F.col(id_col).isNull(),
        "id": F.coalesce(F.col(id_col).cast("bigint"), F.lit(0)),
        "text_hash": F.xxhash64(text),
        "text_size": F.octet_length(text),
    }
    rows = docs.select(F.struct("*").alias("row"), *(key.alias(name) for name, key in keys.items()))
    chosen = (
        rows.select(*keys)
        .distinct()
        .join(groups, ["text_hash", "text_size"])
        .groupBy("component")
        .agg(F.min(F.struct(*keys)).alias("best"))
        .select("best.*")
    )
    # Repeated rows and the choice meet on the same keys, so texts are moved once.
    return rows.dropDuplicates(list(keys)).join(chosen, list(keys), "left_semi").select("row.*")
