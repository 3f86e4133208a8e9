"""Removal of long passages that occur more than once, by prefix-partitioned suffix trees.

Every suffix of the corpus that has at least ``window`` words goes to the subtree of a prefix
of variable length: from the suffix's first word to the end of its anchor, the ``ANCHOR``-word
group with the smallest hash among its first ``window`` words. Equal suffix heads have equal
anchors, so they meet in one subtree, and consecutive suffixes mostly share an anchor, so they
travel as one row: position once, then five bytes per suffix. Below the prefix the tree is cut
at depth ``window``; an edge is compared through the fingerprint of the whole head (the 64 bits
of the prefix plus 40 bits of the head), because the words themselves would be many times the
input. An internal node at that depth, two or more suffixes with the same head, is a repeat;
consecutive repeated suffixes of a document merge into maximal repeats.

Subtrees are memory-sized: a task reads its suffixes in prefix order and settles them group by
group. A head that occurs often within one batch of documents is settled there, and only one
witness of it travels, so a passage in a third of all documents sends a row per batch, not per
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethewood.llm.rolling import Rolling, mix, runs, sliding_min

ANCHOR = 10
BATCH_WORDS = 1_000_000
GROUP_SUFFIXES = 1_000_000
_HEAD_BYTES = 5
_POSITION = np.uint64((1 << 30) - 1)
_SUFFIXES = "prefix bigint, text_hash bigint, text_size int, start int, settled int, heads binary"
_REPEATS = "text_hash bigint, text_size int, span bigint"


def words_of(text: str | None) -> list[bytes]:
    """Words are runs of anything but the six ASCII white-space characters; null has none."""
    return text.encode().split() if text else []


def _heads_column(heads: np.ndarray, counts: np.ndarray) -> pa.Array:
    octets = np.ascontiguousarray(heads.view(np.uint8).reshape(-1, 8)[:, :_HEAD_BYTES])
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * _HEAD_BYTES, out=offsets[1:])
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(octets)]
    )


def _suffix_rows(
    words: np.ndarray, sizes: np.ndarray, keys: np.ndarray, bytes_: np.ndarray, window: int
) -> pa.RecordBatch | None:
    """Rows of one batch of texts: suffixes to compare elsewhere, and repeats settled here."""
    anchor = min(ANCHOR, window)
    rolling = Rolling(words)
    heads = rolling.windows(window)
    if not len(heads):
        return None
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero((first + sizes)[doc[: len(heads)]] - np.arange(len(heads)) >= window)
    if not len(at):
        return None
    heads, doc = heads[at], doc[at]
    prefixes = rolling.windows(anchor)
    ranked = (prefixes & ~_POSITION) | np.arange(len(prefixes), dtype=np.uint64)
    anchors = (sliding_min(ranked, window - anchor + 1)[at] & _POSITION).astype(np.int64)

    _, witness, which, times = np.unique(
        heads, return_index=True, return_inverse=True, return_counts=True
    )
    repeated = times[which] > 1
    travels = np.zeros(len(at), bool)
    travels[witness] = True

    # Settled here: maximal runs inside one document.
    flags = np.zeros(len(words) + 1, bool)
    flags[at[repeated]] = True
    begin, length = runs(flags)
    owner = np.searchsorted(first + sizes, begin, side="right")
    # Travelling: consecutive suffixes with one anchor make a row. Heads of neighbouring
    # documents never join: between them lie starts with too few words left.
    sent = np.flatnonzero(travels)
    new = np.ones(len(sent), bool)
    new[1:] = (np.diff(at[sent]) != 1) | (np.diff(anchors[sent]) != 0)
    row = np.flatnonzero(new)
    lead = sent[row]
    counts = np.diff(np.append(row, len(sent)))
    none = np.zeros(len(begin), np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([prefixes[anchors[lead]].view(np.int64), mix(keys[owner].view(np.uint64)).view(np.int64)])),
            pa.array(np.concatenate([keys[doc[lead]], keys[owner]])),
            pa.array(np.concatenate([bytes_[doc[lead]], bytes_[owner]]).astype(np.int32)),
            pa.array(np.concatenate([at[lead] - first[doc[lead]], begin - first[owner]]).astype(np.int32)),
            pa.array(np.concatenate([np.zeros(len(lead), np.int32), length]).astype(np.int32)),
            _heads_column(heads[sent], np.concatenate([counts, none])),
        ],
        names=[field.split()[0] for field in _SUFFIXES.split(", ")],
    )


def _suffixes(texts: DataFrame, window: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        held: list[tuple[np.ndarray, int, int]] = []
        total = 0

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                made = _suffix_rows(
                    np.concatenate([h[0] for h in held]),
                    np.array([len(h[0]) for h in held], np.int64),
                    np.array([h[1] for h in held], np.int64),
                    np.array([h[2] for h in held], np.int64),
                    window,
                )
                held.clear()
                if made is not None:
                    yield made

        for batch in batches:
            keys, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, size, text in zip(keys, sizes, batch.column(2), strict=True):
                words = words_of(text.as_py())
                if len(words) >= window:
                    held.append((np.fromiter(map(digest, words), np.uint64, len(words)), key, size))
                    total += len(words)
                    if total >= BATCH_WORDS:
                        yield from settle()
                        total = 0
        yield from settle()

    return texts.select("text_hash", "text_size", "text").mapInArrow(scan, _SUFFIXES)


def _subtrees(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Repeats among suffixes that arrive in prefix order."""
    rest: pa.Table | None = None

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        prefix, key, size, start, settled = (
            table.column(c).to_numpy() for c in range(5)
        )
        blob = table.column(5).chunk(0)
        offsets = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
        octets = np.frombuffer(blob.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if blob.buffers()[2] else np.empty(0, np.uint8)
        counts = np.diff(offsets) // _HEAD_BYTES
        heads = np.zeros((len(octets) // _HEAD_BYTES, 8), np.uint8)
        heads[:, :_HEAD_BYTES] = octets.reshape(-1, _HEAD_BYTES)
        row = np.repeat(np.arange(len(counts)), counts)
        node = mix(heads.view(np.uint64).ravel() ^ mix(prefix.view(np.uint64))[row])
        _, which, times = np.unique(node, return_inverse=True, return_counts=True)
        repeated = times[which] > 1
        inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        hit = np.flatnonzero(repeated)
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(row[hit]) != 0) | (np.diff(inside[hit]) != 1)
        lead = hit[new]
        length = np.diff(np.append(np.flatnonzero(new), len(hit)))
        here = np.flatnonzero(settled)
        owner = np.concatenate([row[lead], here])
        begin = np.concatenate([start[row[lead]] + inside[lead], start[here]]).astype(np.int64)
        covered = np.concatenate([length, settled[here]]).astype(np.int64) + (window - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[owner]), pa.array(size[owner]), pa.array((begin << 32) | covered)],
            names=["text_hash", "text_size", "span"],
        )

    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if sum(c.nbytes for c in rest.column(5).chunks) < GROUP_SUFFIXES * _HEAD_BYTES:
            continue
        last = rest.column(0)[rest.num_rows - 1].as_py()
        cut = int(np.searchsorted(rest.column(0).to_numpy(), last, side="left"))
        if cut:
            yield from settle(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield from settle(rest)


def text_key(text: Column) -> list[Column]:
    """Columns that identify a text: equal texts share their repeats."""
    return [F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("text_size")]


def repeated_spans(texts: DataFrame, window: int) -> DataFrame:
    """(text_hash, text_size, spans): for every text with a repeat, the word spans covered by
    repeated windows, each ``first << 32 | number of words``. Spans may overlap."""
    return (
        _suffixes(texts, window)
        .repartition("prefix")
        .sortWithinPartitions("prefix")
        .mapInArrow(lambda batches: _subtrees(batches, window), _REPEATS)
        .groupBy("text_hash", "text_size")
        .agg(F.collect_set("span").alias("spans"))
    )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row per row of ``docs``: every word is removed
    that lies in a window of ``window`` consecutive words occurring at another place too, in
    the same document or another; ``kept`` joins the others by one space.

    Texts shorter than a window, empty and null texts keep what they have (null: no words and
    an empty ``kept``). Repeated rows are occurrences of their own, so exact copies of one
    long text lose all words. Null ids are carried along. Other columns are not read.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    texts = docs.select(
        F.col(id_col).alias("doc_id"), *text_key(F.col(text_col)), F.col(text_col).alias("text")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = words_of(text.as_py())
                keep = np.ones(len(words), bool)
                for span in spans.as_py() or ():
                    keep[span >> 32 : (span >> 32) + (span & 0xFFFFFFFF)] = False
                left = int(keep.sum())
                total.append(len(words))
                gone.append(len(words) - left)
                if left < len(words):
                    words = [words[i] for i in np.flatnonzero(keep)]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    kind = dict(texts.dtypes)["doc_id"]
    spans = repeated_spans(texts, window).hint("shuffle_hash")
    return (
        texts.join(spans, ["text_hash", "text_size"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
    )
