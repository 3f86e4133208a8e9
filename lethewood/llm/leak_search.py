"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

For every benchmark item of n words, the windows of n consecutive words of a document are
compared with it. A window that is similar enough to an item of its size has nearly all its
shingles in that item, so windows are laid only where the share of known shingles allows a
match; this sieve loses nothing. Each remaining window gets a SimHash fingerprint of its
shingles. Fingerprints are cut into ``RADIUS + 1`` blocks of bits: two that differ in at most
``RADIUS`` bits agree in one block at least, so equal blocks of windows and items of one size
give every pair within the radius. Those pairs are verified by their exact weighted shingle
similarity (shared over total shingle counts).

The benchmark's items go to the tasks in groups of bounded size, one pass over the documents
for each group, so neither the broadcast nor a task grows with the benchmark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethewood.llm.rolling import Rolling

SHINGLE = 5
SIMILARITY = 0.8
# Similar windows differ in 64 * acos(cosine) / pi bits on average: 10 at a similarity of 0.8,
# with a spread below 3.
RADIUS = 20
GROUP_WORDS = 1_000_000
BATCH_WORDS = 500_000
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters; null has none."""
    return text.lower().encode().translate(_KEEP).split() if text else []


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Majority fingerprints of rows of shingle hashes (windows x shingles)."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(*shingles.shape, 8), axis=2, bitorder="little")
    ones = bits.sum(axis=1, dtype=np.int32)
    return np.packbits(ones * 2 > shingles.shape[1], axis=1, bitorder="little").view(np.uint64)[:, 0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over total shingle counts of two multisets of shingles."""
    left, right = Counter(a.tolist()), Counter(b.tolist())
    shared = sum((left & right).values())
    return shared / max(1, len(a) + len(b) - shared)


class Blocks:
    """Items of one window size, indexed by the blocks of their fingerprints."""

    def __init__(self, fingerprints: np.ndarray, radius: int):
        cuts = np.linspace(0, 64, radius + 2).astype(int)
        self.parts = [
            (np.uint64(low), np.uint64((1 << (high - low)) - 1))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True)
        ]
        self.fingerprints = fingerprints
        self.radius = radius
        self.tables: list[dict[int, np.ndarray]] = []
        for low, mask in self.parts:
            keys = ((fingerprints >> low) & mask).tolist()
            table: dict[int, list[int]] = {}
            for item, key in enumerate(keys):
                table.setdefault(key, []).append(item)
            self.tables.append({key: np.array(items) for key, items in table.items()})

    def near(self, fingerprint: int) -> np.ndarray:
        """All items within the radius, each once."""
        value = np.uint64(fingerprint)
        meeting = [
            table.get(int((value >> low) & mask))
            for (low, mask), table in zip(self.parts, self.tables, strict=True)
        ]
        meeting = [items for items in meeting if items is not None]
        if not meeting:
            return np.empty(0, int)
        items = np.unique(np.concatenate(meeting))
        return items[np.bitwise_count(self.fingerprints[items] ^ value) <= self.radius]


class Index:
    """A group of benchmark items, by size."""

    def __init__(self, items: list[tuple[int, str]], least: float, radius: int):
        self.least = least
        sizes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for number, text in items:
            words = words_of(text)
            if words:
                k = min(SHINGLE, len(words))
                sizes.setdefault(len(words), []).append((number, Rolling(_hashes(words)).windows(k)))
        self.sizes = {
            n: (
                [number for number, _ in group],
                [shingles for _, shingles in group],
                Blocks(np.array([simhash(s[None, :])[0] for _, s in group], np.uint64), radius),
            )
            for n, group in sorted(sizes.items())
        }
        # Sieve: shingles of the items, by shingle length, behind a small table of bits.
        self.known: dict[int, np.ndarray] = {}
        for n, (_, shingles, _) in self.sizes.items():
            k = min(SHINGLE, n)
            self.known[k] = np.union1d(self.known.get(k, np.empty(0, np.uint64)), np.concatenate(shingles))
        self.bits: dict[int, tuple[np.uint64, np.ndarray]] = {}
        for k, known in self.known.items():
            log = max(10, int(len(known)).bit_length() + 4)
            table = np.zeros(1 << log, bool)
            shift = np.uint64(64 - log)
            table[known >> shift] = True
            self.bits[k] = (shift, table)

    def matches(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, int, int, int]]:
        """(document, item): best similarity, its first word and size, and the number of
        matching windows. ``words``: word hashes of many documents; ``first``: where each
        begins, and the end."""
        found: dict[tuple[int, int], tuple[float, int, int, int]] = {}
        rolling = Rolling(words)
        for k in self.known:
            shingles = rolling.windows(k)
            shift, table = self.bits[k]
            member = table[shingles >> shift]
            at = np.flatnonzero(member)
            member[at] = np.isin(shingles[at], self.known[k])
            # A shingle that reaches over the end of its document belongs to none.
            owner = np.searchsorted(first, at, side="right") - 1
            member[at[at + k > first[owner + 1]]] = False
            if not member.any():
                continue
            total = np.concatenate([[0], np.cumsum(member)])
            for n, (numbers, item_shingles, blocks) in self.sizes.items():
                count = n - k + 1
                if min(SHINGLE, n) != k or len(member) < count:
                    continue
                # Equal sizes: similarity s asks for 2s / (1 + s) of the window's shingles.
                need = 2 * self.least / (1 + self.least) * count - 1e-9
                start = np.flatnonzero(total[count:] - total[:-count] >= need)
                owner = np.searchsorted(first, start, side="right") - 1
                fits = start + n <= first[owner + 1]
                start, owner = start[fits], owner[fits]
                for low in range(0, len(start), 4096):
                    some = start[low : low + 4096]
                    window = shingles[some[:, None] + np.arange(count)]
                    for row, print_ in enumerate(simhash(np.ascontiguousarray(window)).tolist()):
                        for item in blocks.near(print_):
                            score = similarity(window[row], item_shingles[item])
                            if score >= self.least:
                                doc = int(owner[low + row])
                                key = (doc, numbers[item])
                                here = (score, int(some[row] - first[doc]), n, 1)
                                old = found.get(key)
                                if old is not None:
                                    best = here if here[0] > old[0] else old
                                    here = (*best[:3], old[3] + 1)
                                found[key] = here
        return found


_RESULT = "doc_id bigint, item_id bigint, similarity double, first_word int, n_words int, n_windows int"


def _pass(docs: DataFrame, items: list[tuple[int, str]], least: float, radius: int) -> DataFrame:
    index = Index(items, least, radius)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, list[bytes]]] = []
        total = 0

        def settle() -> Iterator[pa.RecordBatch]:
            words = _hashes([w for _, ws in held for w in ws])
            first = np.cumsum([0, *(len(ws) for _, ws in held)])
            found = index.matches(words, first) if len(words) else {}
            if found:
                rows = [(held[doc][0], item, *rest) for (doc, item), rest in sorted(found.items())]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=[part.split()[0] for part in _RESULT.split(", ")],
                )

        for batch in batches:
            for number, text in zip(batch.column(0), batch.column(1), strict=True):
                held.append((number.as_py(), words_of(text.as_py())))
                total += len(held[-1][1])
                if total >= BATCH_WORDS:
                    yield from settle()
                    held.clear()
                    total = 0
        yield from settle()

    return docs.mapInArrow(scan, _RESULT)


def _groups(benchmark: DataFrame, group_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items, group by group; the hash of an item deals them out evenly."""
    words = benchmark.agg(F.sum(F.length("text") / 4)).first()[0] or 0
    groups = int(words // group_words) + 1
    items = benchmark.select(
        F.col("item_id").cast("bigint").alias("item_id"),
        "text",
        F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).alias("part"),
    ).dropna(subset=["text"])
    for part in range(groups):
        rows = items.where(F.col("part") == part).select("item_id", "text").collect()
        yield sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, *map(str, r)))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = SIMILARITY,
    radius: int = RADIUS,
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words, n_windows): one row per document row
    and benchmark item that a window of the document matches, with the best window.

    ``benchmark``: (item_id, text). Items and documents without words match nothing; items of
    fewer than five words are compared as one shingle. Null ids are carried along; repeated
    documents and items match each on their own. An empty benchmark gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    found: DataFrame | None = None
    for items in _groups(benchmark, group_words):
        some = _pass(texts, items, least, radius)
        found = some if found is None else found.unionByName(some)
    return found


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    least: float = SIMILARITY,
    radius: int = RADIUS,
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """The rows of ``docs`` whose text matches no benchmark item, in one narrow pass for each
    group of items. Columns are unchanged; null and empty texts stay."""
    for items in _groups(benchmark, group_words):
        index = Index(items, least, radius)
        at = docs.columns.index(text_col)

        def clean(batches: Iterator[pa.RecordBatch], index=index, at=at) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for low in range(0, whole.num_rows, 200):
                    batch = whole.slice(low, 200)
                    words = [words_of(text.as_py()) for text in batch.column(at)]
                    first = np.cumsum([0, *map(len, words)])
                    found = index.matches(_hashes([w for ws in words for w in ws]), first) if first[-1] else {}
                    keep = np.ones(batch.num_rows, bool)
                    keep[[doc for doc, _ in found]] = False
                    yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
