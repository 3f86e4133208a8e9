"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary file gives pieces with log scores; it is read through Spark, so it may lie in
any store the cluster reaches. Encoding marks spaces with U+2581, adds one marker in front,
and takes the segmentation with the largest sum of scores; a character that no piece covers
is spelled out in byte pieces. No piece has a marker after another character (checked when
the file is read), so the best segmentation of a text is the concatenation of the best ones of
its marked words. The distinct words of a batch of texts are searched together, position by
position, in arrays.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
UNKNOWN_SURFACE = " ⁇ "
# Words up to these numbers of bytes are searched together; longer ones one by one.
WIDTHS = (6, 10, 16, 24, 40, 64)
BATCH_CHARS = 2_000_000
_END = -1
# Name of the copied input column on its way to the tasks; it never leaves them.
_SPARE = "\u2581input"


def _messages(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            octet = blob[at]
            at += 1
            value |= (octet & 0x7F) << shift
            shift += 7
            if octet < 0x80:
                return value

    while at < len(blob):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, blob[at : at + size]
        at += size


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]

    @classmethod
    def parse(cls, blob: bytes) -> Vocabulary:
        entries = [dict(_messages(value)) for number, value in _messages(blob) if number == 1]
        return cls(
            [entry[1].decode() for entry in entries],
            [struct.unpack("<f", entry.get(2, b"\0\0\0\0"))[0] for entry in entries],
            [entry.get(3, NORMAL) for entry in entries],
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vocabulary:
        """Vocabularies have a fixed size (tens of thousands of pieces), so the driver reads one."""
        return cls.parse(bytes(spark.read.format("binaryFile").load(path).first()["content"]))


class DoubleArray:
    """A double-array trie over bytes. The child of node n for byte b is ``base[n] + b``, and is
    n's own if ``check`` there says n. ``value`` is the key's number where one ends, else -1."""

    def __init__(self, keys: dict[bytes, int]):
        trie: dict = {}
        for key, number in keys.items():
            node = trie
            for octet in key:
                node = node.setdefault(octet, {})
            node[_END] = number
        self.base, self.check, self.value = [0], [-1], [-1]
        taken = {0}
        free = 256  # whatever its byte, some node's child can be put here or further on
        queue = [(0, trie)]
        for index, children in queue:
            self.value[index] = children.pop(_END, -1)
            codes = sorted(children)
            if not codes:
                continue
            while free in taken:
                free += 1
            start = max(1, free - codes[0])
            while any(start + code in taken for code in codes):
                start += 1
            missing = start + codes[-1] + 1 - len(self.base)
            if missing > 0:
                self.base.extend([0] * missing)
                self.check.extend([-1] * missing)
                self.value.extend([-1] * missing)
            self.base[index] = start
            for code in codes:
                taken.add(start + code)
                self.check[start + code] = index
                queue.append((start + code, children[code]))
        # Every look-up of a child stays inside the arrays.
        self.check.extend([-1] * 256)


class Tokenizer:
    """The two directions for one vocabulary. Plain data, so Spark can ship it to tasks."""

    def __init__(self, vocabulary: Vocabulary):
        usable = [i for i, kind in enumerate(vocabulary.kinds) if kind in (NORMAL, USER_DEFINED)]
        if any(MARK in vocabulary.pieces[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece has a space marker after another character")
        self.trie = DoubleArray({vocabulary.pieces[i].encode(): i for i in usable})
        self.scores = vocabulary.scores
        self.unknown_score = min(vocabulary.scores[i] for i in usable) - UNKNOWN_PENALTY
        octets = {vocabulary.pieces[i]: i for i, kind in enumerate(vocabulary.kinds) if kind == BYTE}
        self.byte_ids = [octets.get(f"<0x{b:02X}>") for b in range(256)]
        self.unknown_id = vocabulary.kinds.index(UNKNOWN)
        self.surfaces = [
            b""
            if kind == CONTROL
            else UNKNOWN_SURFACE.encode()
            if kind == UNKNOWN
            else bytes([int(piece[3:5], 16)])
            if kind == BYTE
            else piece.replace(MARK, " ").encode()
            for piece, kind in zip(vocabulary.pieces, vocabulary.kinds, strict=True)
        ]
        self._numpy: tuple[np.ndarray, ...] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_numpy": None}

    def segment(self, marked: str) -> list[int]:
        """Ids of the best segmentation of one marked word; of equal ones, the first found
        from left to right."""
        text = marked.encode()
        size = len(text)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best: list[float | None] = [None] * (size + 1)
        begin, chosen = [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        at = 0
        while at < size:
            here, lead = best[at], text[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            single = False
            node, end = 0, at
            while end < size:
                child = base[node] + text[end]
                if check[child] != node:
                    break
                node = child
                end += 1
                piece = value[node]
                if piece >= 0:
                    score = here + scores[piece]
                    if best[end] is None or score > best[end]:
                        best[end], begin[end], chosen[end] = score, at, piece
                    single |= end == at + width
            if not single:
                end, score = at + width, here + self.unknown_score
                if best[end] is None or score > best[end]:
                    best[end], begin[end], chosen[end] = score, at, -1
            at += width
        ids: list[int] = []
        end = size
        while end:
            start, piece = begin[end], chosen[end]
            if piece >= 0:
                ids.append(piece)
            else:
                spelled = [self.byte_ids[b] for b in text[start:end]]
                ids.extend(reversed([self.unknown_id] if None in spelled else spelled))
            end = start
        return ids[::-1]

    def segment_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``segment`` for many marked words: (numbers of ids, all ids in word order)."""
        blobs = [word.encode() for word in words]
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        counts = np.zeros(len(words), np.int64)
        owners: list[np.ndarray] = []
        places: list[np.ndarray] = []
        values: list[np.ndarray] = []
        low = 0
        for high in WIDTHS:
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for at in range(0, len(some), 1 << 15):
                part = some[at : at + (1 << 15)]
                owner, place, value = self._lockstep([blobs[i] for i in part], sizes[part])
                owners.append(part[owner])
                places.append(place)
                values.append(value)
        for i in np.flatnonzero(sizes > low):
            ids = self.segment(words[i])
            owners.append(np.full(len(ids), i))
            places.append(np.arange(len(ids)))
            values.append(np.array(ids, np.int64))
        if not owners:
            return counts, np.empty(0, np.int32)
        owner, place, value = (np.concatenate(part) for part in (owners, places, values))
        order = np.lexsort((place, owner))
        return np.bincount(owner, minlength=len(words)), value[order].astype(np.int32)

    def _lockstep(self, blobs: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The search of ``segment`` for words of similar length at once: (word, place, id)."""
        base, check, value, scores = self._arrays()
        width = int(sizes.max())
        text = np.zeros((len(blobs), width), np.int64)
        text[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(blobs), np.uint8)
        best = np.full((len(blobs), width + 1), -np.inf)
        best[:, 0] = 0.0
        begin = np.zeros((len(blobs), width + 1), np.int64)
        chosen = np.full((len(blobs), width + 1), -1)

        def offer(rows: np.ndarray, end: np.ndarray | int, score: np.ndarray, at: int, piece: np.ndarray | int) -> None:
            better = score > best[rows, end]
            rows = rows[better]
            end = end[better] if isinstance(end, np.ndarray) else end
            best[rows, end], begin[rows, end] = score[better], at
            chosen[rows, end] = piece[better] if isinstance(piece, np.ndarray) else piece

        for at in range(width):
            lead = text[:, at]
            rows = np.flatnonzero((at < sizes) & ((lead & 0xC0) != 0x80))
            here, lead = best[rows, at], lead[rows]
            long = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(rows), bool)
            live, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for end in range(at, width):
                child = base[node] + text[rows[live], end]
                found = (check[child] == node) & (end < sizes[rows[live]])
                live, node = live[found], child[found]
                if not len(live):
                    break
                piece = value[node]
                hit = np.flatnonzero(piece >= 0)
                at_hit, piece = live[hit], piece[hit]
                offer(rows[at_hit], end + 1, here[at_hit] + scores[piece], at, piece)
                single[at_hit] |= long[at_hit] == end + 1 - at
            alone = np.flatnonzero(~single)
            offer(rows[alone], at + long[alone], here[alone] + self.unknown_score, at, -1)

        rows, end = np.arange(len(blobs)), sizes.copy()
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(rows):
            start, piece = begin[rows, end], chosen[rows, end]
            known = piece >= 0
            steps.append((rows[known], start[known], piece[known]))
            for row, first, last in zip(rows[~known], start[~known], end[~known], strict=True):
                spelled = [self.byte_ids[b] for b in blobs[row][first:last]]
                ids = np.array([self.unknown_id] if None in spelled else spelled)
                steps.append((np.full(len(ids), row), first + np.arange(len(ids)), ids))
            rows, end = rows[start > 0], start[start > 0]
        return tuple(np.concatenate(part) for part in zip(*steps, strict=True))

    def _arrays(self) -> tuple[np.ndarray, ...]:
        if self._numpy is None:
            trie = self.trie
            self._numpy = tuple(np.array(a) for a in (trie.base, trie.check, trie.value, self.scores))
        return self._numpy

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of ids, all ids in text order). Every distinct word is segmented once."""
        number: dict[str, int] = {}
        which: list[int] = []
        sizes: list[int] = []
        for text in texts:
            words = (MARK + text).replace(" ", MARK).split(MARK)[1:] if text else []
            if "" in words:
                words = _join_gaps(words)
            which.extend([number.setdefault(word, len(number)) for word in words])
            sizes.append(len(words))
        counts, ids = self.segment_all([MARK + word for word in number])
        index = np.array(which, np.int64)
        lengths = counts[index]
        starts = np.cumsum(counts) - counts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(starts[index] - ends[:-1], lengths) + np.arange(ends[-1])
        borders = ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)]
        return np.diff(borders), ids[take]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surfaces.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _join_gaps(words: list[str]) -> list[str]:
    """Several spaces in a row: all their markers go to the word behind them, or, at the end
    of the text, stand alone. A word comes without its first marker."""
    out, gap = [], 0
    for word in words:
        if word:
            out.append(MARK * gap + word)
            gap = 0
        else:
            gap += 1
    return [*out, MARK * (gap - 1)] if gap else out


def encode(
    docs: DataFrame,
    path: str,
    text_col: str = "text",
    ids_col: str = "token_ids",
    decoded_col: str | None = None,
) -> DataFrame:
    """``docs`` with ``ids_col`` array<int>: the ids of every text. Null and empty texts have no
    ids. With ``decoded_col`` the ids are decoded again in the same pass, as ``decode`` does.
    Rows keep all their other columns; one named like a new column is replaced."""
    tokenizer = Tokenizer(Vocabulary.load(docs.sparkSession, path))
    added = [StructField(ids_col, ArrayType(IntegerType()))]
    if decoded_col is not None:
        added.append(StructField(decoded_col, StringType()))
    kept = docs.drop(*(field.name for field in added))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(whole.num_columns - 1)
            sizes = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(sizes, np.arange(BATCH_CHARS, sizes[-1] if len(sizes) else 0, BATCH_CHARS))
            for low, high in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                if low < high:
                    batch = whole.slice(low, high - low)
                    counts, ids = tokenizer.encode(batch.column(batch.num_columns - 1).to_pylist())
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    made = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
                    if decoded_col is not None:
                        parts = zip(offsets[:-1], offsets[1:], strict=True)
                        texts = [tokenizer.decode(ids[a:b].tolist()) for a, b in parts]
                        made.append(pa.array(texts, pa.string()))
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:-1], *made],
                        names=[*batch.schema.names[:-1], *(field.name for field in added)],
                    )

    out = StructType([*kept.schema.fields, *added])
    return kept.withColumn(_SPARE, F.col(text_col)).mapInArrow(scan, out)


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``text_col``: the text its ids stand for. Null or no ids: an empty text.
    Bytes that are not UTF-8 become U+FFFD. Other columns are kept; one named like
    ``text_col`` is replaced."""
    tokenizer = Tokenizer(Vocabulary.load(tokens.sparkSession, path))
    kept = tokens.drop(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            texts = [
                tokenizer.decode(flat[start:end].tolist())
                for start, end in zip([0, *ends[:-1]], ends, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string())],
                names=[*batch.schema.names[:-1], text_col],
            )

    out = StructType([*kept.schema.fields, StructField(text_col, StringType())])
    return kept.withColumn(_SPARE, F.col(ids_col)).mapInArrow(scan, out)
