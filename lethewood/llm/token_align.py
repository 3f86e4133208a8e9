"""Alignment of two tokenizers over the same texts, and how often their ids go together.

A text is encoded by a byte-level vocabulary A (with one space in front) and by a piece vocabulary
B (which adds that space itself). Byte offsets at which tokens of both end cut the text into
groups; two tokens are linked where their bytes overlap. Between two neighbouring ends of either
side lies exactly one link, so links are found by merging the two lists of ends, for a whole batch
of texts at once: a text's last byte ends both sides, so no group crosses texts.

Where both vocabularies allow it, neither has a token that goes on over a single space between
two words. Then a word's tokens, groups and links do not depend on its neighbours, and a task finds
them once for each distinct word of some megabytes of texts; a text is the sequence of its words.

Most groups are one token with the same bytes on both sides. An array over A's vocabulary
holds each id's B id of equal bytes; links between these two are counted in a vector as long as
the vocabulary, and only other links are counted by pairs that are shuffled.
"""

from __future__ import annotations

import gc
import json
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethewood.llm.sentencepiece import BYTE, CONTROL, MARK, UNKNOWN, Vocabulary, _messages
from lethewood.sources.scratch import Scratch

# Texts are read about this many bytes at a time.
BATCH_BYTES = 1_000_000
BATCH_TOKENS = 300_000
# So many words go to the byte-level vocabulary as one text, and so many texts at once.
JOINED_WORDS = 500
JOINED_TEXTS = 20
# Pairs a task counts before it passes them on.
TASK_PAIRS = 1_000_000
# Pair counts sent to every task, 16 bytes each; rarer pairs meet their counts by a join.
BROADCAST_PAIRS = 4_000_000
# Where a link ends, both its tokens end, or only one does.
BOTH_END, A_ENDS, B_ENDS = 0, 1, 2


# What Python takes for white space includes all that a byte-level vocabulary takes for it.
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
# The same white space for the expressions of Arrow; a space beside it is not between words.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OTHER_SPACES = f"(^|{_SPACE}) | ({_SPACE}|$)"


def _bytes_of_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable Latin-1 characters
    stand for themselves, the others for characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Pair:
    """Two vocabularies: their files' contents, the bytes of every id (empty: an id that stands
    for no bytes), A's array of B ids of the same bytes (-1: none), and whether texts may be cut at
    the spaces between words."""

    a_file: bytes
    b_file: bytes
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    same: np.ndarray
    by_words: bool

    @classmethod
    def load(cls, spark: SparkSession, a_path: str, b_path: str) -> Pair:
        """Vocabularies have a fixed size, so the driver reads them; through Spark, so that they
        may lie in any store the cluster reaches."""

        def content(path: str) -> bytes:
            return bytes(spark.read.format("binaryFile").load(path).first()["content"])

        a_file, b_file = content(a_path), content(b_path)
        letters = _bytes_of_letters()
        whole = json.loads(a_file)
        entries = whole["model"]["vocab"]
        a_bytes = [b""] * (1 + max(entries.values()))
        for entry, number in entries.items():
            known = all(letter in letters for letter in entry)
            a_bytes[number] = bytes(map(letters.__getitem__, entry)) if known else entry.encode()
        pieces = Vocabulary.parse(b_file)
        b_bytes = [
            b""
            if kind in (CONTROL, UNKNOWN)
            else bytes([int(piece[3:5], 16)])
            if kind == BYTE
            else piece.replace(MARK, " ").encode()
            for piece, kind in zip(pieces.pieces, pieces.kinds, strict=True)
        ]
        # An ordinary piece goes before a byte piece of the same bytes.
        order = sorted(range(len(b_bytes)), key=lambda i: (pieces.kinds[i] != BYTE, -i))
        by_bytes = {b_bytes[i]: i for i in order if b_bytes[i]}
        same = np.array([by_bytes.get(spelled, -1) for spelled in a_bytes], np.int64)
        by_words = _splits_words(whole) and _keeps_words(b_file, pieces)
        return cls(a_file, b_file, a_bytes, b_bytes, same, by_words)


def _splits_words(a: dict) -> bool:
    """A byte-level vocabulary whose own pattern cuts texts before a space between two words."""
    cut = a.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    return plain and not a.get("normalizer")


def _keeps_words(b_file: bytes, pieces: Vocabulary) -> bool:
    """A piece vocabulary that changes no characters, adds a marker in front, and has no piece with a
    marker behind another character."""
    settings = next((dict(_messages(value)) for number, value in _messages(b_file) if number == 3), {})
    unchanged = not settings.get(2) and settings.get(3, 1) == 1 and settings.get(4, 1) == 0
    return unchanged and not any(MARK in piece.lstrip(MARK) for piece in pieces.pieces)


@dataclass(frozen=True)
class Ragged:
    """Lists of numbers, by index."""

    flat: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, flat: np.ndarray, counts: np.ndarray) -> Ragged:
        return cls(flat, np.concatenate([[0], np.cumsum(counts)]))

    def counts(self, which: np.ndarray) -> np.ndarray:
        return self.ends[which + 1] - self.ends[which]

    def take(self, which: np.ndarray) -> np.ndarray:
        """The lists of some indexes, one after the other."""
        counts = self.counts(which)
        before = np.cumsum(counts) - counts
        return self.flat[np.repeat(self.ends[which] - before, counts) + np.arange(counts.sum())]


def _steps(
    a: np.ndarray, b: np.ndarray, a_counts: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For words in a row: the step after every link, and how many links each word has."""
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    ends = np.sort(np.concatenate([a_ends, b_ends]))
    # Every end once, and whether it is there twice.
    last = np.append(ends[1:] != ends[:-1], True)[: len(ends)]
    twice = np.append(False, ~last)[: len(ends)][last]
    ends = ends[last]
    at_a = np.searchsorted(a_ends, ends)
    steps = np.where(twice, BOTH_END, np.where(a_ends[at_a] == ends, A_ENDS, B_ENDS))
    word = np.repeat(np.arange(len(a_counts)), a_counts)
    return steps, np.bincount(word[at_a], minlength=len(a_counts))


def _linked(a: np.ndarray, b: np.ndarray, steps: np.ndarray, width: int) -> np.ndarray:
    """The key of every link's pair of ids."""
    a_at, b_at = np.cumsum(steps != B_ENDS), np.cumsum(steps != A_ENDS)
    return a[a_at - (steps != B_ENDS)].astype(np.int64) * width + b[b_at - (steps != A_ENDS)]


class Numbers:
    """Ids in decimal with the mark that follows them, by id."""

    def __init__(self, size: int):
        self.within, self.before_b, self.at_end = (
            np.array([f"{i}{mark}" for i in range(size)], object) for mark in ",|;"
        )

    def written(self, a: np.ndarray, b: np.ndarray, steps: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Groups as ``a1,a2|b1;a3|b2,b3``, for runs of ``sizes`` tokens of both sides."""
        a_last, b_last = steps[steps != B_ENDS] == BOTH_END, steps[steps != A_ENDS] == BOTH_END
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        # A token stands behind all tokens of the groups before and, if of B, its group's A tokens.
        b_before = np.concatenate([[0], np.flatnonzero(b_last) + 1])
        a_until = np.flatnonzero(a_last) + 1
        pieces = np.empty(len(a) + len(b), object)
        pieces[np.arange(len(a)) + b_before[a_group]] = np.where(a_last, self.before_b[a], self.within[a])
        pieces[np.arange(len(b)) + a_until[b_group]] = np.where(b_last, self.at_end[b], self.within[b])
        whole, ends = pieces.tolist(), np.cumsum(sizes).tolist()
        return ["".join(whole[low:high])[:-1] for low, high in zip([0, *ends], ends, strict=False)]


def _concatenated(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(part) for part in parts], np.int64)
    return np.fromiter(chain.from_iterable(parts), np.int64, int(counts.sum())), counts


@dataclass(frozen=True)
class Words:
    """Of distinct words: both sides' ids, the step after every link, the key of its pair, and whether
    both sides give the word's bytes back (if not, the lists are empty)."""

    a: Ragged
    b: Ragged
    steps: Ragged
    links: Ragged
    exact: np.ndarray


KEPT = "lethewood_loaded_tokenizers"


def _released() -> None:
    """Give up what tasks before left in this worker, the tokenizers too."""
    sys.modules.pop(KEPT, None)
    gc.collect()


def _tokenizers(a_file: bytes, b_file: bytes) -> tuple:
    """The two tokenizers. A worker process serves many tasks; it loads them once and keeps the last
    pair in a module of its own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    kept = sys.modules.setdefault(KEPT, ModuleType(KEPT))
    if getattr(kept, "files", None) != (a_file, b_file):
        left = Tokenizer.from_str(a_file.decode())
        left.encode_special_tokens = True
        kept.pair = left, sentencepiece.SentencePieceProcessor(model_proto=b_file)
        kept.files = a_file, b_file
    return kept.pair


class Encoder:
    """The two tokenizers in a task."""

    def __init__(self, pair: Pair):
        self._pair = pair
        self._left, self._right = _tokenizers(pair.a_file, pair.b_file)
        self._a_sizes = np.array([len(b) for b in pair.a_bytes])
        self._b_sizes = np.array([len(b) for b in pair.b_bytes])

    def words(self, words: list[str]) -> Words:
        """Words (or whole texts), each with a space in front."""
        pair = self._pair
        spelled = [" " + word for word in words]
        lengths = np.array([len(word.encode()) for word in spelled], np.int64)
        a_lists, b_lists = self._byte_level(spelled, lengths), self._right.encode(words, num_threads=1)
        (a, a_counts), (b, b_counts) = _concatenated(a_lists), _concatenated(b_lists)
        exact = (_sums(self._a_sizes[a], a_counts) == lengths) & (_sums(self._b_sizes[b], b_counts) == lengths)
        whole = "".join(spelled).encode()
        same = all(_spell(t, chain.from_iterable(ids)) == whole for t, ids in ((pair.a_bytes, a_lists), (pair.b_bytes, b_lists)))
        if not (same and exact.all()):
            for at, word in enumerate(spelled):
                sides = _spell(pair.a_bytes, a_lists[at]), _spell(pair.b_bytes, b_lists[at])
                if sides != (word.encode(), word.encode()):
                    exact[at], a_lists[at], b_lists[at] = False, [], []
            (a, a_counts), (b, b_counts) = _concatenated(a_lists), _concatenated(b_lists)
        steps, counts = _steps(a, b, a_counts, self._a_sizes, self._b_sizes)
        links = _linked(a, b, steps, len(pair.b_bytes))
        return Words(*map(Ragged.of, (a, b, steps, links), (a_counts, b_counts, counts, counts)), exact)

    def _byte_level(self, spelled: list[str], lengths: np.ndarray) -> list[list[int]]:
        """A ids of words with a space in front. Words without other white space at their ends are encoded
        many at a time, and cut apart again where they end."""

        def encode(texts: list[str]) -> list[list[int]]:
            out: list[list[int]] = []
            for at in range(0, len(texts), JOINED_TEXTS):
                found = self._left.encode_batch_fast(texts[at : at + JOINED_TEXTS], add_special_tokens=False)
                out += [encoding.ids for encoding in found]
            return out

        out: list[list[int]] = [[]] * len(spelled)
        plain = [self._pair.by_words and word[1:] == word.strip() for word in spelled]
        joined = np.flatnonzero(plain)
        alone = np.flatnonzero(~np.array(plain, bool)).tolist()
        runs = [joined[at : at + JOINED_WORDS] for at in range(0, len(joined), JOINED_WORDS)]
        for run, ids in zip(runs, encode(["".join(spelled[i] for i in run) for run in runs]), strict=True):
            token_ends, word_ends = np.cumsum(self._a_sizes[ids]), np.cumsum(lengths[run])
            cuts = np.searchsorted(token_ends, word_ends)
            if cuts[-1] >= len(ids) or (token_ends[cuts] != word_ends).any():
                alone.extend(run.tolist())
                continue
            ends = (cuts + 1).tolist()
            for word, low, high in zip(run.tolist(), [0, *ends], ends, strict=False):
                out[word] = ids[low:high]
        for word, ids in zip(alone, encode([spelled[i] for i in alone]), strict=True):
            out[word] = ids
        return out


def _spell(spelled: list[bytes], ids: Iterable[int]) -> bytes:
    return b"".join(map(spelled.__getitem__, ids))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of values, exact."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])


def _token_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose first column is a list of tokens, in pieces."""
    for whole in batches:
        yield from _cut(whole, pa.compute.binary_length(whole.column(0)).to_numpy(zero_copy_only=False), BATCH_TOKENS)


def _id_type(size: int) -> type:
    """The shortest of the types that numbers below ``size`` are written in."""
    return np.uint16 if size <= 1 << 16 else np.int32


def _packed(flat: np.ndarray, counts: np.ndarray, kind: type) -> pa.BinaryArray:
    """Lists of numbers as bytes, which Spark carries as they are."""
    flat = flat.astype(kind)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * np.int32(flat.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """What ``_packed`` was given."""
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat, pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // flat.itemsize


def _lists(flat: np.ndarray, counts: np.ndarray, kind: type = np.int32) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind)))


def _cut(whole: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of rows that add up to about ``most``, or of one row."""
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(ends, np.arange(most, ends[-1] if len(ends) else 0, most))
    for low, high in zip([0, *cuts], [*cuts, len(ends)], strict=True):
        if low < high:
            yield whole.slice(low, high - low)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _as_words(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of lists of words: (distinct words, their numbers in order, how many words each list has)."""
    coded = lists.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary.to_pylist(), numbers, sizes


def _in_words(batch: pa.RecordBatch, by_words: bool) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """The rows of a batch in up to two parts, with the words of their texts: those whose every space is
    between two words, and the others."""
    compute, texts = pa.compute, batch.column(0)
    odd = compute.or_kleene(compute.match_substring_regex(texts, _OTHER_SPACES), compute.equal(texts, ""))
    odd = compute.fill_null(odd, True) if by_words else pa.array([True] * len(texts))
    plain, other = batch.filter(compute.invert(odd)), batch.filter(odd)
    if plain.num_rows:
        yield plain, compute.split_pattern(plain.column(0), " ")
    if other.num_rows:
        split = _BETWEEN_WORDS.split if by_words else lambda text: [text]
        yield other, pa.array([split(t) if t else None for t in other.column(0).to_pylist()], pa.list_(pa.string()))


def _read(
    batches: Iterator[pa.RecordBatch], encoder: Encoder, by_words: bool
) -> Iterator[tuple[pa.Array, Words, np.ndarray, np.ndarray]]:
    """From batches of (text, id), a piece at a time: ids, distinct words, the numbers of all words in
    order, and how many words each text has; none if a word does not come back exactly."""
    for whole in batches:
        lengths = pa.compute.binary_length(whole.column(0)).fill_null(0).to_numpy(zero_copy_only=False)
        for piece in _cut(whole, lengths, BATCH_BYTES):
            for batch, lists in _in_words(piece, by_words):
                distinct, numbers, sizes = _as_words(lists)
                words = encoder.words(distinct)
                spoilt = ~words.exact[numbers]
                if spoilt.any():
                    text = np.repeat(np.arange(batch.num_rows), sizes)
                    gone = np.unique(text[spoilt])
                    numbers = numbers[~np.isin(text, gone)]
                    sizes[gone] = 0
                yield batch.column(1), words, numbers, sizes


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and how often each occurs."""
    x = np.sort(x)
    starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[starts], np.diff(np.append(starts, len(x)))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[1] for p in parts]), len(keys))
    return keys, counts.astype(np.int64)


def _tokenized(texts: DataFrame, pair: Pair) -> DataFrame:
    """Two kinds of rows, so that the texts are read once: (id, a_ids, b_ids, steps), packed, of every text, and
    (a, b, regular, n) of a task's linked pairs: how many texts hold them, and whether their bytes are
    the same."""
    width, same = len(pair.b_bytes), pair.same
    room = len(same) * width
    kind = texts.schema["id"].dataType.simpleString()
    types = _id_type(len(same)), _id_type(width), np.uint8
    schema = f"id {kind}, a_ids binary, b_ids binary, steps binary, a int, b int, regular boolean, n bigint"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()  # what tasks before left in this worker
        encoder = Encoder(pair)
        equal = np.zeros(len(same), np.int64)
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        form: pa.Schema | None = None

        def made(columns: list[pa.Array], first: int) -> pa.RecordBatch:
            rest = [pa.nulls(len(columns[0]), field.type) for field in form]
            return pa.RecordBatch.from_arrays([*rest[:first], *columns, *rest[first + len(columns) :]], schema=form)

        def pairs(keys: np.ndarray, n: np.ndarray, regular: bool) -> pa.RecordBatch:
            a, b = np.divmod(keys, width)
            columns = [a.astype(np.int32), b.astype(np.int32), np.full(len(keys), regular), n]
            return made(list(map(pa.array, columns)), 4)

        for ids, words, which, sizes in _read(batches, encoder, pair.by_words):
            if form is None:
                plain = [("a", pa.int32()), ("b", pa.int32()), ("regular", pa.bool_()), ("n", pa.int64())]
                form = pa.schema([("id", ids.type), *((n, pa.binary()) for n in ("a_ids", "b_ids", "steps")), *plain])
            sides = [
                _packed(side.take(which), _sums(side.counts(which), sizes), dtype)
                for side, dtype in zip((words.a, words.b, words.steps), types, strict=True)
            ]
            yield made([ids, *sides], 0)
            # A text's distinct words first, then their distinct links.
            known = max(1, len(words.exact))
            row, word = np.divmod(_distinct(np.repeat(np.arange(len(ids)), sizes) * known + which), known)
            held = _distinct(np.repeat(row, words.links.counts(word)) * room + words.links.take(word)) % room
            regular = same[held // width] == held % width
            equal += np.bincount(held[regular] // width, minlength=len(same))
            pending.append(_counted(held[~regular]))
            if sum(len(keys) for keys, _ in pending) > TASK_PAIRS:
                pending = [_summed(pending)]
                if len(pending[0][0]) > TASK_PAIRS // 2:
                    yield pairs(*pending.pop(), False)
        if form is not None:
            yield pairs(*_summed([(np.empty(0, np.int64),) * 2, *pending]), False)
            found = np.flatnonzero(equal)
            yield pairs(found * width + same[found], equal[found], True)

    return texts.select("text", "id").mapInArrow(scan, schema)


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` (``id_col``, ``a_ids``, ``b_ids``, ``steps``, ``n_a``, ``n_b``, ``groups``
    as ``a1,a2|b1;a3|b2,b3``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``), and (a, b, regular, n,
    best): in how many rows two ids are linked, whether their bytes are the same, and whether that is
    the most for the A id (ties included).

    ``steps`` has a number per link, from left to right: what ends where it ends (0 both tokens, 1 the
    A token, 2 the B token); with the ids it is the whole alignment.

    ``n_best`` counts a row's links whose pair is a best one, ``count_sum`` adds up the pairs' n over
    its links. Texts that are null, empty, or that either vocabulary does not give back byte
    for byte (with one space in front) have no tokens: empty lists, an empty ``groups``, zeros.
    Special tokens in texts are plain text. Rows are independent: repeated ids, repeated texts and
    null ids each count. An empty table gives empty tables; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pair = Pair.load(spark, a_path, b_path)
    width, same = len(pair.b_bytes), pair.same
    room = len(same) * width
    types = _id_type(len(same)), _id_type(width), np.uint8
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    both = scratch.write(_tokenized(texts, pair), "tokens")
    tokens = both.where("a IS NULL").select("a_ids", "b_ids", "steps", "id")
    counts = both.where("a IS NOT NULL").groupBy("a", "b", "regular").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row per id of A
    counts = counts.join(F.broadcast(most), "a").select("a", "b", "regular", "n", (F.col("n") == F.col("most")).alias("best"))
    counts = scratch.write(counts, "counts")

    # The most frequent pairs, as many as may be sent, by powers of two of their counts.
    power = F.floor(F.log2(F.col("n"))).cast("int")
    levels = {r["p"]: r["rows"] for r in counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    low, left = 64, broadcast_pairs - len(same)
    while low > 0 and sum(rows for p, rows in levels.items() if p >= low - 1) <= left:
        low -= 1
    table = counts.where(F.col("regular") | (power >= low)).select("a", "b", "n", "best").toArrow()
    keys = table.column("a").to_numpy().astype(np.int64) * width + table.column("b").to_numpy()
    order = np.argsort(keys)
    # One more entry, for what is not there.
    keys = np.append(keys[order], room)
    known_n = np.append(table.column("n").to_numpy()[order], 0)
    known_best = np.append(table.column("best").to_numpy()[order], False)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _released()
        numbers = Numbers(max(len(same), width))
        for batch in _token_pieces(batches):
            (a, n_a), (b, n_b), (steps, n_links) = map(_unpacked, batch.columns[:3], types)
            linked = _linked(a, b, steps, width)
            at = np.searchsorted(keys, linked)
            known = keys[at] == linked
            made = [
                _lists(a, n_a),
                _lists(b, n_b),
                _lists(steps, n_links, np.int8),
                pa.array(n_a),
                pa.array(n_b),
                pa.array(numbers.written(a, b, steps, n_a + n_b), pa.string()),
                pa.array(_sums(steps == BOTH_END, n_links)),
                pa.array(n_links),
                pa.array(_sums(known & known_best[at], n_links)),
                pa.array(_sums(np.where(known, known_n[at], 0), n_links)),
            ]
            if low:
                row = np.repeat(np.arange(batch.num_rows), n_links)
                held, times = _counted(row[~known] * room + linked[~known])
                per_row = np.bincount(held // room, minlength=batch.num_rows)
                made += [_lists(held % room, per_row, np.int64), _lists(times, per_row, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(3), *made], names=names)

    schema = (
        f"id {texts.schema['id'].dataType.simpleString()}, a_ids array<int>, b_ids array<int>, "
        "steps array<tinyint>, n_a bigint, n_b bigint, groups string, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint"
    )
    if low:
        schema += ", rare array<bigint>, times array<bigint>"
    names = [part.split()[0] for part in schema.split(", ")]
    measured = tokens.mapInArrow(measure, schema)
    if low:
        seldom = counts.where(~F.col("regular") & (power < low))
        measured = _with_rare(scratch, measured, seldom.withColumn("pair", F.col("a").cast("bigint") * width + F.col("b")))
    given = [name for name in names[1:] if name not in ("rare", "times")]
    return measured.select(F.col("id").alias(id_col), *given), counts


def _with_rare(scratch: Scratch, measured: DataFrame, seldom: DataFrame) -> DataFrame:
    """Add the counts of the links whose pair was not sent: they meet them by a join. A row has a
    pair once there, and such pairs are in few rows, so no key is hot."""
    measured = scratch.write(measured.withColumn("row", F.monotonically_increasing_id()), "measured")
    met = (
        measured.select("row", F.explode(F.arrays_zip("rare", "times")).alias("held"))
        .select("row", F.col("held.rare").alias("pair"), F.col("held.times").alias("times"))
        .join(seldom.select("pair", "n", "best"), "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more"),
        )
    )
    return (
        measured.join(met, "row", "left")
        .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
        .withColumn("count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    )
