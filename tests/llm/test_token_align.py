"""Alignment of two tokenizers against a search byte by byte."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lethewood.llm import token_align
from lethewood.llm.queries import BYTE_LEVEL, PIECES, Q
from lethewood.llm.token_align import Encoder, Pair, _read, align

from .helpers import LONG, TEXTS, docs

ODD = [
    (20, "aaaaaaaa aaaa aaaaa"),
    (21, "  two  spaces\n\n\tand tabs  "),
    (22, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (23, "zero\0byte ﬁ ﬂ ½     é"),
    (24, "日本語のテキスト 한국어 العربية हिन्दी"),
    (25, "\U0001f468‍\U0001f469‍\U0001f467 \U0001f600\U0001f600"),
    (26, "naïve café Übergröße 'twas don't I'LL"),
    (27, "▁ mark"),
    (28, " "),
    (28, "x" * 3000),
    (29, "tab\t after \x1c odd \u3000 wide\u00a0 no\u2028 break \x85 end "),
    (30, " lead it's  can 't  a'b 12 34,5  \n \n x"),
    (31, "combining e\u0301 \u0301alone \u200b zero\u200d joiner"),
]
NAMES = ["doc_id", "a_ids", "b_ids", "groups", "n_groups", "n_links", "n_best", "count_sum"]


def brute(rows, pair):
    """Every token's byte range, every overlap, every common end."""
    left = Tokenizer.from_str(pair.a_file.decode())
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_proto=pair.b_file)

    def ranges(ids, spelled):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(spelled[i])))
            at += len(spelled[i])
        return out

    made, docs_of = [], {}
    for number, (_, text) in enumerate(rows):
        whole = (" " + text).encode() if text else b""
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        spelled = [b"".join(t[i] or b"" for i in ids) for ids, t in ((a, pair.a_bytes), (b, pair.b_bytes))]
        if spelled != [whole, whole]:
            a, b = [], []
        ra, rb = ranges(a, pair.a_bytes), ranges(b, pair.b_bytes)
        links = []
        first = 0
        for i, low, high in ra:
            while first < len(rb) and rb[first][2] <= low:
                first += 1
            at = first
            while at < len(rb) and rb[at][1] < high:
                links.append((i, rb[at][0]))
                at += 1
        ends = sorted({r[2] for r in ra} & {r[2] for r in rb})
        groups, low = [], 0
        for high in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in r if low <= s and e <= high) for r in (ra, rb)))
            low = high
        for link in set(links):
            docs_of.setdefault(link, set()).add(number)
        made.append((a, b, ";".join(groups), len(ends), links))
    most: dict = {}
    for (i, _), holders in docs_of.items():
        most[i] = max(most.get(i, 0), len(holders))
    out = [
        (doc, a, b, groups, n, len(links), sum(len(docs_of[x]) == most[x[0]] for x in links), sum(len(docs_of[x]) for x in links))
        for (doc, _), (a, b, groups, n, links) in zip(rows, made, strict=True)
    ]
    return out, {x: (len(d), len(d) == most[x[0]]) for x, d in docs_of.items()}


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


@pytest.mark.parametrize("sent", [4_000_000, 50_300, 0])
def test_alignment_equals_brute_force(spark, sent):
    """All pairs sent to the tasks, some, and only those of the same bytes."""
    rows = [(i, t[:9000] if t is LONG else t) for i, t in TEXTS] + ODD
    pair = Pair.load(spark, BYTE_LEVEL, PIECES)
    want, pairs = brute(rows, pair)
    aligned, counts = align(docs(spark, rows).repartition(3), BYTE_LEVEL, PIECES, broadcast_pairs=sent)
    assert aligned.columns == ["doc_id", "a_ids", "b_ids", "steps", "n_a", "n_b", *NAMES[3:]]
    assert all((len(r.a_ids), len(r.b_ids)) == (r.n_a, r.n_b) for r in aligned.collect())
    assert all(len(r.steps) == r.n_links and r.steps.count(0) == r.n_groups for r in aligned.collect())
    assert order(map(tuple, aligned.select(*NAMES).collect())) == order(want)
    assert {(r.a, r.b): (r.n, r.best) for r in counts.collect()} == pairs
    assert {r.regular for r in counts.collect()} == {True, False}


def test_same_bytes(spark):
    pair = Pair.load(spark, BYTE_LEVEL, PIECES)
    assert pair.by_words
    for a, b in enumerate(pair.same.tolist()):
        assert b == -1 or pair.a_bytes[a] == pair.b_bytes[b]
    assert (pair.same >= 0).sum() > 10_000


def test_words_are_independent_of_their_neighbours(spark, data):
    """All documents, and texts of random whitespace and letters, read by words and as wholes."""
    pair = Pair.load(spark, BYTE_LEVEL, PIECES)
    random_ = random.Random(5)
    letters = "ab'sé1,. .  \t\n\u3000\u00a0\x1c日\u0301\U0001f600▁"
    texts = ["".join(random_.choice(letters) for _ in range(40)) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    encoder = Encoder(pair)
    batch = pa.record_batch([pa.array(texts), pa.array(range(len(texts)))], names=["text", "id"])
    made = []
    for by_words in (True, False):
        found = {}
        for ids, words, which, sizes in _read([batch], encoder, by_words):
            ends = sizes.cumsum().tolist()
            for i, low, high in zip(ids.to_pylist(), [0, *ends], ends, strict=False):
                found[i] = [side.take(which[low:high]).tolist() for side in (words.a, words.b, words.steps)]
        made.append(found)
    assert made[0] == made[1] and len(made[0]) == len(texts) and sum(map(any, made[0].values())) > 60


def test_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(token_align, "JOINED_WORDS", 3)
    monkeypatch.setattr(token_align, "TASK_PAIRS", 5)
    monkeypatch.setattr(token_align, "BATCH_BYTES", 50)
    want, pairs = brute(ODD, Pair.load(spark, BYTE_LEVEL, PIECES))
    aligned, counts = align(docs(spark, ODD).coalesce(1), BYTE_LEVEL, PIECES)
    assert order(map(tuple, aligned.select(*NAMES).collect())) == order(want)
    assert {(r.a, r.b): (r.n, r.best) for r in counts.collect()} == pairs


def test_empty_table(spark):
    aligned, counts = align(docs(spark, []), BYTE_LEVEL, PIECES)
    assert aligned.collect() == [] == counts.collect()


def test_op11(spark, data):
    """The registered query on all documents of the small tables."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    made, _ = brute(rows, Pair.load(spark, BYTE_LEVEL, PIECES))
    digest = lambda groups: hashlib.sha256(groups.encode()).hexdigest() if groups else ""
    want = {
        doc: (len(a), len(b), n, links, best, total, digest(groups)) for doc, a, b, groups, n, links, best, total in made
    }
    got = {r.doc_id: tuple(r)[1:] for r in Q["op11_token_align"][0](spark, data).collect()}
    assert got == want


def test_later_tasks_do_not_keep_the_tokenizers():
    """A worker that goes on to measure no longer needs them."""
    import sys
    from types import ModuleType

    from lethewood.llm import token_align

    sys.modules[token_align.KEPT] = ModuleType(token_align.KEPT)
    token_align._released()
    assert token_align.KEPT not in sys.modules
