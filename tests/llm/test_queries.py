"""The registered queries on the small tables, against brute force or labels."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from lethewood.llm import sentencepiece as sp
from lethewood.llm.queries import PIECES, Q

from .test_dedup import brute_fingerprint, brute_kept, components
from .test_text_operators import brute_leaks

SECRET = re.compile(r"AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = \")[0-9a-f]{40}")


@pytest.fixture(scope="module")
def texts(spark, data):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def items(spark, data):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]


def test_op1(spark, data, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    label = components(pairs, prints)
    smallest: dict[int, int] = {}
    for i in sorted(prints):
        smallest.setdefault(label[i], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q["op1_simhash_dedup"][0](spark, data).collect()}
    assert got == {i: (f"{p:016x}", smallest[label[i]]) for i, p in prints.items()}


def test_op3(spark, data):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = Q["op3_toxicity"][0](spark, data).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    right = [r.predicted == marks[r.doc_id] for r in rows if r.doc_id in marks]
    assert np.mean(right) > 0.85


def test_op4(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in table])
    x = np.array([r.embedding for r in table], np.float64)
    answers: dict[int, list] = {}
    for r in Q["op4_nearest_neighbours"][0](spark, data).collect():
        answers.setdefault(r.query_id, []).append(r)
    assert sorted(answers) == [i for i in ids.tolist() if i % 20 == 0]
    hits = 0
    for q, rows in answers.items():
        rows.sort(key=lambda r: r["rank"])
        score = (x * x[np.searchsorted(ids, q)]).sum(axis=1)
        score[ids == q] = -np.inf
        assert [r["rank"] for r in rows] == list(range(1, 21))
        assert np.allclose([r.score for r in rows], score[np.searchsorted(ids, [r.vec_id for r in rows])], atol=1e-12)
        order = [(-r.score, r.vec_id) for r in rows]
        assert order == sorted(order)
        hits += len(set(ids[np.lexsort((ids, -score))[:20]].tolist()) & {r.vec_id for r in rows})
    assert hits / (20 * len(answers)) >= 0.9


def test_op5(spark, data, texts, items):
    got = {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in Q["op5_decontamination"][0](spark, data).collect()}
    assert brute_leaks(texts, items) == got and got


def test_op6(spark, data, texts):
    rows = Q["op6_sentencepiece"][0](spark, data).collect()
    assert len(rows) == len(texts) and all(r.exact and r.n_tokens == len(r.token_ids) for r in rows)
    digest = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts}
    assert all(r.decoded_sha256 == digest[r.doc_id] for r in rows)


def test_op8(spark, data, texts):
    rows = Q["op8_secret_scan"][0](spark, data).collect()
    whole = dict(texts)
    assert all(whole[r.doc_id][r.start : r.start + len(r.value)] == r.value for r in rows)
    want = sorted((i, m.start(), m.group()) for i, t in texts for m in SECRET.finditer(t))
    assert sorted((r.doc_id, r.start, r.value) for r in rows if r.is_secret) == want


def test_op9(spark, data, texts):
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute_kept(texts, 35)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in Q["op9_substring_dedup"][0](spark, data).collect()}
    assert got == want


def test_op10(spark, data):
    good = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()}
    rows = Q["op10_quality_classifier"][0](spark, data).collect()
    assert np.mean([r.keep for r in rows if r.doc_id in good]) > 0.95


def test_pipeline(spark, data, texts, items):
    """What stays is clean, and what went had a reason."""
    out = corpus_pipeline.run(spark, data)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids"]
    kept = {r.doc_id: r for r in out.collect()}
    whole = dict(texts)
    leaks = {doc for doc, _ in brute_leaks(texts, items)}
    assert not leaks & kept.keys()
    for i, r in kept.items():
        assert SECRET.search(r.text) is None and r.n_chars == len(r.text)
        assert r.text == SECRET.sub("[SECRET]", whole[i])
    decoded = sp.decode(out, PIECES).select("text", "decoded").collect()
    assert all(r.text == r.decoded for r in decoded)
    marks = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("toxic = 1").collect()}
    scored = corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{data}/documents.parquet"), data)
    calm = {r.doc_id for r in scored.collect()}

    def shingles(text):
        words = text.encode().lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = {i: shingles(t) for i, t in texts}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for i in calm - kept.keys() - leaks:
        assert max(alike(i, j) for j in calm if j != i) > 0.7
    stay = sorted(kept)
    assert all(alike(a, b) < 0.85 for a in stay for b in stay if a < b)
    assert len(marks & kept.keys()) < len(marks) / 2
