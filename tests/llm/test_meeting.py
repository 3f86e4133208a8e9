"""Texts at the similarity always share a listed shingle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lethewood.llm import simhash_dedup

from .helpers import docs, prose
from .test_dedup import components


def test_alike_texts_meet_whatever_the_table_holds():
    """The table only decides which shingles count as common; no choice of them loses a pair."""
    random = np.random.default_rng(3)
    for i in range(300):
        base = prose(i, 10 + i % 150).split()
        at = int(random.integers(len(base)))
        extra = prose(9000 + i, int(random.integers(1, 2 + len(base) // 4))).split()
        texts = [" ".join(base), " ".join(base[:at] + extra + base[at:] if i % 2 else base + extra)]
        owner, shingles = simhash_dedup.shingle_sets(texts, 5)
        a, b = set(shingles[owner == 0].tolist()), set(shingles[owner == 1].tolist())
        known = np.unique(random.choice(shingles, len(shingles) // 2 + 1))
        common = (known, random.integers(1, 50, len(known)))
        n, rare = simhash_dedup.rare_shingles(texts, 5, 0.8, common)
        lists = [set(np.frombuffer(r.as_py(), np.uint64).tolist()) for r in rare]
        assert n.tolist() == [len(a), len(b)] and lists[0] <= a and lists[1] <= b
        if len(a & b) >= 0.8 * len(a | b):
            assert lists[0] & lists[1]


def test_near_copies_in_a_crowd_of_one_template(spark):
    """Pairs alike in 0.8 to 0.9 among many texts of one template that are alike in about 0.6."""
    rows, shared = [], prose(50, 150)
    for i in range(700):
        own = f"{shared} {prose(20_000 + i, 40)}"
        rows += [(2 * i, own), (2 * i + 1, f"{own} {prose(40_000 + i, 30)}")]
    texts = docs(spark, rows).selectExpr("doc_id", "xxhash64(text) text_hash", "octet_length(text) text_size")
    found = simhash_dedup.similar_groups(docs(spark, rows)).join(texts, ["text_hash", "text_size"])
    label = {r.doc_id: r.component for r in found.collect()}
    assert len(label) == len(rows)
    assert [i for i in range(700) if label[2 * i] != label[2 * i + 1]] == []
    assert len(set(label.values())) == 700


def test_cells_answer_with_joining_links_only():
    """A crowd of chained near copies: links join what alike pairs join, and are fewer than texts."""
    random = np.random.default_rng(5)
    sets = []
    for i in range(120):
        old = sets[random.integers(len(sets))] if sets and i % 5 else random.integers(0, 1 << 40, 60, dtype=np.uint64)
        new = old.copy()
        spots = random.choice(60, random.integers(0, 9), replace=False)
        new[spots] = random.integers(1 << 41, 1 << 42, len(spots), dtype=np.uint64)
        sets.append(np.unique(new))
    pairs = [(a, b) for a in range(120) for b in range(a) if len(both := np.intersect1d(sets[a], sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - len(both))]

    def cell(side):
        return pa.table({"node": list(range(120)), "label": list(range(120)), "side": side, "shingles": [s.tobytes() for s in sets]})

    whole = simhash_dedup._cell_links(cell([0] * 120), 0.8)
    links = list(zip(whole["u"].to_pylist(), whole["v"].to_pylist(), strict=True))
    assert groups(links) == groups(pairs) and len(links) < 120 < len(pairs)
    half = simhash_dedup._cell_links(cell([i % 2 for i in range(120)]), 0.8)
    links = list(zip(half["u"].to_pylist(), half["v"].to_pylist(), strict=True))
    assert groups(links) == groups([(a, b) for a, b in pairs if (a - b) % 2]) and len(links) < 120


def groups(links):
    label = components(links, range(120))
    return {frozenset(i for i in label if label[i] == at) for at in label.values()}
