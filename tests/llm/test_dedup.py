from __future__ import annotations

import time
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from lethewood.llm import graph, simhash_dedup
from lethewood.llm.graph import connected_components
from lethewood.llm.substring_dedup import remove_repeats
from lethewood.sources.scratch import FREE_SHUFFLES, Scratch

from .helpers import TEXTS, docs, prose


def brute_fingerprint(text, k=3):
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components_equal_brute_force(spark):
    near = [(100 + i, f"{prose(50, 400)} tail{i // 3}") for i in range(30)]
    rows = TEXTS + near
    got = sorted(
        (r.doc_id, r.fingerprint, r.component_id)
        for r in simhash_dedup.near_duplicates(docs(spark, rows)).collect()
        if r.doc_id is not None
    )
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    spots = range(len(rows))
    pairs = [(a, b) for a in spots for b in range(a) if (prints[a][1] ^ prints[b][1]).bit_count() <= 2]
    label = components(pairs, spots)
    smallest = {}
    for s in spots:
        if prints[s][0] is not None:
            smallest[label[s]] = min(smallest.get(label[s], prints[s][0]), prints[s][0])
    want = sorted((i, f"{f:016x}", smallest[label[s]]) for s, (i, f) in enumerate(prints) if i is not None)
    assert got == want
    assert len({c for _, _, c in want}) < len(want)


def test_every_pair_within_two_bits_is_connected(spark):
    rng = np.random.default_rng(3)
    fps = [0, -1, 1 << 62, -(1 << 63)]
    for start in rng.integers(-(2**63), 2**63 - 1, 40).tolist():
        fps.append(start)
        for _ in range(3):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                start ^= (1 << bit) if bit < 63 else -(1 << 63)
            fps.append(start)
    table = spark.createDataFrame([(0, f) for f in set(fps)], "table INT, fp BIGINT")
    links = [(r.u, r.v) for r in simhash_dedup.close_pairs(table).collect()]
    distance = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(distance(a, b) <= 2 for a, b in links)
    close = [(a, b) for a in set(fps) for b in set(fps) if a < b and distance(a, b) <= 2]
    got, want = components(links, set(fps)), components(close, set(fps))
    assert len(close) > 20 and len(set(got.values())) == len(set(want.values()))
    assert all(got[a] == got[b] for a, b in close)


@pytest.mark.parametrize("shape", ["path", "star", "mixed", "empty"])
def test_components(spark, shape):
    edges = {
        "path": [(i, i + 1) for i in range(300)],
        "star": [(0, i) for i in range(1, 200)] + [(500, 500), (7, 7)],
        "mixed": [(i, (i * 7) % 90) for i in range(90)] + [(200 + i, 201 + i) for i in range(0, 40, 2)] * 2,
        "empty": [],
    }[shape]
    table = spark.createDataFrame([*edges, (None, 3)], "u BIGINT, v BIGINT")
    got = {r.node: r.label for r in connected_components(table, Scratch(spark)).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    want = components([e for e in edges if e[0] != e[1]], nodes)
    assert set(got) == nodes
    assert len(set(got.values())) == len(set(want.values()))
    assert all(got[a] == got[b] for a, b in edges if a != b)


def test_one_of_each_similar_group_stays(spark):
    base = prose(60, 300)
    words = base.split()
    near = " ".join([*words[:150], "changed", *words[151:]])
    far = " ".join("x" + w if i % 4 == 0 else w for i, w in enumerate(words))
    rows = [(5, base), (3, near), (9, base), (4, far), (None, base), (7, ""), (8, None), (6, prose(61, 300)), (6, prose(61, 300))]
    kept = simhash_dedup.keep_one_of_each_group(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted((r.doc_id, (r.text or "")[:9]) for r in kept.collect()) == sorted(
        [(3, near[:9]), (4, far[:9]), (7, ""), (6, prose(61, 300)[:9])]
    )
    assert simhash_dedup.keep_one_of_each_group(docs(spark, [])).count() == 0
    assert simhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def brute_kept(rows, window):
    words = [t.encode().split() if t else [] for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return out


@pytest.mark.parametrize("window", [2, 5, 35])
def test_substring_dedup_equals_brute_force(spark, window, monkeypatch):
    rows = [*TEXTS, *[(200 + i, f"{prose(70, 10)} {prose(71 + i % 2, 45)} {prose(80 + i, 12)}") for i in range(12)]]
    rows.append((300, " ".join(["again"] * 90)))
    key = lambda r: (r[0] is None, str(r))
    want = sorted(brute_kept(rows, window), key=key)
    got = remove_repeats(docs(spark, rows).repartition(5), window=window)
    assert sorted(map(tuple, got.collect()), key=key) == want
    assert sum(w[2] for w in want) > 0


def test_substring_dedup_in_small_groups(spark, monkeypatch):
    """Batches and subtree groups of a few words give the same result."""
    from lethewood.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "BATCH_WORDS", 50)
    monkeypatch.setattr(substring_dedup, "GROUP_SUFFIXES", 3)
    rows = [(200 + i, f"{prose(71 + i % 3, 45)} {prose(80 + i, 12)}") for i in range(20)]
    got = remove_repeats(docs(spark, rows), window=10)
    assert sorted(map(tuple, got.collect())) == sorted(brute_kept(rows, 10))
    assert remove_repeats(docs(spark, []), window=10).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs(spark, rows), window=1)


def _set(text, k=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def _alike(a, b):
    return len(_set(a) & _set(b)) / len(_set(a) | _set(b))


def _groups(spark, rows):
    """Sets of ids that the search puts together."""
    texts = docs(spark, rows).selectExpr("doc_id", "xxhash64(text) text_hash", "octet_length(text) text_size")
    found = simhash_dedup.similar_groups(docs(spark, rows)).join(texts, ["text_hash", "text_size"])
    return {frozenset(r.ids) for r in found.groupBy("component").agg(F.collect_set("doc_id").alias("ids")).collect()}


def _brute_groups(rows):
    pairs = [(a, b) for a, s in rows for b, t in rows if a < b and _alike(s, t) >= 0.8]
    label = components(pairs, [i for i, _ in rows])
    return {frozenset(i for i in label if label[i] == at) for at in label.values()}


def test_near_copies_meet_beside_an_unrelated_centre(spark):
    """Many texts of one template: near copies are found whoever is the centre of their groups."""
    rows = []
    shared = prose(40, 90)
    for i in range(60):
        own = prose(1000 + i, 55)
        rows += [(2 * i, f"{shared} {own}"), (2 * i + 1, f"{shared} {own} {prose(5000 + i, 8 + i % 20)}")]
    got = _groups(spark, rows)
    assert got == _brute_groups(rows)
    assert sum(len(g) == 2 for g in got) > 30
    assert simhash_dedup.keep_one_of_each_group(docs(spark, rows)).count() == len(got)


def test_large_groups_are_compared_in_cells(spark, monkeypatch):
    """Texts that hold one long passage, so its shingles are rare ones of all; cells of few texts."""
    monkeypatch.setattr(simhash_dedup, "CELL_TEXTS", 7)
    shared = prose(41, 120)
    rows = [(i, f"{shared} {prose(2000 + i // 3, 12 + i // 3)} {prose(3000 + i, 5 + i % 3 * 4)}") for i in range(60)]
    got = _groups(spark, rows)
    assert got == _brute_groups(rows)


def test_pairs_count_by_their_exact_similarity(spark):
    """Pairs alike in 0.72 to 0.86: those below 0.8 stay apart, the others are all found."""
    rows = []
    for i in range(33):
        base = prose(7000 + i, 150)
        rows += [(2 * i, base), (2 * i + 1, f"{base} {prose(8000 + i, 24 + i)}")]
    got = _groups(spark, rows)
    assert got == _brute_groups(rows)
    assert 10 < sum(len(g) == 2 for g in got) < 20


def test_fingerprints_join_groups_of_the_stage(spark):
    """Texts of one repeated line have close fingerprints, though few of their distinct shingles agree."""
    line = prose(90, 11)
    rows = [(i, f"{' '.join([line] * 60)} {prose(91 + i, 9)}") for i in range(2)] + [(2, prose(95, 80))]
    assert (brute_fingerprint(rows[0][1]) ^ brute_fingerprint(rows[1][1])).bit_count() <= 2
    assert _alike(rows[0][1], rows[1][1]) < 0.8
    assert _groups(spark, rows) == {frozenset({0, 1}), frozenset({2})}


def test_groups_that_are_joined_already_are_not_walked_again(spark, monkeypatch):
    """Components are sought among the fingerprints; after that only among links between groups."""
    calls = []

    def counted(edges, scratch):
        calls.append(edges.count())
        return connected_components(edges, scratch)

    monkeypatch.setattr(simhash_dedup, "connected_components", counted)
    texts = [prose(90 + i, 120) for i in range(6)]
    rows = [(i, text) for i, text in enumerate(texts)] + [(10 + i, text + " ") for i, text in enumerate(texts)]
    assert _groups(spark, rows) == {frozenset((i, 10 + i)) for i in range(6)}
    assert len(calls) == 1


@pytest.mark.parametrize("few", [0, 5])
def test_components_of_many_edges_come_by_rounds(spark, monkeypatch, few):
    """Rounds down to no edges, and down to so few that one task joins them."""
    monkeypatch.setattr(graph, "FEW", few)
    edges = [(i, (i * 7) % 90) for i in range(90)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 301), (301, 302)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u BIGINT, v BIGINT"), Scratch(spark)).collect()}
    want = components([e for e in edges if e[0] != e[1]], {n for e in edges if e[0] != e[1] for n in e})
    assert set(got) == set(want) and len(set(got.values())) == len(set(want.values()))
    assert all(got[a] == got[b] for a, b in edges if a != b)


def test_cells_are_compared_in_rounds(spark, monkeypatch):
    """Cells that hold several times the texts do not lie on disk at once; the groups stay the same."""
    monkeypatch.setattr(simhash_dedup, "CELL_TEXTS", 7)
    monkeypatch.setattr(simhash_dedup, "ROUND_BYTES", 700_000)
    written = []
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    base, rows = prose(43, 150).split(), []
    for i in range(60):
        spots = {5 + (i * 37 + k * 53 + i * i) % 140 for k in range(2 + i % 2)}
        rows.append((i, " ".join(f"own{i}x{at}" if at in spots else word for at, word in enumerate(base))))
    prints = {i: brute_fingerprint(text) for i, text in rows}
    pairs = [(a, b) for a, s in rows for b, t in rows if a < b and (_alike(s, t) >= 0.8 or (prints[a] ^ prints[b]).bit_count() <= 2)]
    label = components(pairs, [i for i, _ in rows])
    assert _groups(spark, rows) == {frozenset(i for i in label if label[i] == at) for at in label.values()}
    assert written.count("joining") > 1


def test_shuffle_files_go_with_the_tables_they_made(spark):
    """What the search has shuffled does not add up on disk until the driver collects its garbage."""

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        found = [files.apply(i) for i in range(files.size())]
        return {f.getPath(): f.length() for f in found if f.getName().startswith("shuffle_")}

    rows = [(i, prose(6000 + i // 2, 400)) for i in range(200)]
    setting = spark.conf.get(FREE_SHUFFLES, None)
    before = shuffled()
    simhash_dedup.similar_groups(docs(spark, rows))
    for _ in range(20):
        left = sum(size for path, size in shuffled().items() if path not in before)
        if left < sum(len(text) for _, text in rows) / 10:
            break
        time.sleep(0.5)
    else:
        pytest.fail(f"{left} bytes are left")
    assert spark.conf.get(FREE_SHUFFLES, None) == setting
