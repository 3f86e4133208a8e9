"""Exact search and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from lethewood.llm.exact_search import PivotTable, top_k
from lethewood.llm.integer_vectors import exact_products, largest_component
from lethewood.llm.vector_codes import compress, with_group_sum

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, q INT, cell INT, id STRING"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], SCHEMA)


def some(n, dims, seed=3, hot=0):
    """Vectors in clusters, with ties, a share of one vector, and all that must be left out."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    x = (centres[rng.integers(5, size=n)] + 0.3 * rng.normal(size=(n, dims))).astype(np.float32)
    x[:hot] = x[0]
    x[n // 2 : n // 2 + 5] = np.float32(0.25)
    rows = [(i * 3, v.tolist(), None if i % 7 == 0 else i % 4) for i, v in enumerate(x)]
    bad = [None, [], [None] * dims, [NAN] * dims, [INF] + [0.0] * (dims - 1), [1.0] * (dims + 1)]
    return rows + [(10_000_000 + i, v, 1) for i, v in enumerate(bad)]


def usable(rows, scale, dims):
    return [
        (i, [math.floor(scale * float(np.float32(c))) for c in v], label)
        for i, v, label in rows
        if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)
    ]


def brute_top(rows, queries, scale, dims, k):
    whole = [(i, v) for i, v, _ in usable(rows, scale, dims) if i is not None]
    out = []
    for q, x in sorted({(i, tuple(v)) for i, v, _ in usable(queries, scale, dims)}):
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole if i != q)
        out += [(q, rank + 1, i, -score) for rank, (score, i) in enumerate(scored[:k])]
    return out


def test_products_are_exact_beyond_float64():
    rng = np.random.default_rng(1)
    for dims in (1, 3, 64):
        big = largest_component(dims)
        a, b = rng.integers(-big, big + 1, (9, dims)), rng.integers(-big, big + 1, (7, dims))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert exact_products(a, b).tolist() == want
    assert exact_products(np.zeros((0, 4), np.int64), b[:, :4]).shape == (0, 7)


@pytest.mark.parametrize("n, hot, table", [
    (700, 0, PivotTable()),
    (700, 250, PivotTable(pivots=5, block_rows=40, block_queries=7, most_cells=6)),
    (700, 0, PivotTable(pivots=40, block_rows=10, block_queries=3)),
    (4, 0, PivotTable()),
])
def test_top_k_equals_brute_force(spark, n, hot, table):
    rows = some(n, 12, hot=hot)
    given = vectors(spark, rows).repartition(5)
    asked = [r for r in rows if r[0] % 20 == 0]
    found = top_k(given, vectors(spark, asked), k=10, table=table)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, found.collect())) == brute_top(rows, asked, 1024, 12, 10)


def test_top_k_repeated_and_missing_rows(spark):
    rows = some(60, 8) + some(60, 8)[:9] + [(None, [1.0] * 8, 1), (3, [2.0] * 8, 1)]
    asked = [r for r in rows if r[0] is not None and r[0] % 15 == 0]
    found = top_k(vectors(spark, rows), vectors(spark, asked + asked[:2]), k=4)
    assert sorted(map(tuple, found.collect())) == brute_top(rows, asked, 1024, 8, 4)
    empty = vectors(spark, [])
    assert top_k(empty, empty).collect() == [] == top_k(vectors(spark, rows), empty).collect()
    only = vectors(spark, [(None, [1.0], 1)])
    assert top_k(only, only).collect() == []


def brute_codes(rows, dims, parts=8, size=16, rounds=6):
    kept = usable(rows, 4096, dims)
    width = -(-dims // parts)
    cut = lambda v: [(v + [0] * (width * parts - dims))[p * width : (p + 1) * width] for p in range(parts)]
    first: dict = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: r[:2]):
        first.setdefault(i, v)
    books = [[cut(first[i])[p] for i in sorted(first)[:size]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members: dict = {}
            for _, v, _ in kept:
                members.setdefault(nearest(cut(v)[p], book)[1], []).append(cut(v)[p])
            books[p] = [
                [sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if j in members else e
                for j, e in enumerate(book)
            ]
    coded = []
    for i, v, label in kept:
        found = [nearest(x, books[p]) for p, x in enumerate(cut(v))]
        coded.append((i, label, [j for _, j in found], sum(far for far, _ in found)))
    plain = ",".join(str(c) for book in books for entry in book for c in entry)
    return coded, hashlib.sha256(plain.encode()).hexdigest()


@pytest.mark.parametrize("n, dims", [(150, 16), (150, 13), (5, 8)])
def test_codes_equal_brute_force(spark, n, dims):
    rows = some(n, dims, hot=n // 3)
    rows += rows[3:9] + [(None, [0.5] * dims, None), (0, [-0.5] * dims, 2)]
    coded, books = compress(vectors(spark, rows).repartition(4), keep=["label", "q"])
    want, digest = brute_codes(rows, dims)
    assert books.digest() == digest and coded.columns == ["vec_id", "label", "q", "code", "error"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[-2], r[-1])
    got = [(r.vec_id, r.label, r.code, r.error) for r in coded.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    sums: dict = {}
    for _, label, _, error in want:
        sums[label] = sums.get(label, 0) + error
    summed = with_group_sum(coded, "label", "error", "label_error").collect()
    assert len(summed) == len(want) and all(r.label_error == sums[r.label] for r in summed)


def test_codes_of_empty_tables(spark):
    coded, books = compress(vectors(spark, []), keep=["label"])
    assert coded.collect() == [] and books.entries.size == 0
    coded, _ = compress(vectors(spark, [(1, None, 2), (None, [1.0], 3)]), keep=["label", "code"])
    assert coded.collect() == []


def test_group_sums_of_rare_keys_are_joined(spark):
    rows = spark.range(6000).selectExpr("CASE WHEN id < 2000 THEN 0 WHEN id < 2500 THEN NULL ELSE id END AS key", "id AS value")
    got = with_group_sum(rows, "key", "value", "total").collect()
    want = {0: sum(range(2000)), None: sum(range(2000, 2500))}
    assert len(got) == 6000 and all(r.total == want.get(r.key, r.value) for r in got)
