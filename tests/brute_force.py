"""A row-at-a-time twin of the model definition, for small fixtures only."""

from __future__ import annotations

import hashlib
import math

from lethewood.config import RunConfig


def digest(seed: int, kind: str, *keys: object) -> str:
    return hashlib.md5(":".join([f"{seed}:{kind}", *map(str, keys)]).encode()).hexdigest()


def uniform(seed: int, kind: str, *keys: object) -> float:
    return int(digest(seed, kind, *keys)[:13], 16) / 2.0**52


def bits63(seed: int, kind: str, *keys: object) -> int:
    text = digest(seed, kind, *keys)
    return int(text[:8], 16) * 2**31 + int(text[8:16], 16) % 2**31


def trees_for(sample_id: int, config: RunConfig) -> list[int]:
    ranked = []
    for t in range(config.num_trees):
        text = digest(config.seed, "tree", sample_id, t // 4)
        ranked.append((text[8 * (t % 4) : 8 * (t % 4) + 8], t))
    return sorted(t for _, t in sorted(ranked)[: config.trees_per_sample])


def gini(n_pos: int, n: int) -> float:
    if n == 0:
        return 0.0
    share = n_pos / n
    return 2.0 * share * (1.0 - share)


def fit(rows: list[tuple[int, list[float], bool]], config: RunConfig) -> dict:
    """(tree, node) -> (kind, attr, threshold, subset, n, n_pos)."""
    nodes: dict = {}
    for tree in range(config.num_trees):
        own = [r for r in rows if tree in trees_for(r[0], config)]
        if own:
            _grow(own, tree, 1, 0, config, nodes)
    return nodes


def _left(value: float, threshold, subset, base) -> bool:
    if subset is None:
        return value <= threshold
    offset = int(value - base)
    return 0 <= offset < 63 and bool(subset >> offset & 1)


def _grow(rows: list, tree: int, node: int, depth: int, config: RunConfig, nodes: dict) -> None:
    n, n_pos = len(rows), sum(r[2] for r in rows)
    best = None
    if depth < config.max_depth and n >= config.min_samples_split and 0 < n_pos < n:
        p = config.num_features
        attrs = sorted((uniform(config.seed, "attr", tree, node, a), a) for a in range(p))
        for attr in sorted(a for _, a in attrs[: config.features_per_split]):
            values = [r[1][attr] for r in rows]
            lo, hi = min(values), max(values)
            for draw in range(config.num_splits_to_try):
                threshold = subset = None
                if attr in config.categorical_attrs:
                    if hi <= lo:
                        continue
                    every = 2 ** min(int(hi - lo + 1), 63) - 1
                    subset = bits63(config.seed, "set", tree, node, attr, draw) % every + 1
                elif abs(hi - lo) >= 1.1920929e-07:
                    threshold = lo + uniform(config.seed, "cut", tree, node, attr, draw) * (hi - lo)
                else:
                    continue
                left = [r for r in rows if _left(r[1][attr], threshold, subset, lo)]
                nl, nlp = len(left), sum(r[2] for r in left)
                if nl in (0, n):
                    continue
                gain = gini(n_pos, n) - (
                    nl / n * gini(nlp, nl) + (n - nl) / n * gini(n_pos - nlp, n - nl)
                )
                score = math.floor(gain * 1e12)
                if score > 0 and (best is None or (score, -attr, -draw) > best[0]):
                    best = ((score, -attr, -draw), attr, threshold, subset, lo)
    if best is not None:
        _, attr, threshold, subset, lo = best
        left = [r for r in rows if _left(r[1][attr], threshold, subset, lo)]
        right = [r for r in rows if not _left(r[1][attr], threshold, subset, lo)]
        if min(len(left), len(right)) >= config.min_samples_leaf:
            nodes[tree, node] = ("internal", attr, threshold, subset, n, n_pos)
            _grow(left, tree, node * 2, depth + 1, config, nodes)
            _grow(right, tree, node * 2 + 1, depth + 1, config, nodes)
            return
    nodes[tree, node] = ("leaf", None, None, None, n, n_pos)
