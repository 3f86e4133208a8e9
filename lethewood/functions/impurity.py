"""Gini impurity and the integer split score, as SQL expressions over count columns."""

from __future__ import annotations

SCORE_SCALE = "1000000000000.0D"
WORST = "1.7976931348623157E308D"


def gini(n_pos: str, n: str) -> str:
    share = f"(CAST({n_pos} AS DOUBLE) / CAST({n} AS DOUBLE))"
    return f"(CASE WHEN {n} = 0 THEN 0.0D ELSE 2.0D * {share} * (1.0D - {share}) END)"


def _children_gini(n: str, n_pos: str, n_left: str, n_left_pos: str) -> str:
    n_right, n_right_pos = f"({n} - {n_left})", f"({n_pos} - {n_left_pos})"
    return (
        f"(CAST({n_left} AS DOUBLE) / CAST({n} AS DOUBLE) * {gini(n_left_pos, n_left)}"
        f" + CAST({n_right} AS DOUBLE) / CAST({n} AS DOUBLE) * {gini(n_right_pos, n_right)})"
    )


def _both_sides(n: str, n_left: str) -> str:
    return f"({n_left} > 0 AND {n_left} < {n})"


def split_score(n: str, n_pos: str, n_left: str, n_left_pos: str) -> str:
    """Impurity drop scaled to BIGINT; null when one side is empty."""
    gain = f"({gini(n_pos, n)} - {_children_gini(n, n_pos, n_left, n_left_pos)})"
    return f"(CASE WHEN {_both_sides(n, n_left)} THEN floor({gain} * {SCORE_SCALE}) END)"


def weighted_child_gini(n: str, n_pos: str, n_left: str, n_left_pos: str) -> str:
    """Weighted impurity of the children: lower is better, the largest double if a side is empty."""
    weighted = _children_gini(n, n_pos, n_left, n_left_pos)
    return f"(CASE WHEN {_both_sides(n, n_left)} THEN {weighted} ELSE {WORST} END)"
