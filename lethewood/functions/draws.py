"""Keyed random draws, as SQL expressions over key columns.

Every draw is a pure function of the seed, a kind and the ids it belongs to, so a
model is a function of its live samples and never of row order or partitioning.
"""

from __future__ import annotations

TWO_52 = "4503599627370496.0D"  # 2 ** 52, the range of thirteen hex digits
TWO_31 = "2147483648L"


def digest(seed: int, kind: str, *keys: str | int) -> str:
    parts = ", ".join(f"CAST({key} AS STRING)" for key in keys)
    return f"md5(concat_ws(':', '{seed}:{kind}', {parts}))"


def uniform(seed: int, kind: str, *keys: str | int) -> str:
    """Uniform DOUBLE in [0, 1)."""
    return f"(CAST(conv(substring({digest(seed, kind, *keys)}, 1, 13), 16, 10) AS BIGINT) / {TWO_52})"


def bits63(seed: int, kind: str, *keys: str | int) -> str:
    """Uniform non-negative BIGINT below 2 ** 63."""
    text = digest(seed, kind, *keys)
    high = f"CAST(conv(substring({text}, 1, 8), 16, 10) AS BIGINT)"
    low = f"CAST(conv(substring({text}, 9, 8), 16, 10) AS BIGINT) % {TWO_31}"
    return f"({high} * {TWO_31} + {low})"


TREES_PER_DIGEST = 4
# Up to so many trees the ranks are written out, so that they are computed in generated code.
WRITTEN_OUT = 64


def tree_ranks(seed: int, sample_id: str, num_trees: int) -> str:
    """ARRAY<STRUCT<rank STRING, tree_id INT>>: one 32-bit rank per tree.

    One digest serves four trees, since eight of its hex digits rank one tree; equal
    ranks fall back to the tree id.
    """
    blocks = range((num_trees + TREES_PER_DIGEST - 1) // TREES_PER_DIGEST)
    digests = ", ".join(digest(seed, "tree", sample_id, block) for block in blocks)
    if num_trees <= WRITTEN_OUT:
        texts = [digest(seed, "tree", sample_id, block) for block in blocks]
        ranks = [
            f"struct(substring({texts[tree // TREES_PER_DIGEST]}, {8 * (tree % TREES_PER_DIGEST) + 1}, 8) AS rank, "
            f"{tree} AS tree_id)"
            for tree in range(num_trees)
        ]
        return f"array({', '.join(ranks)})"
    slots = ", ".join(
        f"struct(substring(text, {8 * slot + 1}, 8) AS rank, "
        f"CAST(block * {TREES_PER_DIGEST} + {slot} AS INT) AS tree_id)"
        for slot in range(TREES_PER_DIGEST)
    )
    ranked = f"flatten(transform(array({digests}), (text, block) -> array({slots})))"
    return f"slice({ranked}, 1, {num_trees})"
