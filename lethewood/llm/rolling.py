"""Rolling 64-bit hashes over sequences of word hashes, vectorised."""

from __future__ import annotations

import numpy as np

# Any odd multiplier works; its inverse modulo 2**64 undoes a shift of the window.
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of all windows of one sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        self._sums = np.zeros(self.size + 1, np.uint64)
        np.cumsum(words * _powers(_ODD, self.size), out=self._sums[1:])
        self._undo = _powers(_ODD_INVERSE, self.size)

    def windows(self, length: int) -> np.ndarray:
        """One hash per start; empty when the sequence is shorter than a window."""
        count = max(0, self.size - length + 1)
        spans = self._sums[length : length + count] - self._sums[:count]
        return mix(spans * self._undo[:count])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in log2(width) passes."""
    done, best = 1, values
    while done < width:
        step = min(done, width - done)
        best = np.minimum(best[:-step], best[step:])
        done += step
    return best


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every maximal run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]
