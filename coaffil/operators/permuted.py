"""Permutations of a whole column, evaluated at single places."""

from __future__ import annotations

import numpy as np

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted_places(places: np.ndarray, n: int, seed: int, reps: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Where pseudo-random permutations of 0 to n - 1 send the places: places x reps.

    A Feistel network on the least even number of bits that holds n, walked until it falls below n;
    so any task finds the partner of its own rows, with no other row in view.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = _mixed(np.arange(rounds, dtype=np.uint64)[:, None] + np.uint64(seed) * np.uint64(1 << 20), np.asarray(reps, np.uint64)[None, :])
    x = np.repeat(np.asarray(places, np.uint64)[:, None], keys.shape[1], 1)
    todo = np.ones(x.shape, bool)
    while todo.any():
        rep = np.nonzero(todo)[1]
        left, right = x[todo] >> half, x[todo] & low
        for k in range(rounds):
            left, right = right, left ^ (_mixed(right, keys[k, rep]) & low)
        x[todo] = (left << half) | right
        todo &= x >= np.uint64(n)
    return x.astype(np.int64)
