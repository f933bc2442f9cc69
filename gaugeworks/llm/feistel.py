"""Keyed permutation of 0 .. n-1: a balanced Feistel network with cycle walking."""

from __future__ import annotations

import numpy as np

from gaugeworks.llm.words import mix


class Feistel:
    """``permute`` and ``inverse`` are each other's inverse on 0 .. n-1.

    The network permutes 0 .. 4**w - 1, the least such domain that holds n; an
    image outside 0 .. n-1 is fed back until it falls inside, which ends since
    a permutation's cycles return.  Fewer than four steps are expected.
    """

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = int(n)
        half = 1
        while 4**half < self.n:
            half += 1
        self.half, self.mask = np.uint64(half), np.uint64((1 << half) - 1)
        self.keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % (1 << 64)))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        if back:
            left, right = right, left
        for key in self.keys[::-1] if back else self.keys:
            left, right = right, left ^ (mix(right + key) & self.mask)
        if back:
            left, right = right, left
        return (left << self.half) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        y = np.array(x, dtype=np.uint64, ndmin=1)
        todo = np.arange(len(y))
        while len(todo):
            y[todo] = self._once(y[todo], back)
            todo = todo[y[todo] >= self.n]
        return y.astype(np.int64)

    def permute(self, x) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, x) -> np.ndarray:
        return self._walk(x, True)
