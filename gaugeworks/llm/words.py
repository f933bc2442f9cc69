"""Whole-text word scanning over Arrow buffers.

A word is a maximal run of bytes outside the six ASCII blanks (space and
9 to 13).  No UTF-8 lead or continuation byte is one of those, so working on
bytes equals working on characters.  All functions are vectorised: a text is
never turned into Python strings, and texts are taken in slices of about
``SLICE`` bytes, so memory stays bounded however large a batch is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Letters and digits only: every other ASCII byte parts words, so marks around a word do not count.
_MARKS = ~np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown by doubling."""
    if base not in _tables or len(_tables[base]) < n:
        size = max(n, 2 * len(_tables.get(base, ())), SLICE)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        _tables[base] = np.cumprod(table, dtype=np.uint64)
    return _tables[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total, dtype=np.int64)


@dataclass
class Words:
    """Words of rows ``row0`` .. ``row0 + len(first) - 2`` of a batch.

    ``first[i]:first[i + 1]`` are the words of row i; word w is
    ``data[start[w]:end[w]]`` and has the 64-bit value ``value[w]``.
    """

    row0: int
    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def scan(column: pa.Array, lower: bool = False, size: int = SLICE, letters: bool = False, parting: np.ndarray | None = None) -> Iterator[Words]:
    """Words of every text of a string column, slice by slice; null is empty.

    With ``letters``, words are runs of ASCII letters and digits and of all
    bytes above ASCII.  ``parting`` says for each of the 256 bytes, of which
    none above 127, whether it parts words, in place of the blanks.
    """
    if parting is None:
        parting = _MARKS if letters else _BLANK
    column = text_array(column)
    if not len(column):
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield _slice(data, offsets[row : stop + 1], row, lower, parting)
        row = stop


def _slice(data: np.ndarray, offsets: np.ndarray, row0: int, lower: bool, parting: np.ndarray) -> Words:
    part = data[offsets[0] : offsets[-1]]
    if lower:
        part = _LOWER[part]
    edge = offsets - offsets[0]
    solid = ~parting[part]
    n = len(part)
    opens, closes = solid.copy(), solid.copy()
    if n:
        opens[1:] &= ~solid[:-1]
        closes[:-1] &= ~solid[1:]
        inner = edge[(edge > 0) & (edge < n)]
        opens[inner] = solid[inner]
        closes[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    if n:
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    value = mix((sums[end] - sums[start]) * _powers(_INVERSE, n + 1)[start]) if len(start) else np.zeros(0, dtype=np.uint64)
    return Words(row0, part, np.searchsorted(start, edge), start, end, value)


_STEP = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def grams(w: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, first, word): n-word sequences of each row, in order.

    ``word`` is the index of a sequence's first word.  With ``short``, a row
    of fewer than n words (but at least one) gives its whole sequence as one.
    """
    counts = w.counts
    many = np.maximum(counts - n + 1, 0)
    if short:
        many = np.where((counts > 0) & (counts < n), 1, many)
    at = spans(w.first[:-1], many)
    first = np.concatenate([[0], np.cumsum(many)])
    total = len(w.value)
    sums = np.full(len(at), np.uint64(n), dtype=np.uint64)
    full = at + n <= total
    for k in range(n):
        if full.all():
            sums += w.value[at + k] * _STEP[k]
        else:
            sums[full] += w.value[at[full] + k] * _STEP[k]
    if short:
        few = np.flatnonzero((counts > 0) & (counts < n))
        for i in few:
            c, s = int(counts[i]), int(w.first[i])
            value = np.uint64(c)
            for k in range(c):
                value = np.add(value, np.multiply(w.value[s + k], _STEP[k]))
            sums[first[i]] = value
    return mix(sums), first, at


def runs(w: Words, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values of the sequences of n[i] words from word at[i] on, in time free of n."""
    total = len(w.value)
    sums = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum(w.value * _powers(_BASE, total), out=sums[1:])
    return mix((sums[at + n] - sums[at]) * _powers(_INVERSE, total + 1)[at] + n.astype(np.uint64))


def heads(w: Words, n: int) -> np.ndarray:
    """Values of the first n bytes of each word; of the whole word where it is shorter."""
    sums = np.zeros(len(w.data) + 1, dtype=np.uint64)
    np.cumsum((w.data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(w.data)), out=sums[1:])
    return mix((sums[np.minimum(w.start + n, w.end)] - sums[w.start]) * _powers(_INVERSE, len(w.data) + 1)[w.start] + np.uint64(n))


def strings(w: Words, chosen: np.ndarray) -> list[bytes]:
    """The bytes of chosen words."""
    blob = w.data.tobytes()
    return [blob[s:e] for s, e in zip(w.start[chosen].tolist(), w.end[chosen].tolist())]
