"""Vectorised words: a block of texts becomes arrays of word hashes.

Words are the runs of bytes other than ASCII white space.  A word's hash is a
polynomial of its (optionally lower-cased) bytes modulo 2**64, read off one
running sum over the whole block, then mixed.  Blocks are cut between
documents, about ``BLOCK`` bytes each, so memory stays bounded whatever the
batch; one longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

_is_word = np.ones(256, dtype=np.uint8)
_is_word[[0x20, *range(0x09, 0x0E)]] = 0
_byte_value = np.random.default_rng(20240229).integers(1, 2 ** 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_lower_value = _byte_value.copy()
_lower_value[0x41:0x5B] = _byte_value[0x61:0x7B]

_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept between calls up to twice a block."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * BLOCK)
        up = np.full(size, _U(_BASE)); up[0] = 1
        down = np.full(size, _U(_INVERSE)); down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 2 * BLOCK:
            return up, down
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every bit of x over the result."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Block:
    """Words of consecutive documents ``first .. first + n_docs - 1`` of a batch.

    ``start``/``end``: byte ranges in ``data``; ``hash``: word hashes;
    ``offset``: document k has the words offset[k] .. offset[k + 1] - 1."""

    def __init__(self, first: int, data: np.ndarray, ends: np.ndarray, lower: bool):
        self.first, self.data, self.n_docs = first, data, len(ends) - 1
        n = len(data)
        if not n:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.hash = np.zeros(0, dtype=np.uint64)
            self.offset = np.zeros(self.n_docs + 1, dtype=np.int64)
            return
        inside = _is_word[data]
        before = np.empty(n, dtype=np.uint8)
        before[0] = 0
        before[1:] = inside[:-1]
        before[ends[:-1][ends[:-1] < n]] = 0  # a document's first byte begins anew
        after = np.empty(n, dtype=np.uint8)
        after[-1] = 0
        after[:-1] = inside[1:]
        after[ends[1:][ends[1:] > 0] - 1] = 0
        self.start = np.flatnonzero(inside > before)
        self.end = np.flatnonzero(inside > after) + 1
        up, down = _power(n)
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((_lower_value if lower else _byte_value)[data] * up[:n], out=total[1:])
        self.hash = mix64((total[self.end] - total[self.start]) * down[self.start])
        self.offset = np.searchsorted(self.start, ends)

    def word_bytes(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def blocks(texts: pa.Array, lower: bool, block: int = BLOCK) -> Iterator[Block]:
    """Blocks of an Arrow string column; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_string(texts.type):
        kind = np.int32
    else:
        texts, kind = texts.cast(pa.large_string()), np.int64
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + block, side="right")) - 1)
        yield Block(lo, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], lower)
        lo = hi


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, from the words' hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= _U(_BASE)
        out += h[k:k + m]
    return mix64(out)
