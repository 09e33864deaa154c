"""Whole-batch hashing of word shingles with numpy: no Python work per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for i, base in enumerate((_STEP, _BACK)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _POW[i] = np.multiply.accumulate(out)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of texts laid end to end, and each text's first word.

    ``cuts`` holds the len(texts)+1 byte offsets. Words are runs of bytes other than 0x20, 0x09-0x0D.
    """
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[cuts] = True
    before = np.empty(n, dtype=bool)
    before[1:] = inside[:-1]
    before[:1] = False
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[:-1] = inside[1:]
    after[-1:] = False
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, back = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts]), np.searchsorted(starts, cuts)


def shingle_hashes(data: np.ndarray, cuts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``k``-word shingles' hashes, in place of their first word, with each text's first word and
    number of shingles. Fewer words than ``k``: the whole sequence is one shingle. No words: none."""
    words, first = word_hashes(data, cuts)
    n = np.diff(first)
    out = np.zeros(len(words), np.uint64)
    if (m := len(words) - k + 1) > 0:
        for j in range(k):
            out[:m] += words[j : j + m] * _MIX[j]
    out = mix(out)
    for d in np.flatnonzero((n > 0) & (n < k)):
        a, b = first[d], first[d + 1]
        out[a] = mix((words[a:b] * _MIX[: b - a]).sum(dtype=np.uint64, keepdims=True) + _MIX[32 + b - a])[0]
    return out, first[:-1], np.where(n >= k, n - k + 1, np.minimum(n, 1))


def text_slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, cuts) of runs of rows of about ``most`` bytes; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
