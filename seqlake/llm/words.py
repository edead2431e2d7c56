"""Words and word shingles as 64-bit hashes, computed for a block of texts at a time.

A word is a maximal run of bytes other than space and ``\\x09``-``\\x0D``; ``A``-``Z`` count as
``a``-``z``. A word's hash is a polynomial over its bytes modulo 2**64 (a seeded random number
per byte value, a seeded odd base), mixed at the end. All words of a block come from one
cumulative sum, so there is no Python loop over words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 19                      # bytes of text handled at once

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]         # A-Z hash as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1       # = 5 modulo 8: differences of its powers keep few factors of 2
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for ``i < n`` (grown by doubling)."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        for k, b in enumerate((_BASE, inverse)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_block(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of one block of bytes."""
    gap = _SPACE[b]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(b)]))
    if not len(edge):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    start, end = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(b))
    total = np.empty(len(b) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * power[:len(b)], out=total[1:])
    return start, mix((total[end] - total[start]) * inverse[start])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of all words of ``data``, whatever its length: blocks are cut
    at white space, so working memory does not grow with the text (a word longer than a block
    makes its block longer)."""
    b = np.frombuffer(data, dtype=np.uint8)
    if len(b) <= 2 * BLOCK:
        return _hash_block(b) if len(b) else (np.empty(0, np.int64), np.empty(0, np.uint64))
    starts, hashes, at = [], [], 0
    while at < len(b):
        end = at + BLOCK
        while end < len(b):
            gaps = np.flatnonzero(_SPACE[b[end:end + 4096]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += 4096
        s, h = _hash_block(b[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def blocks(texts: list[str | None], limit: int = BLOCK):
    """Groups of consecutive texts of about ``limit`` bytes: yields ``(first, encoded texts)``."""
    first, size, group = 0, 0, []
    for i, t in enumerate(texts):
        e = (t or "").encode("utf-8", "surrogatepass")
        group.append(e)
        size += len(e) + 1
        if size >= limit:
            yield first, group
            first, size, group = i + 1, 0, []
    if group:
        yield first, group


def words_of(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a group of encoded texts and the bounds of each text's words
    (text ``i`` has ``hashes[bounds[i]:bounds[i + 1]]``)."""
    start, h = word_hashes(b" ".join(group))
    size = np.fromiter(map(len, group), dtype=np.int64, count=len(group)) + 1
    begin = np.concatenate(([0], np.cumsum(size)))
    return h, np.searchsorted(start, begin)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each text and their bounds (with repeats). A text
    of fewer words has its whole word sequence as its one shingle, one without words none."""
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate(([0], np.cumsum(count)))
    text = np.repeat(np.arange(len(n)), count)
    first = bounds[:-1][text] + np.arange(out_bounds[-1]) - out_bounds[:-1][text]
    length = np.minimum(n, k)[text]
    s = np.zeros(len(first), dtype=np.uint64)
    for j in range(k):
        if not len(h):
            break
        there = length > j
        part = h[np.minimum(first + j, len(h) - 1)] * _STEP[j]
        s += part if there.all() else np.where(there, part, np.uint64(0))
    return mix(s + length.astype(np.uint64) * _STEP[63]), out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each slice, and the new bounds."""
    flat = values.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        flat[a:b].sort()
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[bounds[:-1][bounds[:-1] < len(flat)]] = True
    return flat[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def set_digests(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set that do not depend on the order of its members."""
    a = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(1)))))
    b = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(0xD6E8FEB86659FD93)))))
    return (mix(a[bounds[1:]] - a[bounds[:-1]]), mix(b[bounds[1:]] - b[bounds[:-1]]))
