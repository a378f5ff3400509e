"""Words of a batch of texts and 64-bit hashes of words and word n-grams, with numpy.

A word is a maximal run of bytes other than blank and tab to carriage return (0x20, 0x09-0x0D) in
the UTF-8 text. Hashes are polynomials modulo 2^64, taken from prefix sums and then mixed; equal
words have equal hashes, and memory is about 40 bytes for each byte of the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A fixed random 64-bit value for each byte.
_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n."""
    got = _cache.get(base)
    if got is None or len(got[0]) <= n:
        size = 1 << max(16, n.bit_length())
        got = tuple(
            np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(size, b, _U)]))
            for b in (base, pow(base, -1, 1 << 64))
        )
        _cache[base] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Words:
    """Words of a batch, in order. ``bounds[i]:bounds[i+1]`` are those of text i; ``starts`` and
    ``ends`` are byte positions in ``data``, the texts one after another."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position on. Positions whose k words leave the batch are
        absent and those that cross into the next text are meaningless: see ``inside``."""
        return gram_hashes(self.hashes, k)

    def inside(self, k: int) -> np.ndarray:
        """For each position of ``grams(k)``: do its k words belong to one text?"""
        n = max(0, len(self.hashes) - k + 1)
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        return text[:n] == text[k - 1 : k - 1 + n]


def prefix_sums(hashes: np.ndarray) -> np.ndarray:
    up, _ = _powers(_WORD_BASE, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the words first to last - 1, which also depends on their number."""
    _, down = _powers(_WORD_BASE, len(sums))
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(_U) * _U(0xD6E8FEB86659FD93))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    first = np.arange(max(0, len(hashes) - k + 1))
    return range_hashes(prefix_sums(hashes), first, first + k)


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of a string array; null counts as empty. ``lower``: A-Z are lower-cased first."""
    texts = texts.fill_null("").cast(pa.large_string())
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    first = ~space
    last = ~space
    if len(data):
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first[1:] &= space[:-1] | edge[1:-1]
        last[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(_BYTE_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes)
