"""Sets of hashed word shingles, straight from UTF-8 buffers, as ragged numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm import pretoken

WORDS = 5
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_PLACES = mix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | _U(1)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in a row, and the number of words of each text; A-Z count as a-z."""
    inside = ~_WHITE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = np.zeros(len(raw), bool)
    stop[:-1] = inside[:-1] & (~inside[1:] | edge[1:-1])
    if len(raw):
        stop[-1] = inside[-1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = pretoken.powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[_LOWER[raw]] * up[: len(raw)], out=sums[1:])
        hashes = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(a, offsets))


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingles of all texts in a row, and the size of each set.

    A text of fewer than WORDS words has one shingle, its whole sequence; a text without words has none.
    """
    raw, offsets = pretoken.utf8_of(texts)
    parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + pretoken.BLOCK_BYTES, side="right")) - 1)
        words, n = word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        first = np.cumsum(n) - n
        with np.errstate(over="ignore"):
            long = np.maximum(n - WORDS + 1, 0)
            at = np.repeat(first - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
            h = np.zeros(len(at), np.uint64)
            for k in range(WORDS):
                h += words[at + k] * _PLACES[k]
            count = np.where(n >= WORDS, long, n > 0)
            all_ = np.empty(int(count.sum()), np.uint64)
            own = np.cumsum(count) - count
            all_[np.repeat(own - (np.cumsum(long) - long), long) + np.arange(len(at))] = mix(h)
            for d in np.flatnonzero((n > 0) & (n < WORDS)):
                w = words[first[d] : first[d] + n[d]]
                all_[own[d]] = mix(mix((w * _PLACES[: len(w)]).sum(dtype=np.uint64)) + _U(len(w)) * _U(0x9E3779B97F4A7C15) + _U(1))[()]
        for d in np.flatnonzero(count > 1):
            all_[own[d] : own[d] + count[d]].sort()
        keep = np.ones(len(all_), bool)
        keep[1:] = all_[1:] != all_[:-1]
        keep[own[count > 0]] = True
        sizes[i:j] = np.add.reduceat(np.append(keep, False), np.minimum(own, len(keep)), dtype=np.int64) * (count > 0)
        parts.append(all_[keep])
        i = j
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), sizes


def digests(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, that depend on its members alone."""
    starts = np.cumsum(sizes) - sizes
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(np.append(mix(flat ^ _U(salt)), _U(0)), np.minimum(starts, len(flat)))
        sums[sizes == 0] = 0
        out.append(mix(sums ^ sizes.astype(np.uint64)).view(np.int64))
    return out[0], out[1]
