"""CRC-32C of many byte strings at once, in numpy, and its masked form.

A checksum without its start and end values is linear, and that of a concatenation follows from those of its parts.
So each string is padded with zeros in front (which change nothing), its words are looked up all at once, and
neighbours are joined pairwise, level by level.
"""

from __future__ import annotations

from functools import cache

import numpy as np

POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8


@cache
def byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 0xFF] ^ tables[1][(c >> 8) & 0xFF] ^ tables[2][(c >> 16) & 0xFF] ^ tables[3][c >> 24]


@cache
def _wide_tables(level: int) -> tuple[np.ndarray, np.ndarray]:
    """The tables of ``level``, by 16 bits at once."""
    t, x = shift_tables(level), np.arange(1 << 16)
    return t[0][x & 0xFF] ^ t[1][x >> 8], t[2][x & 0xFF] ^ t[3][x >> 8]


def _apply_wide(level: int, c: np.ndarray) -> np.ndarray:
    low, high = _wide_tables(level)
    return low[c & 0xFFFF] ^ high[c >> 16]


@cache
def shift_tables(level: int) -> np.ndarray:
    """Tables that carry a checksum over 4 * 2 ** level zero bytes."""
    if level:
        half = shift_tables(level - 1)
        return np.stack([_apply(half, t) for t in half])
    one = byte_table()
    c = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(4):
        c = one[c & 0xFF] ^ (c >> np.uint32(8))
    return c


@cache
def _bytes_shifts() -> np.ndarray:
    """What a start value becomes over 2 ** k bytes, as tables, for k up to 40."""
    one = byte_table()
    c = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    tables = [one[c & 0xFF] ^ (c >> np.uint32(8))]
    for _ in range(40):
        tables.append(np.stack([_apply(tables[-1], t) for t in tables[-1]]))
    return np.stack(tables)


def crc32c(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of raw[starts[i] : starts[i] + lengths[i]] for each i."""
    n = len(starts)
    if not n:
        return np.empty(0, np.uint32)
    words = np.maximum((lengths + 3) // 4, 1)
    ends = np.cumsum(words)
    padded = np.zeros(int(ends[-1]) * 4, np.uint8)
    for a, k, b in zip(starts.tolist(), lengths.tolist(), (ends * 4).tolist(), strict=True):
        padded[b - k : b] = raw[a : a + k]
    c = _apply_wide(0, padded.view("<u4").astype(np.uint32))
    level = 0
    while words.max() > 1:
        half = (words + 1) // 2
        if (words & 1).any():  # a zero block in front makes the number even
            out = np.zeros(int(half.sum()) * 2, np.uint32)
            to = np.cumsum(half * 2) - words
            out[np.arange(len(c)) + np.repeat(to - (np.cumsum(words) - words), words)] = c
            c = out
        c = _apply_wide(level, c[0::2]) ^ c[1::2]
        words, level = half, level + 1
    start = np.full(n, 0xFFFFFFFF, np.uint32)
    for k in range(int(lengths.max()).bit_length()):
        on = (lengths >> k) & 1 == 1
        start[on] = _apply(_bytes_shifts()[k], start[on])
    return c ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    with np.errstate(over="ignore"):
        return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
