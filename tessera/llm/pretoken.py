"""Pre-tokens of byte-level BPE as ragged numpy arrays, straight from UTF-8 buffers.

The split equals the pattern of the byte-level pre-tokenizer:
'(s|t|re|ve|m|ll|d), or an optional space and a run of letters, of numbers or of other characters, or white space.
It is found from character classes by whole-array operations, without a loop over characters or texts.
"""

from __future__ import annotations

import ctypes
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Bytes worked on at once; working arrays take some 60 times as much.
BLOCK_BYTES = 2 << 20
#: Bytes that are looked through at once for a place to cut a long text.
CUT_BYTES = 1 << 14
# White space of the Unicode property White_Space.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ROOT = np.uint64(0x9E3779B97F4A7C15 | 1)


@cache
def classes() -> np.ndarray:
    """Class of each code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kinds[cp] = LETTER
        elif c == "N":
            kinds[cp] = NUMBER
    kinds[WHITE] = SPACE
    return kinds


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """root ** i and root ** -i modulo 2 ** 64 for i < n.

    A worker keeps one pair of tables, as long as the longest that was asked for, in whole megabytes.
    """
    if not _powers or len(_powers[0]) < n:
        size = -(-n >> 20) << 20
        inverse = np.uint64(pow(int(_ROOT), -1, 1 << 64))
        _powers.clear()
        for root in (_ROOT, inverse):
            table = np.full(size, root, np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(table, out=table)
            _powers.append(table)
    return _powers[0][:n], _powers[1][:n]


@cache
def special_tokens(path: str) -> dict[bytes, int]:
    with open(path, encoding="utf-8") as f:
        return {x["content"].encode(): x["id"] for x in json.load(f)["added_tokens"]}


@cache
def lean() -> None:
    """Let this worker give freed arrays back to the system, rather than keep them for later.

    Workers live on between tasks, and what they keep adds up beside the executor's own memory.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 24 << 20)  # M_MMAP_THRESHOLD: larger arrays are mapped on their own
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass  # not glibc


def give_back() -> None:
    """Return the free memory of this worker to the system, at the end of a task; what it remembers stays."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def utf8_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and len(texts) + 1 offsets; a null is empty."""
    lean()
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets is not None and offsets.size else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the texts of a column reach ``size`` bytes; a longer text is alone."""
    _, offsets = utf8_of(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each character of valid UTF-8 begins, its code point and its class."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    head = raw[lead]
    cp = head.astype(np.int32)
    kind = classes()[:256][head]
    high = np.flatnonzero(head >= 0x80)
    if len(high):
        padded, at = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int32), lead[high]
        first, a, b, c = cp[high], *(padded[at + k] & 0x3F for k in (1, 2, 3))
        wide = np.where(first < 0xE0, (first & 0x1F) << 6 | a, (first & 0x0F) << 12 | a << 6 | b)
        cp[high] = np.where(first < 0xF0, wide, (first & 0x07) << 18 | a << 12 | b << 6 | c)
        kind[high] = classes()[cp[high]]
    return lead, cp, kind


def cut_after(raw: np.ndarray, at: int, specials: dict[bytes, int] | None = None) -> int:
    """First place from ``at`` on where a pre-token begins whatever stands around it; the end, if there is none.

    That is where a run of letters, of numbers or of other characters ends, but for other characters that end in an
    apostrophe before a letter (it may belong to a contraction). Places inside of a special string don't count.
    """
    longest = max(map(len, specials or {}), default=0)
    while at < len(raw):
        while at > 0 and raw[at] & 0xC0 == 0x80:
            at -= 1
        stop = min(len(raw), at + CUT_BYTES)
        while stop < len(raw) and raw[stop] & 0xC0 == 0x80:
            stop += 1
        lead, cp, kind = code_points(raw[at:stop])
        before, after = kind[:-1], kind[1:]
        safe = (before != after) & (before != SPACE) & ~((before == OTHER) & (after == LETTER) & (cp[:-1] == 0x27))
        for p in (lead[1:][safe] + at).tolist():
            near = raw[max(0, p - longest + 1) : p + longest - 1].tobytes() if longest else b""
            own = p - max(0, p - longest + 1)
            if not any(0 <= (q := near.find(w, max(0, own - len(w) + 1))) < own for w in specials or {}):
                return p
        if stop == len(raw):
            break
        at = stop - 1  # its last character is the next piece's first
    return len(raw)


def blocks(raw: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES, specials: dict[bytes, int] | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut texts into blocks of about ``size`` bytes: (first text, one past the last, bytes, offsets in the block).

    A text longer than that comes in several blocks, cut where a pre-token begins in any case (``cut_after``).
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        part = raw[offsets[i] : offsets[j]]
        if j == i + 1 and len(part) > size:
            a = 0
            while a < len(part):
                b = cut_after(part, a + size, specials)
                yield i, j, part[a:b], np.array([0, b - a])
                a = b
        else:
            yield i, j, part, offsets[i : j + 1] - offsets[i]
        i = j


def split(raw: np.ndarray, offsets: np.ndarray, specials: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pre-tokens begin, and the id of the special token that begins there, or -1."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lead, cp, kind = code_points(raw)
    n = len(lead)
    edge = np.zeros(n + 1, bool)  # texts and special tokens begin and end here
    edge[np.searchsorted(lead, offsets)] = True
    edge[0] = edge[n] = True
    found: list[tuple[int, int, int]] = []
    if specials:
        whole = raw.tobytes()
        for word, token in specials.items():
            p = whole.find(word)
            while p >= 0:
                q = p + len(word)
                if offsets[np.searchsorted(offsets, p, side="right")] >= q:
                    found.append((int(np.searchsorted(lead, p)), int(np.searchsorted(lead, q)), token))
                    p = whole.find(word, q)
                else:
                    p = whole.find(word, p + 1)
        for a, b, _ in found:
            edge[a] = edge[b] = True
    begin = edge[:n].copy()
    white = kind == SPACE
    inner = ~edge[1:n]
    change = (kind[1:] != kind[:-1]) & inner
    begin[1:] |= change
    # the last of a run of white space parts from the run, and a space joins what follows
    last = white[:-1] & ~white[1:] & inner
    begin[:-1] |= last
    begin[1:] &= ~(last & (cp[:-1] == 0x20))
    # contractions
    for k in np.flatnonzero(begin & (cp == 0x27)):
        if k + 1 < n and not edge[k + 1] and kind[k + 1] == LETTER:
            one = chr(cp[k + 1])
            two = one + chr(cp[k + 2]) if k + 2 < n and not edge[k + 2] else ""
            size = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
            if size:
                begin[k + 1 : k + 1 + size] = False
                if k + 1 + size < n:
                    begin[k + 1 + size] = True
    token = np.full(n, -1, np.int64)
    for a, b, t in found:
        begin[a + 1 : b] = False
        token[a] = t
    first = np.flatnonzero(begin)
    return lead[first], token[first]


def distinct(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group equal pieces: for each piece its group, and for each group begin and end of one piece of it.

    Pieces are grouped by a 64-bit hash; then every piece is compared with its group's first, byte by byte, and pieces
    that differ (a collision) get groups of their own, so groups are exact.
    """
    ends = np.append(starts[1:], len(raw))
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        sums[1:] = raw
        sums[1:] += np.uint64(1)
        sums[1:] *= up[: len(raw)]
        np.cumsum(sums, out=sums)
        hashes = (sums[ends] - sums[starts]) * down[starts]
        hashes ^= hashes >> np.uint64(32)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= (ends - starts).astype(np.uint64)
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = starts.astype(np.int32), ends.astype(np.int32)
    begin, end = starts[first], ends[first]
    lengths = ends - starts
    bad = np.flatnonzero(lengths != (end - begin)[group])
    at = np.repeat(begin[group] - starts, np.minimum(lengths, (end - begin)[group])) if len(bad) else np.repeat(begin[group] - starts, lengths)
    if not len(bad):
        differ = raw != raw[np.arange(len(raw), dtype=np.int32) + at]
        if differ.any():
            bad = np.unique(np.searchsorted(starts, np.flatnonzero(differ), side="right") - 1)
    if len(bad):  # a collision: give each of these pieces a group of its own
        group = group.copy()
        group[bad] = len(begin) + np.arange(len(bad))
        begin, end = np.append(begin, starts[bad]), np.append(end, ends[bad])
    return group, begin.astype(np.int64), end.astype(np.int64)
