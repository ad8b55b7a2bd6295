"""Token counts by rank-synchronous merging of numpy arrays.

Texts of a batch are split into pre-tokens; equal ones are merged once. All distinct pre-tokens are held as one ragged
array of symbols. In each round every pre-token's lowest-rank pair is found and all its occurrences in that pre-token
are merged, for all pre-tokens of the batch at the same time. Pre-tokens without a pair to merge leave the array with
their number of symbols. A document's count is the sum over its pre-tokens; special strings count as one.

Only (id, text) enters, only counts leave, nothing is shuffled, and memory follows the batch. Long texts of any script are
worked on in blocks cut where a pre-token begins; only a single pre-token (a run of letters, say) is never cut.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated results; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import pretoken
from tessera.runtime import small_batches

NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """Ranks of symbol pairs in an open-addressing table that whole arrays can be looked up in."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        self.of_byte = np.array([ids[c] for c in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks, self.made = np.full(1 << self.bits, NONE, np.int64), np.zeros(1 << self.bits, np.int64)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] < 0
            _, one = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][one]
            self.keys[slot[put]], self.ranks[slot[put]], self.made[slot[put]] = keys[put], put, made[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of each pair, or that of an empty place, whose rank is NONE."""
        keys = left << 32 | right
        slot = self._slot(keys)
        seen = self.keys[slot]
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[slot[open_]]
            open_ = open_[(seen != keys[open_]) & (seen >= 0)]
        return slot


@cache
def merges(path: str) -> Merges:
    return Merges(path)


def count_symbols(symbols: np.ndarray, lengths: np.ndarray, table: Merges) -> np.ndarray:
    """Number of symbols left of each sequence of the ragged array (symbols, lengths) after all merges."""
    left = lengths.astype(np.int64).copy()
    alive = np.flatnonzero(lengths > 1)
    keep = np.repeat(lengths > 1, lengths)
    symbols, lengths = symbols[keep], left[alive]
    slots = None
    while len(alive):
        starts = np.cumsum(lengths) - lengths
        final = np.zeros(len(symbols), bool)
        final[starts + lengths - 1] = True
        slots = np.zeros(len(symbols), np.int64)
        slots[:-1] = table.find(symbols[:-1], symbols[1:])
        ranks = np.where(final, NONE, table.ranks[slots])
        least = np.minimum.reduceat(ranks, starts)
        hit = (ranks == np.repeat(least, lengths)) & (ranks < NONE)
        # of pairs that overlap, as in a run of one symbol, every second is merged
        run = hit.copy()
        run[1:] &= hit[:-1]
        if run.any():
            at = np.arange(len(hit))
            first = np.maximum.accumulate(np.where(hit & ~run, at, 0))
            hit &= (at - first) % 2 == 0
        symbols = np.where(hit, table.made[slots], symbols)
        gone = np.zeros(len(symbols), bool)
        gone[1:] = hit[:-1]
        lengths = lengths - np.add.reduceat(hit, starts, dtype=np.int64)
        left[alive] = lengths
        go_on = (least < NONE) & (lengths > 1)
        keep = ~gone & np.repeat(go_on, np.add.reduceat(np.ones(len(gone), np.int64), starts))
        symbols, lengths, alive = symbols[keep], lengths[go_on], alive[go_on]
    return left


def counts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of each text."""
    raw, offsets = pretoken.utf8_of(texts)
    tokens, table = np.zeros(len(offsets) - 1, np.int64), merges(path)
    specials = pretoken.special_tokens(path)
    for i, j, part, at in pretoken.blocks(raw, offsets, specials=specials):
        if not len(part):
            continue
        starts, special = pretoken.split(part, at, specials)
        group, begin, end = pretoken.distinct(part, starts)
        lengths = end - begin
        flat = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        each = count_symbols(table.of_byte[part[flat]], lengths, table)[group]
        each[special >= 0] = 1
        text = np.searchsorted(at, starts, side="right") - 1
        tokens[i:j] += np.bincount(text, weights=each, minlength=j - i).astype(np.int64)
    return np.diff(offsets), tokens


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. ``vocabulary`` is a file on every executor."""

    def run(batches):
        for batch in batches:
            n_bytes, n_tokens = counts(batch.column(1), vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
