"""Lines and tables from the places of words on pages, for extractors that give words with their boxes.

Words are rows of file, page, x0, x1 (left and right edge), y (their line's height from the top) and word. Words whose
heights differ by at most ``line_gap`` from the one above them are one line; a larger step than ``block_gap`` begins a new
block. In a block, the spans of all words, put over one another, leave gaps; each gap wider than ``column_gap`` parts two
columns. A block of several columns is a table, its lines the rows; others are prose. Words are shuffled once, by page, and
sorted by Spark; tasks take them as arrays, some whole pages at a time, so a page is the most that must be held.

``page_tables`` and ``page_lines`` read words in that one pass. ``placed`` gives the words themselves with their places, for
other uses; ``tables`` and ``prose`` put them together again, which shuffles them.

Defined results: a word without a place or of white space alone goes; equal places keep the order of the words; a block's
table has all its columns in every row, empty cells as empty strings; tables are numbered from 0 on their page, lines of
prose too; pages without words give nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T

LINE_GAP, BLOCK_GAP, COLUMN_GAP = 3.0, 18.0, 12.0
#: Words that a task works on at once; a page of more is held whole.
PAGE_WORDS = 1 << 16


def _kept(words: DataFrame) -> DataFrame:
    """Words with a place, a page's in one task and one after the other."""
    rows = words.where("x0 IS NOT NULL AND x1 IS NOT NULL AND y IS NOT NULL").where(F.col("word").rlike(f"[^{T.WS[1:-1]}]"))
    rows = rows.select("file", "page", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y")], "word")
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "file", "page").sortWithinPartitions("file", "page")


def _begins(*columns: pa.ChunkedArray) -> np.ndarray:
    """Whether a row differs from the one before in any column; nulls are equal."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        code = pc.dictionary_encode(c.combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return new


def _whole_pages(batches) -> Iterator[pa.Table]:
    """Rows that are sorted by page, some pages at a time. A page of many batches is put together a few times only."""
    held, n, most = [], 0, PAGE_WORDS
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n < most:
            continue
        table = pa.Table.from_batches(held)
        last = int(np.flatnonzero(_begins(table["file"], table["page"]))[-1])
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
        held, n = rest.to_batches(), rest.num_rows
        most = max(PAGE_WORDS, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def _since(flags: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Number of flags from the beginning of each row's group on, the beginning's own left out."""
    total = np.cumsum(flags)
    first = np.flatnonzero(begins)
    return total - np.repeat(total[first], np.diff(np.append(first, len(flags))))


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


class _Words:
    """Words of whole pages in the order of page, block, row, col, x0, x1, word; ``at`` is where each stood."""

    def __init__(self, table: pa.Table, line_gap: float, block_gap: float, column_gap: float):
        page = np.cumsum(_begins(table["file"], table["page"])) - 1
        x0, x1, y = (table[c].to_numpy() for c in ("x0", "x1", "y"))
        word = pc.rank(table["word"].combine_chunks(), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        at = _order(page, y, x0, x1, word)
        page, x0, x1, y, word = (v[at] for v in (page, x0, x1, y, word))
        first = np.append(True, page[1:] != page[:-1])
        with np.errstate(invalid="ignore"):
            step = np.where(first, 0.0, y - np.append(0.0, y[:-1]))
        # as Spark compares: NaN is larger than any number
        row, block = _since(~(step <= line_gap), first), _since(~(step <= block_gap), first)
        group = np.cumsum(first | np.append(False, block[1:] != block[:-1])) - 1
        across = _order(group, x0, x1, y, word)
        at, page, x0, x1, word, row, block, group = (v[across] for v in (at, page, x0, x1, word, row, block, group))
        first = np.append(True, group[1:] != group[:-1])
        # the right end of all words before in the block: a running maximum of ranks, blocks apart
        ends, rank = np.unique(x1, return_inverse=True)
        top = np.maximum.accumulate(group * len(ends) + rank)
        covered = ends[np.append(0, top[:-1]) % len(ends)] + column_gap
        col = _since(~first & np.where(np.isnan(x0), ~np.isnan(covered), x0 > covered), first)
        columns = np.maximum.reduceat(col, np.flatnonzero(first))[group] + 1
        self.order = _order(group, row, col, x0, x1, word)
        self.at, self.page, self.x0, self.x1, self.word, self.row, self.block, self.group, self.col, self.columns = (
            v[self.order] for v in (at, page, x0, x1, word, row, block, group, col, columns)
        )
        self.table = table

    def some(self, keep: np.ndarray, *order: str) -> list[np.ndarray]:
        """at, page, group, row, col and columns of the words that are kept, in another order if one is given."""
        at = np.flatnonzero(keep)
        if order:
            at = at[_order(*(getattr(self, c)[at] for c in order))]
        return [v[at] for v in (self.at, self.page, self.group, self.row, self.col, self.columns)]

    def texts(self, at: np.ndarray, first: np.ndarray) -> pa.Array:
        """Words joined by spaces; a text begins at each of ``first``."""
        words = self.table["word"].combine_chunks().cast(pa.string()).take(pa.array(at))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), words), " ")

    def names(self, at: np.ndarray) -> list[pa.Array]:
        return [self.table[c].combine_chunks().take(pa.array(at)) for c in ("file", "page")]


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _kinds(words: DataFrame, rest: str) -> str:
    return ", ".join([f"{c} {words.schema[c].dataType.simpleString()}" for c in ("file", "page")]) + ", " + rest


def placed(words: DataFrame, line_gap: float = LINE_GAP, block_gap: float = BLOCK_GAP, column_gap: float = COLUMN_GAP) -> DataFrame:
    """Words with block, row (both by page, from 0), col (by block, from 0) and the block's number of columns."""

    def run(batches):
        for table in _whole_pages(batches):
            w = _Words(table, line_gap, block_gap, column_gap)
            numbers = [pa.array(v) for v in (w.block, w.row, w.col, w.columns, w.x0, w.x1)]
            yield pa.RecordBatch.from_arrays([*w.names(w.at), *numbers, table["word"].combine_chunks().take(pa.array(w.at))], names=[*"file page block row col columns x0 x1 word".split()])

    return _kept(words).mapInArrow(run, _kinds(words, "block long, row long, col long, columns long, x0 double, x1 double, word string"))


def page_tables(words: DataFrame, line_gap: float = LINE_GAP, block_gap: float = BLOCK_GAP, column_gap: float = COLUMN_GAP) -> DataFrame:
    """Words -> file, page, table_no, rows (row_no, cells), as ``records.markdown`` takes them: a row for each table."""

    def run(batches):
        for table in _whole_pages(batches):
            w = _Words(table, line_gap, block_gap, column_gap)
            at, page, group, row, col, columns = w.some(w.columns > 1)
            if not len(at):
                continue
            cell = _changes(group, row, col)
            line, block = _changes(group, row), _changes(group)
            text = w.texts(at, cell)
            # a line has all columns of its block; those without a word take the empty text, which stands last
            ends = np.cumsum(columns[line])
            number = np.searchsorted(line, cell, side="right") - 1
            every = np.full(int(ends[-1]), len(text))
            every[(ends - columns[line])[number] + col[cell]] = np.arange(len(text))
            text = pa.concat_arrays([text, pa.array([""])]).take(pa.array(every))
            cells = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), text)
            lines = pa.StructArray.from_arrays([pa.array(row[line].astype(np.int32)), cells], names=["row_no", "cells"])
            rows = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(line, block), len(line)).astype(np.int32)), lines)
            first = np.append(True, page[block][1:] != page[block][:-1])
            table_no = _since(np.ones(len(block), np.int64), first).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*w.names(at[block]), pa.array(table_no), rows], names=["file", "page", "table_no", "rows"])

    return _kept(words).mapInArrow(run, _kinds(words, "table_no int, rows array<struct<row_no int, cells array<string>>>"))


def page_lines(words: DataFrame, line_gap: float = LINE_GAP, block_gap: float = BLOCK_GAP, column_gap: float = COLUMN_GAP) -> DataFrame:
    """Words -> file, page, line_no, raw, as ``records.prose_pages`` takes them."""

    def run(batches):
        for table in _whole_pages(batches):
            w = _Words(table, line_gap, block_gap, column_gap)
            at, page, _, row, _, _ = w.some(w.columns == 1, "page", "row", "x0", "x1", "word")
            if not len(at):
                continue
            line = _changes(page, row)
            first = np.append(True, page[line][1:] != page[line][:-1])
            line_no = _since(np.ones(len(line), np.int64), first).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*w.names(at[line]), pa.array(line_no), w.texts(at, line)], names=["file", "page", "line_no", "raw"])

    return _kept(words).mapInArrow(run, _kinds(words, "line_no int, raw string"))


def _joined(rows: DataFrame, *by: str) -> DataFrame:
    """Words of one line or cell, from left to right, with spaces between."""
    some = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "word"))).alias("_w"))
    return some.withColumn("raw", F.array_join(F.transform("_w", lambda w: w["word"]), " ")).drop("_w")


def tables(rows: DataFrame) -> DataFrame:
    """``placed`` words -> file, page, table_no, row_no, cells, as ``records.table_markdown`` takes them."""
    cells = _joined(rows.where("columns > 1"), "file", "page", "block", "columns", "row", "col")
    lines = cells.groupBy("file", "page", "block", "columns", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "raw"))).alias("_c"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1), lambda i: F.coalesce(F.col("_c")[i], F.lit("")))
    number = F.dense_rank().over(Window.partitionBy("file", "page").orderBy("block")) - 1
    return lines.select("file", "page", number.cast("int").alias("table_no"), F.col("row").cast("int").alias("row_no"), every.alias("cells"))


def prose(rows: DataFrame) -> DataFrame:
    """``placed`` words -> file, page, line_no, raw, as ``records.prose_pages`` takes them."""
    lines = _joined(rows.where("columns = 1"), "file", "page", "row")
    number = F.row_number().over(Window.partitionBy("file", "page").orderBy("row")) - 1
    return lines.select("file", "page", number.cast("int").alias("line_no"), "raw")
