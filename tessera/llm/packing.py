"""Best-fit packing of documents into token sequences of several permitted lengths.

Texts are encoded by the tokenizers library, each followed by an end token. Documents longer than the longest permitted
length are cut into pieces of that length; nothing is dropped. Pieces are packed in descending order of length. A piece
goes to the open bin in which it leaves the least room. If it fits nowhere, a bin is opened in the size that costs least
for the tokens it can still get: ``cost(L)`` divided by the smaller of L and the tokens not yet packed, over all
permitted L that hold the piece. At the end each bin shrinks to the shortest permitted length that holds its contents.
So the lengths are chosen jointly. The default cost of a sequence is a fixed part, its tokens, and a share that grows
with the square of its length, as attention does: long bins are opened for long pieces only, and middle ones for others.

Pieces are dealt to tasks by a hash of their content and shuffled once, with their token ids. A task packs about
``chunk_tokens`` tokens at a time, in the order of that hash, so its memory is bounded and the same pieces in the same
partitions give the same bins. Bins never span two such chunks. Equal pieces from different parts of the reading go to
different tasks, so a row that repeats very often is spread.

Defined results: a null or empty text has length 1, its end token; rows that are equal in id and text are packed
separately; an id may be null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import pretoken
from tessera.llm.token_records import encoder
from tessera.runtime import row_key, small_batches

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence besides its tokens, in tokens, and the length at which attention costs as much as all the rest.
OVERHEAD, ATTENTION = 256, 8192
CHUNK_TOKENS = 8 << 20
#: Pieces held at once: short ones take more memory than their tokens do.
CHUNK_PIECES = 1 << 18
#: Bytes of text for one task of the packing; of small inputs, so that all tasks get something.
TASK_BYTES, LEAST_TASK_BYTES = 256 << 20, 4 << 20
BIN_BITS = 32
#: Pre-tokens that a worker remembers in a task and after it, as other stages need the memory, too.
MEMO_PIECES, REST_PIECES = 1 << 17, 1 << 14

SCHEMA = "bin_id long, bin_length int, bin_used int, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<int>, ids binary"


def sequence_cost(length: int) -> float:
    return OVERHEAD + length + length * length / ATTENTION


def pack_sizes(sizes: Sequence[int], lengths: Sequence[int], cost: Callable[[int], float] = sequence_cost) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pack ``sizes``, sorted descending and none above max(lengths).

    Returns bin and position in the bin of each item, and length and used tokens of each bin.
    """
    lengths = sorted(lengths)
    costs = [cost(n) for n in lengths]
    left = int(sum(sizes))
    by_room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    rooms = 0  # bit r is set if an open bin has room for r tokens
    where, position, opened, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), [], []
    for i, size in enumerate(sizes):
        fitting = rooms >> size
        if fitting and size:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room = min((c / min(n, left), n) for n, c in zip(lengths, costs, strict=True) if n >= size)[1] if left else lengths[0]
            b = len(used)
            opened.append(room)
            used.append(0)
        where[i], position[i] = b, used[b]
        used[b] += size
        left -= size
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    final = np.asarray(lengths)[np.searchsorted(lengths, used)] if used else np.empty(0, np.int64)
    return where, position, final, np.asarray(used, np.int64)


def _pieces(vocabulary: str, end_id: int | None, longest: int):
    """Batches of (id, text, k1, k2, part) to rows for each piece: k1, k2, piece, part, id, start, ids."""

    def run(batches):
        lib = encoder(vocabulary, MEMO_PIECES)
        for batch in (s for b in batches for s in pretoken.slices(b, 1)):
            ids, n = lib.encode(batch.column(1))
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            # without an end token an empty text has no piece
            pieces = -(-n // longest)
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * longest
            first = (np.cumsum(n) - n)[row] + start
            size = np.minimum(n[row] - start, longest)
            data, take = ids.astype("<u4"), pa.array(row)
            for a in range(0, len(row), SEND_PIECES):
                z = slice(a, a + SEND_PIECES)
                ends = np.concatenate([[0], np.cumsum(size[z] * 4)]).astype(np.int64)
                body = np.ascontiguousarray(data[first[z][0] : first[z][-1] + size[z][-1]])
                own = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body)]).cast(pa.binary())
                k = take.slice(a, len(ends) - 1)
                cols = [batch.column(2).take(k), batch.column(3).take(k), pa.array(piece[z].astype(np.int32)), batch.column(4).take(k), batch.column(0).take(k), pa.array(start[z]), own]
                yield pa.RecordBatch.from_arrays(cols, names=["k1", "k2", "piece", "part", "id", "start", "ids"])
        lib.thin(REST_PIECES)
        pretoken.give_back()

    return run


#: Pieces sent to Spark at once.
SEND_PIECES = 4096


def _bins(tables: list[pa.RecordBatch], lengths: Sequence[int], cost, first: int) -> Iterator[pa.RecordBatch]:
    """Pack all pieces of ``tables``; one row per bin, numbered from ``first``."""
    table = pa.Table.from_batches(tables)
    ids = table.column("ids").cast(pa.large_binary()).combine_chunks()
    offsets = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
    data = np.frombuffer(ids.buffers()[2], np.uint8)
    size = np.diff(offsets) // 4
    # pieces come in the order of their keys, so a stable sort settles ties by them
    order = np.argsort(-size, kind="stable")
    where, _, final, used = pack_sizes(size[order].tolist(), lengths, cost)
    by_bin = np.argsort(where, kind="stable")
    order, where = order[by_bin], where[by_bin]
    doc, piece, start = (table.column(c).combine_chunks().take(pa.array(order)) for c in ("id", "piece", "start"))
    for a in range(0, len(used), SEND_BINS):
        b = min(a + SEND_BINS, len(used))
        lo, hi = np.searchsorted(where, [a, b])
        some = order[lo:hi]
        at = np.concatenate([[0], np.cumsum(np.bincount(where[lo:hi] - a, minlength=b - a))]).astype(np.int32)
        body = b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in some.tolist())
        ends = np.concatenate([[0], np.cumsum(used[a:b] * 4)]).astype(np.int64)
        packed = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body)]).cast(pa.binary())
        nested = lambda x, at=at: pa.ListArray.from_arrays(pa.array(at), x)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(first + np.arange(a, b)),
                pa.array(final[a:b].astype(np.int32)),
                pa.array(used[a:b].astype(np.int32)),
                nested(doc.slice(lo, hi - lo)),
                nested(piece.slice(lo, hi - lo)),
                nested(start.slice(lo, hi - lo)),
                nested(pa.array(size[some].astype(np.int32))),
                packed,
            ],
            names=["bin_id", "bin_length", "bin_used", "doc_ids", "pieces", "starts", "lengths", "ids"],
        )


#: Bins sent to Spark at once.
SEND_BINS = 256


def pack(
    df: DataFrame,
    vocabulary: str,
    end_id: int | None,
    lengths: Sequence[int] = LENGTHS,
    cost: Callable[[int], float] = sequence_cost,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_tokens: int = CHUNK_TOKENS,
    tasks: int | None = None,
) -> DataFrame:
    """One row per packed sequence: bin_id, bin_length, bin_used, doc_ids, pieces, starts, lengths, ids.

    The four arrays have one entry per piece, in the order in which they stand in the sequence: its document, its
    number in that document, the place of its first token there, and its length. ``ids`` are the token ids, 4 bytes
    little-endian each, ``bin_used`` of them; the sequence is to be padded to ``bin_length``. ``vocabulary`` is a file
    on every executor.
    """
    lengths, spark = tuple(sorted(lengths)), df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if tasks is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        tasks = max(1, -(-size // TASK_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_TASK_BYTES)))
    k1, k2 = row_key(rows)
    # the number of the part that is read is the same when a lost task is repeated
    rows = rows.select("id", "text", k1.alias("k1"), k2.alias("k2"), F.spark_partition_id().alias("part"))
    pieces = rows.mapInArrow(_pieces(vocabulary, end_id, lengths[-1]), "k1 long, k2 long, piece int, part int, id long, start long, ids binary")
    order = ["k1", "k2", "piece", "part"]
    dealt = pieces.repartition(int(tasks), *order).sortWithinPartitions(*order)

    def run(batches):
        pretoken.lean()
        first, held, tokens, n = TaskContext.get().partitionId() << BIN_BITS, [], 0, 0
        for batch in batches:
            held.append(batch.select(["id", "piece", "start", "ids"]))
            tokens, n = tokens + batch.column("ids").nbytes // 4, n + batch.num_rows
            if tokens >= chunk_tokens or n >= CHUNK_PIECES:
                for out in _bins(held, lengths, cost, first):
                    first += out.num_rows
                    yield out
                held, tokens, n = [], 0, 0
        if n:
            yield from _bins(held, lengths, cost, first)
        held = []
        pretoken.give_back()

    return dealt.mapInArrow(run, SCHEMA)
