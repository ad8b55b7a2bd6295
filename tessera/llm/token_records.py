"""Token ids as length-delimited binary records with an offset index.

A record file is a row of frames, as in the TFRecord format:

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked CRC-32C of the length's bytes
    payload  id of the document (8 bytes), flags (1 byte), token ids (2 or 4 bytes each, little-endian)
    check    4 bytes: masked CRC-32C of the payload

Flag 1: the id is null. Flag 2: ids of 4 bytes, taken if one is above 65,535. The index is a Parquet table, one row per
record: part, seq, doc_id, file, offset, length, n_tokens; `read_shuffled` reads records through it in a random order.

Texts are encoded by the model of the tokenizers library, given pre-tokens. Equal ones are encoded once: they are found by
the pre-tokenizer's own split, and since no merge crosses one, a text's ids are those of its pre-tokens in a row.

Rows are range-partitioned by id (and text), so part files and the records in them ascend. Each task writes its file
under a new name and returns index rows; Spark's commit of the index decides which files count. Reads run over byte
ranges of about READ_BYTES and check every frame.

Defined results: a null or empty text gives the end token only; null ids come first; rows of equal id stand next to
each other in text order; an empty table gives an index without rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import files, pretoken
from tessera.llm.checksums import crc32c, masked
from tessera.llm.token_counts import byte_symbols
from tessera.runtime import materialise, new_folder, small_batches

NULL_ID, WIDE = 1, 2
READ_BYTES = 16 << 20
#: Working arrays take some 60 times as much; pre-tokens are remembered from block to block, so larger ones save nothing.
ENCODE_BYTES = 1 << 19
#: Pre-tokens that a worker remembers, some 200 bytes each.
MEMO_PIECES = 1 << 18
#: Pre-tokens that are encoded in a row: so few lists at once that they don't start Python's garbage collector.
LEARN_PIECES = 500
INDEX = "part int, seq long, doc_id long, file string, offset long, length long, n_tokens long"


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... , counts[k] numbers for each k."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Encoder:
    """The tokenizers library behind a memory of pre-tokens."""

    def __init__(self, path: str, most: int | None = None):
        from tokenizers import Tokenizer

        self.most = most or MEMO_PIECES
        # its model alone: pre-tokens need not be split or looked through for special strings again
        self.model = Tokenizer.from_file(path).model
        # the characters that stand for bytes, all below 65,536
        self.shown = np.array([ord(c) for c in byte_symbols()], "<u2")
        self.special = pretoken.special_tokens(path)
        self._empty()
        if self.special:
            self._remember([self._symbols(np.frombuffer(x, np.uint8)) for x in self.special], np.array(list(self.special.values()), np.int32), np.ones(len(self.special), np.int64))

    def _empty(self) -> None:
        self.memo: dict[str, int] = {}  # piece: its number, whose ids stand from at[number] to at[number + 1]
        self.ids, self.at, self.n = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0
        self.uses = np.zeros(1 << 14, np.int32)  # blocks that had the piece

    def _symbols(self, raw: np.ndarray) -> str:
        """A character for each byte, as the model takes them."""
        return self.shown[raw].tobytes().decode("utf-16-le")

    def _remember(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        base, n = int(self.at[self.n]), self.n + len(pieces)
        while base + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + 1 > len(self.at):
            self.at, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.uses))
        self.ids[base : base + len(ids)] = ids
        self.at[self.n + 1 : n + 1] = base + np.cumsum(counts)
        self.memo.update(zip(pieces, range(self.n, n), strict=True))
        self.n = n

    def thin(self, most: int) -> None:
        """Forget what few blocks had: ``most`` pieces stay, and the special ones."""
        if len(self.memo) <= most:
            return
        pieces, number = list(self.memo), np.array(list(self.memo.values()), np.int64)
        order = np.argsort(-self.uses[number[len(self.special) :]], kind="stable")[:most] + len(self.special)
        keep = np.append(np.arange(len(self.special)), np.sort(order))
        number = number[keep]
        first, counts = self.at[number], self.at[number + 1] - self.at[number]
        ids, uses = self.ids[_ranges(first, counts)], self.uses[number] // 2
        self._empty()
        self._remember([pieces[k] for k in keep.tolist()], ids, counts)
        self.uses[: self.n] = uses

    def _learn(self, pieces: list[str]) -> None:
        ids, counts = [], []
        for a in range(0, len(pieces), LEARN_PIECES):
            found = list(map(self.model.tokenize, pieces[a : a + LEARN_PIECES]))
            ids += [t.id for tokens in found for t in tokens]
            counts += map(len, found)
        self._remember(pieces, np.array(ids, np.int32), np.array(counts, np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each."""
        raw, offsets = pretoken.utf8_of(texts)
        parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
        for i, j, part, at in pretoken.blocks(raw, offsets, ENCODE_BYTES, self.special):
            if not len(part):
                continue
            if len(self.memo) > self.most:
                self.thin(self.most // 2)
            starts, _ = pretoken.split(part, at, self.special)
            group, begin, end = pretoken.distinct(part, starts)
            symbols = self._symbols(part)
            pieces = [symbols[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            known = np.array(list(map(self.memo.get, pieces, repeat(-1))), np.int64)
            unknown = np.flatnonzero(known < 0)
            if len(unknown):
                known[unknown] = self.n + np.arange(len(unknown))
                self._learn([pieces[k] for k in unknown.tolist()])
            self.uses[known] += 1
            known = known[group]
            first, n = self.at[known], self.at[known + 1] - self.at[known]
            parts.append(self.ids[_ranges(first, n)])
            text = np.searchsorted(at, starts, side="right") - 1
            counts[i:j] += np.bincount(text, weights=n, minlength=j - i).astype(np.int64)
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), counts


@cache
def encoder(path: str, most: int | None = None) -> Encoder:
    return Encoder(path, most)


def frames(ids: np.ndarray, counts: np.ndarray, doc_ids: list) -> tuple[bytes, np.ndarray]:
    """Frames of all sequences in a row, and the length of each frame."""
    out, lengths = [], np.empty(len(counts), np.int64)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, doc_id in enumerate(doc_ids):
        own = ids[at[k] : at[k + 1]]
        wide = bool(len(own)) and int(own.max()) > 0xFFFF
        flags = (NULL_ID if doc_id is None else 0) | (WIDE if wide else 0)
        out.append((doc_id or 0).to_bytes(8, "little", signed=True) + bytes([flags]) + own.astype("<u4" if wide else "<u2").tobytes())
        lengths[k] = len(out[-1])
    sizes = lengths.astype("<u8").view(np.uint8)
    eights = np.full(len(lengths), 8)
    head = masked(crc32c(sizes, np.arange(len(lengths)) * 8, eights)).astype("<u4").tobytes()
    body = np.frombuffer(b"".join(out), np.uint8)
    tail = masked(crc32c(body, np.cumsum(lengths) - lengths, lengths)).astype("<u4").tobytes()
    size_bytes = sizes.tobytes()
    whole = b"".join(
        x for k, payload in enumerate(out) for x in (size_bytes[8 * k : 8 * k + 8], head[4 * k : 4 * k + 4], payload, tail[4 * k : 4 * k + 4])
    )
    return whole, lengths + 16


def parse(raw: bytes) -> list[tuple[int, int | None, np.ndarray]]:
    """(offset, doc_id, ids) of each frame; every checksum is verified."""
    starts, p = [], 0
    while p < len(raw):
        starts.append(p)
        p += 16 + int.from_bytes(raw[p : p + 8], "little")
    if p != len(raw):
        raise ValueError("record file is cut short")
    data, at = np.frombuffer(raw, np.uint8), np.array(starts, np.int64)
    lengths = np.diff(np.append(at, len(raw))) - 16
    word = lambda where: data[where[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    if len(at) and not (
        np.array_equal(word(at + 8), masked(crc32c(data, at, np.full(len(at), 8)))) and np.array_equal(word(at + 12 + lengths), masked(crc32c(data, at + 12, lengths)))
    ):
        raise ValueError("record checksum does not match")
    out = []
    for a, n in zip(starts, lengths.tolist(), strict=True):
        flags = raw[a + 20]
        doc_id = None if flags & NULL_ID else int.from_bytes(raw[a + 12 : a + 20], "little", signed=True)
        out.append((a, doc_id, np.frombuffer(raw, "<u4" if flags & WIDE else "<u2", (n - 9) // (4 if flags & WIDE else 2), a + 21)))
    return out


def write(df: DataFrame, vocabulary: str, end_id: int | None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode and write ``df``; returns the index, which also is written, to ``folder``/index."""
    spark = df.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "token-records")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows equal in id and text are parted by the partition they are read in, which a repeated task does not change
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.withColumn("tie", F.spark_partition_id())
    rows = rows.repartitionByRange(n, *order, F.col("tie")).sortWithinPartitions(*order).drop("tie")

    def run(batches):
        lib, part, out, offset, seq = encoder(vocabulary), TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            # a batch may hold many long texts; slices keep what is held at once small
            for s in pretoken.slices(batch, 1):
                ids, counts = lib.encode(s.column(1))
                if end_id is not None:
                    ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                data, lengths = frames(ids, counts, s.column(0).to_pylist())
                if out is None:
                    out, name = files.new_file(folder, part, ".records")
                out.write(data)
                k = len(counts)
                at = offset + np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * k, pa.int32()), pa.array(np.arange(seq, seq + k)), s.column(0), pa.array([name] * k), pa.array(at), pa.array(lengths), pa.array(counts)],
                    names=["part", "seq", "doc_id", "file", "offset", "length", "n_tokens"],
                )
                offset, seq = offset + len(data), seq + k
        if out is not None:
            out.close()
        pretoken.give_back()

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(index: DataFrame) -> DataFrame:
    """Read all records: part, offset, doc_id, n_tokens, ids_crc32, from the files alone.

    The index gives byte ranges that begin and end with a record; these are dealt out, one to a row.
    """
    chunk = F.floor(F.col("offset") / READ_BYTES)
    ranges = index.groupBy("part", "file", chunk.alias("chunk")).agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges.repartition(n, "file", "chunk").select("part", "file", "start", "end")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = parse(files.read_range(r["file"], r["start"], r["end"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["part"]] * len(found), pa.int32()),
                        pa.array([r["start"] + a for a, _, _ in found], pa.int64()),
                        pa.array([d for _, d, _ in found], pa.int64()),
                        pa.array([len(x) for _, _, x in found], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, _, x in found], pa.int64()),
                    ],
                    names=["part", "offset", "doc_id", "n_tokens", "ids_crc32"],
                )

    return ranges.mapInArrow(run, "part int, offset long, doc_id long, n_tokens long, ids_crc32 long")


def with_starts(records: DataFrame) -> DataFrame:
    """Add ``start``, the number of ids in all records before. One row for each part file meets in a single task.

    What was read is written first, as it is needed twice: the files are read and checked once.
    """
    records = materialise(records, "token-records-read")
    sums = records.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("part").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("_own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, "part").withColumn("start", F.col("_own") + F.col("_ahead")).drop("_own", "_ahead")


def read_shuffled(index: DataFrame, seed: int, partitions: int | None = None) -> DataFrame:
    """Records in a random order that depends on ``seed`` and the records alone: doc_id, ids (array of int), place.

    The index alone is sorted, by a hash; each task then reads its records one by one, at the offsets the index gives,
    and checks them. ``place`` is the record's hash, so ``orderBy("place")`` is the order of the whole table.
    """
    place = F.xxhash64(F.lit(seed), "part", "seq")
    n = partitions or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = index.select(place.alias("place"), "part", "seq", "file", "offset", "length")
    plan = plan.repartitionByRange(n, "place", "part", "seq").sortWithinPartitions("place", "part", "seq").select("place", "file", "offset", "length")

    def run(batches):
        with files.Opened() as opened:
            for batch in batches:
                rows, held = [], 0
                for r in batch.to_pylist():
                    _, doc_id, ids = parse(opened.read(r["file"], r["offset"], r["length"]))[0]
                    rows.append((doc_id, ids, r["place"]))
                    held += r["length"]
                    if held > READ_BYTES:
                        yield shown(rows)
                        rows, held = [], 0
                if rows:
                    yield shown(rows)

    def shown(rows):
        ends = np.concatenate([[0], np.cumsum([len(x) for _, x, _ in rows])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x.astype(np.int32) for _, x, _ in rows])))
        return pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in rows], pa.int64()), ids, pa.array([p for _, _, p in rows], pa.int64())], names=["doc_id", "ids", "place"])

    return plan.mapInArrow(run, "doc_id long, ids array<int>, place long")
