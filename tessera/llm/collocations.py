"""Phrases whose words belong together, found by count tries.

A shard (a block of whole texts, or of part of a long one) becomes a count trie of depth three: below the language its
words, below each word what follows it, and once more. The trie is built level by level from arrays of word numbers: a
node is a parent and a word, and its count is how often that pair stands in the shard. It is serialised sorted, in parts
by prefix range. Everything of one range meets in one task, which merges the sorted runs of all shards, adds the counts
of equal nodes and walks what is left in order: the ancestors of a node stand before it, so the walk knows the counts of
a phrase's left parts. Ranges cut through the phrases of a frequent word, so every shard adds to a range its counts of
the (at most three) ancestors of the range's first key, also where it has no other node there. The right part of a phrase is another node; its path is the
phrase's suffix link, and ``lookup`` follows it, safe against suffixes of very many phrases.

The bounds of ranges come from a sample of the texts, which decides how evenly nodes are dealt, not what is counted.
A range holds about RANGE_NODES nodes; driver and tasks hold one key for each range, as Spark's own range partitions do.

Defined results: a null text is empty, a null language is ``und``; a text without words counts nothing; repeated rows
count as often as they stand there; languages and words may hold any character; an empty table gives an empty table;
columns besides text and language are not read, so their names are free.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import pretoken
from tessera.runtime import lookup, materialise, running_total, small_batches

DEPTH = 3
LEAST, SHOWN, HIDDEN_BY, SCALE = 10, 2000, 50, 1_000_000
#: Bytes of text in a shard; its arrays take some 30 times as much.
SHARD_BYTES = 3 << 20
#: Nodes that meet in a range, before equal ones are added up, and how many a byte of text gives.
RANGE_NODES, NODES_A_BYTE = 1 << 19, 0.3
#: Keys sampled for each bound between ranges, and bytes of text that give them.
SAMPLED_KEYS, SAMPLED_BYTES = 64, 16 << 10
UNKNOWN = "und"
BREAK, BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANK)] = 1
_KIND[list(BREAK)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = re.compile(b"[" + re.escape(BREAK + BLANK) + b"]")
_AHEAD = re.compile(b"(?:[ \t]+[^" + re.escape(BREAK + BLANK) + b"]+){0,%d}" % (DEPTH - 1))


def escape(word: bytes) -> bytes:
    """A word as a step of a path: steps are joined by a zero byte, so it has none itself and sorts as before."""
    return word.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01")


def unescape(step: bytes) -> bytes:
    return step.replace(b"\x01\x01", b"\x00").replace(b"\x01\x02", b"\x01")


def shards(langs: pa.Array, texts: pa.Array, size: int = SHARD_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], int]]:
    """Bytes, offsets of texts, their languages, and the end of the places at which phrases are counted.

    A long text comes in several shards, cut between words. Each but the last also has the two words that follow it in
    the same piece, so that phrases across the cut are counted, once.
    """
    raw, at = pretoken.utf8_of(texts)
    names = [UNKNOWN.encode() if x is None else x.encode() for x in langs.to_pylist()]
    i, n = 0, len(names)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        if at[j] - at[i] <= size:
            yield raw[at[i] : at[j]], at[i : j + 1] - at[i], names[i:j], int(at[j] - at[i])
        else:
            whole, a = memoryview(raw[at[i] : at[j]]), 0
            while a < len(whole):
                edge = _EDGE.search(whole, a + size)
                b = edge.start() if edge else len(whole)
                c = _AHEAD.match(whole, b).end() if edge else b
                yield raw[at[i] + a : at[i] + c], np.array([0, c - a]), names[i:j], b - a
                a = b
        i = j


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, how often each stands there, and the place of each key among them."""
    found = pc.dictionary_encode(pa.array(keys))
    values, codes = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(values, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return values[order], np.bincount(codes, minlength=len(values))[order], place[codes]


def trie(raw: np.ndarray, offsets: np.ndarray, langs: list[bytes], stop: int) -> list[tuple[pa.Array, np.ndarray]]:
    """Paths, in order, and counts of the nodes of each level, the languages first."""
    kind = _KIND[raw]
    word = kind == 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(raw)]
    begins[inner] |= word[inner]
    first = np.flatnonzero(begins)
    if not len(first):
        return []
    own = np.cumsum(word)
    ends = np.append(own[first] - 1, own[-1])
    data = _LOWER[raw[word]]
    words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)])
    coded = pc.dictionary_encode(words)
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids, names = place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))
    if (data <= 1).any():
        names = pa.array([escape(x) for x in names.to_pylist()], pa.large_binary())
    text = np.searchsorted(offsets, first, side="right") - 1
    # words in a row belong to one piece if they have one text and no break between them
    piece = text + np.cumsum(kind == 2)[first]
    known = sorted(set(langs))
    lang = np.array([known.index(x) for x in langs])[text]
    paths = pa.array([escape(x) for x in known], pa.large_binary())
    counted = int(np.searchsorted(first, stop))
    level, here = [(paths, np.bincount(lang[:counted], minlength=len(known)))], lang[:counted].astype(np.int64)
    starts = np.arange(counted)
    for depth in range(DEPTH):
        if depth:
            fits = np.flatnonzero(starts + depth < len(first))
            fits = fits[piece[starts[fits] + depth] == piece[starts[fits]]]
            starts, here = starts[fits], here[fits]
        if not len(starts):
            break
        keys, n, here = _counted(here * len(names) + ids[starts + depth])
        paths = pc.binary_join_element_wise(paths.take(pa.array(keys // len(names))), names.take(pa.array(keys % len(names))), pa.scalar(b"\x00", pa.large_binary()))
        level.append((paths, n))
    return level


def _at_least(paths: pa.Array, key: bytes) -> int:
    lo, hi = 0, len(paths)
    while lo < hi:
        mid = (lo + hi) // 2
        if paths[mid].as_py() < key:
            lo = mid + 1
        else:
            hi = mid
    return lo


def ancestors(key: bytes) -> list[bytes]:
    """The paths of the nodes above a path, the highest first."""
    steps = key.split(b"\x00")
    return [b"\x00".join(steps[:k]) for k in range(1, len(steps))]


def serialise(level: list[tuple[pa.Array, np.ndarray]], bounds: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """The trie in parts by range, compressed: nodes at or above a range's bound, and ancestors of that bound."""
    cuts = [[0, *(_at_least(paths, b) for b in bounds), len(paths)] for paths, _ in level]
    packing = pa.ipc.IpcWriteOptions(compression="zstd")
    for r in range(len(bounds) + 1):
        keys = [paths.slice(c[r], c[r + 1] - c[r]) for (paths, _), c in zip(level, cuts, strict=True)]
        n = [count[c[r] : c[r + 1]] for (_, count), c in zip(level, cuts, strict=True)]
        for (paths, count), above in zip(level, ancestors(bounds[r - 1]) if r else [], strict=False):
            i = _at_least(paths, above)
            if i < len(paths) and paths[i].as_py() == above:
                keys.append(paths.slice(i, 1))
                n.append(count[i : i + 1])
        if not any(map(len, keys)):
            continue
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([pa.concat_arrays(keys), pa.array(np.concatenate(n))], names=["path", "n"])
        with pa.ipc.new_stream(sink, batch.schema, options=packing) as out:
            out.write_batch(batch)
        yield r, sink.getvalue().to_pybytes()


def merge(parts: list[bytes], least: int) -> list[tuple[bytes, int]]:
    """The nodes of one range, in order: counts of equal ones added up, languages and those of at least ``least`` kept."""
    table = pa.concat_tables(pa.ipc.open_stream(p).read_all() for p in parts)
    summed = table.group_by("path").aggregate([("n", "sum")])
    top = pc.equal(pc.count_substring(summed["path"].cast(pa.large_binary()), b"\x00"), 0)
    summed = summed.filter(pc.or_(top, pc.greater_equal(summed["n_sum"], least))).sort_by("path")
    return list(zip(summed["path"].to_pylist(), summed["n_sum"].to_pylist(), strict=True))


NODES = "path binary, depth int, lang string, phrase string, n long, left1 long, left2 long, right1 binary, right2 binary, parent binary"
FIELDS = [{"binary": pa.binary(), "int": pa.int32(), "string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in NODES.split(", ")]


def walk(nodes: list[tuple[bytes, int]], bound: bytes) -> Iterator[tuple]:
    """Rows of NODES for the nodes from ``bound`` on, with the counts of their left parts and the paths of the right ones."""
    above: list[tuple[bytes, int]] = []
    for path, n in nodes:
        steps = path.split(b"\x00")
        depth = len(steps) - 1
        del above[depth:]
        above.append((path, n))
        if path < bound:
            continue
        words = [unescape(s).decode() for s in steps]
        left = [above[k][1] if k < depth else None for k in (1, 2)]
        right = [b"\x00".join([steps[0], *steps[1 + k :]]) if k < depth else None for k in (1, 2)]
        yield path, depth, words[0], " ".join(words[1:]), n, *left, *right, b"\x00".join(steps[:-1])


def _sampled(rows: DataFrame, ranges: int, size: int) -> list[bytes]:
    """Bounds between ``ranges`` ranges, from the keys of a sample of the texts."""
    share = min(1.0, 1.2 * ranges * SAMPLED_BYTES / size)

    def run(batches):
        for batch in batches:
            for shard in shards(batch.column(0), batch.column(1)):
                for paths, _ in trie(*shard):
                    step = max(1, int(SAMPLED_BYTES * NODES_A_BYTE / SAMPLED_KEYS))
                    at = np.arange(len(paths) % step // 2, len(paths), step)
                    yield pa.record_batch([paths.take(pa.array(at)).cast(pa.binary())], names=["path"])

    # about SAMPLED_KEYS keys for each range
    keys = sorted({bytes(r["path"]) for r in rows.where(F.rand(7) < share).mapInArrow(run, "path binary").distinct().collect()})
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def nodes(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, range_nodes: int = RANGE_NODES) -> DataFrame:
    """All words and phrases of up to DEPTH words with a count of at least ``least``, and each language (depth 0)."""
    small_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = int(max(size * NODES_A_BYTE / range_nodes, min(wanted, size * NODES_A_BYTE / (1 << 14)))) + 1
    bounds = _sampled(rows, ranges, size) if ranges > 1 else []

    def build(batches):
        for batch in batches:
            for shard in shards(batch.column(0), batch.column(1)):
                level = trie(*shard)
                for r, part in serialise(level, bounds) if level else ():
                    yield pa.record_batch([pa.array([r], pa.int32()), pa.array([part], pa.binary())], names=["range", "part"])
        pretoken.give_back()

    def meet(table: pa.Table) -> pa.Table:
        pretoken.lean()
        r = table["range"][0].as_py()
        out = list(walk(merge(table["part"].to_pylist(), least), bounds[r - 1] if r else b""))
        pretoken.give_back()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(FIELDS), FIELDS, strict=True)], names=[c.split()[0] for c in NODES.split(", ")])

    return rows.mapInArrow(build, "range int, part binary").groupBy("range").applyInArrow(meet, NODES)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, shown: int = SHOWN, hidden_by: int = HIDDEN_BY, range_nodes: int = RANGE_NODES) -> DataFrame:
    """The first ``shown`` phrases of each language: lang, rank, phrase, a, l, r, n, score; see the module.

    The score of a cut into two parts is floor(SCALE * a * a / (l * r)), and the cut with the lowest counts. A phrase
    goes where a longer one that holds it has at least ``hidden_by`` hundredths of its count. Products are decimals of 38
    digits, which are exact for counts of up to 10 ** 15.
    """
    known = materialise(nodes(df, text_col, lang_col, least, range_nodes), "collocation-nodes")
    phrases = known.where(F.col("depth") > 1)
    link = lambda k: phrases.where(F.col("depth") > k).select("path", "lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("k"), F.col(f"left{k}").alias("l"), F.col(f"right{k}").alias("to"))
    links = link(1)
    for k in range(2, DEPTH):
        links = links.unionByName(link(k))
    ends = links.groupBy("to").agg(F.count(F.lit(1)).alias("times"))
    ends = materialise(ends.join(known.select(F.col("path").alias("to"), F.col("n").alias("r")), "to"), "collocation-ends")
    total = ends.agg(F.sum("times")).first()[0] or 0
    score = F.expr(f"cast(cast({SCALE} as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) as decimal(38,0)) div cast(cast(l as decimal(18,0)) * cast(r as decimal(18,0)) as decimal(38,0))")
    met = lookup(links, ends, "to", "times", total).withColumn("score", score)
    scored = met.groupBy("path", "lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    longer = phrases.where(F.col("depth") > 2)
    inside = longer.select(F.col("right1").alias("path"), "n").unionByName(longer.select(F.col("parent").alias("path"), "n"))
    hidden = inside.groupBy("path").agg(F.max("n").alias("_longer"))
    left = scored.join(hidden, "path", "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < hidden_by * F.col("a")))
    left = left.select("lang", "phrase", "a", "_cut.score", "_cut.l", "_cut.r")
    placed = running_total(left, [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")], F.lit(1), "_place", "collocations")
    placed = materialise(placed, "collocations")
    sizes = placed.groupBy("lang").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_size"))
    sizes = materialise(sizes.join(known.where("depth = 0").select("lang", "n"), "lang"), "collocation-languages")
    ranked = lookup(placed, sizes, "lang", "_size", placed.count()).withColumn("rank", F.col("_place") - F.col("_first") + 1)
    return ranked.where(F.col("rank") <= shown).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
