"""Near-duplicate groups by an exact n-gram Jaccard join over prefix trees.

1. One pass turns whole texts into sets of hashed 5-word shingles: size, a 128-bit digest, and the first of them in
   the order of hashes, as many as two sets of the wanted similarity must share one or more of (`prefix_size`). Equal
   sets are one class from here on.
2. Which of these hashes occur in two classes or more? Hashes are dealt out in packed blocks, already reduced in each
   task, so that a hash in a third of all texts costs a task two rows. Classes with too few shared ones have no
   partner. Of the others, the candidates, whole sets are made in a second pass over the texts (a bit filter of fixed
   size keeps other texts out of the shuffle; a join makes it exact).
3. Candidates' shingles get a global order, rare ones first, by their exact number of classes; those of one class only
   are counted and dropped. Only the first of this order are postings, so passages that very many texts share hold
   nothing together. Components of the postings bring together what may have a link.
4. Each such cluster is searched by prefix trees (`prefix_tree`), in tasks of bounded size. A cluster too large for
   one task is dealt into blocks, each with the cluster's first class. Where postings still lie between different
   components, a few classes of each are searched together, until that joins no more; then the classes of different
   components are compared in full, by pairs of blocks. Blocks of one component never meet, so a large group costs in
   proportion to its size. No link is lost: two classes with a link share a posting, so they are in one component, or
   in one cluster of what is left and there in one block or pair of blocks.
5. Components of the links, and a join that gives every document its component.

Defined results: a null or blank text has no shingles and stays alone; a text of fewer than five words has its whole
sequence as its only shingle; a null id is ignored by the smallest id, and is a component of null if alone; repeated
rows give repeated results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import pretoken, shingles
from tessera.llm.graph import components
from tessera.llm.prefix_tree import link
from tessera.runtime import fitting, forget, free_name, lookup, materialise, pick, row_key, small_batches, without

PERCENT = 80
#: Pairs of a hash and a class that a task packs at once, and about as many as come together in one bucket.
BLOCK_PAIRS = 1 << 18
BUCKET_PAIRS = 1 << 19
LEAST_BUCKETS = 16
#: Shingles of the classes in one tree-search task.
TASK_SHINGLES, LEAST_TASK_SHINGLES = 4 << 20, 4 << 10
#: Shingles whose rows a task of a join or an aggregation takes at least, if there are fewer than shuffles have parts for.
FIT_SHINGLES = 1 << 19
#: Rows of ids and keys that a task takes at least in the same way.
FIT_ROWS = 1 << 13
#: Classes that speak for a component when components are joined, and rounds of that before the full comparison.
SPOKESMEN, JOINING_ROUNDS = 8, 6
#: Bits of the filter that keeps other texts out of the candidates' shuffle: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
PACKED = "bucket int, block binary"
_U = np.uint64


def ceil_share(n, percent: int):
    return -(-percent * n // 100)


def extra(n):
    """How many shared hashes beyond the first the prefix asks for."""
    return n // 20


def prefix_size(n, percent: int):
    return n - ceil_share(n, percent) + 1 + extra(n)


def least_shared(n, percent: int):
    """A partner has percent of n shingles at least, and its prefix asks for so many."""
    return 1 + extra(ceil_share(n, percent))


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... count[i] numbers, for each i in a row."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def by_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (shingles.mix(keys ^ _U(0xA5A5A5A5A5A5A5A5)) >> _U(33)).astype(np.int64) % buckets


def pack(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of 64-bit numbers, a block of bytes for each bucket."""
    order = np.argsort(bucket, kind="stable")
    rows = np.stack([c[order] for c in columns], 1)
    found, at = np.unique(bucket[order], return_index=True)
    ends = np.append(at[1:], len(order)) if len(order) else at
    return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())], names=["bucket", "block"])


def unpack(blocks: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    pretoken.lean()
    rows = np.frombuffer(b"".join(b.as_buffer() for chunk in blocks.chunks for b in chunk), np.uint64).reshape(-1, width)
    return [rows[:, k] for k in range(width)]


def groups_of(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in the order of keys, and where each key begins."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    keys, values = keys[new], values[new]
    return keys, values, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def document_sets(df: DataFrame, id_col: str, text_col: str, percent: int, key: list[Column]) -> DataFrame:
    """doc_id, r1, r2 (the row's key), n, k1, k2, prefix."""

    def run(batches):
        for batch in (s for b in batches for s in pretoken.slices(b, 3)):
            flat, n = shingles.sets(batch.column(3))
            k1, k2 = shingles.digests(flat, n)
            size = np.where(n > 0, prefix_size(n, percent), 0)
            own = flat[ragged(np.cumsum(n) - n, size)].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(size * 8)]).astype(np.int64)
            prefix = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(own.tobytes())]).cast(pa.binary())
            made = [*batch.columns[:3], pa.array(n), pa.array(k1), pa.array(k2), prefix]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "r1", "r2", "n", "k1", "k2", "prefix"])
        pretoken.give_back()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), key[0].alias("r1"), key[1].alias("r2"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, r1 long, r2 long, n long, k1 long, k2 long, prefix binary")


def shared_counts(docs: DataFrame, buckets: int, fit: Callable) -> DataFrame:
    """k1 -> c: in how many of the prefix's hashes a class has company (never too few; copies may raise it)."""

    def reduced(keys, values):
        keys, values, at = groups_of(keys, values)
        size = np.diff(np.append(at, len(keys)))
        place = np.arange(len(keys)) - np.repeat(at, size)
        # two classes of a hash tell the others that it is shared; what a task has beyond them is counted here
        spare = place >= 2
        return keys[~spare], values[~spare], values[spare]

    def counted(classes):
        own, c = np.unique(classes, return_counts=True)
        return pack(by_hash(own, buckets), own, c.astype(np.uint64))

    def deal(far: bool):
        def emit(keys, values):
            keys, values, spare = reduced(np.concatenate(keys), np.concatenate(values))
            return pack(by_hash(keys, buckets), keys, values) if far else counted(spare)

        def run(batches):
            keys, values, held = [], [], 0
            for batch in batches:
                prefix = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(1)), np.uint64)
                size = np.array([len(x.as_buffer()) // 8 for x in batch.column(1)], np.int64)
                keys.append(prefix)
                values.append(np.repeat(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size))
                held += len(prefix)
                if held >= BLOCK_PAIRS:
                    yield emit(keys, values)
                    keys, values, held = [], [], 0
            if held:
                yield emit(keys, values)

        return run

    def count(table: pa.Table) -> pa.Table:
        keys, values, at = groups_of(*unpack(table.column("block"), 2))
        size = np.diff(np.append(at, len(keys)))
        return pa.Table.from_batches([counted(values[np.repeat(size > 1, size)])])

    def total(table: pa.Table) -> pa.Table:
        classes, c = unpack(table.column("block"), 2)
        own, at = np.unique(classes, return_inverse=True)
        return pa.table({"k1": own.view(np.int64), "c": np.bincount(at, weights=c, minlength=len(own)).astype(np.int64)})

    # what is sent and what is counted on the spot come of the same pass; it is made twice, as that costs less than
    # keeping its blocks
    prefixes = docs.where("n > 0").select("k1", "prefix")
    far = fit(prefixes.mapInArrow(deal(True), PACKED).groupBy("bucket").applyInArrow(count, PACKED))
    near = prefixes.mapInArrow(deal(False), PACKED)
    return far.union(near).groupBy("bucket").applyInArrow(total, "k1 long, c long")


def bit_filter(ids: DataFrame) -> np.ndarray | None:
    """FILTER_BITS bits with two set for each id; comes to the driver in at most FILTER_BITS / 32768 rows of 4 KB."""
    position = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(FILTER_BITS)) for salt in (1, 2)]))
    found = ids.select(position.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in found:
        # bucket b holds the positions from (b - 1) * 32768 + 1
        m = np.unpackbits(np.frombuffer(bytes(r["m"]), np.uint8), bitorder="little")
        at = (r["b"] - 1) * 32768 + 1 + np.flatnonzero(m)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def candidate_sets(df: DataFrame, candidates: DataFrame, id_col: str, text_col: str, fit: Callable) -> DataFrame:
    """cid, n, items (ascending hashes, packed) of each candidate class."""
    bits = bit_filter(candidates.where("doc_id is not null"))
    bits_b = df.sparkSession.sparkContext.broadcast(bits)
    place = [F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(FILTER_BITS)).alias(f"p{salt}") for salt in (1, 2)]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")

    def run(batches):
        bits = bits_b.value
        for batch in (s for b in batches for s in pretoken.slices(b, 1)):
            hit = np.ones(batch.num_rows, bool)
            for c in (2, 3):
                p = batch.column(c).to_numpy(zero_copy_only=False)
                hit &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            if batch.column(0).null_count:
                hit |= np.array(batch.column(0).is_null())
            batch = batch.filter(pa.array(hit))
            flat, n = shingles.sets(batch.column(1))
            k1, k2 = shingles.digests(flat, n)
            at = np.concatenate([[0], np.cumsum(n)])
            items = pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1), pa.array(k2), items], names=["d", "k1", "k2", "items"])

    made = rows.select("doc_id", "text", *place).mapInArrow(run, "d long, k1 long, k2 long, items binary")
    mine = fit(candidates.join(made, ["k1", "k2"])).where(F.col("d").eqNullSafe(F.col("doc_id")))
    return mine.select("cid", "n", "items").dropDuplicates(["cid"])


def ordered_sets(sets: DataFrame, buckets: int, percent: int, fit: Callable) -> DataFrame:
    """cid, n, items (shared hashes in the global order, as (classes, hash) pairs, packed), posts (the first of them).

    Classes that can't have a partner are left out.
    """

    def deal(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(x.as_buffer() for x in batch.column(1)), np.uint64)
            size = np.array([len(x.as_buffer()) // 8 for x in batch.column(1)], np.int64)
            cids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)
            for a in range(0, len(flat), BLOCK_PAIRS):
                yield pack(by_hash(flat[a : a + BLOCK_PAIRS], buckets), flat[a : a + BLOCK_PAIRS], cids[a : a + BLOCK_PAIRS])

    def rank(table: pa.Table) -> pa.Table:
        keys, cids, at = groups_of(*unpack(table.column("block"), 2))
        size = np.diff(np.append(at, len(keys)))
        often = np.repeat(size, size).astype(np.uint64)
        keep = often > 1
        return pa.Table.from_batches([pack((cids[keep] % _U(buckets)).astype(np.int64), cids[keep], often[keep], keys[keep])])

    def order(key, ranked: pa.Table, sizes: pa.Table) -> pa.Table:
        out = []
        if len(ranked):
            cids, often, keys = unpack(ranked.column("block"), 3)
            by = np.lexsort((keys, often, cids))
            cids, pairs = cids[by], np.stack([often[by], keys[by]], 1)
            own = sizes.column("cid").to_numpy().astype(np.uint64)
            first, last = np.searchsorted(cids, own), np.searchsorted(cids, own, side="right")
            for cid, n, a, b in zip(sizes.column("cid").to_pylist(), sizes.column("n").to_pylist(), first, last, strict=True):
                if b - a >= ceil_share(n, percent):
                    posts = n - ceil_share(n, percent) + 1 - (n - (b - a))
                    out.append({"cid": cid, "n": n, "items": pairs[a:b].tobytes(), "posts": pairs[a : a + posts, 1].copy().view(np.int64)})
        return pa.Table.from_pylist(out, pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("items", pa.binary()), ("posts", pa.list_(pa.int64()))]))

    ranked = fit(sets.select("cid", "items").mapInArrow(deal, PACKED).groupBy("bucket").applyInArrow(rank, PACKED))
    sizes = sets.select(F.pmod(F.col("cid"), F.lit(buckets)).cast("int").alias("bucket"), "cid", "n")
    return ranked.groupBy("bucket").cogroup(sizes.groupBy("bucket")).applyInArrow(order, "cid long, n long, items binary, posts array<long>")


def cluster(posts: DataFrame, fit: Callable) -> DataFrame:
    """(h, cid) -> (cid, cluster): classes that are connected by postings."""
    first = fit(posts.groupBy("h").agg(F.min("cid").alias("m")))
    # components takes repeated edges out in the tasks that join
    edges = fit(posts.join(first, "h")).select(F.col("cid").alias("a"), F.col("m").alias("b")).where("a <> b")
    return components(edges).select(F.col("v").alias("cid"), F.col("component").alias("cluster"))


def search(tasks: DataFrame, percent: int) -> DataFrame:
    """task, cluster, cid, own, n, items -> links (a, b) between classes; a task's rows are searched together.

    Classes with the same ``own`` are known to be in one component.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cids, n, cl, own = (table.column(c).to_pylist() for c in ("cid", "n", "cluster", "own"))
        pairs = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2) for x in table.column("items")]
        size = np.array([len(p) for p in pairs])
        all_ = np.concatenate(pairs)
        # dense numbers in the global order
        order = np.lexsort((all_[:, 1], all_[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (all_[order[1:]] != all_[order[:-1]]).any(1)
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        at = np.concatenate([[0], np.cumsum(size)])
        sets = [number[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        links = link(cl, sets, n, percent, own)
        return pa.table({"a": pa.array([cids[i] for i, _ in links], pa.int64()), "b": pa.array([cids[j] for _, j in links], pa.int64())})

    return tasks.groupBy("task").applyInArrow(run, "a long, b long")


def shard(shards: int) -> Column:
    return F.concat(F.lit("s"), F.pmod(F.xxhash64("cluster"), F.lit(shards)).cast("string"))


def deal_tasks(rows: DataFrame, block_shingles: int, shards: int, fit: Callable) -> tuple[DataFrame, bool]:
    """Rows (cluster, cid, own, n, items, w) for ``search``, and whether a cluster is in several blocks.

    Small clusters share tasks; a large one is dealt into blocks by a hash of the class, each with the cluster's first class.
    """
    sizes = fit(rows.groupBy("cluster").agg(F.sum("w").alias("cluster_w"), F.min("cid").alias("leader")))
    sizes = materialise(sizes.withColumn("blocks", F.ceil(F.col("cluster_w") / block_shingles).cast("int")), "ngram-sizes")
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    rows = fit(rows.join(sizes, "cluster"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    name = lambda k: F.concat_ws("-", F.lit("b"), F.col("cluster"), k)
    blocks = F.when(F.col("cid") == F.col("leader"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), name)).otherwise(F.array(name(own)))
    task = F.explode(F.when(F.col("blocks") == 1, F.array(shard(shards))).otherwise(blocks))
    return rows.select(task.alias("task"), "cluster", "cid", "own", "n", "items"), most > 1


def deal_pairs(rows: DataFrame, block_shingles: int, shards: int, fit: Callable) -> DataFrame:
    """Rows (cluster, cid, own, n, items, w) for a ``search`` that compares all classes of a cluster whose components differ.

    A component above a block's size has blocks of its own, the others of a cluster share some. Pairs of blocks are
    tasks unless both are of one component, so the blocks of a large component meet those of the others only.
    """
    comps = fit(rows.groupBy("cluster", "own").agg(F.sum("w").alias("own_w")))
    large = F.col("own_w") > block_shingles
    rest = F.sum(F.when(~large, F.col("own_w")).otherwise(0))
    sizes = comps.groupBy("cluster").agg(F.sum("own_w").alias("cluster_w"), F.ceil(F.greatest(rest, F.lit(1)) / block_shingles).alias("shared"))
    comps = materialise(fit(comps.join(fit(sizes), "cluster")), "ngram-components")
    rows = fit(rows.join(comps, ["cluster", "own"]))
    parts = F.ceil(F.col("own_w") / block_shingles)
    block = F.when(large, F.concat_ws("-", F.lit("c"), "own", F.pmod(F.xxhash64("cid"), parts))).otherwise(F.concat_ws("-", F.lit("m"), F.pmod(F.xxhash64("own"), F.col("shared"))))
    alone = F.col("cluster_w") <= block_shingles
    small = rows.where(alone).select(shard(shards).alias("task"), "cluster", "cid", "own", "n", "items")
    rows = rows.where(~alone).withColumn("block", block).withColumn("of", F.when(large, F.col("own")))
    blocks = materialise(fit(rows.select("cluster", "block", "of").distinct()), "ngram-blocks")
    x, y = blocks.alias("x"), blocks.alias("y")
    apart = ~F.coalesce(F.col("x.of") == F.col("y.of"), F.lit(False))
    pairs = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.block") <= F.col("y.block")) & apart)
    task = F.concat_ws("|", F.col("x.cluster"), F.col("x.block"), F.col("y.block"))
    pairs = pairs.select(F.col("x.cluster").alias("cluster"), task.alias("task"), F.explode(F.array_distinct(F.array("x.block", "y.block"))).alias("block"))
    return small.union(fit(rows.join(fit(pairs), ["cluster", "block"])).select("task", "cluster", "cid", "own", "n", "items"))


def all_links(posts: DataFrame, ordered: DataFrame, percent: int, task_shingles: int, fit: Callable) -> DataFrame:
    """Links that connect all classes which Jaccard similarity connects, from postings (h, cid) and ordered sets.

    First each cluster is searched in blocks. While postings lie between components that are still apart, a few classes
    of each component are searched together, which mostly joins them; when that joins no more, classes of different
    components that share such a posting are compared in full.
    """
    spark = ordered.sparkSession
    ordered = ordered.select("cid", "n", "items", F.greatest(F.length("items") / 16, F.lit(1)).cast("long").alias("w"))
    total = ordered.agg(F.sum("w")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = int(max(1, min(task_shingles, max(LEAST_TASK_SHINGLES, total // (4 * tasks)))))
    shards = int(max(tasks, total // task_shingles))
    clusters = materialise(cluster(posts, fit), "ngram-clusters")
    dealt, split = deal_tasks(fit(ordered.join(clusters, "cid")).withColumn("own", F.col("cid")), block, shards, fit)
    links = materialise(fit(search(dealt, percent)), "ngram-links")
    rounds = 0
    while split:
        forget(clusters)
        known = materialise(components(links), "ngram-known")
        named = fit(posts.join(known, posts["cid"] == known["v"], "left")).select("h", "cid", F.coalesce("component", "cid").alias("own"))
        open_ = fit(named.groupBy("h").agg(F.min("own").alias("x"), F.max("own").alias("y"))).where("x <> y").select("h")
        left = materialise(fit(named.join(open_, "h", "left_semi")), "ngram-open")
        clusters = materialise(cluster(left.select("h", "cid"), fit), "ngram-clusters")
        forget(known)
        if clusters.isEmpty():
            break
        rows = fit(fit(ordered.join(clusters, "cid")).join(fit(left.select("cid", "own").distinct()), "cid"))
        found = None
        if rounds < JOINING_ROUNDS:
            few = Window.partitionBy("cluster", "own").orderBy(F.xxhash64("cid"), "cid")
            # from what is written, as the sizes of clusters and their rows are both read from it
            some = materialise(fit(rows.withColumn("_k", F.row_number().over(few)).where(F.col("_k") <= SPOKESMEN)).drop("_k"), "ngram-spokesmen")
            found = materialise(fit(search(deal_tasks(some, block, shards, fit)[0], percent)), "ngram-links")
            forget(some)
        if found is None or found.isEmpty():
            found, split = materialise(fit(search(deal_pairs(rows, block, shards, fit), percent)), "ngram-links"), False
        rounds += 1
        before, links = links, materialise(links.union(found), "ngram-links")
        forget(before, found, left)
    return links


def _grouped(df: DataFrame, percent: int, id_col: str, text_col: str, task_shingles: int, key: list[Column]) -> DataFrame:
    """doc_id, r1, r2, n, component_id, class_docs, g (names the group; null for texts without shingles)."""
    small_batches(df.sparkSession)
    docs = materialise(document_sets(df, id_col, text_col, percent, key), "ngram-documents")
    size = docs.agg(F.sum("n")).first()[0] or 0
    # buckets follow the data alone: a quarter of all shingles is dealt
    buckets = max(LEAST_BUCKETS, -(-int(size) // 4 // BUCKET_PAIRS))
    fit = fitting(df.sparkSession, size, FIT_SHINGLES)
    classes = docs.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("class_docs"))
    classes = materialise(fit(classes), "ngram-classes")
    need = F.lit(1) + F.floor(F.ceil(F.col("n") * percent / 100) / 20)
    counts = fit(shared_counts(docs, buckets, fit))
    candidates = fit(classes.join(counts, "k1")).where(F.col("c") >= need).select("k1", "k2", "doc_id", "n")
    candidates = materialise(candidates.withColumn("cid", F.monotonically_increasing_id()), "ngram-candidates")
    sets = materialise(fit(candidate_sets(df, candidates, id_col, text_col, fit)), "ngram-sets")
    size = candidates.agg(F.sum("n")).first()[0] or 0
    ordered = materialise(fit(ordered_sets(sets, max(LEAST_BUCKETS, -(-int(size) // BUCKET_PAIRS)), percent, fit)), "ngram-ordered")
    posts = ordered.select(F.explode("posts").alias("h"), "cid")
    found = components(all_links(posts, ordered, percent, task_shingles, fit))
    linked = fit(candidates.join(found, candidates["cid"] == found["v"])).select("k1", "k2", "doc_id", "component")
    least = fit(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    linked = fit(linked.join(least, "component")).select("k1", "k2", "component_id", "component")
    same = F.struct(F.col("component").isNull().alias("class"), F.coalesce("component", "k1").alias("a"), F.when(F.col("component").isNull(), F.col("k2")).alias("b"))
    named = fit(classes.join(linked, ["k1", "k2"], "left")).select(
        F.struct("k1", "k2").alias("key"), F.coalesce("component_id", "doc_id").alias("component_id"), "class_docs", same.alias("g")
    )
    named = materialise(named, "ngram-named")
    full = docs.where("n > 0").select("doc_id", "r1", "r2", "n", F.struct("k1", "k2").alias("key"))
    out = fit(lookup(full, named, "key", "class_docs", docs.count())).select("doc_id", "r1", "r2", "n", "component_id", "class_docs", "g")
    alone = docs.where("n = 0").select(
        "doc_id", "r1", "r2", "n", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_docs"), F.lit(None).cast(out.schema["g"].dataType).alias("g")
    )
    return out.union(alone)


def near_groups(df: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, class_docs (rows with the very same set)."""
    key = [F.lit(0).cast("long")] * 2  # rows need not be found again
    out = _grouped(df, percent, id_col, text_col, task_shingles, key)
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "class_docs")


def drop_near(df: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """One row of each group, in the columns of ``df``: the one with the smallest id, null ids last.

    Of rows of one group with that id the one with the smallest content key stays. Texts without a word all stay. Rows
    are known by their content, so different texts of one id are told apart, and other columns may have any name.
    """
    names = [free_name(df.columns, n) for n in ("r1", "r2")]
    times = free_name(df.columns, "times")
    key = row_key(df)
    rows = materialise(_grouped(df, percent, id_col, text_col, task_shingles, key).where("g is not null").select("doc_id", "r1", "r2", "g"), "ngram-grouped")
    total = rows.count()
    fit = fitting(df.sparkSession, total, FIT_ROWS)
    first = fit(rows.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r1", "r2")).alias("f"))).select(F.col("f.r1").alias("f1"), F.col("f.r2").alias("f2"))
    each = fit(rows.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias(times)))
    named = fit(each.join(first, (F.col("r1") == F.col("f1")) & (F.col("r2") == F.col("f2")), "left"))
    # rows that go, and rows that stay but repeat; all others are left alone
    plan = named.where(F.col("f1").isNull() | (F.col(times) > 1)).select(F.col("r1").alias(names[0]), F.col("r2").alias(names[1]), times, F.col("f1").isNotNull().alias("stays"))
    plan = materialise(plan, "ngram-plan")
    keyed = df.withColumns(dict(zip(names, key, strict=True)))
    out, again = without(keyed, plan, names, times, total), plan.where("stays").drop("stays")
    if not again.isEmpty():
        out = out.unionByName(pick(keyed, again, names, times, total).drop(times))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
