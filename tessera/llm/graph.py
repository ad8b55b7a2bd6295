"""Connected components of a graph held as a table of edges.

Each task first brings its own edges down to stars by union-find, as many edges at once as TASK_STARS. What they leave meets
in one task if it is no more than that, which settles it; more is settled by alternating large-star and small-star steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import forget, materialise, release

MOST_ROUNDS = 60
#: Edges that a task takes.
TASK_EDGES = 1 << 16
#: Edges that a task brings down to stars at once: 2 MB, and some ten times as much at work.
TASK_STARS = 1 << 17


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All vertices of some edges, each once, and the smallest vertex that each can reach by them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, u, v = np.arange(len(ids)), at[: len(a)], at[len(a) :]
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            return ids, ids[root]
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up


def _to_stars(most: int, roots: bool):
    """A function for ``mapInArrow`` from edges to (u, v), v the smallest vertex that u reaches by ``most`` edges or so in a row.

    Without ``roots``, edges from a vertex to itself are left out.
    """

    def emit(held):
        u, v = stars(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1)))
        keep = slice(None) if roots else u != v
        return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most and not roots:
                made = emit(held)
                # what is left goes on with the next edges, unless it is too much itself
                held, n = [made], made.num_rows
                if n > most // 2:
                    yield made
                    held, n = [], 0
        if n:
            yield emit(held)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (v, component): the smallest vertex that is reachable, for each vertex that has an edge.

    Each step on a graph that one task can't take is an aggregation with partial sums and a join on its key, so a vertex with
    very many edges is spread over tasks. Each round is written to the shared folder. The number of rounds grows with the
    logarithm of the size. Tables of earlier rounds are deleted, and shuffle files of what came before, earlier calls
    among it, are let go of first. A round's tasks are as many as its edges need: there are many rounds, and mostly over few edges.
    """
    spark = edges.sparkSession
    release(spark)
    some = edges.where("a <> b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    e = materialise(some.mapInArrow(_to_stars(TASK_STARS, False), "u long, v long"), "components")
    n = e.count()
    if n <= TASK_STARS:
        whole = e.coalesce(1).mapInArrow(_to_stars(TASK_STARS, True), "v long, component long")
        out = materialise(whole, "components-whole")
        forget(e)
        return out
    e, before = materialise(e.distinct(), "components"), e
    forget(before)
    most, mark = int(spark.conf.get("spark.sql.shuffle.partitions")), (e.count(), None)
    for _ in range(MOST_ROUNDS):
        tasks = -(-2 * mark[0] // TASK_EDGES) + 1
        fit = lambda df, n=tasks: df.coalesce(n) if n < most else df
        now = fit(e)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = fit(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"))
        large = fit(both.where("v > u").join(least, "u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(fit(large.distinct()), "components-large")
        least = fit(fit(large).groupBy("u").agg(F.min("v").alias("m")))
        near = fit(fit(large).join(least, "u"))
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        before, e = e, materialise(fit(small.distinct()), "components-small")
        forget(before, large)
        now = fit(e).agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    e = fit(e)
    roots = fit(e.select(F.col("v").alias("u")).distinct()).select(F.col("u").alias("v"), F.col("u").alias("component"))
    return e.select(F.col("u").alias("v"), F.col("v").alias("component")).union(roots)
