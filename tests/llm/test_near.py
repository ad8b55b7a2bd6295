import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, near_groups, shingles

from tessera.llm import graph, ngram_join, queries
from tessera.llm.graph import components
from tessera.llm.prefix_tree import link
from tessera.llm.shingles import sets

D = "/root/testdata/sf0.001"


def got(df, **k):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_groups(df, **k).collect()), key=repr)


def test_shingles():
    texts = [None, "", " \n", "a", "A b\tc  d", "a b c d e", "a b c d e f a b c d e", "É b c d e", "x\x0by"]
    flat, n = sets(pa.array(texts))
    assert n.tolist() == [len(shingles(t)) for t in texts]
    assert len(np.unique(flat)) == len(set().union(*map(shingles, texts)))


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in queries.table(spark, D, "documents").select("doc_id", "text").collect()]
    out = queries.op6_ngram_jaccard_join(spark, D)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()), key=repr) == near_groups(rows)


def test_query_is_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = sorted(duck.sql(queries.ORACLE_SQL["op6_ngram_jaccard_join"]).fetchall())
    assert sorted(tuple(r) for r in queries.op6_ngram_jaccard_join(spark, D).collect()) == want


@pytest.mark.parametrize("task_shingles", [4 << 20, 200])
def test_families(spark, task_shingles):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(30))
    common = [word() for _ in range(60)]
    base = [[word() for _ in range(rng.randrange(10, 90))] for _ in range(5)]
    rows = []
    for i in range(220):
        w = list(rng.choice(base)) + (common if rng.random() < 0.4 else [])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = f"z{rng.randrange(500)}"
        rows.append((i, " ".join(w[: rng.randrange(1, 6)] if rng.random() < 0.1 else w)))
    df = frame(spark, rows).repartition(3)
    assert got(df, task_shingles=task_shingles) == near_groups(rows)


def test_edges(spark):
    five = "a b c d e"
    rows = [(1, None), (2, ""), (3, five), (3, five), (4, "A  B c d E"), (5, "a b"), (6, "a  b"), (7, "a"), (None, five), (None, "q r s t u v"), (8, " ")]
    assert got(frame(spark, rows)) == near_groups(rows)
    assert got(frame(spark, [])) == []


def test_exact_threshold(spark):
    # 9 and 11 shingles, 8 of them shared: 8 / 12; and sets of 9 and 10 with 8.44... needed
    w = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join(w[:14])), (2, " ".join(w[:12])), (3, " ".join(w[:11])), (4, " ".join(w[2:14] + ["x"]))]
    assert got(frame(spark, rows)) == near_groups(rows)


def test_link_connects_everything():
    rng = random.Random(1)
    for _ in range(200):
        made = []
        for _ in range(rng.randrange(2, 25)):
            b = set(rng.sample(range(14), rng.randrange(1, 14)))
            made.append(sorted(b))
        own = [rng.randrange(0, 3) for _ in made]
        sizes = [len(s) + u for s, u in zip(made, own, strict=True)]
        links = link([0] * len(made), made, sizes, 80)
        ok = lambda i, j: 100 * len(set(made[i]) & set(made[j])) >= 80 * (sizes[i] + sizes[j] - len(set(made[i]) & set(made[j])))  # noqa: E731, B023
        assert all(ok(i, j) for i, j in links)

        def groups(pairs, n=len(made)):
            p = list(range(n))
            for _ in range(n):
                for i, j in pairs:
                    p[i] = p[j] = min(p[i], p[j])
            return p

        assert groups(links) == groups([(i, j) for i in range(len(made)) for j in range(i) if ok(i, j)])


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    p = {v: v for e in edges for v in e}
    for _ in range(100):
        for a, b in edges:
            p[a] = p[b] = min(p[a], p[b])
    found = {r["v"]: r["component"] for r in components(frame(spark, edges, "a long, b long")).collect()}
    assert found == {v: c for v, c in p.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(2, "a b c d e", "x"), (1, "a b c d e", "y"), (3, None, "z")], "doc_id long, text string, n string")
    assert sorted(r["n"] for r in ngram_join.drop_near(df).collect()) == ["y", "z"]


def test_no_row_of_a_group_is_lost(spark):
    """Different texts of one id, near copies without ids, repeated rows, columns with the operator's own names."""
    t, far = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, t, 1), (5, t + " x", 2), (5, far, 3), (None, far + " y", 4), (None, far + " z", 4), (7, None, 5), (7, None, 5), (8, " ", 6), (9, "q r s t u v", 7), (9, "q r s t u v", 7), (9, "q r s t u v", 8)]
    df = spark.createDataFrame([(*r, r[2], {"a": r[2]}) for r in rows], "doc_id long, text string, r1 int, component_id int, g map<string,int>").repartition(3)
    got_ = ngram_join.drop_near(df)
    assert got_.columns == df.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got_.collect()), key=repr)
    assert kept == sorted([(1, t), (5, far), (7, None), (7, None), (8, " "), (9, "q r s t u v")], key=repr)
    none = ngram_join.drop_near(df.where("doc_id is null")).collect()
    assert len(none) == 1
    assert ngram_join.drop_near(df.where("false")).count() == 0


def test_hot_group_of_two_components(spark):
    """Two large groups that share rare passages but no link, among them chains; blocks far below the groups' sizes."""
    rng = random.Random(5)
    a, b = ([f"{x}{i}" for i in range(60)] for x in "pq")
    shared = [f"s{i}" for i in range(12)]
    rows = []
    for i in range(20_000):
        w = list(a if i % 3 else b) + (shared if i % 2 else [])
        w[rng.randrange(len(w))] = f"u{i}"
        rows.append((i, " ".join(w)))
    df = frame(spark, rows).repartition(8)
    sizes = {}
    for r in ngram_join.near_groups(df, task_shingles=20_000).select("component_id").collect():
        sizes[r[0]] = sizes.get(r[0], 0) + 1
    # with 12 of 72 words shared or not, all four kinds are groups of their own, up to links the brute force shows below
    few = rows[:300]
    assert got(frame(spark, few), task_shingles=2000) == near_groups(few)
    assert sum(sizes.values()) == 20_000 and len([n for n in sizes.values() if n > 2000]) == len([c for c in {c for _, _, c in near_groups(few)} if sum(x == c for _, _, x in near_groups(few)) > 20])


def test_small_graph_is_settled_in_few_jobs(spark):
    path = [(i + 1, i) for i in range(3000)] + [(5000, 4000 + i) for i in range(900)]
    edges = frame(spark, path, "a long, b long").repartition(5)
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = jobs()
    found = {r["v"]: r["component"] for r in components(edges).collect()}
    assert jobs() - before <= 6
    assert found == dict.fromkeys(range(3001), 0) | dict.fromkeys([*range(4000, 4900), 5000], 4000)


def test_graph_above_one_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_STARS", 16)
    rng = random.Random(5)
    path = [(i + 1, i) for i in range(200)] + [(1000 + rng.randrange(99), 1000 + rng.randrange(99)) for _ in range(99)]
    rng.shuffle(path)
    found = {r["v"]: r["component"] for r in components(frame(spark, path, "a long, b long").repartition(4)).collect()}
    least = {v: v for e in path for v in e if e[0] != e[1]}
    for _ in path:
        for a, b in path:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least


def test_few_rows_in_many_partitions(spark):
    rows = [(i, " ".join(f"w{i % 7}-{k}" if k % 40 != i // 7 % 40 else f"z{i}" for k in range(120))) for i in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 61)
        assert got(frame(spark, rows), task_shingles=200) == near_groups(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
