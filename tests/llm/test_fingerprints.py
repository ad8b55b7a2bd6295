import hashlib
import random

from helpers import WORD
from pyspark.sql import functions as F

from tessera.llm import fingerprints, queries

D = "/root/testdata/sf0.001"


def restated_edit(rows):
    """(id, text) in order -> edited texts."""
    texts = [t or "" for _, t in rows]
    out = []
    for k, t in enumerate(texts):
        n = len(t) // 4
        out.append(t[: len(t) - n] + texts[(k + 1) % len(texts)][:n])
    return out


def restated_tuples(spark, texts):
    """Tuples by plain loops; hashes are Spark's own."""
    flat = spark.createDataFrame([(i, j, w) for i, t in enumerate(texts) for j, w in enumerate(WORD.findall(t or ""))], "i int, j int, w string")
    hashes = {(r["i"], r["j"]): r["h"] for r in flat.select("i", "j", F.xxhash64("w").alias("h")).collect()}
    kmers, k = {}, fingerprints.K
    for i, t in enumerate(texts):
        n = len(WORD.findall(t or ""))
        h = [hashes[i, j] for j in range(n)]
        kmers[i] = [h[j : j + k] for j in range(n - k + 1)] if n >= k else [h] if n else []
    rows = [(i, j, g, len(g)) for i, gs in kmers.items() for j, g in enumerate(gs)]
    g = spark.createDataFrame(rows, "i int, j int, g array<long>, n int")
    whole = F.when(F.col("n") == k, F.xxhash64(*[F.get("g", x) for x in range(k)])).otherwise(F.xxhash64("g"))
    hashed = {(r["i"], r["j"]): r["h"] for r in g.select("i", "j", F.shiftright(whole, fingerprints.PLACE_BITS).alias("h")).collect()}
    count, numbered = {}, []
    for (i, j), h in sorted(hashed.items()):
        c = count[i, h] = count.get((i, h), -1) + 1
        numbered.append((i, j, h, c))
    values = spark.createDataFrame(numbered, "i int, j int, h long, c int").select("i", "j", F.xxhash64("h", "c").alias("v")).collect()
    chosen = {}
    for r in values:
        v = r["v"] >> fingerprints.PLACE_BITS  # bucket and hash
        chosen.setdefault((r["i"], (r["v"] % 2**64) >> 59), []).append((v % 2**37, r["j"]))
    tuples = []
    for (i, b), x in chosen.items():
        first = sorted(sorted(x)[: fingerprints.TUPLE], key=lambda p: p[1])
        tuples.append((i, b, [p[0] % 2**32 for p in first]))
    made = spark.createDataFrame(tuples, "i int, b long, v array<long>").select("i", "b", F.xxhash64(*[F.get("v", x) for x in range(fingerprints.TUPLE)]).bitwiseAND(F.lit(0xFFFFFFFF)).alias("h"))
    out = {i: [] for i in range(len(texts))}
    for r in made.collect():
        out[r["i"]].append(r["b"] << 32 | r["h"])
    return {i: sorted(x) for i, x in out.items()}


def test_tuples_by_brute_force(spark):
    rng = random.Random(0)
    texts = ["", None, "one", "one two", "a b c", "a " * 700, "a b " * 40, " x\ty  z "] + [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(200))) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {r["i"]: r["tuples"] for r in fingerprints.with_tuples(df, "text").collect()}
    assert got == restated_tuples(spark, texts)


def likeness(a, b):
    cut = lambda s: {s[i : i + 10] for i in range(0, len(s), 10)}
    x, y = cut(a), cut(b)
    filled = {s[:2] for s in x | y}
    return len(x & y) / len(filled) if filled else 1.0


def check(rows, made):
    """rows in the order of documents."""
    edited = restated_edit(rows)
    assert len(made) == len(rows)
    by_text = {}
    for r, (d, t), e, k in zip(made, rows, edited, range(len(rows)), strict=True):
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (d, len(t or ""), hashlib.sha256(e.encode()).hexdigest())
        assert by_text.setdefault(t or "", r["fingerprint"]) == r["fingerprint"]
        assert r["near_edited"] == likeness(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == likeness(r["fingerprint"], made[(k + 1) % len(made)]["fingerprint"])


def test_query(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in queries.table(spark, D, "documents").collect())
    made = queries.op7_order_minhash(spark, D).orderBy("doc_id").collect()
    check(rows, made)
    assert sum(r["near_edited"] for r in made) / len(made) > 0.25 > 0.1 > sum(r["near_next"] for r in made) / len(made)


def test_odd_rows(spark):
    rows = [(None, "x y z"), (1, "a b c d e f g h"), (2, None), (3, ""), (4, "🙂é " * 30), (7, "w " * 3000)]
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], "doc_id long, text string, row int, place string").repartition(2)
    check(rows, fingerprints.edited_pairs(df).orderBy(F.col("doc_id").asc_nulls_first()).collect())
    assert fingerprints.edited_pairs(df.where("false")).count() == 0
    one = fingerprints.edited_pairs(df.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0
    twice = fingerprints.edited_pairs(spark.createDataFrame([(1, "a b c d")] * 3, "doc_id long, text string")).collect()
    assert [r["near_next"] for r in twice] == [1.0] * 3


def test_order_counts(spark):
    """The same k-mers in another order give another fingerprint; a small edit changes little."""
    w = [f"w{i}" for i in range(400)]
    blocks = [w[i : i + 40] for i in range(0, 400, 40)]
    texts = [" ".join(w), " ".join(x for b in blocks[::-1] for x in b), " ".join([*w[:200], "new", *w[200:]])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    f = {r["i"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    assert likeness(f[0], f[2]) > 0.8 > likeness(f[0], f[1])
