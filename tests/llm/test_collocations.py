import re
from collections import Counter

import pytest

from tessera.llm import collocations as C


def brute(rows, least=10, shown=2000):
    """All of the contract in plain Python: rows of (text, lang) -> (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in (1, 2, 3):
                for i in range(len(w) - d + 1):
                    f[lang, tuple(w[i : i + d])] += 1
    out = []
    for lang in n:
        found = []
        for (g, w), a in f.items():
            if g != lang or len(w) < 2 or a < least:
                continue
            if any(v == lang and len(x) > len(w) and (x[:2] == w or x[1:] == w) and 100 * b >= 50 * a for (v, x), b in f.items() if len(x) == 3):
                continue
            cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(w).encode(), left, right))
        found.sort()
        out += [(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(found[:shown], 1)]
    return sorted(out)


def mine(df, **kw):
    return sorted(tuple(r) for r in C.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


HARD = [
    ("a b c. A B\tc, a b!x y\nz z z z z z", "en"), (None, "en"), ("", None), ("a b c a b c", None), (". ,;", "de"), ("é \x00a \x01b \x00a\x01 \x05 a", "fr"),
    ("a  b   c a\x0bb c d e", "l\x00x"), ("THE ÄÖ the äö", "de"), ("x", ""), ("lone", "zz"),
]


@pytest.mark.parametrize("least", [1, 2, 3])
def test_hard_texts(spark, least):
    rows = HARD * 2
    df = spark.createDataFrame(rows, "text string, lang string").withColumnRenamed("text", "text")
    assert mine(df, least=least, range_nodes=7) == brute(rows, least)


def test_ranges_shards_and_long_texts(spark, monkeypatch):
    """Many ranges cut one word's phrases; small shards cut texts; neither changes a count."""
    import random

    rnd = random.Random(1)
    word = lambda: rnd.choice(["hot", "hot", "hot", "a", "b", "cc", "d.", "e", "hoth", "ho"])
    rows = [(" ".join(word() for _ in range(rnd.choice([0, 1, 5, 3000]))), rnd.choice(["x", "x", None])) for _ in range(12)]
    want = brute(rows, 4)
    assert len(want) > 100
    for size in (11, 64, 1 << 20):
        both = C.shards(*(C.pa.array(c, C.pa.string()) for c in ([r[1] for r in rows], [r[0] for r in rows])), size)
        total = Counter()
        for shard in both:
            for paths, n in C.trie(*shard):
                total.update(dict(zip(paths.to_pylist(), n.tolist(), strict=True)))
        assert total[b"x\x00hot"] == sum(w == "hot" for t, g in rows if g == "x" for w in re.findall(r"[^. ]+", t))
        if size == 11:
            first = total
        assert total == first
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for nodes in (50, 1000, 1 << 20):
        assert mine(df, least=4, range_nodes=nodes) == want


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("p q p q", "en", 1, "x", b"z")] * 12, "text string, lang string, n long, path string, range binary")
    assert mine(df) == brute([("p q p q", "en")] * 12)
    assert mine(df.limit(0)) == []


def test_counts_beyond_64_bits_of_products(spark, monkeypatch):
    """Scores of counts whose squares times a million pass 64 bits are exact."""
    big = 3_037_000_500_123

    def fake(df, *a):
        w = lambda *x: b"\x00".join([b"en", *x])
        rows = [(w(), 0, "en", "", 9 * big, None, None, None, None, b""), (w(b"p"), 1, "en", "p", big + 7, None, None, None, None, w()), (w(b"q"), 1, "en", "q", big + 11, None, None, None, None, w()),
                (w(b"p", b"q"), 2, "en", "p q", big, big + 7, None, w(b"q"), None, w(b"p"))]
        return spark.createDataFrame(rows, C.NODES)

    monkeypatch.setattr(C, "nodes", fake)
    assert mine(spark.range(1)) == [("en", 1, "p q", big, big + 7, big + 11, 9 * big, 1000000 * big * big // ((big + 7) * (big + 11)))]


def test_equal_order_of_escaped_steps():
    words = [b"", b"\x00", b"\x01", b"\x00\x01", b"\x02", b"a", b"a\x00", b"a\x01"]
    assert [C.unescape(C.escape(w)) for w in words] == words
    paths = sorted((C.escape(v) + b"\x00" + C.escape(w), (v, w)) for v in words for w in words)
    assert [p for _, p in paths] == sorted((v, w) for v in words for w in words)
