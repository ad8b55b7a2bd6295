import random
import re
from collections import Counter

from helpers import WORD, near_groups
from pyspark.sql import functions as F
from test_mix_pack import check_pack

import corpus_pipeline
from tessera.llm import language_id, packing
from tessera.runtime import materialise

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, kept = docs.columns, {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = materialise(stage(spark, docs, D), name)
        rows = [r.asDict() for r in docs.collect()]
        if name != names[-1]:
            assert docs.columns == columns
        if name == "language_id":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in rows}
            assert len(gone) <= 0.05 * len(before) and all(r in before for r in rows)
        if name == "exact_dedup":
            norm = lambda r: re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
            first = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                first.setdefault(norm(r), r)
            assert sorted(rows, key=lambda r: r["doc_id"]) == sorted(first.values(), key=lambda r: r["doc_id"])
        if name == "ngram_jaccard_join":
            stay = {d for d, _, c in near_groups([(r["doc_id"], r["text"]) for r in before]) if d == c}
            assert sorted(r["doc_id"] for r in rows) == sorted(stay)
        if name == "mix_to_targets":
            size = lambda rs: sum(len(WORD.findall(r["text"] or "")) for r in rs)
            assert abs(size(rows) - size(before)) <= len({r["source"] for r in before})
        if name == "best_fit_packing":
            check_pack([(r["doc_id"], r["text"]) for r in before], rows, packing.LENGTHS)
        kept[name] = len(rows)
    assert corpus_pipeline.run(spark, D).count() == kept[names[-1]]


def test_rejects_texts_without_a_language(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "12 34", "en", "s", 5), (10**6 + 1, None, "en", "s", 0)], docs.schema)
    got = corpus_pipeline.identify_language(spark, docs.union(odd), D)
    assert got.where("doc_id >= 1000000").count() == 0 and got.columns == docs.columns
    assert corpus_pipeline.identify_language(spark, odd.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars"), D).count() == 0
    assert language_id.train(docs).languages == ["de", "en", "es", "fr"]


def test_rejects_gibberish_and_languages_not_learned(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    bad = [" ".join(word() for _ in range(n)) for n in (3, 60, 2000)] + [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.",
        "人人生而自由,在尊严和权利上一律平等。",
    ]
    clean = {}
    for r in docs.where("length(text) > 200").orderBy("doc_id").collect():
        clean.setdefault(r["lang"], r["text"][:200])
    mixed = [clean["en"] + " " + clean["de"], clean["fr"] + " " + clean["es"]]
    rows = [(10**6 + i, t, lang, "s", len(t)) for lang, at in ((None, 0), ("en", 100)) for i, t in enumerate(bad, at)]
    # clean documents in two, three and four languages, in parts of equal size
    pick = {lang: [r["text"] for r in docs.where(F.col("lang") == lang).where("length(text) > 900").orderBy("doc_id").limit(10).collect()] for lang in ("de", "en", "es", "fr")}
    for n in (2, 3, 4):
        for k in range(10):
            some = [pick[lang][k % len(pick[lang])][300:700] for lang in sorted(pick)[k % 4 :] + sorted(pick)[: k % 4]]
            mixed.append("\n".join(some[:n]))
    rows += [(2 * 10**6 + i, t, None, "s", len(t)) for i, t in enumerate(mixed)]
    got = corpus_pipeline.identify_language(spark, docs.union(spark.createDataFrame(rows, docs.schema)), D)
    stay = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert {i for i in stay if i >= 10**6} == {2 * 10**6 + i for i in range(32)}
    assert stay >= {r["doc_id"] for r in docs.where(r"text rlike '\\p{L}'").collect()}


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, D), "empty")
        assert docs.count() == 0


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, one id with different texts, and all clashing names."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    text = {}
    for r in docs.where("length(text) > 300").orderBy("doc_id").collect():
        text.setdefault(r["lang"], r["text"])
    t, u, v = text["en"], text["de"], text["fr"]
    rows = [(1, t, "en", "a", len(t)), (1, u, "de", "a", len(u)), (1, t, "en", "a", len(t)), (None, t + " and", None, None, None), (None, None, None, None, None), (None, None, None, None, None)]
    rows += [(7, "", "en", "b", 0), (8, " \n", "en", "b", 2), (9, (v + " ") * 40, "fr", "b", None), (10, v, "fr", "c", len(v)), (10, v, "fr", "c", len(v)), (11, t + " the of", "en", None, 5)]
    names = ["score", "lang_pred", "proportions", "_row", "row", "_copies", "_partial", "_cut", "k1", "k2", "times", "r1", "component_id", "keep_id", "digest", "bin_id", "part", "ids"]
    odd = spark.createDataFrame(rows, docs.schema).unionByName(docs.limit(60)).repartition(3)
    return odd.select("*", *[F.xxhash64("doc_id", "text", F.lit(n)).cast("double" if n == "score" else "string").alias(n) for n in names])


def test_odd_documents_in_every_stage(spark):
    docs = odd_documents(spark).cache()
    columns = docs.columns
    plain = lambda r: tuple(r[c] for c in columns)
    given = Counter(map(plain, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, D)
        assert got.columns == columns and got.dtypes == docs.dtypes, name
        rows = Counter(map(plain, got.collect()))
        if name == "mix_to_targets":  # a cut copy has another text and length, but all other columns
            cut = [i for i, c in enumerate(columns) if c not in ("text", "n_chars")]
            known = {tuple(r[i] for i in cut) for r in given}
            assert all(tuple(r[i] for i in cut) in known for r in rows)
            size = lambda rs: sum(len(WORD.findall(r[1] or "")) * n for r, n in rs.items())
            assert abs(size(rows) - size(given)) <= len({r[3] for r in given})
            continue
        assert all(n <= given[r] for r, n in rows.items()), name
        norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if name == "language_id":
            assert not [r for r in rows if not re.search(r"[^\W\d_]", r[1] or "")]
            assert {r: n for r, n in given.items() if len(WORD.findall(r[1] or "")) > 40}.items() <= rows.items()
        if name == "exact_dedup":
            assert Counter(norm(r[1]) for r in rows.elements()) == Counter({norm(r[1]) for r in given})
            least = {}
            for r in given:
                least[norm(r[1])] = min(least.get(norm(r[1]), (True, 0)), (r[0] is None, r[0] or 0))
            assert all((r[0] is None, r[0] or 0) == least[norm(r[1])] for r in rows)
        if name == "ngram_jaccard_join":
            number = list(given.elements())
            groups = {}
            for i, _, c in near_groups([(i, r[1]) for i, r in enumerate(number)]):
                groups.setdefault(c, []).append(number[i])
            want = 0
            for g in groups.values():
                if not WORD.findall(g[0][1] or ""):
                    want += len(g)
                    continue
                want += 1
                first = min((r[0] is None, r[0] or 0) for r in g)
                assert sum(rows[r] for r in set(g)) == 1 and any(rows[r] and (r[0] is None, r[0] or 0) == first for r in g)
            assert sum(rows.values()) == want
    made = corpus_pipeline.pack_sequences(spark, docs, D).collect()
    check_pack([(r[0], r[1]) for r in given.elements()], made, packing.LENGTHS)
