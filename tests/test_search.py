"""Search, fusion, vectors, answers and reports on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import answer, index, reports


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def restated_fusion(vector, keyword):
    score = {}
    for found in (vector, keyword):
        for rank, row in enumerate(found[:50]):
            score[row] = score.get(row, 0.0) + 1.0 / (60 + rank + 1)
    return sorted(score, key=lambda r: -score[r])


def test_fusion_ties(spark):
    v, k = [5, 3, 9, 1], [3, 7, 5, 2]
    lists = [frame(spark, [(0, r, i) for i, r in enumerate(x)], "query_id long, ord long, rank int") for x in (v, k)]
    got = [r["ord"] for r in index.fuse(*lists, k=9).orderBy("n").collect()]
    assert got == [3, 5, 7, 9, 1, 2] == restated_fusion(v, k)


def test_filters(spark):
    df = frame(spark, [(1, "public", "SA"), (2, "internal", "EG"), (3, None, None)], "ord long, audience string, country string")
    ids = lambda c: [r["ord"] for r in df.where(c).orderBy("ord").collect()]
    assert ids(index.allowed()) == [1, 2, 3]
    assert ids(index.allowed("public")) == [1]
    assert ids(index.allowed(country="SA")) == [1, 3]
    assert ids(index.allowed("external", "SA")) == []


def test_filter_keeps_scores_and_duplicates_weigh_twice(spark):
    docs = frame(spark, [(i, t, a, None) for i, (t, a) in enumerate([("a b c", "public"), ("a a", "internal"), ("b", "public"), ("", "public")])], "ord long, text string, audience string, country string")
    q = frame(spark, [(0, "a b"), (1, "a a b")], "query_id long, question string")
    all_ = {(r["query_id"], r["ord"]): r["score"] for r in index.bm25(docs, q).collect()}
    some = {(r["query_id"], r["ord"]): r["score"] for r in index.bm25(docs, q, index.allowed("public")).collect()}
    assert some == {k: v for k, v in all_.items() if k[1] != 1}
    assert all_[1, 1] == pytest.approx(2 * all_[0, 1])
    assert all(k[1] != 3 for k in all_)


def test_the_corpus_is_tokenised_once(spark, tmp_path):
    frame(spark, [(i, f"a b c {i}") for i in range(50)], "ord long, text string").write.parquet(str(tmp_path / "corpus"))
    frame(spark, [(0, "a b"), (1, "c 7 7")], "query_id long, question string").write.parquet(str(tmp_path / "asked"))
    found = index.bm25(spark.read.parquet(str(tmp_path / "corpus")), spark.read.parquet(str(tmp_path / "asked")))
    assert found.count() == 100
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert final.count("Generate explode(concat(") == 1 and final.count("ReusedExchange") >= 2


def test_empty_corpus(spark):
    docs = frame(spark, [], "ord long, text string, audience string, country string")
    q = frame(spark, [(0, "a")], "query_id long, question string")
    assert index.keyword_search(docs, q).count() == 0
    assert index.corpus_stats(docs).first()["avg_len"] == 1.0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = frame(spark, [(0, [nan, 1.0]), (1, [0.0, 0.0]), (2, [inf, 2.0]), (3, [3.0, 4.0])], "ord long, embedding array<float>")
    clean = {r["ord"]: r["v"] for r in df.select("ord", index.sanitise(F.col("embedding")).alias("v")).collect()}
    assert clean == {0: [0, 1], 1: [0, 0], 2: [0, 2], 3: [3, 4]}
    assert df.where(index.is_bad(F.col("embedding"))).count() == 2
    unit = {r["ord"]: r["v"] for r in df.select("ord", index.unit(index.sanitise(F.col("embedding"))).alias("v")).collect()}
    assert unit[1] == [0, 0] and unit[3] == pytest.approx([0.6, 0.8])
    # a zero vector is found with score 0, before negative ones
    scores = {r["ord"]: r["score"] for r in index.one_vector_scores(df, [-1.0, 0.0]).collect()}
    assert scores[1] == 0.0 and scores[3] == pytest.approx(-0.6)
    batch = index.vector_search(df, frame(spark, [(0, [-1.0, 0.0])], "query_id long, embedding array<float>"))
    assert {r["ord"]: r["score"] for r in batch.collect()} == scores


def restated_search(rows, asked, most):
    def unit(v):
        v = [x if x is not None and math.isfinite(x) else 0.0 for x in v]
        total = 0.0
        for x in v:
            total += x * x
        return [x / math.sqrt(total) for x in v] if total else v

    out = []
    for q, w in asked:
        w, scores = unit(w), []
        for o, v in rows:
            if v is not None and len(v) == len(w):
                total = 0.0
                for x, y in zip(unit(v), w, strict=True):
                    total += x * y
                scores.append((-round(total, 9), o))
        out += [(q, o, -s, i) for i, (s, o) in enumerate(sorted(scores)[:most])]
    return sorted(out)


def test_vector_search_is_exact(spark, monkeypatch):
    """Ties, near ties, odd vectors, several lengths, several blocks of queries, tiles of few rows."""
    rnd = random.Random(8)
    some = lambda n: [float(np.float32(rnd.choice([rnd.gauss(0, 1), 0.0, 1.0]))) for _ in range(n)]
    rows = [(i, some(rnd.choice([6, 6, 6, 2]))) for i in range(300)]
    rows += [(300 + i, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0 + i * 2e-7]) for i in range(30)] + [(400 + i, [0.5] * 6) for i in range(30)]
    rows += [(500, None), (501, []), (502, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (503, [math.nan, math.inf, 1.0, 0.0, 0.0, 0.0]), (504, [0.0] * 6)]
    vectors = frame(spark, rows, "ord long, embedding array<float>").repartition(5)
    asked = [(i, v) for i, v in rows if i % 7 == 0 and v]
    want = restated_search([(i, None if v is None else single(v)) for i, v in rows], [(i, single(v)) for i, v in asked], 12)
    got = lambda **kw: sorted(map(tuple, index.vector_search(vectors, frame(spark, asked, "query_id long, embedding array<float>"), most=12, **kw).collect()))
    assert got() == want
    assert got(block_bytes=200) == want
    many = index.Heaps(np.eye(3), 2)
    monkeypatch.setattr(index, "TILE_QUERIES", 2)
    monkeypatch.setattr(index, "PAIRS", 3)
    many.add(np.arange(6), np.repeat(np.eye(3), 2, 0))
    many.add(np.arange(6, 9), np.eye(3)[::-1] * 0.5)
    assert many.row.tolist() == [0, 0, 1, 1, 2, 2] and many.ord.tolist() == [0, 1, 2, 3, 4, 5]
    assert frame(spark, [], "ord long, embedding array<float>").transform(lambda v: index.vector_search(v, v.withColumnRenamed("ord", "query_id"))).count() == 0


def single(v):
    return [x if x is None else float(np.float32(x)) for x in v]


def test_vector_search_shuffles_few_rows(spark):
    """A task sends at most ``most`` rows for each query, whatever it reads."""
    vectors = spark.range(0, 20000, 1, 4).select(F.col("id").alias("ord"), F.array(F.sin("id"), F.cos(F.col("id") * 7), F.lit(0.1)).alias("embedding"))
    found = index.vector_search(vectors, vectors.where("ord < 10").withColumnRenamed("ord", "query_id"), most=20)
    assert found.count() == 200
    scored = found._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in scored and "Join" not in scored
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    heaps = index.Heaps(np.eye(2), 20)
    heaps.add(np.arange(5000), np.random.default_rng(0).standard_normal((5000, 2)))
    assert len(heaps.ord) == 40


def test_lists_are_cut_before_the_shuffle(spark):
    scores = spark.range(1000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("ord"), (F.col("id") % 7).cast("double").alias("score"))
    top = index.ranked(scores, 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.agg(F.min("rank"), F.max("rank"), F.count("*")).first()[:] == (0, 4, 15)


def test_whole_hybrid_finds_documents_without_a_vector(spark, tmp_path):
    d = str(tmp_path)
    docs = [(1, "the thing", "en", "s", 9), (7, "other", "en", "s", 5), (8, "unasked", "en", "s", 7)]
    frame(spark, docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    frame(spark, [(7, [1.0, 0.0], 0), (9, [0.5, 0.5], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    frame(spark, [(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for name in ("hybrid", "rrf"):
        assert [r["ord"] for r in catalog.QUERIES[name](spark, d).orderBy("n").collect()] == [7, 1]


def test_index_file(spark, tmp_path):
    docs = frame(spark, [(0, "a b c"), (1, "a a"), (2, "b")], "ord long, text string")
    built = index.Index.build(docs, str(tmp_path / "i"))
    got = {r["ord"]: r["score"] for r in built.bm25("a b a").collect()}
    want = {r["ord"]: r["score"] for r in index.bm25(docs, frame(spark, [(0, "a b a")], "query_id long, question string")).collect()}
    assert got == pytest.approx(want)


def test_replies(spark):
    cases = [("x [1]\n[[ANSWERED]]", "x [1]", True), ("none\n[[NO_ANSWER]]", "none", False), ("[[NO_ANSWER]] later", "[[NO_ANSWER]] later", False)]
    df = frame(spark, [(c[0],) for c in cases], "r string").select(answer.parse_reply(F.col("r")).alias("p")).select("p.*")
    assert [tuple(r) for r in df.collect()] == [c[1:] for c in cases]
    cited = frame(spark, [("a [3] b [1] c [3] [12] [0]",)], "r string").select(answer.cited(F.col("r"), F.lit(6)).alias("c")).first()["c"]
    assert cited == [1, 3]


def test_answers(spark):
    questions = frame(spark, [(0, "q"), (1, "q"), (2, "q")], "query_id long, question string")
    shown = frame(spark, [(0, 1, "t1", "u1"), (0, 2, "t2", "u2"), (2, 1, "t", "u")], "query_id long, n int, title string, url string")
    replies = frame(spark, [(0, "x [2]\n[[ANSWERED]]"), (1, "never shown"), (2, "claims\n[[ANSWERED]]")], "query_id long, reply string")
    got = {r["query_id"]: r for r in answer.answers(questions, replies, shown).collect()}
    assert got[0]["answer"] == "x [2]" and got[0]["grounded"] and [tuple(c) for c in got[0]["citations"]] == [(2, "t2", "u2")]
    assert got[1]["answer"] == answer.REFUSAL and not got[1]["answered"] and got[1]["grounded"] and got[1]["citations"] == []
    assert got[2]["answered"] and not got[2]["grounded"]


def test_format_passages_tags(spark):
    rows = frame(spark, [(0, 1, "body", "", "f.pdf", "SA", True, False, None)], "query_id long, n int, text string, doc_title string, source_file string, country string, pricing_not_local boolean, competitive boolean, curated boolean")
    got = answer.format_passages(rows).first()["prompt"]
    assert got == f"[1] (source: f.pdf; country: SA; {answer.TAGS['pricing_not_local']})\nbody"


def test_diagnose_verdicts(spark):
    docs = frame(spark, [(0, "alpha beta"), (1, "gamma"), (2, "delta omega")], "ord long, text string")
    q = frame(spark, [(0, "alpha"), (1, "gamma zeta")], "query_id long, question string")
    v = lambda e, k=8: {r["query_id"]: (r["verdict"], r["unknown_terms"]) for r in index.diagnose(docs, q, e, k).collect()}
    assert v("beta") == {0: ("retrieved", 0), 1: ("unranked", 1)}
    assert v("nothing") == {0: ("absent", 0), 1: ("absent", 1)}
    assert v("beta", 0)[0] == ("ranked_low", 0)
    ties = frame(spark, [(i, "same words" + " held" * (i in (4, 6))) for i in range(8)] + [(8, "same same words")], "ord long, text string")
    asked = frame(spark, [(0, "same words"), (1, "held"), (2, "none")], "query_id long, question string")
    full = index.ranked(index.bm25(ties, asked), 99).where("ord IN (4, 6)").groupBy("query_id").agg(F.min("rank") + 1)
    want = {r[0]: r[1] for r in full.collect()}
    assert {r["query_id"]: r["keyword_rank"] for r in index.diagnose(ties, asked, "held").collect()} == {0: want[0], 1: want[1], 2: None}


def test_size_report(spark):
    got = reports.size_report(frame(spark, [(i,) for i in (4, 2, 3, 1)], "tokens int")).first()
    assert (got["median"], got["p90"], got["total"], got["largest"], got["above"]) == (3, 4, 10, 4, 0)


def test_embedding_store(spark):
    rows = frame(spark, [(0, "a"), (1, "b"), (2, "a")], "ord long, text string")
    from tessera.sources.files import embed, text_key

    made = embed(text_key(rows), lambda texts: [[float(ord(t[0])), 0.0] for t in texts], 2)
    assert made.count() == 2
    assert index.embed_todo(rows, made.where("embedding[0] = 97")).select("ord").collect()[0]["ord"] == 1
    assert [r["embedding"] for r in index.embed_join(rows, made).collect()] == [[1.0, 0.0]] * 3


@pytest.mark.parametrize("block_bytes", [index.QUERY_BYTES, 200])
def test_lists_are_those_of_all_scores(spark, monkeypatch, block_bytes):
    rnd = random.Random(5)
    words = ["the", "of", *(f"w{i}" for i in range(30))]
    docs = [(i, rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.choice([1, 6, 40])))]), rnd.choice(["public", "internal"]), None) for i in range(400)]
    corpus = frame(spark, docs, "ord long, text string, audience string, country string").repartition(4)
    asked = frame(spark, [(q, " ".join(rnd.choices(words, k=5))) for q in range(9)] + [(20, None), (21, "unheard of"), (22, "the the")], "query_id long, question string")
    monkeypatch.setattr(index.asked_blocks, "__defaults__", (block_bytes,))
    shown = lambda df: sorted((r["query_id"], r["rank"], r["ord"], r["score"]) for r in df.collect())
    for may in (None, index.allowed("public")):
        want, lists = shown(index.ranked(index.bm25(corpus, asked, may), 7)), index.bm25_lists(corpus, asked, may, 7)
        assert shown(lists) == [(*r[:3], pytest.approx(r[3], abs=1e-8)) for r in want]
    # nothing is shuffled but lists that are cut
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "WindowGroupLimit" in plan
    rank = {r["query_id"]: r["r"] for r in index.ranked(index.bm25(corpus, asked), 400).join(index.holders(corpus, "w7"), "ord").groupBy("query_id").agg((F.min("rank") + 1).alias("r")).collect()}
    told = {r["query_id"]: r for r in index.diagnose(corpus, asked, "w7").collect()}
    assert {q: r["keyword_rank"] for q, r in told.items()} == {q: rank.get(q) for q in [*range(9), 20, 21, 22]}
    assert told[21]["unknown_terms"] == 1 and told[20]["unknown_terms"] == 0 and told[0]["holders"] == index.holders(corpus, "w7").count()


def test_lists_of_nothing(spark):
    docs = frame(spark, [], "ord long, text string")
    assert index.bm25_lists(docs, frame(spark, [(0, "a")], "query_id long, question string")).count() == 0
    assert index.bm25_lists(docs, frame(spark, [], "query_id long, question string")).count() == 0
    assert index.diagnose(docs, frame(spark, [(0, None)], "query_id long, question string"), "x").collect()[0][:] == (0, 0, 0, 0, None, "absent")
