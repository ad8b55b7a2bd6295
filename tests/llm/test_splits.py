"""Results don't depend on how files are split, also if that changes between the jobs of one call, as when executors come or go."""

import itertools
import re
from collections import Counter

import pytest
from helpers import WORD
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import exact_dedup, fingerprints, mixing, packing, warc

MODULES = (exact_dedup, fingerprints, mixing, packing, warc, corpus_pipeline)


@pytest.fixture
def shaken(spark, monkeypatch):
    """Before each written table the number of cores that Spark splits files for changes."""
    cores = itertools.cycle(["1", "7", "2", "23"])

    def change(f):
        def g(*a, **k):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", next(cores))
            return f(*a, **k)

        return g

    for m in MODULES:
        if hasattr(m, "materialise"):
            monkeypatch.setattr(m, "materialise", change(m.materialise))
    yield
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('rows')}/t"
    rows = spark.range(800).selectExpr(
        "id % 700 AS doc_id",
        "concat_ws(' ', transform(sequence(0, cast(id % 700 % 13 AS int)), i -> concat('w', cast(id % 400 AS string), 'x', cast(i AS string)))) AS text",
        "concat('s', cast(id % 3 AS string)) AS source",
        "id % 700 % 5 AS _row",
        "map('a', id % 7) AS k1",
    )
    rows.repartition(40).write.parquet(path)
    return path


def plain(r):
    return repr(sorted(r.asDict(recursive=True).items()))


def test_exact_dedup(spark, many_files, shaken):
    df = spark.read.parquet(many_files)
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    rows = [r.asDict(recursive=True) for r in got.collect()]
    assert len(rows) == len({r["text"] for r in rows}) == df.select("text").distinct().count()
    least = {}
    for r in df.collect():
        least[r["text"]] = min(least.get(r["text"], 10**9), r["doc_id"])
    assert {r["text"]: r["doc_id"] for r in rows} == least
    given = {plain(r) for r in df.collect()}
    assert all(repr(sorted(r.items())) in given for r in rows)


def test_warc(spark, many_files, shaken):
    df = spark.read.parquet(many_files).select("doc_id", F.concat(F.lit("http://a/"), "source").alias("url"), F.repeat("text", 9).alias("html"))
    got = warc.resolve(warc.assemble(warc.read(warc.write(df, id_col="doc_id"), with_block=False).cache())).collect()
    rows = [(r["doc_id"], r["html"]) for r in df.collect()]
    least = {}
    for i, h in rows:
        if len(h) >= 100:
            least[h] = min(least.get(h, i), i)
    assert len(got) == len(rows) and all(r["digest_ok"] for r in got)
    want = Counter((i, len(h), None if least.get(h, i) == i else least[h]) for i, h in rows)
    have = Counter((r["row_id"], r["payload_bytes"], r["refers_to"] if r["refers_to"] != r["row_id"] else None) for r in got)
    assert have == want
    assert Counter(r["record_type"] for r in got)["response"] == len(least) + sum(len(h) < 100 for _, h in rows)


def test_mixing(spark, many_files, shaken):
    df = spark.read.parquet(many_files)
    plan = mixing.mix(df).collect()
    made = mixing.copies(df).collect()
    want = Counter()
    for r in plan:
        want[r["source"]] += r["taken"]
    have = Counter()
    texts = {(r["doc_id"], r["source"], r["_row"], r["text"]) for r in df.collect()}
    starts = {(d, s, k): t for d, s, k, t in texts}
    for r in made:
        have[r["source"]] += len(WORD.findall(r["text"]))
        key = (r["doc_id"], r["source"], r["_row"])
        assert (*key, r["text"]) in texts or starts[key].startswith(r["text"])
    assert +have == +want


def test_fingerprints(spark, many_files, shaken):
    df = spark.read.parquet(many_files).select("doc_id", "text")
    first = Counter(plain(r) for r in fingerprints.edited_pairs(df).collect())
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    assert first == Counter(plain(r) for r in fingerprints.edited_pairs(df.repartition(5)).collect())
    assert sum(first.values()) == df.count()


def test_hot_repeated_rows(spark, monkeypatch):
    """A row that repeats more often than one task makes copies of."""
    df = spark.range(6000).selectExpr("CASE WHEN id % 2 = 0 THEN 1 ELSE id END AS doc_id", "CASE WHEN id % 2 = 0 THEN repeat('ab ', 40) ELSE concat('t ', id) END AS text", "'s' AS source")
    assert exact_dedup.drop_copies(df).count() == 3001
    made = fingerprints.edited_pairs(df.select("doc_id", "text"))
    hot = made.where("doc_id = 1 AND n_chars = 120").groupBy("near_next").count().collect()
    assert made.count() == 6000 and {r["near_next"]: r["count"] for r in hot}.get(1.0) == 2999 and sum(r["count"] for r in hot) == 3000
    copies = mixing.copies(df)
    size = sum(len(WORD.findall(r["text"])) for r in df.collect())
    assert sum(len(re.findall(r"\S+", r["text"])) for r in copies.collect()) == size
    pages = df.selectExpr("doc_id AS page_id", "source AS url", "text AS html")
    got = warc.resolve(warc.assemble(warc.read(warc.write(pages), with_block=False).cache())).where("payload_bytes = 120").groupBy("record_type").count().collect()
    assert {r["record_type"]: r["count"] for r in got} == {"response": 1, "revisit": 2999}
