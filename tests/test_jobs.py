"""The two jobs: results on small tables, reruns, growing input, failures on the way, and their command lines."""

import json
import logging
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import build_corpus, common, refresh_index
from tessera.operators import chunking, records
from tessera.runtime import keep

ROOT = Path(__file__).resolve().parents[1]
DOCS = "doc_id long, text string, lang string, source string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def site(spark, tmp_path):
    docs = [(1, "Heading\n" + "long line of prose. " * 6 + "\n" + "more of it here. " * 8, "en", "a_guide"), (2, None, "en", "a_guide"), (3, " \n ", "en", "empty"), (4, "قصير", None, None), (1, "x", "en", "a_guide")]
    spark.createDataFrame(docs, DOCS).withColumn("n_chars", F.lit(1)).write.parquet(str(tmp_path / "docs"))
    body = "".join(f"<p>word {i} of the page</p>" for i in range(30))
    pages = [("https://s/egypt/a", f"<h1>Egypt</h1><body>{body}</body>"), ("https://s/b", "<body>short</body>"), (None, body), ("https://s/c", None), ("https://s/switchers", f"<title>Home | x</title><body>{body}</body>")]
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(tmp_path / "pages"))
    return tmp_path


def test_build_corpus(spark, site, caplog):
    caplog.set_level(logging.INFO)
    args = (spark, str(site / "docs"), str(site / "pages"), str(site / "out"), {"target_chars": 100, "least_chars": 20})
    got = build_corpus.build(*args).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["chunk_index"]):
        by.setdefault(r["source_file"], []).append(r)
    assert set(by) == {"a_guide/1", "unknown/4", "https://s/egypt/a", "https://s/switchers"}
    first = by["a_guide/1"]
    assert [r["chunk_index"] for r in first if r["parent_id"] == first[0]["parent_id"]] == [0, 1] and first[0]["doc_title"] == "a guide"
    assert {r["text"] for r in first} >= {"x", "Heading\n" + ("more of it here. " * 8).strip() + "\nHeading"}  # a rest of a heading alone joins the chunk before it
    assert all(r["chars"] == len(r["text"]) and r["chunk_count"] >= 1 and r["type"] == ("prose" if "http" not in r["source_file"] else "marketing") for r in got)
    assert {r["country"] for r in by["https://s/egypt/a"]} == {"EG"} and by["https://s/switchers"][0]["competitive"] and by["https://s/switchers"][0]["country"] == "SA"
    assert by["unknown/4"][0]["lang"] == "ar" and by["unknown/4"][0]["country"] is None
    report = {r["source"]: (r["documents"], r["chunks"], r["empty"]) for r in spark.read.json(str(site / "out" / "report")).collect()}
    assert report["empty"] == (0, 0, True) and report["a_guide"] == (2, 3, False) and report["marketing"][0] == 2
    parts = {p.name for p in (site / "out" / "chunks").rglob("*=*") if p.is_dir()}
    assert parts == {"type=prose", "type=marketing", "country=EG", "country=SA", "country=__HIVE_DEFAULT_PARTITION__"}
    told = caplog.text
    assert "of 5 documents" in told and "of 4 pages" in told and f"{len(got)} chunks of 5 records" in told and "source empty gave no chunk" in told
    before = sorted(map(repr, got))
    assert sorted(map(repr, build_corpus.build(*args).collect())) == before
    assert sorted(map(repr, build_corpus.read(spark, str(site / "out")).collect())) == before


def test_chunks_are_counted_by_source_file(spark, site):
    """Pages that share a URL, and documents that share a name, are counted together, as the query's SQL does."""
    body = lambda w: "<body>" + "".join(f"<p>{w} {i} of the page</p>" for i in range(30)) + "</body>"
    pages = [("https://s/a", body("one")), ("https://s/a", body("another")), ("https://s/b", body("one")), ("https://s/d", body("one")), ("https://s/d", "<p>short</p>")]
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(site / "twice"))
    got = build_corpus.build(spark, str(site / "docs"), str(site / "twice"), str(site / "out"), {"target_chars": 100, "least_chars": 20}).collect()
    n = Counter(r["source_file"] for r in got)
    assert n["https://s/a"] > n["https://s/b"] == n["https://s/d"] > 1 and n["a_guide/1"] == 3
    assert all(r["chunk_count"] == n[r["source_file"]] for r in got)


def test_build_corpus_of_nothing(spark, site):
    spark.createDataFrame([], DOCS).write.parquet(str(site / "none"))
    spark.createDataFrame([], "url string, html string").write.parquet(str(site / "no_pages"))
    assert build_corpus.build(spark, str(site / "none"), str(site / "no_pages"), str(site / "o")).count() == 0


def test_unknown_settings_are_errors():
    with pytest.raises(ValueError, match="target"):
        common.settings("build_corpus", {"target": 1})


def expected(*batches):
    """Postings of the texts of all batches, each text once under the first batch's smallest id."""
    seen, out = {}, Counter()
    for batch in batches:
        for d, t, *_ in sorted(batch, key=lambda r: (r[0] is not None, r[0] or 0)):
            seen.setdefault(t or "", d)
    for t, d in seen.items():
        words = t.lower().split()
        for w, n in Counter(words).items():
            out[w, d, n, len(words)] += 1
    return sorted(out.elements(), key=repr)


FIRST = [(5, "The cat sat", "en", "a"), (3, "The cat sat", "fr", "a"), (9, None, "en", "b"), (7, "dog dog", "en", None)]
SECOND = [(1, "the cat", "en", "a"), (2, "The cat sat", "en", "a"), (2, "", "en", "a"), (4, "new words new", "en", "a"), (4, "new words new", "en", "a"), (None, "no id", None, None)]


def add(spark, folder, name, some):
    spark.createDataFrame(some, DOCS).coalesce(1).withColumn("extra", F.lit("x")).write.parquet(f"{folder}/{name}-tmp")
    for p in Path(f"{folder}/{name}-tmp").glob("part*.parquet"):
        p.rename(Path(folder) / "in" / f"{name}.parquet")


def listing(folder):
    return sorted((str(p.relative_to(folder)), p.stat().st_mtime_ns) for p in Path(folder).rglob("*.parquet"))


def test_refresh_index_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), {"parts": 3, "files_per_part": 2})
    add(spark, tmp_path, "first", FIRST)
    assert rows(refresh_index.refresh(*args)) == expected(FIRST)
    assert "4 rows in 1 batches" in caplog.text and "wrote 3 new texts" in caplog.text
    once = listing(tmp_path / "out")
    assert rows(refresh_index.refresh(*args)) == expected(FIRST)
    assert [x for x in listing(tmp_path / "out") if x in once] == once  # nothing was written again
    add(spark, tmp_path, "second", SECOND)
    caplog.clear()
    assert rows(refresh_index.refresh(*args)) == expected(FIRST, SECOND)
    assert "6 rows in 1 batches" in caplog.text and "wrote 3 new texts" in caplog.text
    assert [x for x in listing(tmp_path / "out") if x in once] == once
    texts = spark.read.parquet(str(tmp_path / "out" / "documents"))
    assert texts.count() == texts.select("text_key").distinct().count() == 6


@pytest.mark.parametrize("broken", ["documents", "postings", "after"])
def test_a_batch_that_failed_is_indexed_once(spark, tmp_path, monkeypatch, broken):
    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    add(spark, tmp_path, "first", FIRST)
    refresh_index.refresh(*args)
    add(spark, tmp_path, "second", SECOND)
    made = {"documents": "new_texts", "postings": "postings", "after": "log"}[broken]
    good = getattr(refresh_index, made)

    class Fails:
        def info(self, *a):
            raise RuntimeError("planned")

        def __call__(self, *a):
            raise RuntimeError("planned")

    monkeypatch.setattr(refresh_index, made, Fails())
    with pytest.raises(Exception, match="planned"):
        refresh_index.refresh(*args)
    monkeypatch.setattr(refresh_index, made, good)
    assert rows(refresh_index.refresh(*args)) == expected(FIRST, SECOND)
    assert rows(refresh_index.refresh(*args)) == expected(FIRST, SECOND)


def test_command_lines(site):
    config = site / "own.json"
    config.write_text(json.dumps({"files_per_batch": 1}))
    call = lambda *a: subprocess.run([sys.executable, "-m", *map(str, a)], cwd=ROOT, capture_output=True, text=True, timeout=300)
    done = call("jobs.build_corpus", site / "docs", site / "pages", site / "c")
    assert done.returncode == 0 and "chunks of" in done.stderr and (site / "c" / "chunks" / "_SUCCESS").exists()
    done = call("jobs.refresh_index", site / "docs", site / "i", site / "k", "--config", config)
    assert done.returncode == 0 and "wrote" in done.stderr and list((site / "i" / "postings").rglob("*.parquet"))


def test_terms_are_counted_without_a_shuffle(spark):
    texts = ["b a b, A", None, "", "..", "x" * 5, "c b a " * 50]
    rows = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "text_key string, doc_id long, text string")
    found = refresh_index.postings(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(0, "a", 2, 4), (0, "b", 2, 4), (4, "xxxxx", 1, 1), *((5, t, 50, 150) for t in "abc")]
    assert sorted((r["doc_id"], r["term"], r["tf"], r["doc_len"]) for r in found.collect()) == want


def steps(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_costly_steps_are_planned_once(spark, site):
    """No filter on what a record holds is moved to its source, which would make the record twice, or make all where a join leaves few."""
    docs = spark.read.parquet(str(site / "docs"))
    made = build_corpus.prose(docs)
    made = chunking.lineage(made.withColumn("_parts", chunking.chunk_chars(F.col("text"))), "_parts")
    assert steps(made, "ArrowEvalPython") == 1 and steps(made, "Filter") == 0 and steps(made, "aggregate(split") == 1
    few = spark.createDataFrame([("https://s/egypt/a",)], "url string")
    found = records.market_pages(spark.read.parquet(str(site / "pages")).join(few, "url", "left_semi").select("url", "html"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 3 and plan.count("<noscript") == 1  # plans, repeated blocks, NFKC
    assert "ArrowEvalPython" not in plan[plan.index("LeftSemi") :]
    assert [r["source_file"] for r in found.collect()] == ["https://s/egypt/a"]


def test_tables_in_one_file_are_dealt_out(spark, site, monkeypatch):
    parts = []
    monkeypatch.setattr(build_corpus, "prose", lambda texts, real=build_corpus.prose: parts.append(texts.rdd.getNumPartitions()) or real(texts))
    for name in ("docs", "pages"):
        spark.read.parquet(str(site / name)).coalesce(1).write.parquet(str(site / f"{name}_1"))
    build_corpus.build(spark, str(site / "docs_1"), str(site / "pages_1"), str(site / "out"))
    assert parts[0] == spark.sparkContext.defaultParallelism


def test_keep(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "i int, t string")
    assert [tuple(r) for r in keep(rows, F.col("t") == "a").collect()] == [(1, "a")] and keep(rows, F.col("i") > 1).schema.names == ["i", "t"]
