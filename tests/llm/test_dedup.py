import glob
import hashlib
import re

import duckdb
import pytest
from helpers import frame

from tessera.llm import exact_dedup, queries

D = "/root/testdata/sf0.001"
ROWS = [(5, "a  b"), (2, "a\tb"), (9, None), (3, ""), (7, "a b "), (2, "a b"), (None, "a b"), (4, " x"), (1, "x")]


def restated(rows):
    digest = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t in rows]
    out = []
    for (i, _), d in zip(rows, digest, strict=True):
        ids = [j for (j, _), e in zip(rows, digest, strict=True) if e == d]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, d))
    return sorted(out, key=repr)


def test_cases(spark):
    got = exact_dedup.dedup(frame(spark, ROWS))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == restated(ROWS)


def test_empty(spark):
    assert exact_dedup.dedup(frame(spark, [])).count() == 0


def test_extra_columns_and_long_texts(spark):
    long = "word " * 300_000
    df = spark.createDataFrame([(1, long, "x", 1), (2, long + " ", "y", 2)], "doc_id long, text string, digest string, keep_id int")
    assert {r["keep_id"] for r in exact_dedup.dedup(df).collect()} == {1}
    assert exact_dedup.drop_copies(df).collect()[0]["digest"] == "x"


def test_hot_group(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same' ELSE concat('t', id) END AS text")
    got = exact_dedup.dedup(df).where("text_sha256 = sha2('same', 256)").agg({"keep_id": "max", "group_size": "min", "doc_id": "count"}).first()
    assert got["max(keep_id)"] == 0 and got["min(group_size)"] == 2000 and got["count(doc_id)"] == 2000


def test_index_persists_and_grows(spark, tmp_path):
    place = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, place, 4)
    exact_dedup.dedup(frame(spark, [(10, "a"), (11, "b")]), first)
    again = exact_dedup.DigestIndex(spark, place, 4)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.dedup(frame(spark, [(1, "a"), (2, "c")]), again).collect()}
    assert got == {1: (10, False), 2: (2, True)}
    assert again.read().count() == 3
    assert again.buckets == 4 and glob.glob(f"{tmp_path}/index/v0/*_0000*.parquet")


@pytest.mark.parametrize("partitions", ["8", "200", "400"])
def test_index_is_never_shuffled(spark, partitions):
    index = exact_dedup.DigestIndex(spark, buckets=16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    batch = lambda a: spark.range(a, a + 3000).selectExpr("id", "unhex(sha2(cast(id AS string), 256)) AS digest")
    try:
        index.add(batch(0))
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        with index.in_place():
            new = batch(2000).groupBy("digest").agg({"id": "min"}).withColumnRenamed("min(id)", "keep_id")
            found = index.missing(new)
            assert found.count() == 2000
            plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "LeftAnti" in plan
        # a hot digest is reduced before it is shuffled
        assert plan.index("LeftAnti") < plan.index("partial_min")
        below = plan[plan.index("LeftAnti") :].split("\n")
        own = next(i for i, line in enumerate(below) if "FileScan" in line and "keep_id" not in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above, d = [], depth(below[own])
        for line in reversed(below[1:own]):
            if depth(line) < d:
                above.append(line)
                d = depth(line)
        assert above and not any("Exchange" in line for line in above), plan
        assert not any(line.lstrip(" :+-*(0123456789)").startswith("Sort ") for line in above), plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        index.close()


def test_adding_again_and_merging_change_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_FILES", 2)
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    rows = lambda a, b: spark.range(a, b).selectExpr("id", "unhex(sha2(cast(id AS string), 256)) AS digest")
    for a in (0, 50, 100, 150):
        for _ in range(2):
            index.add(rows(a, a + 80))
    assert index.version >= 1 and index.files <= 2
    index.merge()
    want = sorted(tuple(r) for r in rows(0, 230).select("digest", "id").collect())
    assert sorted(tuple(r) for r in index.read().collect()) == want
    assert len(glob.glob(f"{tmp_path}/index/v{index.version}/part*.parquet")) == 4
    other = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index")
    assert (other.version, other.buckets, other.files) == (index.version, 4, 1) and sorted(tuple(r) for r in other.read().collect()) == want
    with index.locked(), pytest.raises(RuntimeError):
        other.add(rows(0, 1))
    other.add(rows(500, 501))
    assert other.read().count() == 231


def test_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    want = sorted(duck.sql(queries.ORACLE_SQL["op3_exact_dedup"]).fetchall())
    assert sorted(tuple(r) for r in queries.op3_exact_dedup(spark, D).collect()) == want


@pytest.mark.parametrize("batches", [1, 3])
def test_batches_do_not_matter(spark, batches):
    got = exact_dedup.dedup(frame(spark, ROWS), batches=batches)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == restated(ROWS)
