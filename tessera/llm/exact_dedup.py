"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a Parquet table bucketed and sorted by digest, one row for each distinct text seen so far. A batch of new
texts is reduced to one row for each digest first, so that a text with a third of all rows costs one row per task.
A sort-merge anti-join with the index in its buckets leaves the digests that it lacks, and these are appended.

Defined results: a null text counts as empty; texts are equal when equal after each run of white space
(``[\\x20\\x09-\\x0D]+``) became one space; of equal texts in one batch the smallest id stays, a null id ranking last;
rows with the same id and text are one group and all carry ``kept`` true; an empty batch leaves the index as it is.
Columns of the input other than id and text are not read, so they may have any name.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import free_name, lookup, materialise, new_folder, pick, row_key


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


#: Digests that one bucket should hold: about 128 MB of them.
BUCKET_ROWS = 3_000_000
#: Files of one bucket after which the index is merged.
MOST_FILES = 8


class DigestIndex:
    """Digests of all texts seen, with the id that stays, in buckets sorted by digest.

    The bucket number never falls below the session's shuffle partitions when an index is made, and grows with the
    ``rows`` that are expected; the anti-join runs with as many partitions as there are buckets, so the index is read
    in place whatever the session asks for later: it is never shuffled. ``location`` may hold an earlier index, which is
    then continued with its own number of buckets. Each batch adds one file to a bucket; ``merge``, which ``add`` calls
    after MOST_FILES batches, makes them one again, so a bucket is read in its order without sorting.

    The index is a row of versions, folders under ``location``; a version counts once its table CURRENT, written last,
    names it. One ``add`` works at a time: a lock file that only one can create stands for that. After a driver's death
    the file must be taken away by hand (``unlock``).
    """

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int | None = None, rows: int = 0):
        self.spark = spark
        self.location = location or new_folder(spark, "digest-index")
        self.table = None
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.location, *parts)))
        self._fs = self._path().getFileSystem(conf)
        current = self._current()
        if current is None:
            least = int(spark.conf.get("spark.sql.shuffle.partitions"))
            self.version, self.buckets, self.files = 0, max(buckets or least, -(-rows // BUCKET_ROWS)), 0
        else:
            self.version, self.buckets, self.files = current
        self._open()

    def _current(self) -> tuple[int, int, int] | None:
        if not self._fs.exists(self._path("CURRENT")):
            return None
        # one small row per change; the last one counts
        row = self.spark.read.schema("at long, version int, buckets int, files int").parquet(f"{self.location}/CURRENT").orderBy(F.desc("at")).first()
        return None if row is None else (row["version"], row["buckets"], row["files"])

    def _commit(self) -> None:
        at = 0 if not self._fs.exists(self._path("CURRENT")) else self.spark.read.parquet(f"{self.location}/CURRENT").agg(F.max("at")).first()[0] + 1
        row = self.spark.range(1).select(F.lit(at).cast("long").alias("at"), *[F.lit(v).cast("int").alias(c) for c, v in (("version", self.version), ("buckets", self.buckets), ("files", self.files))])
        row.write.mode("append").parquet(f"{self.location}/CURRENT")

    def _open(self) -> None:
        self.close()
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.location}/v{self.version}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Take the table's name out of the catalog; its files stay."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            self.table = None

    @contextmanager
    def locked(self):
        lock = self._path("LOCK")
        try:
            self._fs.create(lock, False).close()
        except Exception as e:
            raise RuntimeError(f"{lock.toString()} exists: another add is at work, or died; unlock() if it did") from e
        try:
            yield
        finally:
            self._fs.delete(lock, False)

    def unlock(self) -> None:
        self._fs.delete(self._path("LOCK"), False)

    @contextmanager
    def in_place(self):
        """Joins planned and run in here take the index's buckets as their partitions, and their order where they have one."""
        conf, want = self.spark.conf, {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
        # the anti-join must not move below the batch's aggregation: a hot digest would be shuffled row by row
        kept = [r for r in (conf.get("spark.sql.optimizer.excludedRules", None) or "").split(",") if r]
        want["spark.sql.optimizer.excludedRules"] = ",".join([*kept, "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin"])
        if self.files <= 1:
            want["spark.sql.legacy.bucketedTableScan.outputOrdering"] = "true"
        before = {k: conf.get(k, None) for k in want}
        for k, v in want.items():
            conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def missing(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (digest, keep_id; each digest once) that the index lacks, by sort-merge anti-join."""
        return batch.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def _write(self, rows: DataFrame, table: str, location: str) -> None:
        """Append rows, dealt by digest into as many parts as there are buckets, to a bucketed table: one file per bucket."""
        (
            rows.write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .format("parquet")
            .option("path", location)
            .saveAsTable(table)
        )

    def add(self, members: DataFrame) -> None:
        """Append the digests of ``members`` (id, digest) that are new, each with its smallest id. Adding again changes nothing."""
        batch = members.groupBy("digest").agg(F.min("id").alias("keep_id"))
        with self.locked(), self.in_place():
            # a table can't be read and appended to in one step; the new digests are staged
            fresh = materialise(self.missing(batch), "digest-fresh")
            if fresh.isEmpty():
                return
            self._write(fresh.repartition(self.buckets, "digest"), self.table, f"{self.location}/v{self.version}")
            self.files += 1
            self._commit()
            self.spark.catalog.refreshTable(self.table)
            if self.files > MOST_FILES:
                self._merge()

    def _merge(self) -> None:
        # the scan is dealt by bucket already, so the rows of a bucket are only sorted, not shuffled
        old, next_ = self.read(), f"digest_index_{uuid.uuid4().hex}"
        self._write(old.select("digest", "keep_id"), next_, f"{self.location}/v{self.version + 1}")
        self.spark.sql(f"DROP TABLE {next_}")
        self.version, self.files = self.version + 1, 1
        self._commit()
        self._open()

    def merge(self) -> None:
        """Make the files of each bucket one, in a new version. The old version's files stay for readers that still use them."""
        with self.locked(), self.in_place():
            if self.files > 1:
                self._merge()


def _groups(members: DataFrame, index: DigestIndex | None, batches: int) -> DataFrame:
    """digest, group_size, keep_id of the texts of ``members`` (id, digest), which are added to the index."""
    given, index = index, index or DigestIndex(members.sparkSession, rows=members.count())
    cuts = sorted(set(members.approxQuantile("id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    rank = F.coalesce(sum((F.col("id") > F.lit(int(c))).cast("int") for c in cuts), F.lit(len(cuts))) if cuts else F.lit(0)
    for i in range(len(cuts) + 1):
        index.add(members.where(rank == i))
    sizes = members.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    with index.in_place():
        groups = materialise(sizes.join(index.read().hint("merge"), "digest"), "digest-groups")
    if given is None:
        index.close()
    return groups


def dedup(df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are fed to the index in ``batches`` of ascending id ranges, as new data would arrive. With a new index,
    keep_id is the smallest id of all equal texts; with one that held the text before, it is the id stored there, and
    no row of this call is kept for that text unless it is that very id.
    """
    members = materialise(df.select(F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest")), "digests")
    out = lookup(members, _groups(members, index, batches), "digest", "group_size", members.count())
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """The rows of ``df`` whose text is the first of its kind; of rows equal in id and text one stays.

    That one is the row with the smallest content key. Only digests and content keys of the rows that stay meet the
    texts again, so a second reading of ``df`` may be split in any way. Other columns may have any name.
    """
    names = [free_name(df.columns, n) for n in ("k1", "k2")]
    k1, k2 = row_key(df)
    members = df.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).cast("long").alias("id"), digest(F.col(text_col)).alias("digest"))
    members = materialise(members, "digests")
    total = members.count()
    found = lookup(members, _groups(members, index, batches), "digest", "group_size", total)
    own = found.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    stay = own.groupBy("digest").agg(F.min(F.struct("k1", "k2", "n")).alias("k"))
    times = free_name(df.columns, "times")
    plan = materialise(stay.select(F.col("k.k1").alias(names[0]), F.col("k.k2").alias(names[1]), F.col("k.n").alias(times)), "dedup-plan")
    rows = df.withColumn(names[0], k1).withColumn(names[1], k2)
    return pick(rows, plan, names, times, total).select(*[F.col(f"`{c}`") for c in df.columns])
