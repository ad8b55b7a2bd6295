"""Keeps the keyword index of a growing collection up to date, reading only what is new.

    python -m jobs.refresh_index DOCUMENTS OUT CHECKPOINT [--config FILE]

DOCUMENTS is a folder of Parquet files (doc_id, text, lang, source) to which files are added; a single file serves too.
A file stream with a checkpoint takes the files that no earlier run has taken, in batches, and ends. OUT gets
``documents`` (each text that is indexed) and ``postings`` (term, doc_id, tf, doc_len), both partitioned by batch, postings also
by a hash of the term, so that a question reads the parts of its terms only.

A text is indexed once: of equal texts in a batch the row with the smallest id (then language, then source) stands for all,
and texts of earlier batches are left out. Texts are compared by a digest of 64 bits. A batch writes its own partitions
only, and replaces them if it runs again after a failure, compared with earlier batches only; so a text is indexed
exactly once whatever fails when. No later batch starts before an earlier one has ended.

Nulls: a null text is empty, an empty text is indexed without terms; a null id or language stays null.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, run, settings
from tessera.functions import text as T

INPUT = "doc_id long, text string, lang string, source string"
DOCUMENTS = "text_key string, doc_id long, lang string, source string, text string, batch long"
POSTINGS = "term string, doc_id long, tf long, doc_len long, batch long, part int"


def stream_path(path: str) -> str:
    """``path`` as a glob of that one name: a file stream takes a glob for a single file as well as for a folder."""
    path = path.rstrip("/")
    return path if re.search(r"[*?\[{]", path) else f"{path[:-1]}[{path[-1]}]"


def new_texts(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """text_key, doc_id, lang, source, text: one row for each text that ``seen`` (text_key) lacks.

    Equal texts are brought down to one in each task before the shuffle, so a text of very many rows is no hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    first = batch.select(T.content_key(text).alias("text_key"), F.struct("doc_id", "lang", "source", text.alias("text")).alias("row")).groupBy("text_key").agg(F.min("row").alias("row"))
    return first.join(seen, "text_key", "left_anti").select("text_key", "row.*")


def postings(documents: DataFrame) -> DataFrame:
    """text_key, term, doc_id, tf, doc_len of indexed texts; the text's key keeps texts apart whose ids are null or repeat.

    A row holds a whole text, so its terms are counted where it is, without a shuffle: its tokens are sorted, and a term
    counts from the place where it begins to that of the next.
    """
    rows = documents.select("text_key", "doc_id", F.sort_array(T.tokens(F.col("text"))).alias("_t"))
    rows = rows.select("text_key", "doc_id", F.size("_t").cast("long").alias("doc_len"), "_t").where("doc_len > 0")
    begins = F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: (i == 1) | (F.get("_t", i - 1) != F.get("_t", i - 2)))
    rows = rows.withColumn("_b", begins)
    ends = F.concat(F.slice("_b", F.lit(2), F.size("_b")), F.array(F.size("_t") + 1))
    terms = F.zip_with("_b", ends, lambda a, b: F.struct(F.get("_t", a - 1).alias("term"), (b - a).cast("long").alias("tf")))
    return rows.select("text_key", "doc_id", "doc_len", F.inline(terms))


def refresh(spark: SparkSession, documents: str, out: str, checkpoint: str, own: dict | None = None) -> DataFrame:
    """Index what is new in ``documents`` and return all postings, read back; see the module. ``own`` replaces settings."""
    conf = settings("refresh_index", own)
    for name, kind in (("documents", DOCUMENTS), ("postings", POSTINGS)):  # so that there is always something to read
        spark.createDataFrame([], kind).write.mode("append").partitionBy(*(["batch", "part"] if "part" in kind else ["batch"])).parquet(f"{out}/{name}")

    def replace(df: DataFrame, name: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{out}/{name}")

    def take(batch: DataFrame, number: int) -> None:
        # files are listed when a table is opened, so it is opened again once it is written
        known = lambda: batch.sparkSession.read.schema(DOCUMENTS).parquet(f"{out}/documents")
        rows = new_texts(batch, known().where(F.col("batch") < number).select("text_key"))
        replace(rows.withColumn("batch", F.lit(number).cast("long")), "documents", "batch")
        # from what is written, so texts are neither kept in memory nor brought down to one again
        own = known().where(F.col("batch") == number)
        posts = postings(own).withColumns({"batch": F.lit(number).cast("long"), "part": F.pmod(F.hash("term"), F.lit(conf["parts"]))})
        # a part is written by so many tasks, which keeps the number of files down
        posts = posts.repartition(conf["parts"] * conf["files_per_part"], "part", F.pmod(F.hash("text_key"), F.lit(conf["files_per_part"])))
        replace(posts.select("term", "doc_id", "tf", "doc_len", "batch", "part"), "postings", "batch", "part")
        log.info("batch %d: wrote %d new texts below %s", number, own.count(), out)

    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", conf["files_per_batch"]).parquet(stream_path(documents))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    log.info("read %s: %d rows in %d batches", documents, sum(p["numInputRows"] for p in done), len(done))
    return read(spark, out)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The postings of all texts as they stand below ``out``."""
    return spark.read.schema(POSTINGS).parquet(f"{out}/postings").select("term", "doc_id", "tf", "doc_len")


if __name__ == "__main__":
    run("refresh_index", __doc__, ["documents", "out", "checkpoint"], refresh)
