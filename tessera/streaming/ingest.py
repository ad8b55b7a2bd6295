"""Incremental ingestion: new JSON lines are keyed by content, and only unseen texts are kept (not in the original scope)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import text as T
from tessera.operators.records import DOCUMENT
from tessera.sources.files import exists


def upsert(batch: DataFrame, path: str) -> int:
    """Append the rows whose text no row at ``path`` has; returns how many."""
    from pyspark.sql import functions as F

    spark = batch.sparkSession
    rows = batch.withColumn("text_key", T.content_key(F.col("text"))).dropDuplicates(["text_key"])
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select("text_key"), "text_key", "left_anti")
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n


def follow(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    """Run through the JSON lines in ``folder`` that were not seen before, then stop."""
    stream = spark.readStream.schema(DOCUMENT).json(folder)
    return stream.writeStream.foreachBatch(lambda df, _: upsert(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
