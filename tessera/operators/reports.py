"""Reports of a build as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def source_report(sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """source -> documents, chunks, empty; sources without rows are listed too. Keys are in ``source``."""
    count = lambda df, name: df.groupBy("source").agg(F.count(F.lit(1)).alias(name))
    out = sources.select("source").join(count(documents, "documents"), "source", "left").join(count(chunks, "chunks"), "source", "left")
    out = out.select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "chunks")])
    return out.withColumn("empty", F.col("chunks") == 0)


def size_report(sizes: DataFrame, most: int = 700) -> DataFrame:
    """(tokens) -> chunks, total, median, p90, largest, above: order statistics at floor(n / 2) and floor(0.9 n).

    Sizes are counted first, so one row for each distinct size is ordered, not one for each chunk.
    """
    from pyspark.sql.window import Window

    counts = sizes.groupBy("tokens").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.orderBy("tokens").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_end", F.sum("c").over(upto)).withColumn("_n", F.sum("c").over(Window.partitionBy()))
    at = lambda i: F.min(F.when(F.col("_end") > i, F.col("tokens")))
    return ranked.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"),
        F.sum(F.col("tokens") * F.col("c")).alias("total"),
        at(F.floor(F.col("_n") / 2)).alias("median"),
        at(F.floor(F.col("_n") * F.lit(0.9))).alias("p90"),
        F.max("tokens").alias("largest"),
        F.coalesce(F.sum(F.when(F.col("tokens") > most, F.col("c")).otherwise(0)), F.lit(0)).alias("above"),
    )


def quality_report(records: DataFrame) -> DataFrame:
    """chunks, tables, chars, estimated tokens, records of low confidence and their share of those judged low or high."""
    low = F.count_if(F.col("confidence") == "low")
    return records.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("type") == "table").alias("tables"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.floor(F.coalesce(F.sum("chars"), F.lit(0)) / 3).alias("estimated_tokens"),
        low.alias("low"),
        F.round(low / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("low_share"),
    )


def country_report(records: DataFrame) -> DataFrame:
    return records.groupBy("country").agg(F.count(F.lit(1)).alias("pages"), F.count_if("competitive").alias("competitive"), F.count_if("pricing_not_local").alias("not_local"))


def status(corpus: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """ready, chunks: what a service reports."""
    return corpus.agg(F.count(F.lit(1)).alias("chunks")).select(F.lit(vectors is not None and not vectors.isEmpty()).alias("ready"), "chunks")


def kind_report(records: DataFrame) -> DataFrame:
    """Articles per content type."""
    return records.groupBy("wp_type").agg(F.count(F.lit(1)).alias("items"))


def low_confidence(records: DataFrame, samples: int = 3, most_chars: int = 100) -> DataFrame:
    """For each document the first few records of low confidence, cut for display."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("source_file").orderBy("page", "id")
    low = records.where("confidence = 'low'").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= samples)
    return low.select("source_file", "page", F.substring("text", 1, most_chars).alias("text"))
