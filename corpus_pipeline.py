"""From raw documents to packed training sequences: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, language_id, mixing, ngram_join, packing
from tessera.llm.queries import END_ID, VOCABULARY
from tessera.runtime import materialise

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be learned from ``docs``; the others, and those without a letter, go.

    The prediction rejects but leaves no trace: all columns, ``score`` or ``lang_pred`` among them, are the user's own.
    A document without letters is rejected, and one that no mixture of the learned languages explains, however many of
    them that takes. Without a labelled row nothing can be learned, and only texts without a letter go. Repeated rows have
    one fate; null ids and labels are allowed; an empty table stays empty.
    """
    model = language_id.train(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    return language_id.keep(docs, model, typical=language_id.typical_gain(docs, model))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, up to white space: that with the smallest id, null ids last.

    Null and empty texts are one text. Of rows with that id one stays, by content, also if they repeat. Other columns
    may have any name; an empty table stays empty.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of texts that links of five-word shingles with similarity 0.8 connect.

    The smallest id stays, null ids last; different texts of one id are told apart; texts without a word all stay; a row
    that repeats stays once. Other columns may have any name; an empty table stays empty.
    """
    return ngram_join.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, so that sources come to their targets; a cut copy has its first words.

    A null source is a source; texts without words are taken 0 times; n_chars follows a cut text, other columns may have
    any name; repeated rows are taken like others; an empty table stays empty.
    """
    return mixing.copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of several lengths that hold all documents, long ones in pieces; see ``packing.pack``.

    A null or empty text is its end token; repeated rows are packed separately; an empty table gives no sequence.
    """
    return packing.pack(docs, public_tokenizers.path(VOCABULARY), END_ID)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_to_targets", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The language model and the mixture have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
