"""Whole plans: building a corpus from sources, and answering questions over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answer, chunking, index, records
from tessera.sources import files


def build_corpus(*sources: DataFrame, counter: chunking.Counter | None = None) -> DataFrame:
    """Documents of all sources, in their order, as chunks with ``ord``."""
    from tessera.runtime import running_total

    made = chunking.chunks(records.union(*sources), counter)
    order = [F.col("source_ord"), F.col("source_file"), F.col("page").asc_nulls_first(), F.col("parent_id"), F.col("chunk_index")]
    return running_total(made, order, F.lit(1), "ord", "corpus")


def ask(corpus: DataFrame, questions: DataFrame, answer_fn: Callable[[str], str], vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 6, audience: str = "internal", country: str | None = None, embed_fn: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """questions: query_id, question -> query_id, answer, answered, grounded, citations. Without vectors, keywords alone rank.

    The questions' vectors come as ``query_vectors`` (query_id, embedding), or from ``embed_fn``, each distinct question once.
    A blank question isn't asked: it gets the refusal. A corpus without a chunk is an error, as nothing was built yet.
    """
    if corpus.isEmpty():
        raise ValueError("the corpus is empty: build it before questions are asked")
    asked = questions.where(T.strip(F.coalesce("question", F.lit(""))) != "")
    if vectors is not None and query_vectors is None and embed_fn is not None:
        keyed = files.text_key(asked.withColumnRenamed("question", "text"))
        query_vectors = keyed.select("query_id", "text_key").join(files.embed(keyed, embed_fn), "text_key").select("query_id", "embedding")
    if vectors is None or query_vectors is None:
        found = index.keyword_search(corpus, asked, k, audience, country)
    else:
        found = index.search(corpus, vectors, asked, query_vectors, k, audience, country)
    rows = found.join(corpus, "ord")
    prompts = answer.format_passages(rows).join(questions, "query_id")
    prompts = prompts.select("query_id", F.concat("prompt", F.lit("\n\n---\n\nQuestion: "), "question").alias("prompt"))
    shown = rows.select("query_id", "n", F.col("doc_title").alias("title"), F.col("source_file").alias("url"))
    return answer.answers(questions, answer.generate(prompts, answer_fn), shown)
