"""Passages for a prompt, and reading a reply's marker and citations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

NO_ANSWER = "[[NO_ANSWER]]"
MARKER = r"[\p{IsWhite_Space}\x1C-\x1F]*\[\[(?:ANSWERED|NO_ANSWER)\]\][\p{IsWhite_Space}\x1C-\x1F]*$"
# a fixed value: what is said where nothing was found
REFUSAL = "لا توجد لدي معلومات كافية للإجابة على هذا السؤال."
#: What a passage's tags say; name your products here if readers should see them.
TAGS = {
    "pricing_not_local": "pricing_not_local: this figure is the home market's price",
    "competitive": "competitive: compares with a named competitor",
    "curated": "CURATED: maintained by hand; authoritative if it conflicts with a crawled page",
}


def passages(found: DataFrame, corpus: DataFrame, most_chars: int = 600) -> DataFrame:
    """(query_id, n, ord, score) -> query_id, n, title, url, country, score, text for display."""
    return found.join(corpus, "ord").select(
        "query_id", "n", F.col("doc_title").alias("title"), F.col("source_file").alias("url"), "country", F.round("score", 4).alias("score"), F.substring("text", 1, most_chars).alias("text")
    )


def format_passages(rows: DataFrame, tags: dict[str, str] = TAGS) -> DataFrame:
    """(query_id, n, text, doc_title, source_file, country and flags) -> query_id, prompt: numbered blocks with tags."""
    source = F.concat(F.lit("source: "), F.coalesce(F.nullif(F.col("doc_title"), F.lit("")), F.col("source_file")))
    country = F.when(F.coalesce(F.col("country"), F.lit("")) != "", F.concat(F.lit("country: "), F.col("country")))
    flags = [F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(t)) for c, t in tags.items() if c in rows.columns]
    block = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), F.concat_ws("; ", source, country, *flags), F.lit(")\n"), F.col("text"))
    # k passages belong to a question, so a group is small
    grouped = rows.withColumn("_b", block).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "_b"))).alias("_a"))
    return grouped.select("query_id", F.array_join(F.transform("_a", lambda s: s["_b"]), "\n\n").alias("prompt"))


def parse_reply(reply: Column) -> Column:
    """struct(answer, answered): the marker at the end goes; a refusal marker anywhere means not answered."""
    return F.struct(T.strip(F.regexp_replace(reply, MARKER, "")).alias("answer"), (~F.contains(reply, F.lit(NO_ANSWER))).alias("answered"))


def cited(answer: Column, passages_: Column) -> Column:
    """Distinct numbers [n] from 1 to ``passages_``, ascending."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\p{Nd}+)\]"), 1), lambda s: s.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: n.isNotNull() & (n >= 1) & (n <= passages_))))


def answers(questions: DataFrame, replies: DataFrame, shown: DataFrame) -> DataFrame:
    """questions: query_id; replies: query_id, reply; shown: query_id, n, title, url.

    query_id, answer, answered, grounded, citations. A question without passages gets the refusal.
    """
    per = shown.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("_n"), F.map_from_entries(F.collect_list(F.struct(F.col("n").cast("int"), F.struct("title", "url")))).alias("_p"))
    rows = questions.select("query_id").join(per, "query_id", "left").join(replies, "query_id", "left").withColumn("_r", parse_reply(F.coalesce("reply", F.lit(""))))
    rows = rows.withColumn("_c", cited(F.col("_r.answer"), F.col("_n")))
    none = F.col("_n").isNull()
    listed = F.transform("_c", lambda n: F.struct(n.alias("n"), F.get(F.array(F.col("_p").getItem(n)), 0)["title"].alias("title"), F.col("_p").getItem(n)["url"].alias("url")))
    return rows.select(
        "query_id",
        F.when(none, F.lit(REFUSAL)).otherwise(F.col("_r.answer")).alias("answer"),
        F.when(none, F.lit(False)).otherwise(F.col("_r.answered")).alias("answered"),
        F.when(none, F.lit(True)).otherwise((F.size("_c") > 0) | ~F.col("_r.answered")).alias("grounded"),
        F.when(none, F.array().cast("array<struct<n:int,title:string,url:string>>")).otherwise(listed).alias("citations"),
    )


def generate(prompts: DataFrame, answer_fn: Callable[[str], str]) -> DataFrame:
    """(query_id, prompt) -> query_id, reply by a function of the prompt, such as a client of a model."""

    @F.pandas_udf("string")
    def ask(p: pd.Series) -> pd.Series:
        return p.map(answer_fn)

    return prompts.select("query_id", ask(F.col("prompt")).alias("reply"))
