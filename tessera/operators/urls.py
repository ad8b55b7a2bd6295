"""URL lists: filters, canonical forms, keep-first deduplication, and link crawling as a series of joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import markup
from tessera.runtime import materialise

# Paths that are no content, and the country of a path.
SKIP = r"/(testing|tesr|private|test-typography|profile)/?|/legal/test"
COUNTRIES = {"/egypt": "EG", "/uae": "AE", "/kuwait": "KW", "/oman": "OM", "terms-conditions-kw": "KW"}


def wanted(url: Column, include: str = "/ar", skip: str = SKIP) -> Column:
    return F.contains(url, F.lit(include)) & ~url.rlike(skip)


def only(url: Column, pieces: str) -> Column:
    """Any of the comma-separated substrings; all URLs if there is none."""
    found = [p.strip() for p in pieces.split(",") if p.strip()]
    out = F.lit(not found)
    for p in found:
        out = out | F.contains(url, F.lit(p))
    return out


def key(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def canonical(url: Column) -> Column:
    return F.concat(key(url), F.lit("/"))


def country(url: Column, by_fragment: Mapping[str, str] = COUNTRIES, default: str = "SA") -> Column:
    """The country of the first fragment, in the mapping's order, that the URL contains."""
    out = F.lit(default)
    for fragment, code in reversed(list(by_fragment.items())):
        out = F.when(F.contains(url, F.lit(fragment)), F.lit(code)).otherwise(out)
    return out


def keep_first(df: DataFrame, by: Column, order: Column) -> DataFrame:
    """Of rows with one key, the first by ``order``."""
    w = Window.partitionBy("_key").orderBy(order)
    return df.withColumn("_key", by).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key")


def add_missing(urls: DataFrame, extra: DataFrame) -> DataFrame:
    """``extra`` URLs whose key is not in ``urls`` join these."""
    known = urls.select(key(F.col("url")).alias("_k")).distinct()
    new = extra.join(known, key(extra["url"]) == F.col("_k"), "left_anti")
    return urls.select("url").unionByName(new.select("url"))


def crawl(pages: DataFrame, start: Sequence[str], site: str = "", prefix: str = "/", depth: int = 2) -> DataFrame:
    """URLs reachable by at most ``depth`` hops from ``start``: url, hop.

    pages: url, html. A URL that has no page is found, but leads nowhere.
    """
    spark = pages.sparkSession
    out = pages.select("url", F.explode(markup.links(F.col("html"), prefix)).alias("path")).select("url", F.concat(F.lit(site), "path").alias("to")).distinct()
    frontier = found = spark.createDataFrame([(u, 0) for u in start], "url string, hop int")
    for hop in range(1, depth + 1):
        reached = frontier.select("url").join(out, "url").select(F.col("to").alias("url")).distinct().join(found, "url", "left_anti")
        frontier = materialise(reached.withColumn("hop", F.lit(hop)), "crawl")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def page_urls(sitemap: DataFrame, crawled: Callable[[], DataFrame], include: str = "/ar", skip: str = SKIP) -> tuple[DataFrame, str]:
    """Canonical URLs (url) and where they come from: the sitemap (xml), or link crawling if it has no wanted URL."""
    listed = sitemap.select(F.posexplode(markup.sitemap_urls(F.col("xml"))).alias("position", "url")).where(wanted(F.col("url"), include, skip))
    source = "sitemap"
    if listed.isEmpty():
        listed, source = crawled().select("url").where(~F.col("url").rlike(skip)).withColumn("position", F.col("url")), "link crawl"
    return keep_first(listed, key(F.col("url")), F.col("position")).orderBy("position").select(canonical(F.col("url")).alias("url")), source
