"""Readers and writers: JSON lines, curated folders, file scans, vector stores, and injectable remote sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.records import DOCUMENT

CHUNK = DOCUMENT + ", tokens int, chunk_index int, chunk_count int, parent_id string"
VECTORS = "ord long, id string, text_key string, embedding array<float>"
CURATED_SUFFIXES = ("md", "markdown", "txt")


def read_jsonl(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """One JSON object per line. The schema is stated, since inference makes a column of nulls a string."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_curated(spark: SparkSession, folder: str) -> DataFrame:
    """rel_path, raw of text files at any depth; a missing folder has none."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "rel_path string, raw string")
    found = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("_p"), F.col("value").alias("raw"))
    base = folder.rstrip("/").split("://")[-1]
    decoded = F.url_decode(F.replace(F.col("_p"), F.lit("+"), F.lit("%2B")))
    rel = F.substring_index(decoded, base + "/", -1)
    return found.select(rel.alias("rel_path"), "raw").where(F.lower("rel_path").rlike(rf"\.({'|'.join(CURATED_SUFFIXES)})$")).orderBy("rel_path")


def read_binary(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, content of files by name, ordered."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content").orderBy("path")


def extract_pdf_lines(files: DataFrame) -> DataFrame:
    """file, page, line_no, raw of PDF files; needs the optional package pypdf on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = [
                    (path.rsplit("/", 1)[-1], page, n, raw)
                    for page, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1)
                    for n, raw in enumerate((p.extract_text() or "").split("\n"))
                ]
                yield pd.DataFrame(rows, columns=["file", "page", "line_no", "raw"])

    return files.mapInPandas(run, "file string, page int, line_no int, raw string")


def fetch(urls: DataFrame, get: Callable[[str], str]) -> DataFrame:
    """url -> url, html, error: a failing URL is a row with its error, not a failed job. ``get`` does the retries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, get(url), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string")


def fetch_report(pages: DataFrame, records: DataFrame) -> DataFrame:
    """url -> state: error, empty (no record came of it) or ok."""
    made = records.select(F.col("source_file").alias("url")).distinct().withColumn("_ok", F.lit(True))
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("_ok"), "ok").otherwise("empty")
    return pages.join(made, "url", "left").select("url", state.alias("state"))


def read_listing(spark: SparkSession, kinds: list[str], get_page: Callable[[str, int], list[dict] | None]) -> DataFrame:
    """A paginated listing, one task per content type: link, modified, title, content, wp_type.

    ``get_page(kind, page)`` returns rows, or nothing after the last page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind in batch["kind"]:
                page = 1
                while rows := get_page(kind, page):
                    yield pd.DataFrame([{"link": r["link"], "modified": r.get("modified", ""), "title": r.get("title", ""), "content": r.get("content", ""), "wp_type": kind} for r in rows])
                    page += 1

    df = spark.createDataFrame([(k,) for k in kinds], "kind string").repartition(max(1, len(kinds)), "kind")
    return df.mapInPandas(run, "link string, modified string, title string, content string, wp_type string")


def embed(rows: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], batch: int = 128) -> DataFrame:
    """(text_key, text) -> text_key, embedding, in batches of ``batch`` texts; each distinct text is asked for once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({"text_key": part["text_key"], "embedding": embed_fn(part["text"].tolist())})

    return rows.select("text_key", "text").dropDuplicates(["text_key"]).mapInPandas(run, "text_key string, embedding array<float>")


def write_vectors(df: DataFrame, path: str) -> None:
    df.select("ord", "id", "text_key", "embedding").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)


def text_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("text_key", T.content_key(F.col(text_col)))
