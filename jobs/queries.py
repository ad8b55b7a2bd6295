"""The jobs as registered queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import build_corpus, refresh_index
from tessera import catalog
from tessera.runtime import new_folder

#: The tables' own sites.
SITE = {"home": "EN", "countries": catalog.COUNTRY_PARTS}


def job1_build_corpus(spark: SparkSession, d: str) -> DataFrame:
    out = new_folder(spark, "job1")
    for _ in range(2):
        found = build_corpus.build(spark, f"{d}/documents.parquet", f"{d}/pages.parquet", out, SITE)
    return found


def job2_refresh_index(spark: SparkSession, d: str) -> DataFrame:
    out = new_folder(spark, "job2")
    for _ in range(2):
        found = refresh_index.refresh(spark, f"{d}/documents.parquet", f"{out}/index", f"{out}/checkpoint")
    return found


QUERIES = {"job1_build_corpus": job1_build_corpus, "job2_refresh_index": job2_refresh_index}

RECORDS = f"""x AS (
        SELECT coalesce(source, 'unknown') || '/' || doc_id AS source_file, coalesce(source, 'unknown') AS doc_title, 'prose' AS type, NULL AS country, NULL::BOOLEAN AS competitive, NULL::BOOLEAN AS pricing_not_local,
            {catalog.NORMAL("coalesce(text, '')")} AS text FROM documents
    ), b AS (
        SELECT page_id, {catalog.BODY} AS lines FROM pages
    ), w AS (
        SELECT page_id, list_filter(lines, lambda x, i: i = 1 OR lines[i - 1] <> x) AS l, 1::BIGINT AS i FROM b
        UNION ALL SELECT page_id, CASE WHEN size IS NULL THEN l ELSE list_concat(l[1:i + size - 1], l[i + 2 * size:]) END, i + 1
        FROM (SELECT *, list_max(list_filter(range(2, 13), lambda n: i + 2 * n - 1 <= len(l) AND l[i:i + n - 1] = l[i + n:i + 2 * n - 1])) AS size FROM w WHERE i <= len(l))
    ), m AS (
        SELECT url, {catalog.TITLE} AS title, array_to_string(l, chr(10)) AS body, {catalog.CASES} AS country FROM pages JOIN w USING (page_id) WHERE i = len(l) + 1
    ), p AS (
        SELECT url AS source_file, title AS doc_title, 'marketing' AS type, country, contains(url, '/switchers') AS competitive, {catalog.NORMAL("title || chr(10) || chr(10) || body")} AS text FROM m WHERE length(body) >= 200
    ), r AS (
        SELECT *, text AS whole, substr(sha256(text), 1, 16) AS parent_id FROM x WHERE text <> ''
        UNION ALL BY NAME
        SELECT *, text AS whole, country <> 'EN' AND regexp_matches(text, '\\b\\d{{2,5}}\\s*(?:تدفع|/\\s*شهر|شهري|سنوي)') AND NOT regexp_matches(text, '(جنيه|درهم|دينار|ريال عماني|\\$|USD|EGP|AED|KWD|OMR)') AS pricing_not_local, substr(sha256(source_file), 1, 16) AS parent_id FROM p
    )"""

ORACLE_SQL = {
    "job1_build_corpus": f"""WITH RECURSIVE {RECORDS}, {catalog.chunk_sql("r", "source_file, doc_title, type, country, competitive, pricing_not_local, parent_id, whole", "k")},
        n AS (SELECT *, count(*) OVER (PARTITION BY source_file) AS chunk_count FROM k)
        SELECT substr(sha256(parent_id || ':' || part), 1, 16) AS id, parent_id, part::INT AS chunk_index, chunk_count::INT AS chunk_count, source_file, doc_title,
            CASE WHEN {catalog.RATIO.replace("text", "whole")} > 0.6 THEN 'ar' WHEN type = 'prose' AND {catalog.RATIO.replace("text", "whole")} < 0.2 THEN 'en' ELSE 'mixed' END AS lang,
            'internal' AS audience, CASE WHEN type = 'prose' AND NOT regexp_matches(whole, '[{catalog.T.ARABIC}]') THEN 'n/a' ELSE 'high' END AS confidence,
            competitive, pricing_not_local, length(text)::INT AS chars, text, type, country FROM n""",
    "job2_refresh_index": f"""WITH d AS (SELECT min(doc_id) AS doc_id, coalesce(text, '') AS text FROM documents GROUP BY 2),
        w AS (SELECT doc_id, regexp_extract_all(lower(text), '{catalog.TOKEN}') AS w FROM d)
        SELECT term, doc_id, count(*) AS tf, any_value(doc_len) AS doc_len FROM (SELECT doc_id, len(w) AS doc_len, unnest(w) AS term FROM w) GROUP BY ALL""",
}
