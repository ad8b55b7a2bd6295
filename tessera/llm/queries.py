"""The registered queries of the data-preparation operators: production parameters, whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import collocations, exact_dedup, fingerprints, language_id, mixing, neighbours, ngram_join, packing, token_counts, token_records, url_filter, warc
from tessera.runtime import materialise, spread

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_ID)


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"))
    records = materialise(warc.read(manifest, with_block=False), "warc-records")
    rows = warc.resolve(warc.assemble(records))
    return rows.withColumnRenamed("row_id", "page_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = token_records.write(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_ID)
    records = token_records.with_starts(token_records.read(index))
    return records.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents")).drop("class_docs")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents")).withColumn("proportions", F.to_json("proportions"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_records": op5_token_records,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_order_minhash": op7_order_minhash,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_nearest_neighbours": op12_nearest_neighbours,
}

ORACLE_SQL = {
    "op6_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY ALL
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
        ), e AS (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r(v, reached) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.reached FROM r JOIN e ON e.a = r.v
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM (SELECT v AS doc_id, min(reached) AS component_id FROM r GROUP BY ALL) LEFT JOIN n USING (doc_id)
    """,
    "op2_warc_transactions": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), g AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first < page_id THEN first END AS refers_to, 1::BIGINT AS n_requests, 1::BIGINT AS n_metadata, true AS digest_ok FROM g
    """,
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        ), w AS (
            SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
    """,
    "op11_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
        ), g AS (
            SELECT lang, 1 AS d, unnest(w) AS phrase FROM w
            UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w
            UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w
        ), f AS (
            SELECT lang, d, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10
        ), t AS (
            SELECT lang, count(*) AS n FROM g WHERE d = 1 GROUP BY ALL
        ), s AS (
            SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, d)) AS k FROM f WHERE d > 1
        ), c AS (
            SELECT s.lang, s.phrase, s.a, s.k, x.f AS l, y.f AS r, (1000000::HUGEINT * s.a * s.a) // (x.f::HUGEINT * y.f) AS score
            FROM s JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[1:s.k], ' ') JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[s.k + 1:], ' ')
        ), b AS (
            SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inside AS (
            SELECT lang, q AS phrase, max(f) AS longer FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS q FROM f WHERE d = 3) GROUP BY ALL
        ), o AS (
            SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
        )
        SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN t USING (lang) WHERE rank <= 2000
    """,
    "op12_nearest_neighbours": """
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), p AS (
            SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.e, c.e)) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e) GROUP BY ALL
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
}
