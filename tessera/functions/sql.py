"""Functions for users who write SQL: tokens, headings and chunks, as temporary SQL functions of a session.

They are SQL themselves, so Catalyst inlines them. Over a table take the lists, which are exploded where the rows are:

    SELECT doc_id, part, chunk FROM (SELECT doc_id, tessera_chunk_list(text) AS l FROM documents)
    LATERAL VIEW OUTER posexplode(l) AS part, chunk WHERE part IS NOT NULL

OUTER keeps Spark from asking for the list a second time, for a filter on its size. ``tessera_chunks`` and
``tessera_tokens`` are table functions for one text: after a table, by LATERAL, Spark joins their rows to the table's by
the text, which shuffles the whole text with each of its tokens.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions import text as T
from tessera.operators.chunking import LEAST_CHARS, TARGET_CHARS


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _folded(t: str) -> str:
    cases = " ".join(f"WHEN length({t}) > {len(p) + 2} AND startswith({t}, '{p}') THEN substring({t}, {len(p) + 1})" for p in T.PREFIXES)
    return f"CASE {cases} ELSE {t} END"


def _heading(x: str) -> str:
    space, end = _quoted(f"^{T.WS}+|{T.WS}+$"), _quoted(f"{T.WS}+$")
    bare = f"regexp_replace({x}, {space}, '')"
    return f"(length({x}) <= 80 AND NOT regexp_replace({x}, {end}, '') RLIKE '[.،:]$' AND ({bare} = '' OR size(split({bare}, {_quoted(T.WS + '+')})) <= 10))"


def _statements() -> list[str]:
    full = f"a.n + length(l) >= {TARGET_CHARS}"
    named = f"CASE WHEN size(a.cur) = 0 AND {_heading('l')} THEN l ELSE a.heading END"
    cur = "concat(a.cur, array(l))"
    return [
        f"tessera_token_list(x STRING) RETURNS ARRAY<STRING> RETURN transform(transform(regexp_extract_all(lower(coalesce(x, '')), {_quoted(T.TOKEN)}, 0), t -> translate(t, '{T.FOLDED[0]}', '{T.FOLDED[1]}')), t -> {_folded('t')})",
        "tessera_tokens(x STRING) RETURNS TABLE(place INT, token STRING) RETURN SELECT posexplode(l) AS (place, token) FROM (SELECT tessera_token_list(x) AS l)",
        f"tessera_is_heading(x STRING) RETURNS BOOLEAN RETURN {_heading('x')}",
        f"""tessera_chunk_list(x STRING) RETURNS ARRAY<STRING> RETURN aggregate(split(x, '\\n'),
            named_struct('out', cast(array() AS ARRAY<STRING>), 'cur', cast(array() AS ARRAY<STRING>), 'heading', '', 'n', 0),
            (a, l) -> named_struct(
                'out', CASE WHEN {full} THEN concat(a.out, array(array_join({cur}, '\\n'))) ELSE a.out END,
                'cur', CASE WHEN {full} THEN CASE WHEN ({named}) <> '' THEN array({named}) ELSE cast(array() AS ARRAY<STRING>) END ELSE {cur} END,
                'heading', {named},
                'n', CASE WHEN {full} THEN length({named}) ELSE a.n + length(l) END),
            a -> CASE WHEN size(a.cur) = 0 THEN a.out
                WHEN a.n >= {LEAST_CHARS} OR size(a.out) = 0 THEN concat(a.out, array(array_join(a.cur, '\\n')))
                ELSE concat(slice(a.out, 1, size(a.out) - 1), array(concat(element_at(a.out, -1), '\\n', array_join(a.cur, '\\n')))) END)""",
        "tessera_chunks(x STRING) RETURNS TABLE(part INT, text STRING) RETURN SELECT posexplode(l) AS (part, text) FROM (SELECT tessera_chunk_list(x) AS l)",
    ]


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, in place of any of these names."""
    for s in _statements():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {s}")
