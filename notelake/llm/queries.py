"""The queries over the driver's tables and, where SQL can state them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, near_duplicates, packing, secret_scan, suffix_dedup, token_counts, topk_search, toxicity
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated(table(spark, sf_dir, "documents")).drop("spans")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 0.85, as its contract has it."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.findings(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_topk_search": op2_topk_search,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_secret_scan": op10_secret_scan,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _secret_spans(rule: secret_scan.Rule, place: int) -> str:
    """Spans of one rule: matches start after the gaps and matches before them."""
    pattern = rule.pattern.replace("'", "''")
    return f"""
        SELECT doc_id, {place} AS ord, '{rule.kind}' AS kind, ms[i] AS m, gs[i] AS g,
               CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
        FROM (SELECT doc_id, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {rule.group}) AS gs
              FROM t WHERE regexp_matches(text, '{pattern}')) x, unnest(generate_series(1, len(ms))) AS u(i)
        WHERE length(gs[i]) >= {rule.least}"""


_SECRETS_SQL = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    s AS ({" UNION ALL ".join(_secret_spans(r, k) for k, r in enumerate(secret_scan.RULES))}),
    d AS (
        SELECT doc_id, count(*) FILTER (WHERE ord = 0) AS a, count(*) FILTER (WHERE ord = 1) AS b, count(*) FILTER (WHERE ord = 2) AS c,
               string_agg(kind || ':' || start || ':' || (start + length(m)), ',' ORDER BY start, ord) AS spans,
               string_agg(kind || ':' || start || ':' || (start + length(m)), ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base
        FROM s GROUP BY doc_id
    )
    SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN d ON t.doc_id = d.doc_id
"""

_WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_DECONTAMINATE_SQL = f"""
    WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
    i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[k:k + least(13, len(w)) - 1] AS v FROM i, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS u(k) WHERE len(w) > 0),
    size AS (SELECT DISTINCT n FROM win),
    places AS (SELECT doc_id, n, k, w[k:k + n - 1] AS v FROM d, size, unnest(generate_series(1, len(w) - n + 1)) AS u(k)),
    hit AS (SELECT doc_id, places.n, k, item_id FROM places JOIN win ON places.n = win.n AND places.v = win.v),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(k, k + n - 1)) AS u(p) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

_NEAR_SQL = f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, w[k:k + 4] AS v FROM d, unnest(generate_series(1, greatest(1, len(w) - 4))) AS u(k) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    link AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.v = b.v AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
        GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
    ),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
    FROM d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT query_id, vec_id, score,
                   CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op5_decontaminate": _DECONTAMINATE_SQL,
    "op9_near_duplicates": _NEAR_SQL,
    "op10_secret_scan": _SECRETS_SQL,
}
