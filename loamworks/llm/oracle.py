"""SQL counterparts of the training-data queries, where SQL can express them on whole tables.

Queries that encode with a tokenizer or use a trained model have none; the tests check them against brute force,
round trips or held-out accuracy.
"""

from __future__ import annotations

_RECORDS = """
WITH r AS (SELECT * FROM doc_records WHERE record_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC NULLS LAST) = 1),
t AS (SELECT lower(trim(source)) AS s, max(trust) AS trust FROM source_catalog WHERE source IS NOT NULL GROUP BY 1),
c AS (SELECT r.record_id, lower(trim(r.dedup_cluster_id)) AS cluster_id,
  (coalesce(trim(url), '') <> '')::INT + (coalesce(trim(dump), '') <> '')::INT + (coalesce(trim(language), '') <> '')::INT + (coalesce(trim(dedup_method), '') <> '')::INT
    + (language_score IS NOT NULL AND NOT isnan(language_score))::INT + (token_count IS NOT NULL)::INT + (toxicity_score IS NOT NULL AND NOT isnan(toxicity_score))::INT AS filled,
  coalesce(fetched_at, '-infinity'::TIMESTAMPTZ) AS fetched, coalesce(t.trust, -1) AS trust, coalesce(token_count, -9223372036854775808) AS tokens,
  CASE WHEN quality_scores['overall'] IS NULL OR isnan(quality_scores['overall']) THEN -1e300 ELSE quality_scores['overall'] END AS overall
  FROM r LEFT JOIN t ON lower(trim(r.source)) = t.s WHERE coalesce(trim(r.dedup_cluster_id), '') <> '')
"""

ORACLE: dict[str, str] = {
    "p4_found": _RECORDS
    + """
SELECT a.cluster_id, a.record_id FROM c a JOIN c b ON a.cluster_id = b.cluster_id AND a.record_id <> b.record_id GROUP BY 1, 2
HAVING bool_and(a.filled >= b.filled AND a.fetched >= b.fetched AND a.trust >= b.trust AND a.tokens >= b.tokens AND a.overall >= b.overall
  AND (a.filled > b.filled OR a.fetched > b.fetched OR a.trust > b.trust OR a.tokens > b.tokens OR a.overall > b.overall))
""",
    "p5_found": r"""
WITH w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT doc_id_a, doc_id_b FROM p JOIN n x ON x.doc_id = doc_id_a JOIN n y ON y.doc_id = doc_id_b WHERE k >= 0.7 * (x.n + y.n - k) - 1e-9
""",
}
