"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, fingerprints, html_text, jaccard, line_dedup, packing, pieces, quality, token_counts, topk

QUERIES = {
    "op1_quality_classifier": quality.op1,
    "op2_html_extraction": html_text.op2,
    "op3_token_counts": token_counts.op3,
    "op4_chat_formatting": chat.op4,
    "op5_line_dedup": line_dedup.op5,
    "op6_topk_search": topk.op6,
    "op7_ngram_jaccard": jaccard.op7,
    "op8_sentencepiece": pieces.op8,
    "op9_packing": packing.op9,
    "op10_fingerprints": fingerprints.op10,
}

ORACLES = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_topk_search": """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND len(a.q) = len(b.q)
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
""",
}
