"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

import corpus_pipeline
from stancemill.llm import oracles, queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op")} | {"pipeline": corpus_pipeline.run}
ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to, url
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op10_embedding_neardup": """
        WITH RECURSIVE l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.93),
        r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
        m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN m ON m.v = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op11_licences": oracles.licence_scan(),
    "op12_ranked_search": oracles.RANKED_SEARCH,
    "op13_collocations": oracles.COLLOCATIONS,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
