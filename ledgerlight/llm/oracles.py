"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

import re

from ledgerlight.llm import reply_trees

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
# A control string, with any backslashes behind its first character.
CONTROLS = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in reply_trees.CONTROL)

REPLY_TREES = f"""
    WITH c AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, COUNT(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(COALESCE(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        SUM({len(reply_trees.OPEN) + len(reply_trees.CLOSE) + 2} + length(role) + length(text) + len(regexp_extract_all(text, '{CONTROLS}')))::BIGINT AS formatted_chars
    FROM c GROUP BY 1
"""

JACCARD = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    sh AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
    ),
    n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY 1),
    pr AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
    ln AS (SELECT x, y FROM pr JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
    r AS (SELECT x AS doc_id, x AS root FROM ln UNION SELECT ln.y, r.root FROM r JOIN ln ON ln.x = r.doc_id),
    m AS (SELECT doc_id, MIN(root) AS root FROM r GROUP BY 1)
    SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(m.root, d.doc_id) AS component_id
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_BENCH_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SUFFIXES = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '{_BENCH_WORDS}') AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOW}, '{_BENCH_WORDS}') AS w FROM benchmark),
    bw AS (
        SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
    ),
    sizes AS (SELECT DISTINCT k FROM bw),
    dw AS (
        SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
    ),
    hit AS (SELECT doc_id, item, i, k FROM dw JOIN bw USING (k, g)),
    words AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
    items AS (
        SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1
    )
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
        sha256(COALESCE(names, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ARCHIVES = """
    WITH p AS (
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages
    ), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f
"""

COSINES = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings),
  good AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS size FROM v WHERE label IS NOT NULL AND x IS NOT NULL
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
  link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.98),
  reach(u, v) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u),
  least AS (SELECT u, MIN(v) AS component_id FROM reach GROUP BY 1), n AS (SELECT u, COUNT(*) AS n FROM link GROUP BY 1)
  SELECT vec_id, COALESCE(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
  FROM v JOIN least ON vec_id = least.u LEFT JOIN n ON vec_id = n.u"""


def _centroids(rounds: int = 5) -> str:
    parts = ["""w AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  p AS (SELECT vec_id, UNNEST(generate_series(1, 64)) AS i, UNNEST(x) AS x FROM w),
  s AS (SELECT vec_id, ROW_NUMBER() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM w),
  c0 AS (SELECT c, i, x FROM s JOIN p USING (vec_id) WHERE c < 40)"""]
    for k in range(rounds + 1):
        parts.append(f"""d{k} AS (SELECT vec_id, c, SUM((p.x - c{k}.x) * (p.x - c{k}.x))::BIGINT AS d FROM p JOIN c{k} USING (i) GROUP BY 1, 2),
  a{k} AS MATERIALIZED (SELECT vec_id, c, d FROM d{k} QUALIFY ROW_NUMBER() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if k < rounds:
            parts.append(f"""m{k} AS (SELECT c, i, SUM(x) AS t, COUNT(*) AS n FROM a{k} JOIN p USING (vec_id) GROUP BY 1, 2),
  c{k + 1} AS MATERIALIZED (SELECT c, i, COALESCE(t // n - CASE WHEN t % n < 0 THEN 1 ELSE 0 END, x)::BIGINT AS x FROM c{k} LEFT JOIN m{k} USING (c, i))""")
    return "WITH " + ",\n  ".join(parts) + f""",
  h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY 1)
  SELECT vec_id, c::INTEGER AS cluster, d AS distance, (SUM(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
    (SUM(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN h USING (c)"""


CENTROIDS = _centroids()
