"""DuckDB SQL for the operators that SQL can express: plain definitions over whole tables, with components
by a recursive closure.  They state the results and are no way to compute them at scale."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP3 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s)::bigint AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""
OP9 = """WITH RECURSIVE ok AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93::double),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
OP2 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), b AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, unnest(range(0, n - 49)) AS p, h FROM b WHERE n >= 50), k AS (SELECT doc_id, p, md5_number(substr(h, (2 * p + 1)::bigint, 100)) AS k FROM w),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY 1 HAVING min(doc_id) < max(doc_id)), x AS (SELECT k.doc_id, p FROM k JOIN f USING (k) WHERE first < k.doc_id),
s AS (SELECT doc_id, p, CASE WHEN p <= max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 0 ELSE 1 END AS fresh FROM x),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM s), v AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY 1, 2),
t AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM v),
q AS (SELECT doc_id, sum(z - a)::bigint AS gone, count(*) AS spans, string_agg(substr(h, (2 * before + 1)::bigint, (2 * (a - before))::bigint), '' ORDER BY a) AS head, max(z) AS z FROM t JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, n::bigint AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(z, 0) + 1)::bigint))) AS kept_sha256 FROM b LEFT JOIN q USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_array_dedup": OP2,
    "op3_minhash_near_dedup": OP3,
    "op9_embedding_near_dedup": OP9,
}
