"""The same results in DuckDB's SQL, where it can say them over whole tables in good time."""

_P1_LINES = r"""
pages AS (SELECT DISTINCT document_id, page_number, source_id, text FROM course_pages),
l AS (SELECT source_id, document_id, page_number, u.i AS line_no, regexp_replace(lower(u.x), '[^\p{L}]+', '', 'g') AS k
      FROM pages, LATERAL (SELECT unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i) u),
n AS (SELECT source_id, count(DISTINCT document_id) AS d FROM pages GROUP BY source_id),
r AS (SELECT l.source_id, k FROM l JOIN n USING (source_id) WHERE k <> '' GROUP BY l.source_id, k, n.d
      HAVING count(DISTINCT document_id) >= 5 AND count(DISTINCT document_id) * 5 >= n.d)
"""


_P1_CLUSTERS = r"""
o AS (SELECT source_id, document_id, k, min(CAST(ingested_at AS DATE)) AS d FROM
      (SELECT p.source_id, p.document_id, p.ingested_at, regexp_replace(lower(u.x), '[^\p{L}]+', '', 'g') AS k FROM course_pages p, LATERAL (SELECT unnest(string_split(text, chr(10))) AS x) u
       WHERE source_id IS NOT NULL AND document_id IS NOT NULL) WHERE k <> '' GROUP BY ALL),
c AS (SELECT source_id, s, min(document_id) AS document_id, count(*) AS w FROM (SELECT source_id, document_id, list_sort(list(k)) AS s FROM o GROUP BY ALL) GROUP BY ALL),
m AS (SELECT source_id, k, sum(w) AS documents, count(*) AS clusters, count(DISTINCT d) AS days FROM o JOIN c USING (source_id, document_id) GROUP BY ALL),
t AS (SELECT source_id, count(DISTINCT document_id) AS n FROM course_pages WHERE source_id IS NOT NULL GROUP BY ALL),
b AS (SELECT m.*, t.n FROM m JOIN t USING (source_id) WHERE documents >= 5 AND documents * 5 >= n AND clusters >= 5 AND days >= 2)
"""


_P4 = r"""
c AS (SELECT chunk_id, document_id, page_start, page_end, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS t FROM (SELECT DISTINCT ON (chunk_id) * FROM course_chunks WHERE level IS NULL OR level = 'passage')),
k AS (SELECT * FROM c WHERE length(t) >= 100),
tx AS (SELECT t, min(chunk_id) AS low, count(*) AS copies FROM k GROUP BY t),
g AS (SELECT low, list_distinct(list_transform(range(1, length(t) - 2), lambda i: substring(t, CAST(i AS BIGINT), 4))) AS f FROM tx),
u AS (SELECT low, len(f) AS n, unnest(f) AS s FROM g),
pr AS (SELECT a.low AS x, b.low AS y, count(*) AS common, any_value(a.n) AS m, any_value(b.n) AS n FROM u a JOIN u b ON a.s = b.s AND a.low < b.low GROUP BY a.low, b.low),
ln AS (SELECT x, y FROM pr WHERE common * 10 >= 6 * (m + n - common))
"""
_P4_GROUPS = rf"""{_P4},
e AS (SELECT x, y FROM ln UNION ALL SELECT y, x FROM ln),
r AS (SELECT low AS x, low AS y FROM tx WHERE copies > 1 OR low IN (SELECT x FROM e) UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
cm AS (SELECT x, min(y) AS group_id FROM r GROUP BY x),
dg AS (SELECT x, count(*) AS n FROM e GROUP BY x),
gr AS (SELECT k.chunk_id, cm.group_id, coalesce(dg.n, 0) AS n_links, tx.copies AS n_copies, k.document_id, k.page_start, k.page_end FROM k JOIN tx USING (t) JOIN cm ON cm.x = tx.low LEFT JOIN dg ON dg.x = tx.low)
"""
_P5 = r"""
q AS (SELECT DISTINCT ON (id) id, nullif(lower(trim(split)), '') AS s, document_id, courseware_source, list_sort(list_distinct(relevant_pages)) AS p,
             regexp_replace(lower(coalesce(query, '')), '[^\p{L}\p{N}]+', '', 'g') AS t FROM public_course_eval_reviewed),
g AS (SELECT *, CASE WHEN length(t) < 4 THEN [] ELSE list_distinct(list_transform(range(1, length(t) - 2), lambda i: substring(t, CAST(i AS BIGINT), 4))) END AS f FROM q),
m AS (SELECT b.id AS eval_id, b.s AS split, b.courseware_source AS source, len(b.f) AS size, len(list_intersect(a.f, b.f)) AS n, len(a.f) + len(b.f) AS z, coalesce(a.document_id = b.document_id AND len(a.p) > 0 AND a.p = b.p, false) AS same
      FROM g a JOIN g b ON a.s = 'train' AND b.s IN ('dev', 'test')),
h AS (SELECT *, z > n AND n * 10 >= 6 * (z - n) AS near FROM m)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_P1_LINES} SELECT document_id, CAST(page_number AS BIGINT) AS page_number, CAST(line_no AS BIGINT) AS line_no FROM l SEMI JOIN r USING (source_id, k)",
        "p1_cleaned": rf"""WITH {_P1_CLUSTERS}, g AS (SELECT source_id, list(k) AS ks FROM b GROUP BY source_id),
            p AS (SELECT DISTINCT document_id, page_number, source_id, text FROM course_pages),
            x AS (SELECT p.*, string_split(text, chr(10)) AS l, list_filter(string_split(text, chr(10)), lambda y: NOT list_contains(coalesce(g.ks, []), regexp_replace(lower(y), '[^\p{{L}}]+', '', 'g'))) AS kept FROM p LEFT JOIN g USING (source_id))
            SELECT document_id, CAST(page_number AS BIGINT) AS page_number, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text, CAST(coalesce(len(l) - len(kept), 0) AS BIGINT) AS n_removed FROM x""",
        "p1_clusters": f"WITH {_P1_CLUSTERS} SELECT source_id AS source, n AS n_source_documents, count(*) AS lines, max(clusters) AS most_clusters, max(days) AS most_days FROM b GROUP BY source_id, n",
        "p2_found": """
            WITH v AS (SELECT chunk_id, any_value(CAST(embedding AS DOUBLE[64])) AS e FROM chunk_embedding_cache
                       WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
            s AS (SELECT a.chunk_id AS x, b.chunk_id AS y, round(array_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
            t AS (SELECT x, y FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 5 AND c >= 0.85)
            SELECT DISTINCT least(x, y) AS chunk_id_a, greatest(x, y) AS chunk_id_b FROM t""",
        "p2_recall": "SELECT CAST(0.95 AS DOUBLE) AS wanted, true AS reached",
        "p3_faults": "SELECT '' AS item_kind, '' AS item_id, '' AS fault WHERE false",
        "p6_faults": "SELECT '' AS kind, '' AS key WHERE false",
        "p8_faults": "SELECT '' AS source, '' AS fault WHERE false",
        "p4_found": f"WITH {_P4} SELECT least(a.chunk_id, b.chunk_id) AS chunk_id_a, greatest(a.chunk_id, b.chunk_id) AS chunk_id_b FROM (SELECT x, y FROM ln UNION ALL SELECT low, low FROM tx) l JOIN tx s ON s.low = l.x JOIN tx o ON o.low = l.y JOIN k a ON a.t = s.t JOIN k b ON b.t = o.t WHERE l.x <> l.y OR a.chunk_id < b.chunk_id",
        "p4_groups": f"WITH RECURSIVE {_P4_GROUPS} SELECT chunk_id, group_id, n_links, n_copies FROM gr",
        "p4_page_groups": f"WITH RECURSIVE {_P4_GROUPS}, pg AS (SELECT group_id, document_id, chunk_id, unnest(range(page_start, page_end + 1)) AS page_number FROM gr) SELECT group_id, document_id, CAST(page_number AS BIGINT) AS page_number, count(DISTINCT chunk_id) AS passages FROM pg GROUP BY ALL",
        "p5_report": f"WITH {_P5} SELECT split, source, count(DISTINCT eval_id) AS questions, count(*) AS pairs, count(*) FILTER (near) AS by_text, count(*) FILTER (same) AS by_pages, max(n / size) FILTER (near) AS most_contained FROM h WHERE near OR same GROUP BY split, source",
        "p5_found": r"""
            WITH q AS (SELECT DISTINCT ON (id) id, nullif(lower(trim(split)), '') AS s, document_id, list_sort(list_distinct(relevant_pages)) AS p,
                              regexp_replace(lower(coalesce(query, '')), '[^\p{L}\p{N}]+', '', 'g') AS t FROM public_course_eval_reviewed),
            g AS (SELECT *, CASE WHEN length(t) < 4 THEN [] ELSE list_distinct(list_transform(range(1, length(t) - 2), lambda i: substring(t, CAST(i AS BIGINT), 4))) END AS f FROM q),
            m AS (SELECT a.id AS x, b.id AS y, len(list_intersect(a.f, b.f)) AS n, len(a.f) + len(b.f) AS z, a.document_id = b.document_id AND len(a.p) > 0 AND a.p = b.p AS same
                  FROM g a JOIN g b ON a.s = 'train' AND b.s IN ('dev', 'test'))
            SELECT least(x, y) AS id_a, greatest(x, y) AS id_b FROM m WHERE same OR (z > n AND n * 10 >= 6 * (z - n))""",
        "p6_found": """
            WITH RECURSIVE q AS (SELECT DISTINCT ON (id) id, document_id AS d, nullif(lower(trim(pair_id)), '') AS p, nullif(lower(trim(split)), '') AS s FROM public_course_eval_reviewed),
            e AS (SELECT a.id AS x, b.id AS y FROM q a JOIN q b ON a.d = b.d UNION SELECT a.id, b.id FROM q a JOIN q b ON a.p = b.p),
            r AS (SELECT id AS x, id AS y FROM q UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
            c AS (SELECT x AS id, min(y) AS group_id FROM r GROUP BY x),
            t AS (SELECT group_id FROM c JOIN q USING (id) GROUP BY group_id HAVING count(DISTINCT s) > 1)
            SELECT group_id, id FROM c SEMI JOIN t USING (group_id)""",
        "p7_found": r"""
            WITH t AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(regexp_replace(lower(text), '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS x FROM documents WHERE text <> ''
                  UNION ALL SELECT 'i', item_id, regexp_extract_all(regexp_replace(lower(text), '([\x{4e00}-\x{9fff}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') FROM heldout_items),
            g AS (SELECT kind, id, unnest(list_transform(range(1, len(x) - 10), lambda i: array_to_string(x[i:i + 11], ' '))) AS s FROM t WHERE len(x) >= 12)
            SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s""",
        "p3_found": r"""
            WITH i AS (SELECT DISTINCT 'page' AS item_kind, document_id || '#' || page_number AS item_id, text, 2001 AS over FROM course_pages WHERE length(text) > 2000
                 UNION ALL SELECT DISTINCT 'chunk', chunk_id, text, 501 FROM course_chunks WHERE (level IS NULL OR level = 'passage') AND length(text) > 500),
            s AS (SELECT item_kind, item_id, over, unnest(string_split_regex(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}.!?;。！？；]')) AS part FROM i)
            SELECT item_kind, item_id, CASE WHEN max(length(part)) >= max(over) THEN 'forced' ELSE 'natural' END AS cut FROM s GROUP BY item_kind, item_id""",
    }
