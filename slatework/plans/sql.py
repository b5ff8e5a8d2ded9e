"""The core queries in DuckDB's SQL, over whole tables."""

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = r"\r\n|[\n\x{0b}\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def lines(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{NL}'), lambda l: length({strip('l')}) > 0)"


def form(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({strip(x)}), '\p{{Nd}}+', '<n>', 'g'), '{WS}+', ' ', 'g')"


def tokens(x: str) -> str:
    low = f"lower({x})"
    han = r"regexp_extract_all(" + low + r", '[\x{3400}-\x{9fff}]+')"
    return (rf"list_concat(list_concat(regexp_extract_all({low}, '[a-z0-9]+(?:[-_.][a-z0-9]+)*'), regexp_extract_all({low}, '[\x{{0370}}-\x{{03ff}}]+|[+*/=^]+')), "
            rf"flatten(list_transform({han}, lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1)), list_transform(range(1, length(r)), lambda i: substring(r, i, 2))))))")  # fmt: skip


PAGES = "p AS (SELECT DISTINCT ON (document_id, page_number) * FROM course_pages)"
CHUNKS = "c AS (SELECT DISTINCT ON (chunk_id) * REPLACE (coalesce(level, 'passage') AS level) FROM course_chunks)"
PASSAGES = "c AS (SELECT * FROM (SELECT DISTINCT ON (chunk_id) * REPLACE (coalesce(level, 'passage') AS level) FROM course_chunks) WHERE level = 'passage')"
EXAMPLES = "e AS (SELECT DISTINCT ON (id) * FROM public_course_eval_reviewed)"
BOILER = rf"""
{PAGES},
pl AS (SELECT document_id, page_number, {lines('text')} AS l FROM p),
pe AS (SELECT document_id, page_number, {strip('x')} AS raw, {form('x')} AS line FROM (SELECT document_id, page_number, unnest(list_concat(l[1:2], l[-2:])) AS x FROM pl)),
pn AS (SELECT document_id, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 3),
bl AS (SELECT document_id, line, count(DISTINCT page_number) AS pages FROM pe JOIN pn USING (document_id) WHERE length(line) BETWEEN 1 AND 80 GROUP BY document_id, line, n
       HAVING count(DISTINCT page_number) >= greatest(3, ceil(n * CAST(0.3 AS DOUBLE)))
          AND (regexp_matches(line, 'copyright|university|unimelb|lecture|slide|page|<n>\s*/\s*<n>') OR count(DISTINCT raw) > 1))"""
CLEAN = rf"""
{BOILER},
bs AS (SELECT document_id, list(line) AS s FROM bl GROUP BY ALL),
al AS (SELECT p.*, coalesce(s, []) AS s, string_split_regex(text, '{NL}') AS a FROM p LEFT JOIN bs USING (document_id)),
cl AS (SELECT *, len(list_filter(a, lambda x: list_contains(s, {form('x')}))) AS removed FROM al),
cp AS (SELECT * EXCLUDE (text, s, a), CASE WHEN removed > 0 THEN {strip("array_to_string(list_filter(a, lambda x: NOT list_contains(s, " + form('x') + ")), chr(10))")} ELSE text END AS text FROM cl)"""


def quality(source: str) -> str:
    """q: role, flags and score of the rows of source."""
    return rf"""
q0 AS (SELECT *, coalesce(metadata.image_count, 0) AS im, {strip("coalesce(text, '')")} AS b FROM {source}),
q1 AS (SELECT *, length(regexp_replace(b, '{WS}+', '', 'g')) AS n, {lines('b')} AS l FROM q0),
q2 AS (SELECT *, CASE WHEN regexp_matches(lower(b), 'copyright act|do not remove this notice|pursuant to part vb|subject to copyright') THEN 'boilerplate'
         WHEN im > 0 AND len(l) = 1 AND n <= 100 AND NOT regexp_matches({strip('l[1]')}, '[.!?。！？]$') THEN 'section_divider'
         WHEN im > 0 AND n < 20 THEN 'visual_only' WHEN b = '' THEN 'empty' ELSE 'content' END AS role FROM q1),
q AS (SELECT *, array_to_string(list_filter([CASE WHEN im <> 0 AND n < 120 THEN 'image_with_sparse_text' END, CASE WHEN im >= 10 THEN 'many_image_objects' END,
         CASE WHEN im <> 0 AND len(l) >= 10 AND n < 500 THEN 'dense_visual_layout' END, CASE WHEN role IN ('visual_only', 'section_divider') THEN role END], lambda x: x IS NOT NULL), ',') AS reasons FROM q2)"""


RISK = """round(least(CAST(1 AS DOUBLE), (CASE WHEN im <> 0 AND n < 120 THEN CAST(0.55 AS DOUBLE) ELSE 0 END) + (CASE WHEN im >= 10 THEN CAST(0.35 AS DOUBLE) ELSE 0 END)
          + (CASE WHEN im <> 0 AND len(l) >= 10 AND n < 500 THEN CAST(0.45 AS DOUBLE) ELSE 0 END) + (CASE WHEN n < 40 THEN CAST(0.1 AS DOUBLE) ELSE 0 END)), 2)"""
EXCLUDED = "role IN ('boilerplate', 'visual_only', 'section_divider', 'empty')"
FIRST = strip("l[1]")
HEAD = rf"""CASE WHEN length(title) BETWEEN 1 AND 100 THEN trim(title, '# ') WHEN {FIRST} LIKE '#%' OR (length({FIRST}) BETWEEN 1 AND 60 AND NOT regexp_matches({FIRST}, '[.!?。！？]$')) THEN trim({FIRST}, '# ') END"""
SECTION_ROWS = rf"""
s0 AS (SELECT q.*, {HEAD} AS head FROM q),
s1 AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND (role = 'section_divider' OR coalesce(regexp_matches(trim(head, '# '), '^第[0-9一二三四五六七八九十百]+[章节篇单元]') OR regexp_matches(trim(head, '# '), '(?i)^(chapter|unit|module|part)\s+[0-9ivx]+\b'), false)) THEN 1 ELSE 0 END AS st
       FROM s0 WINDOW w AS (PARTITION BY document_id ORDER BY page_number)),
s2 AS (SELECT *, sum(st) OVER (PARTITION BY document_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) + 1 AS section_no FROM s1),
sg AS (SELECT document_id, section_no, coalesce(nullif(arg_min(coalesce(head, ''), page_number), ''), CASE WHEN section_no = 1 THEN document_id ELSE 'Section ' || section_no END) AS section,
       min(page_number) AS page_start, max(page_number) AS page_end, count(*) AS pages FROM s2 GROUP BY document_id, section_no)"""
SECTIONS = f"""{PAGES}, {quality('p')}, {SECTION_ROWS}
SELECT document_id, CAST(section_no AS BIGINT) AS section_no, section, CAST(page_start AS BIGINT) AS page_start, CAST(page_end AS BIGINT) AS page_end, pages FROM sg"""


def sentences(x: str) -> str:
    return rf"""list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace({strip(x)}, '[ \t]+', ' ', 'g'), '([。！？.!?；;])', '\1' || chr(1), 'g'), '\x01{WS}*|\n+'), lambda s: {strip('s')}), lambda s: length(s) > 0)"""


def truncated(x: str, n: int) -> str:
    w = rf"regexp_extract(substring({x}, 1, {n}), '(?s)^(.*[。！？.!?\n])', 1)"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE {strip(f'CASE WHEN length({w}) - 1 >= {n // 2} THEN {w} ELSE substring({x}, 1, {n}) END')} END"


def windows(source: str, keys: str, text: str, limit: int = 500, overlap: int = 1) -> str:
    """w: keys, at, text of each window: ps are prefix sums, a window ends where they exceed those of its start by the limit."""
    after = lambda at: f"greatest({at} + 1, len(list_filter(ps, lambda v: v <= ps[{at} + 1] + {limit})) - 1)"
    following = f"greatest(a + 1, e - {overlap})"
    return f"""
w0 AS (SELECT {keys}, {sentences(text)} AS x FROM {source}),
w1 AS (SELECT *, list_transform(range(0, len(x) + 1), lambda i: coalesce(list_sum(list_transform(x[1:i], lambda t: length(t))), 0)) AS ps FROM w0 WHERE len(x) > 0),
w2 AS (SELECT {keys}, x, ps, CAST(0 AS BIGINT) AS a, {after('0')} AS e, CAST(0 AS BIGINT) AS pos FROM w1
       UNION ALL SELECT {keys}, x, ps, {following}, {after(following)}, pos + 1 FROM w2 WHERE e < len(x)),
w AS (SELECT {keys}, pos, array_to_string(x[a + 1:e], ' ') AS text FROM w2)"""


def sid(prefix: str, *parts: str) -> str:
    return f"'{prefix}_' || substring(sha1({' || chr(58) || '.join(parts)}), 1, 12)"


CHUNKED = rf"""WITH RECURSIVE {CLEAN}, {quality('cp')}, {SECTION_ROWS},
pg AS (SELECT s2.document_id, s2.page_number, coalesce(s2.text, '') AS text, sg.section, {EXCLUDED} AS ex, b <> '' AND NOT ({EXCLUDED}) AS good, sg.page_start AS first_page, sg.page_end AS last_page,
       {sid('sec', 's2.document_id', 'sg.page_start', 'sg.section')} AS sec, {sid('page', 's2.document_id', 's2.page_number')} AS page FROM s2 JOIN sg USING (document_id, section_no)),
kept AS (SELECT * FROM pg WHERE NOT ex), {windows('kept', 'document_id, page_number, section, page', 'text')},
ck AS (SELECT *, {sid('chk', 'document_id', 'page_number', 'pos', 'text')} AS id FROM w),
ch AS (SELECT page, string_agg(id, ',' ORDER BY pos) AS children FROM ck GROUP BY page),
sx AS (SELECT sec, document_id, section, first_page, last_page, {strip("section || chr(10) || coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_number) FILTER (good), '')")} AS body, string_agg(page, ',' ORDER BY page_number) AS children FROM pg GROUP BY sec, document_id, section, first_page, last_page),
out AS (SELECT sec AS chunk_id, document_id, first_page AS page_start, last_page AS page_end, {truncated('body', 2000)} AS text, section, NULL AS parent_id, 'section' AS level, children FROM sx
  UNION ALL SELECT page, document_id, page_number, page_number, text, section, sec, 'page', coalesce(children, '') FROM pg LEFT JOIN ch USING (page)
  UNION ALL SELECT id, document_id, page_number, page_number, text, section, page, 'passage', '' FROM ck)"""


def bm25(chunks: str, name: str = "r", k: int = 5, k1: float = 1.5, b: float = 0.75) -> str:
    """{name}: query_id, chunk_id, score, rank over c (from chunks) for the examples e."""
    n = name
    return rf"""
{n}k AS (SELECT chunk_id, level, {tokens('text')} AS t FROM c WHERE NOT coalesce(metadata.text_retrieval_excluded, false)),
{n}p AS (SELECT chunk_id, level, len(t) AS ln, term, count(*) AS tf FROM (SELECT chunk_id, level, t, unnest(t) AS term FROM {n}k) GROUP BY ALL),
{n}s AS (SELECT (SELECT count(*) FROM c) AS n, avg(len(t)) AS al FROM {n}k),
{n}i AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM {n}s) - count(*) + CAST(0.5 AS DOUBLE)) / (count(*) + CAST(0.5 AS DOUBLE))) AS idf FROM {n}p GROUP BY term),
{n}q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT id AS query_id, unnest({tokens('query')}) AS term FROM e WHERE trim(query) <> '') GROUP BY ALL),
{n}x AS (SELECT query_id, chunk_id, level, sum(qtf * idf * tf * CAST({k1} + 1 AS DOUBLE) / (tf + CAST({k1} AS DOUBLE) * (1 - CAST({b} AS DOUBLE) + CAST({b} AS DOUBLE) * ln / (SELECT al FROM {n}s)))) AS score
       FROM {n}q JOIN {n}i USING (term) JOIN {n}p USING (term) GROUP BY ALL HAVING score > 0),
{n}w AS (SELECT query_id, chunk_id, round(score * CASE level WHEN 'section' THEN CAST(0.65 AS DOUBLE) WHEN 'page' THEN CAST(0.85 AS DOUBLE) ELSE 1 END, 6) AS score FROM {n}x),
{n} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {n}w QUALIFY rank <= {k})"""


def to_pages(name: str, ranked: str, k: int, candidates: int = 50) -> str:
    return f"""
{name}b AS (SELECT query_id, document_id, page_number, min(rank) AS r, arg_min(score, rank) AS score
       FROM (SELECT r.query_id, c.document_id, unnest(range(c.page_start, c.page_end + 1)) AS page_number, r.rank, r.score FROM {ranked} r JOIN c USING (chunk_id) WHERE r.rank <= {candidates}) SEMI JOIN p USING (document_id, page_number) GROUP BY ALL),
{name} AS (SELECT query_id, document_id, page_number, round(score, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY r, score DESC, document_id, page_number) AS rank FROM {name}b QUALIFY rank <= {k})"""


def rrf(parts: dict[str, float], keys: str, k: int = 5, rrf_k: int = 60, candidates: int = 50) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, {keys}, rank, CAST({w} AS DOUBLE) / ({rrf_k} + rank) AS part FROM {n} WHERE rank <= {candidates}" for n, w in parts.items())
    return f"""
fu AS (SELECT query_id, {keys}, round(sum(part), 12) AS f, min(rank) AS best FROM ({union}) GROUP BY ALL),
fr AS (SELECT query_id, {keys}, round(f, 8) AS score, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, best, {keys}) AS rank FROM fu QUALIFY rank <= {k})"""


def chunk_hits(name: str, ranked: str) -> str:
    return f"""
{name} AS (SELECT r.query_id, r.chunk_id, r.rank, coalesce(list_contains(e.relevant_chunk_ids, r.chunk_id), false) OR ((e.document_id IS NULL OR e.document_id = c.document_id)
          AND coalesce(len(list_filter(e.relevant_pages, lambda x: x BETWEEN c.page_start AND c.page_end)) > 0, false)) AS hit
       FROM {ranked} r JOIN c USING (chunk_id) JOIN e ON e.id = r.query_id)"""


def metrics(hits: str, pages: bool, k: int = 5) -> str:
    ideal = "greatest(1, coalesce(len(relevant_pages), 0))" if pages else "greatest(1, coalesce(len(relevant_pages), 0), coalesce(len(relevant_chunk_ids), 0), good)"
    return f"""
m0 AS (SELECT query_id, count(*) AS n, count(*) FILTER (hit) AS good, min(rank) FILTER (hit) AS f, coalesce(sum(1 / log2(rank + CAST(1 AS DOUBLE))) FILTER (hit), 0) AS dcg FROM {hits} WHERE rank <= {k} GROUP BY ALL),
m1 AS (SELECT id AS query_id, coalesce(question_type, 'unlabeled') AS question_type, coalesce(n, 0) AS n, coalesce(good, 0) AS good, f, coalesce(dcg, 0) AS dcg, relevant_pages, relevant_chunk_ids FROM e LEFT JOIN m0 ON e.id = query_id),
m AS (SELECT query_id, question_type, CAST(good > 0 AS DOUBLE) AS recall, good / CAST({k} AS DOUBLE) AS precision, coalesce(1 / CAST(f AS DOUBLE), 0) AS rr,
        dcg / list_sum(list_transform(range(1, CAST(least({k}, {ideal}) AS BIGINT) + 1), lambda i: 1 / log2(i + CAST(1 AS DOUBLE)))) AS ndcg, CAST(n = 0 AS DOUBLE) AS no_result FROM m1)"""


SHOWN = "query_id, question_type, recall, precision, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg, no_result"
POSITIVE = """
po AS (SELECT e.id AS query_id, x.chunk_id FROM (SELECT id, unnest(relevant_chunk_ids) AS chunk_id FROM e) x JOIN e USING (id) SEMI JOIN c ON c.chunk_id = x.chunk_id
  UNION SELECT w.id, c.chunk_id FROM (SELECT id, document_id, unnest(relevant_pages) AS pg FROM e) w JOIN c ON (w.document_id IS NULL OR w.document_id = c.document_id) AND w.pg BETWEEN c.page_start AND c.page_end)"""
NEGATIVES = rf"""WITH {PASSAGES}, {EXAMPLES}, {bm25(PASSAGES, k=20)}, {POSITIVE},
bp AS (SELECT po.query_id, po.chunk_id AS positive_chunk_id FROM po LEFT JOIN rw USING (query_id, chunk_id) QUALIFY row_number() OVER (PARTITION BY po.query_id ORDER BY rw.score DESC NULLS LAST, po.chunk_id) = 1),
ng AS (SELECT query_id, positive_chunk_id, chunk_id AS negative_chunk_id, rank AS negative_rank, 'bm25' AS miner, CASE WHEN rank <= 5 THEN 'hard' WHEN rank <= 10 THEN 'medium' ELSE 'easy' END AS difficulty
       FROM r ANTI JOIN po USING (query_id, chunk_id) JOIN bp USING (query_id))"""
DENSE = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id, a.label AS want, b.label, round(array_cosine_similarity(a.v, b.v), 6) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0)"""
BOTH = f"{PASSAGES}, {EXAMPLES}, {bm25(PASSAGES, 'r', 50)}, {bm25(PASSAGES, 'z', 50, 1.2, 0.0)}"
STATUS = "('candidate', 'verified')"


def oracle_sql() -> dict[str, str]:
    cast = lambda *c: ", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in c)
    counts = lambda table, col, vals: f"SELECT v AS {col}, count(t.{col}) AS rows FROM (SELECT unnest({list(vals)}) AS v) LEFT JOIN {table} t ON t.{col} = v GROUP BY v"
    return {
        "doc_content_id": "SELECT doc_id, 'doc-' || substring(sha256(text), 1, 16) AS document_id FROM documents",
        "manifest_flatten": """WITH x AS (SELECT source_id, license, redistribution, unnest(pairs) AS p FROM source_manifest),
            y AS (SELECT source_id, p.pair_id AS pair_id, p.topic AS topic, 'courseware' AS role, license, redistribution, unnest(p.courseware) AS f FROM x UNION ALL SELECT source_id, p.pair_id, p.topic, 'review', license, redistribution, unnest(p.review) FROM x)
            SELECT source_id, pair_id, topic, role, f.filename AS filename, f.url AS url, license, redistribution FROM y""",
        "repeated_downloads": "SELECT source_id, topic, role, count(*) AS rows FROM course_files GROUP BY ALL HAVING count(*) > 1",
        "level_filter": f"WITH {CHUNKS} SELECT level, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS characters FROM c WHERE level IN ('section', 'page') GROUP BY level",
        "low_value_filter": f"WITH {CHUNKS} SELECT level, count(*) AS chunks FROM c WHERE NOT coalesce(metadata.text_retrieval_excluded, false) GROUP BY level",
        "split_filter": f"WITH {EXAMPLES} SELECT id FROM e WHERE split = 'dev'",
        "boilerplate_lines": f"WITH {BOILER} SELECT document_id, line, pages FROM bl",
        "cleaned_pages": f"WITH {CLEAN} SELECT document_id, {cast('page_number')}, text, removed FROM cp",
        "page_quality": f"WITH {PAGES}, {quality('p')} SELECT document_id, {cast('page_number')}, role, reasons <> '' AND role <> 'boilerplate' AS requires_vision, {EXCLUDED} AS text_retrieval_excluded, {RISK} AS visual_risk_score, reasons FROM q",
        "parse_report": f"""WITH {CLEAN}, {quality('cp')},
            f AS (SELECT document_id, count(*) AS page_count, count(*) FILTER (b <> '') AS nonempty_pages, CAST(sum(length(text)) AS BIGINT) AS total_characters, CAST(sum(removed) AS BIGINT) AS removed_boilerplate_lines,
              count(*) FILTER (b = '') AS empty_pages, count(*) FILTER (length(b) BETWEEN 1 AND 39) AS low_text_pages, count(*) FILTER (im > 0) AS image_pages, count(*) FILTER (reasons <> '' AND role <> 'boilerplate') AS requires_vision_pages,
              count(*) FILTER (role IN ('boilerplate', 'section_divider')) AS low_value_pages, count(*) FILTER ({EXCLUDED}) AS text_retrieval_excluded_pages FROM q GROUP BY document_id)
            SELECT *, round(nonempty_pages / page_count, 6) AS text_coverage, CAST((empty_pages > 0)::INT + (low_text_pages > 0)::INT + (requires_vision_pages > 0)::INT + (low_value_pages > 0)::INT + (text_retrieval_excluded_pages > 0)::INT AS BIGINT) AS warnings FROM f""",
        "vision_pages": f"WITH {PAGES}, {quality('p')} SELECT role, count(*) AS pages FROM q WHERE reasons <> '' AND role <> 'boilerplate' GROUP BY role",
        "section_groups": f"WITH {SECTIONS}",
        "sentence_split": f"WITH {PASSAGES}, x AS (SELECT chunk_id, {sentences('text')} AS x FROM c) SELECT chunk_id, CAST(len(x) AS BIGINT) AS sentences, sha1(array_to_string(x, '|')) AS mark FROM x",
        "passage_windows": f"""WITH RECURSIVE {PAGES}, {windows('p', 'document_id, page_number', 'text')} SELECT document_id, {cast('page_number')}, pos AS "window", text FROM w""",
        "chunked_pages": f"{CHUNKED} SELECT * REPLACE (CAST(page_start AS BIGINT) AS page_start, CAST(page_end AS BIGINT) AS page_end) FROM out",
        "chunk_levels": f"{CHUNKED} {counts('out', 'level', ('section', 'page', 'passage'))}",
        "own_hierarchy_errors": "SELECT '' AS chunk_id, '' AS error WHERE false",
        "truncated_sections": f"WITH {CHUNKS}, y AS (SELECT chunk_id, {truncated('text', 400)} AS t FROM c WHERE level = 'section') SELECT chunk_id, sha1(t) AS mark, length(t) AS size FROM y",
        "hierarchy_errors": f"""WITH {CHUNKS},
            u AS (SELECT c.chunk_id, CASE WHEN p.chunk_id IS NULL THEN 'parent_unknown' WHEN NOT list_contains(coalesce(p.child_ids, []), c.chunk_id) THEN 'parent_lacks_child'
                    WHEN NOT (p.document_id = c.document_id AND p.page_start <= c.page_start AND p.page_end >= c.page_end) THEN 'range_beyond_parent' END AS error FROM c LEFT JOIN c p ON p.chunk_id = c.parent_id WHERE c.parent_id <> ''),
            k AS (SELECT chunk_id, unnest(child_ids) AS child FROM c),
            w AS (SELECT k.*, x.chunk_id AS f, x.parent_id AS back FROM k LEFT JOIN c x ON x.chunk_id = k.child)
            SELECT * FROM u WHERE error IS NOT NULL UNION ALL SELECT chunk_id, 'child_unknown' FROM w WHERE f IS NULL UNION ALL SELECT child, 'child_has_other_parent' FROM w WHERE f IS NOT NULL AND back IS DISTINCT FROM chunk_id""",
        "token_counts": f"WITH {PASSAGES} SELECT chunk_id, CAST(len({tokens('text')}) AS BIGINT) AS tokens FROM c",
        "bm25_idf": f"WITH {PASSAGES}, {EXAMPLES}, {bm25(PASSAGES)} SELECT term, df, round(idf, 6) AS idf FROM ri",
        "bm25_topk": f"WITH {PASSAGES}, {EXAMPLES}, {bm25(PASSAGES)} SELECT query_id, chunk_id, score, rank FROM r",
        "bm25_level_weighted": f"WITH {CHUNKS}, {EXAMPLES}, {bm25(CHUNKS)} SELECT query_id, chunk_id, score, rank FROM r",
        "dense_topk": f"WITH {DENSE} SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d QUALIFY rank <= 5",
        "dense_label_precision": f"WITH {DENSE}, k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 11) SELECT want, count(*) AS neighbours, count(*) FILTER (label = want) AS same_label FROM k WHERE query_id <> vec_id GROUP BY want",
        "visual_topk": f"WITH {DENSE} SELECT query_id, 'doc-' || label AS document_id, vec_id AS page_number, score FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5",
        "cache_faults": f"""WITH {PASSAGES}, h AS (SELECT DISTINCT ON (chunk_id) chunk_id, text_sha256 FROM chunk_embedding_cache)
            SELECT chunk_id, 'duplicate' AS fault FROM chunk_embedding_cache GROUP BY chunk_id HAVING count(*) > 1 UNION ALL SELECT c.chunk_id, 'text changed' FROM c JOIN h USING (chunk_id) WHERE h.text_sha256 IS DISTINCT FROM sha256(c.text)""",
        "bm25_pages": f"WITH {PASSAGES}, {EXAMPLES}, {PAGES}, {bm25(PASSAGES, k=50)}, {to_pages('g', 'r', 5)} SELECT query_id, document_id, {cast('page_number')}, score, rank FROM g",
        "rrf_chunks": f"WITH {BOTH}, {rrf({'r': 1.0, 'z': 3.0}, 'chunk_id', candidates=50)} SELECT * FROM fr",
        "rrf_pages": f"WITH {BOTH}, {PAGES}, {to_pages('g', 'r', 50, 50)}, {to_pages('y', 'z', 50, 50)}, {rrf({'g': 1.0, 'y': 1.0}, 'document_id, page_number')} SELECT query_id, document_id, {cast('page_number')}, score, rank FROM fr",
        "reranked_by_length": f"WITH {PASSAGES}, {EXAMPLES}, {bm25(PASSAGES, k=20)} SELECT query_id, chunk_id, CAST(-length(text) AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY length(text), r.rank) AS rank FROM r JOIN c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(text), r.rank) <= 5",
        "eval_chunks": f"WITH {PASSAGES}, {EXAMPLES}, {bm25(PASSAGES)}, {chunk_hits('h', 'r')}, {metrics('h', False)} SELECT {SHOWN} FROM m",
        "eval_pages": f"""WITH {PASSAGES}, {EXAMPLES}, {PAGES}, {bm25(PASSAGES, k=50)}, {to_pages('g', 'r', 5)},
            h AS (SELECT g.query_id, g.rank, coalesce(e.document_id = g.document_id AND list_contains(e.relevant_pages, g.page_number), false) AS hit FROM g JOIN e ON e.id = g.query_id), {metrics('h', True)} SELECT {SHOWN} FROM m""",
        "eval_summary": f"""WITH {PASSAGES}, {EXAMPLES}, {bm25(PASSAGES)}, {chunk_hits('h', 'r')}, {metrics('h', False)}
            SELECT CASE WHEN grouping(question_type) = 1 THEN 'ALL' ELSE question_type END AS question_type, count(*) AS queries, round(avg(recall), 6) AS recall_at_k, round(avg(precision), 6) AS precision_at_k,
                   round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_at_k, round(avg(no_result), 6) AS no_result_rate FROM m GROUP BY GROUPING SETS ((), (question_type))""",
        "compare_systems": f"""WITH {BOTH}, {chunk_hits('h1', 'r')}, {chunk_hits('h2', 'z')},
            u AS (SELECT 'bm25' AS system, * FROM h1 UNION ALL SELECT 'bm25_flat', * FROM h2),
            k AS (SELECT system, query_id, bool_or(hit) AS hit, min(rank) FILTER (hit) AS f, count(*) AS n FROM u WHERE rank <= 10 GROUP BY ALL)
            SELECT e.id AS query_id, s.system, coalesce(k.hit, false) AS hit_at_k, k.f AS first_relevant_rank, k.n AS shown FROM e CROSS JOIN (SELECT unnest(['bm25', 'bm25_flat']) AS system) s LEFT JOIN k ON k.system = s.system AND k.query_id = e.id""",
        "dataset_errors": f"""WITH {EXAMPLES}, {CHUNKS}, pg AS (SELECT DISTINCT document_id, unnest(range(page_start, page_end + 1)) AS page FROM c), dc AS (SELECT DISTINCT document_id FROM pg),
            b AS (SELECT *, coalesce({strip('query')}, '') AS sq, coalesce({strip('document_id')}, '') AS sd, coalesce(len(list_filter(relevant_pages, lambda x: x IS NULL OR x < 1)) > 0, false) AS bp,
                    coalesce(len(list_filter(relevant_chunk_ids, lambda x: coalesce({strip('x')}, '') = '')) > 0, false) AS bc FROM e),
            nm AS (SELECT id, document_id, unnest(relevant_chunk_ids) AS chunk_id FROM b WHERE NOT bc),
            ch AS (SELECT nm.id, bool_or(c.document_id IS NULL) AS lost, bool_or(c.document_id <> nm.document_id) AS foreign_ FROM nm LEFT JOIN c USING (chunk_id) GROUP BY ALL),
            wp AS (SELECT id, document_id, unnest(relevant_pages) AS page FROM b WHERE sd <> '' AND NOT bp)
            SELECT id, 'query' AS code FROM b WHERE sq = '' UNION ALL SELECT id, 'relevant_pages' FROM b WHERE bp UNION ALL SELECT id, 'relevant_chunk_ids' FROM b WHERE bc
            UNION ALL SELECT id, 'id' FROM b WHERE coalesce({strip('id')}, '') = '' UNION ALL SELECT id, 'no_label' FROM b WHERE coalesce(len(relevant_pages), 0) = 0 AND coalesce(len(relevant_chunk_ids), 0) = 0
            UNION ALL SELECT id, 'document_id' FROM b WHERE document_id IS NOT NULL AND sd = ''
            UNION ALL SELECT id, 'question_type' FROM b WHERE question_type NOT IN ('text', 'formula', 'table_chart', 'visual_only', 'cross_page') UNION ALL SELECT id, 'split' FROM b WHERE split NOT IN ('train', 'dev', 'test')
            UNION ALL SELECT id, 'annotation_status' FROM b WHERE annotation_status NOT IN {STATUS}
            UNION ALL SELECT id, 'document_id_missing' FROM b WHERE document_id IS NULL UNION ALL SELECT id, 'question_type_missing' FROM b WHERE question_type IS NULL
            UNION ALL SELECT id, 'split_missing' FROM b WHERE split IS NULL UNION ALL SELECT id, 'annotation_status_missing' FROM b WHERE annotation_status IS NULL
            UNION ALL SELECT id, 'duplicate_query' FROM (SELECT id, row_number() OVER (PARTITION BY document_id, lower(sq) ORDER BY id) AS nth FROM b WHERE sq <> '') WHERE nth > 1
            UNION ALL SELECT id, 'document_not_in_corpus' FROM b ANTI JOIN dc USING (document_id) WHERE sd <> ''
            UNION ALL SELECT DISTINCT id, 'page_not_in_corpus' FROM wp SEMI JOIN dc USING (document_id) ANTI JOIN pg USING (document_id, page)
            UNION ALL SELECT id, CASE WHEN lost THEN 'chunk_not_in_corpus' ELSE 'chunk_of_other_document' END FROM ch WHERE lost OR foreign_
            UNION ALL SELECT id, 'pages_need_document' FROM b WHERE len(relevant_pages) > 0 AND NOT bp AND document_id IS NULL""",
        "dataset_counts": f"WITH {EXAMPLES}, u AS (SELECT unnest(['question_type', 'split', 'document_id', 'annotation_status']) AS field, unnest([question_type, split, document_id, annotation_status]) AS value FROM e) SELECT field, coalesce(value, 'unlabeled') AS value, count(*) AS examples FROM u GROUP BY ALL",
        "hard_negatives": f"{NEGATIVES} SELECT * FROM ng",
        "hard_negatives_quota": f"{NEGATIVES} SELECT * FROM ng QUALIFY row_number() OVER (PARTITION BY query_id, difficulty ORDER BY negative_rank) <= CASE difficulty WHEN 'hard' THEN 2 ELSE 1 END",
        "difficulty_counts": f"{NEGATIVES} {counts('ng', 'difficulty', ('hard', 'medium', 'easy'))}",
        "review_counts": f"WITH {EXAMPLES}, t AS (SELECT coalesce(review_decision, 'unreviewed') AS decision FROM e) {counts('t', 'decision', ('unreviewed', 'verified', 'needs_revision', 'rejected'))}",
        "pair_conflicts": f"""{NEGATIVES}, tr AS (SELECT ng.*, {strip('e.query')} AS query FROM ng JOIN e ON e.id = ng.query_id), lo AS (SELECT query, positive_chunk_id AS chunk_id, 1 AS label FROM tr UNION ALL SELECT query, negative_chunk_id, 0 FROM tr),
            pr AS (SELECT query, text, min(label) = max(label) AS sound FROM lo JOIN c USING (chunk_id) GROUP BY query, text) SELECT sound, count(*) AS pairs FROM pr GROUP BY sound""",
        "negative_pack": f"""{NEGATIVES} SELECT query_id, positive_chunk_id, negative_chunk_id, a.document_id AS positive_document, b.document_id AS negative_document FROM ng JOIN c a ON a.chunk_id = positive_chunk_id JOIN c b ON b.chunk_id = negative_chunk_id
            QUALIFY difficulty <> 'hard' OR row_number() OVER (PARTITION BY query_id, difficulty ORDER BY negative_rank) <= 1""",
        "review_pack": f"""WITH {EXAMPLES}, {CHUNKS}, g AS (SELECT document_id, page_start AS page, any_value(text) AS t FROM c WHERE level = 'page' AND page_start = page_end GROUP BY ALL),
            w AS (SELECT id, document_id, unnest(CASE WHEN coalesce(len(relevant_pages), 0) = 0 THEN [NULL] ELSE list_distinct(relevant_pages) END) AS page FROM e)
            SELECT w.id, w.document_id, CAST(w.page AS BIGINT) AS page, g.t IS NULL AS missing, length(g.t) AS size FROM w LEFT JOIN g USING (document_id, page)""",
        "example_evidence": f"""WITH {EXAMPLES}, {CHUNKS}, g AS (SELECT metadata.source_name AS source_name, page_start AS page, document_id AS d, chunk_id FROM c WHERE level = 'page'),
            w AS (SELECT id, courseware_source AS source_name, unnest(list_distinct(relevant_pages)) AS page FROM e WHERE courseware_source IS NOT NULL)
            SELECT id, min(d) AS document_id, count(DISTINCT d) AS documents, count(DISTINCT chunk_id) AS chunks, count(*) FILTER (d IS NULL) AS missing FROM w LEFT JOIN g USING (source_name, page) GROUP BY id""",
        "pair_components": """WITH RECURSIVE e AS (SELECT DISTINCT document_id AS d, lower(trim(pair_id)) AS p FROM public_course_eval_reviewed WHERE document_id IS NOT NULL AND pair_id IS NOT NULL),
            l AS (SELECT DISTINCT a.d AS x, b.d AS y FROM e a JOIN e b USING (p)), r AS (SELECT d AS x, d AS y FROM e UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
            SELECT x AS document_id, min(y) AS component FROM r GROUP BY x HAVING count(DISTINCT y) > 1""",
    }
