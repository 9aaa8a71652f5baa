"""The vault's queries once more, in DuckDB SQL over the same layout."""

from __future__ import annotations

from quillspark.plans.vault import _PATH, LAYOUT, LINKS

_V = f"""v AS (SELECT *, {_PATH} AS path FROM (SELECT {', '.join(f'{x} AS {k}' for k, x in LAYOUT.items())} FROM documents WHERE doc_id IS NOT NULL))"""
_L = f"l AS (SELECT {LAYOUT['doc_id']} AS src, unnest([{', '.join(LINKS)}]) AS link FROM documents WHERE doc_id IS NOT NULL)"
_SPLIT = "list_filter(string_split(lower(coalesce({}, '')), '/'), lambda x: x <> '')"
#: Every candidate of every link is scored.
_RESOLVED = f"""{_V}, {_L}, c AS (SELECT doc_id, lower(regexp_replace(filename, '\\.md$', '')) AS name, concat_ws('/', folder, filename) AS p, {_SPLIT.format('folder')} AS segs FROM v),
 t AS (SELECT row_number() OVER () AS i, src, link, trim(regexp_replace(link, '[|#].*$', '')) AS target, {_SPLIT.format('folder')} AS home FROM l JOIN v ON src = doc_id WHERE link IS NOT NULL),
 k AS (SELECT *, regexp_replace(lower(target), '^.*/', '') AS name, {_SPLIT.format("regexp_extract(target, '^(.*)/[^/]*$', 1)")} AS dirs FROM t WHERE target <> ''),
 s AS (SELECT i, c.doc_id, p, CASE WHEN len(dirs) > 0 AND segs[-len(dirs):] = dirs THEN 5000 ELSE 0 END + CASE WHEN segs = home THEN 1000 ELSE 0 END
  + 10 * len(list_filter(range(1, 1 + least(len(segs), len(home))), lambda x: segs[1:x] = home[1:x])) - len(segs) AS score FROM k JOIN c ON c.name = k.name),
 b AS (SELECT i, doc_id FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, p) = 1),
 r AS (SELECT src, link, CASE WHEN target IN (SELECT doc_id FROM v) THEN target WHEN b.doc_id IS NOT NULL THEN b.doc_id ELSE '_phantom_' || lower(regexp_replace(regexp_replace(target, '[/ ]', '_', 'g'), '[^A-Za-z0-9_]', '', 'g')) END AS dst,
  CASE WHEN target IN (SELECT doc_id FROM v) THEN 'id' WHEN b.doc_id IS NULL THEN 'phantom' WHEN len(dirs) > 0 THEN 'subpath' ELSE 'name' END AS how FROM k LEFT JOIN b USING (i)),
 resolved AS (SELECT * FROM r WHERE src <> dst)"""
_TEAM = "NOT regexp_matches(coalesce(path, ''), '(^|/)[_.]')"
_SIG = f"""{_RESOLVED}, e AS (SELECT DISTINCT src, dst FROM resolved WHERE how <> 'phantom'), both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
 team AS (SELECT doc_id, lang, source FROM v WHERE {_TEAM}), sig AS (SELECT src AS doc_id, dst AS element FROM both_ways WHERE src IN (SELECT doc_id FROM team) AND dst IN (SELECT doc_id FROM team)
 UNION SELECT doc_id, '#' || lower(lang) FROM team UNION SELECT doc_id, '#' || lower(source) FROM team)"""


def _similar(doc: str) -> str:
    return f"""sim AS (SELECT o.doc_id, count(m.element) AS shared, round(count(m.element) / (count(*) + (SELECT count(*) FROM sig WHERE doc_id = '{doc}') - count(m.element)), 9) AS score FROM sig o
 LEFT JOIN (SELECT element FROM sig WHERE doc_id = '{doc}') m ON o.element = m.element WHERE o.doc_id <> '{doc}' GROUP BY 1 HAVING count(m.element) > 0 ORDER BY score DESC, shared DESC, o.doc_id LIMIT 6)"""


_P = "coalesce(path, '')"
_WS = "' ' || chr(9) || chr(10) || chr(13)"

ORACLES = {
    "path_rules": f"""WITH {_V} SELECT n, CASE WHEN nfc_normalize(path) = '' OR regexp_matches(path, '(^|/)\\.') OR length(path) > 1024 THEN NULL ELSE nfc_normalize(path) END AS stored,
        regexp_matches({_P}, '\\.md$') AND NOT regexp_matches({_P}, '(^|/)[_.]') AND NOT contains({_P}, '(conflict') AS reactable,
        regexp_matches({_P}, '\\.md$') AND NOT regexp_matches({_P}, '(^|/)[_.]') AND NOT contains({_P}, '(conflict') AND (starts_with({_P}, 'fr/') OR starts_with({_P}, 'src2/')) AS in_folders,
        regexp_matches({_P}, '\\.(md|png)$') AND NOT regexp_matches({_P}, '(^|/)\\.') AS syncable, regexp_matches({_P}, '(^|/)\\.') AS hidden, starts_with({_P}, '_members/') AS member, starts_with({_P}, '_agent/') AS proposal,
        regexp_matches({_P}, '(^|/)[_.]') AS bookkeeping, CASE WHEN starts_with(path, '_personal/') THEN split_part(path, '/', 2) END AS owner, CASE WHEN starts_with(path, '_personal/') THEN split_part(path, '/', 3) || '/' || split_part(path, '/', 4) END AS rest,
        CASE WHEN starts_with(path, '_members/') THEN split_part(path, '/', 3) || '/' || split_part(path, '/', 4) END AS remarked FROM v""",
    "enqueued_reactions": f"WITH {_V} SELECT n FROM v WHERE NOT deleted AND author IS DISTINCT FROM 'src7' AND size >= 400 AND regexp_matches(path, '\\.md$') AND NOT regexp_matches(path, '(^|/)[_.]') AND NOT contains(path, '(conflict')",
    "folder_listing": f"WITH {_V} SELECT n, path FROM v WHERE starts_with(path, 'fr/') ORDER BY path, n LIMIT 200",
    "ownership": f"""WITH {_V} SELECT n, coalesce(author_sub = 'fr' OR (author_sub = '' AND author = 'src3'), false) AS by_sub, coalesce(author = 'src3', false) AS by_name, coalesce(author_sub = 'es', false) OR coalesce(lang = 'de', false) AS addressed,
        concat_ws('-', author, lang) AS segment FROM v""",
    "status_weights": f"""WITH {_V} SELECT coalesce(status = 'outdated', false) OR coalesce(starts_with(folder, 'Archive/'), false) AS outdated, CASE WHEN status = 'In Dev' THEN 0.05::DOUBLE WHEN status IN ('closed', ' Done ') THEN -0.05::DOUBLE ELSE 0::DOUBLE END AS boost, count(*) AS n FROM v GROUP BY 1, 2""",
    "numeric_terms": "SELECT lang, count_if(list_contains(string_split_regex(coalesce(text, ''), '[^0-9]+'), '12')) AS alone, count_if(contains(coalesce(text, ''), '12')) AS anywhere FROM documents GROUP BY 1",
    "content_dates": f"""WITH {_V} SELECT n, coalesce(CASE WHEN n % 3 = 0 THEN CASE WHEN n % 40 BETWEEN 1 AND 20 THEN try_cast('2025-03-' || lpad((n % 40)::VARCHAR, 2, '0') AS DATE) END END,
        try_cast(date AS DATE), make_timestamp_ms(mtime)::DATE) AS at FROM v""",
    "resolved_links": f"WITH {_RESOLVED} SELECT src, link, dst, how FROM resolved",
    "link_ways": f"WITH {_RESOLVED} SELECT how, count(*) AS n, count(DISTINCT dst) AS targets FROM resolved GROUP BY 1",
    "link_totals": f"""WITH f AS (SELECT {LAYOUT['filename']} AS filename, {LINKS[0]} AS a, {LINKS[3]} AS b, CASE doc_id % 3 WHEN 0 THEN lang || '.png' WHEN 1 THEN 'none.jpg' ELSE 'note' END AS e FROM documents WHERE doc_id IS NOT NULL), g AS (SELECT * FROM f WHERE ends_with(filename, '.md')),
        i AS (SELECT DISTINCT lang || '.png' AS name FROM documents WHERE lang IN ('fr', 'de')), stem AS (SELECT replace(filename, '.md', '') AS s FROM g), w AS (SELECT unnest([a, b]) AS x FROM g WHERE e IS NOT NULL),
        u AS (SELECT CASE WHEN e = 'note' THEN 'bad_bangs' WHEN e IN (SELECT name FROM i) THEN 'ok_images' ELSE 'broken_images' END AS kind FROM g WHERE e IS NOT NULL UNION ALL SELECT 'broken_docs' FROM w WHERE x NOT IN (SELECT s FROM stem) UNION ALL SELECT 'files' FROM g)
        SELECT kind, count(*) AS n FROM u GROUP BY 1""",
    "similar_surroundings": f"WITH {_SIG}, {_similar('doc-7')} SELECT * FROM sim",
    "document_surroundings": f"""WITH {_SIG}, {_similar('doc-8')}, d AS (SELECT doc_id AS other, path FROM v) SELECT 'similar' AS kind, doc_id AS other FROM sim
        UNION ALL SELECT 'linked_from', other FROM e JOIN d ON src = other WHERE dst = 'doc-8' AND {_TEAM} UNION ALL SELECT 'links_to', other FROM e JOIN d ON dst = other WHERE src = 'doc-8' AND {_TEAM}
        UNION ALL SELECT 'proposal', other FROM e JOIN d ON src = other WHERE dst = 'doc-8' AND starts_with(path, '_agent/')
        UNION ALL SELECT 'remark', other FROM d WHERE regexp_extract(path, '^_members/[^/]+/(.+)$', 1) = (SELECT path FROM v WHERE doc_id = 'doc-8')""",
    "remarks": f"""WITH {_V}, a AS (SELECT n, path, lang FROM v WHERE path IS NOT NULL), b AS (SELECT n AS doc_id, path FROM a UNION ALL SELECT -n - 1, '_members/' || lang || '/' || path FROM a WHERE n % 2 = 0)
        SELECT t.doc_id, m.doc_id AS note_id, split_part(m.path, '/', 2) AS member FROM b m JOIN b t ON m.path = '_members/' || split_part(m.path, '/', 2) || '/' || t.path""",
    "author_documents": f"""WITH {_V}, p AS (SELECT DISTINCT source AS sub FROM v WHERE source IS NOT NULL AND path IS NOT NULL) SELECT sub, (SELECT count(*) FROM v WHERE source = sub AND NOT deleted AND path NOT LIKE '\\_%' ESCAPE '\\') AS docs FROM p""",
    "standing_hits": f"WITH {_V} SELECT vec_id AS doc_id, label FROM embeddings WHERE vec_id IN (SELECT n FROM v WHERE NOT deleted AND NOT starts_with(path, '_personal/'))",
    "related_seeds": f"""WITH d AS (SELECT doc_id, lower(regexp_replace({LAYOUT['filename']}, '\\.md$', '')) AS key, n_chars, {LINKS[0]} AS r2, 'n' || ((doc_id + 9) // 3) AS r1 FROM documents WHERE doc_id IS NOT NULL),
        s AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM d QUALIFY place <= 8), w AS (SELECT place, 1 AS pos, n_chars, r1 AS key FROM s WHERE place <= 5 UNION ALL SELECT place, 2, n_chars, r2 FROM s WHERE place <= 5),
        m AS (SELECT (SELECT min(doc_id) FROM d WHERE d.key = w.key) AS doc_id, n_chars, place, pos FROM w), x AS (SELECT * FROM m WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM s) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place, pos) = 1)
        SELECT doc_id, round(n_chars / 1000, 6) AS score, false AS added FROM s UNION ALL SELECT doc_id, round(round(n_chars / 1000, 6) * 0.7::DOUBLE, 9), true FROM x""",
    "two_tracks": """WITH a AS (SELECT doc_id, round(n_chars / 1000, 6) AS score FROM documents WHERE lang <> 'es' ORDER BY score DESC, doc_id LIMIT 32), b AS (SELECT doc_id, round(n_chars / 1000, 6) AS score FROM documents WHERE lang IN ('es', 'fr') ORDER BY score DESC, doc_id LIMIT 4)
        SELECT doc_id, score, 'own' AS track FROM a UNION ALL SELECT doc_id, score, 'outside' FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)""",
    "metadata_filtered": "WITH h AS (SELECT doc_id, coalesce(source = 'src3', false) OR coalesce(lang = 'fr', false) AS hit FROM documents), c AS (SELECT count_if(hit) >= greatest(50, ceil(count(*) * 0.05)) AS ok FROM h) SELECT doc_id FROM h, c WHERE hit OR NOT ok",
    "narrow_metadata_filter": "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
    "run_log": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1 ORDER BY day DESC LIMIT 30",
    "due_routines": """WITH l AS (SELECT user_id, floor(epoch(max(ts))) AS last FROM events GROUP BY 1), n AS (SELECT floor(epoch(max(ts))) AS now FROM events)
        SELECT user_id, coalesce(user_id % 5 <> 0 AND user_id % 3 <> 2 AND now - last >= CASE WHEN user_id % 3 = 0 THEN 77760 ELSE 544320 END, false) AS due, coalesce(user_id % 5 <> 0, false) AS forced FROM l, n""",
    "previous_content": """WITH r AS (SELECT o_custkey AS path, o_orderkey AS seq, o_orderpriority AS etag, last_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS live FROM orders)
        SELECT path, seq, etag FROM r WHERE etag <> live QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1""",
    "patched_counts": "SELECT CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE lang END AS lang, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1",
    "web_context": """WITH s AS (SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, page_id, 23 + sum(length(html)) OVER (PARTITION BY lower(regexp_extract(url, '://([^/?#]*)', 1)) ORDER BY page_id ROWS UNBOUNDED PRECEDING) AS used FROM pages)
        SELECT host, page_id FROM s WHERE used <= 20000""",
    "asked": f"""WITH a AS (SELECT conv_id, turn, trim(regexp_extract(coalesce(text, ''), '^([^ \\n]+(?: [^ \\n]+)?)', 1), {_WS}) AS body FROM conversations), b AS (SELECT *, CASE turn % 5 WHEN 3 THEN body || ',' WHEN 2 THEN trim(body || ' latest') ELSE body END AS c0 FROM a),
        c AS (SELECT *, CASE WHEN c0 = '' THEN CASE turn % 5 WHEN 0 THEN '분석해줘' WHEN 1 THEN '보고서 만들어줘' ELSE c0 END ELSE c0 END AS cleaned FROM b)
        SELECT conv_id, turn, cleaned, CASE WHEN turn % 5 = 0 THEN '분석' END AS verb, CASE WHEN turn % 5 = 0 OR length(cleaned) > 15 OR length(cleaned) - length(replace(cleaned, ' ', '')) > 2 OR regexp_matches(cleaned, '[?!.？！。]') THEN 'complex' ELSE 'simple' END AS weight,
        regexp_matches(lower(body), 'latest|recent') OR turn % 5 = 2 AS recency, regexp_matches(body, '(?i)^overview($|[?.!,])') AS overview,
        CASE turn % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 3 THEN true ELSE length(CASE WHEN turn % 5 = 2 THEN trim(body || ' latest') ELSE body END) >= 2 END AND length(body) < 70
        AND NOT regexp_matches(CASE WHEN turn % 5 IN (0, 1, 2) THEN body || ' x' WHEN turn % 5 = 3 THEN body || ', x' ELSE body END, '[.!?]\\s|[.!?]$|\\*\\*') AS keyword FROM c""",
    "refinable_documents": "SELECT doc_id FROM documents WHERE (CASE WHEN doc_id % 2 = 0 THEN length(text) + 34 ELSE length(text) END) >= 100 AND (doc_id % 2 = 1 OR doc_id % 30 + 1 < 15)",
    "trimmed_posts": f"""WITH a AS (SELECT conv_id, turn, turn % 7 AS k, trim(coalesce(text, ''), {_WS}) AS t FROM conversations), p AS (SELECT *, CASE WHEN k BETWEEN 1 AND 5 THEN t ELSE '[intensity:' || k || '] ' || t END AS b FROM a),
        q AS (SELECT *, trim(b, {_WS}) AS c, reverse(left(trim(b, {_WS}), 280)) AS back FROM p), m AS (SELECT *, length(regexp_extract(back, '^[^.!?]*')) AS tail FROM q)
        SELECT conv_id, turn, CASE WHEN k BETWEEN 1 AND 5 THEN k::INT END AS intensity, CASE WHEN turn % 2 = 0 THEN 'neutral' END AS stance, CASE WHEN length(c) <= 280 THEN c WHEN 280 - tail > 101 THEN left(c, 280 - tail) ELSE rtrim(left(c, 280), {_WS}) || '...' END AS post FROM m""",
    "described_images": f"SELECT doc_id FROM documents WHERE length(trim(regexp_extract(coalesce(text, ''), '^([^\\s]*(?: [^\\s]+){{0,3}})', 1), {_WS})) >= 20",
    "priority_documents": f"WITH {_V}, p AS (SELECT n, mtime, CASE n % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS priority FROM v) SELECT n, priority FROM p ORDER BY priority, mtime DESC LIMIT 20",
    "document_domains": "SELECT source, CASE doc_id % 4 WHEN 0 THEN 'narrative' WHEN 1 THEN 'system' ELSE 'general' END AS domain, count(*) AS n FROM documents GROUP BY 1, 2",
    "vector_documents": "SELECT label, count(DISTINCT vec_id) AS documents, count(*) AS vectors FROM embeddings GROUP BY 1",
    "contents_page": f"WITH {_V} SELECT n, path, length(text) AS size FROM v WHERE NOT deleted AND n > 25 ORDER BY n LIMIT 100",
    "recent_documents": f"WITH {_V} SELECT folder, count(*) AS n FROM v WHERE mtime >= (SELECT max(mtime) FROM v) - 2592000000 GROUP BY 1",
}
