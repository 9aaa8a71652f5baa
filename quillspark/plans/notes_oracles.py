"""The notes' queries once more, in DuckDB SQL over the same layout."""

from __future__ import annotations

from quillspark.plans.notes import BODY, GONE, HALF, KNOWN, LATER, MTIME, NOW, PATH, lined

_DOC = f"""f AS (SELECT *, {PATH} AS path, {MTIME} AS mtime, {lined(BODY)} AS body, {HALF} AS half, {LATER} AS later, {GONE} AS gone FROM documents WHERE {KNOWN}),
 g AS (SELECT *, ltrim(replace(replace(path, '.md', ''), '/', '_'), '_') AS s, lower(replace(regexp_extract(path, '[^/]*$'), '.md', '')) AS key FROM f),
 p AS (SELECT * EXCLUDE (doc_id), doc_id AS k, s || CASE WHEN row_number() OVER (PARTITION BY s ORDER BY path) > 1 THEN '_' || row_number() OVER (PARTITION BY s ORDER BY path) ELSE '' END AS id FROM g)"""
_GRAPH = f"""{_DOC}, own AS (SELECT * FROM p WHERE NOT starts_with(path, '_reports/')), byname AS (SELECT key, arg_min(id, path) AS dst FROM own GROUP BY 1),
 l AS (SELECT id AS src, unnest([half, later || '|alias', 'n' || k || '#x'] || CASE WHEN k % 7 < 5 THEN [gone] ELSE [] END) AS label FROM own), m AS (SELECT src, lower(regexp_replace(label, '[|#].*$', '')) AS key, label, dst FROM l LEFT JOIN byname ON lower(regexp_replace(label, '[|#].*$', '')) = byname.key),
 edges AS (SELECT src, dst, count(*) AS refs FROM m WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2), ghosts AS (SELECT key AS target, src AS referrer, min(label) AS label FROM m WHERE dst IS NULL GROUP BY 1, 2)"""
_PHANTOMS = "SELECT 'phantom-hot' AS rule, 'error' AS severity, target AS doc_id, count(DISTINCT referrer)::DOUBLE AS score FROM ghosts GROUP BY target HAVING count(DISTINCT referrer) >= 3"
_ORPHANS = """SELECT 'orphan' AS rule, 'warn' AS severity, id AS doc_id, (SELECT count(*) FROM ghosts WHERE referrer = id)::DOUBLE AS score FROM own WHERE id NOT IN (SELECT src FROM edges WHERE ends_with(dst, '1')) AND id NOT IN (SELECT dst FROM edges WHERE ends_with(dst, '1'))"""
_HUBS = f"""SELECT 'stale-hub' AS rule, 'warn' AS severity, id AS doc_id, (({NOW} - mtime) // 86400000)::DOUBLE AS score FROM own WHERE ({NOW} - mtime) // 86400000 >= 90 AND id IN
 (SELECT coalesce(o.src, i.dst) FROM (SELECT DISTINCT src FROM edges) o FULL JOIN (SELECT dst, count(DISTINCT src) AS n FROM edges GROUP BY 1) i ON o.src = i.dst ORDER BY coalesce(n, 0) DESC, 1 LIMIT (SELECT greatest(3, ceil(count(*) * 0.1))::BIGINT FROM own))"""
_EXC = "CASE WHEN length(body) <= {0} THEN body ELSE rtrim(body[1:{0}], ' ') END"


ORACLES = {
    "parsed_notes": f"""WITH {_DOC} SELECT path, id AS doc_id, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS folder, key, 'T' || k AS title, '2024-0' || (1 + k % 9) || '-05' AS date, 'active' AS status,
        CASE WHEN k % 6 = 0 THEN 'skip' END AS graph_weight, CASE WHEN k % 4 = 0 THEN 'ann' ELSE 'unknown' END AS speaker, lang || ';' || source AS tags,
        half || ';' || later || '|alias;' || CASE WHEN k % 7 < 5 THEN gone || ';' ELSE '' END || 'n' || k || '#x' AS links, 'pic' || k % 3 || '.png' AS images, length(body) AS n_body FROM p""",
    "note_sections": f"""WITH {_DOC}, r AS (SELECT id AS doc_id, unnest([0, 1, 2, 3]) AS pos, half, later, gone, k FROM p) SELECT doc_id, pos::INT AS pos, doc_id || CASE pos WHEN 0 THEN '_head_' || k % 5 WHEN 1 THEN '_part' WHEN 2 THEN '_part_2' ELSE '_deep_one' END AS section_id,
        CASE pos WHEN 0 THEN 'Head ' || k % 5 WHEN 3 THEN 'Deep One' ELSE 'Part' END AS heading, CASE pos WHEN 0 THEN 'About [[' || half || ']] and [[' || later || '|alias]], ![[pic' || k % 3 || '.png]]' WHEN 1 THEN 'some words, more words'
        WHEN 2 THEN CASE WHEN k % 7 < 5 THEN '[[' || gone || ']]' ELSE 'plain' END ELSE '[[n' || k || '#x]]' END AS body, (CASE pos WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN k % 7 < 5 THEN 1 ELSE 0 END ELSE 1 END)::INT AS links FROM r""",
    "note_chapters": f"WITH {_DOC} SELECT unnest(['(intro)', 'Part', 'Part']) AS heading, id || unnest(['_intro', '_part', '_part_2']) AS section_id, 1::BIGINT AS n FROM p",
    "note_links": f"WITH {_GRAPH} SELECT src, dst, refs FROM edges",
    "note_phantoms": f"WITH {_GRAPH} SELECT target, referrer, label FROM ghosts",
    "note_degrees": f"""WITH {_GRAPH}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node, (SELECT count(*) FROM edges WHERE src = node) AS out_degree, coalesce((SELECT sum(refs) FROM edges WHERE src = node), 0)::BIGINT AS refs_out,
        (SELECT count(*) FROM edges WHERE dst = node) AS in_degree, coalesce((SELECT sum(refs) FROM edges WHERE dst = node), 0)::BIGINT AS refs_in FROM n""",
    "lint_phantoms": f"WITH {_GRAPH} {_PHANTOMS}",
    "lint_orphans": f"WITH {_GRAPH} {_ORPHANS}",
    "lint_stale_hubs": f"WITH {_GRAPH} {_HUBS}",
    "lint_thin_bridges": f"""WITH {_GRAPH}, e AS (SELECT src, dst FROM edges WHERE ends_with(src, '7') AND ends_with(dst, '3')), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)
        SELECT 'bridge-spof' AS rule, 'warn' AS severity, src AS doc_id, count(DISTINCT CASE WHEN split_part(dst, '_', 1) <> split_part(src, '_', 1) THEN split_part(dst, '_', 1) END)::DOUBLE AS score FROM b WHERE NOT ends_with(src, '17') GROUP BY src HAVING count(*) <= 2 AND score > 0""",
    "lint_near_duplicates": f"""WITH {_GRAPH} SELECT 'near-duplicate' AS rule, 'warn' AS severity, least(dst, src || 'x') AS doc_id, 0.95::DOUBLE AS score FROM (SELECT DISTINCT src, dst FROM edges)""",
    "lint_cluster_drift": f"""WITH r AS (SELECT lang, source, count(*) AS n FROM documents WHERE {KNOWN} AND doc_id % 9 <> 0 GROUP BY 1, 2), a AS (SELECT lang, sum(n) AS n FROM r GROUP BY 1), b AS (SELECT source, sum(n) AS n FROM r GROUP BY 1)
        SELECT 'cluster-drift' AS rule, 'warn' AS severity, lang AS doc_id, round(1 - max(r.n / (a.n + b.n - r.n)), 6)::DOUBLE AS score FROM r JOIN a USING (lang) JOIN b USING (source) GROUP BY lang, a.n HAVING a.n >= 5 AND max(r.n / (a.n + b.n - r.n)) < 0.6""",
    "findings_by_rule": f"WITH {_GRAPH}, x AS ({_PHANTOMS} UNION ALL {_ORPHANS} UNION ALL {_HUBS}) SELECT severity, NULL AS rule, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT NULL, rule, count(*) FROM x GROUP BY 2 UNION ALL SELECT NULL, NULL, count(*) FROM x",
    "recall_bundle": f"""WITH {_GRAPH}, d AS (SELECT lang || '_n' || doc_id AS id, n_chars::DOUBLE AS score, 'About ' || source AS title, source, regexp_replace(text, '\\n+', chr(10), 'g') AS body FROM documents WHERE {KNOWN} AND doc_id % 23 <> 0 AND doc_id % 10 <> 0),
        c AS (SELECT id, score FROM d ORDER BY score DESC, id LIMIT 5), b AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), t AS (SELECT dst AS id, count(*) AS touched FROM b WHERE src IN (SELECT id FROM c) GROUP BY 1),
        n AS (SELECT t.id, 2 * touched + 3 * CASE WHEN source = 'src3' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + 0.2::DOUBLE * least((SELECT count(*) FROM b WHERE src = t.id), 5) AS score FROM t JOIN d ON t.id = d.id WHERE t.id NOT IN (SELECT id FROM c) ORDER BY score DESC, t.id LIMIT 5),
        r AS (SELECT 'core' AS role, row_number() OVER (ORDER BY score DESC, id) AS place, id, score FROM c UNION ALL SELECT 'around', row_number() OVER (ORDER BY score DESC, id), id, score FROM n)
        SELECT role, place::INT AS place, r.id AS doc_id, title, round(r.score, 6) AS score, CASE role WHEN 'core' THEN {_EXC.format(2080)} ELSE {_EXC.format(1120)} END AS excerpt FROM r JOIN d ON r.id = d.id""",
    "version_survivors": """WITH h AS (SELECT doc_id, doc_id // 4 AS g, doc_id % 4 AS m FROM documents WHERE doc_id IS NOT NULL AND doc_id % 3 <> 2) SELECT doc_id, 'plan' || g || 'x' || CASE m WHEN 0 THEN ' v1' WHEN 1 THEN '_v2.5' WHEN 2 THEN ' Final' ELSE '' END AS name FROM h
        QUALIFY row_number() OVER (PARTITION BY g ORDER BY CASE m WHEN 2 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END, doc_id) = 1""",
    "tag_peers": f"""WITH d AS (SELECT doc_id, lang || lpad(doc_id::VARCHAR, 9, '0') AS title, lang, source FROM documents WHERE {KNOWN}), a AS (SELECT a.doc_id, b.doc_id AS peer FROM d a JOIN d b ON a.doc_id <> b.doc_id AND (a.lang = b.lang OR a.source = b.source)
        QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY b.title DESC, b.doc_id) <= 8) SELECT doc_id, string_agg(peer::VARCHAR, ',' ORDER BY peer) AS peers FROM a GROUP BY 1""",
    "month_links": f"""WITH d AS (SELECT 'T' || doc_id AS title, '2024-0' || (1 + doc_id % 9) AS month FROM documents WHERE {KNOWN}) SELECT month, count(*) AS n, '## ' || month || chr(10) || string_agg('- [[' || title || ']] ' || month || '-05', chr(10) ORDER BY title DESC) AS markdown FROM d GROUP BY 1""",
    "hubs_and_spokes": f"""WITH {_DOC}, x AS (SELECT path, replace(path, '.md', '') AS stem, regexp_extract(replace(path, '.md', ''), '[^/]*$') AS base, string_split(body, '## Part' || chr(10)) AS c, body FROM p), y AS (SELECT * FROM x WHERE NOT ends_with(path, '9.md'))
        SELECT path, body FROM x WHERE ends_with(path, '9.md') UNION ALL SELECT path, c[1] || '- [[' || base || '__01]]' || chr(10) || '- [[' || base || '__02]]' || chr(10) FROM y UNION ALL SELECT stem || '__01.md', '## Part' || chr(10) || c[2] FROM y UNION ALL SELECT stem || '__02.md', '## Part' || chr(10) || c[3] FROM y""",
    "keyword_links": f"WITH {_DOC} SELECT path, regexp_replace(replace(body, 'some words', '[[some]] words'), '\\bwords', '[[Wordbook|words]]') AS body FROM p",
    "repaired_links": f"SELECT doc_id, 'see [[' || lang || ']] or [[' || source || ']]' AS body FROM documents WHERE {KNOWN}",
    "ghost_targets": f"""WITH g AS (SELECT DISTINCT 'page' || doc_id AS ghost FROM documents WHERE {KNOWN}), t AS (SELECT 'page' || doc_id || 'a' AS key FROM documents WHERE {KNOWN} AND doc_id % 3 = 0)
        SELECT ghost, min(key) AS target FROM g JOIN t ON starts_with(key, ghost) OR starts_with(ghost, key) GROUP BY 1 HAVING count(*) = 1""",
}
