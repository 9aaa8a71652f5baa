"""The registered queries once more, in DuckDB SQL."""

from __future__ import annotations

from quillspark.plans import contexts, histories, index, notes_oracles, ranking, streams, upkeep, vault_oracles
from quillspark.plans.catalog import TERMS

_T = "', '".join(TERMS)
#: Tokens of a text that has no Hangul, as the tables' texts haven't.
TOKENS = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda x: length(x) > 1)"

_BM25 = f"""
d AS (SELECT doc_id, source, {TOKENS} AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
q AS (SELECT unnest(['{_T}']) AS q),
df AS (SELECT q, (SELECT count(*) FROM d WHERE list_contains(t, q)) AS df FROM q),
tf AS (SELECT doc_id, len(t) AS dl, q, len(list_filter(t, lambda x: x = q)) AS tf FROM d, q),
w AS (SELECT doc_id, dl, tf.q, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM tf JOIN df USING (q), st WHERE tf > 0)"""


def _bm25(b: float, tf: str, scale: str = "", k: int = 10) -> str:
    return f"""WITH {_BM25}, cap AS (SELECT sum(2.5 * ln(1 + (n - df + 0.5) / (df + 0.5))) AS cap FROM df, st WHERE df > 0),
    s AS (SELECT doc_id, sum(idf * {tf} * 2.5 / ({tf} + 1.5 * ({1 - b} + {b} * dl / avgdl))) AS s, count(*) AS m FROM w GROUP BY doc_id)
    SELECT doc_id, round({scale or 's'}, 6) AS score FROM s, cap ORDER BY score DESC, doc_id LIMIT {k}"""


def _sum(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def _occ(q: str) -> str:
    return f"((length(body) - length(replace(body, '{q}', ''))) // {len(q)})"


_LOW = "low AS (SELECT doc_id, lower(source) AS name, lower(coalesce(text, '')) AS body FROM documents)"
_VEC = """
e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS nv FROM e),
pair AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_dot_product(a.v, b.v) / (a.nv * b.nv), 6) AS score FROM u a, u b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair WHERE score > 0)"""
_HREF = "h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages)"
_TRADE = """
trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS refs FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
strong AS (SELECT * FROM trade WHERE refs > (SELECT avg(refs) FROM trade)),
near AS (SELECT src, dst FROM strong UNION SELECT dst, src FROM strong)"""


def _pagerank(links: str, n: int, final: str) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT n_nationkey AS node, 1.0::DOUBLE / (SELECT count(*) FROM nation) AS score FROM nation)"]
    for k in range(n):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT r.node, 0.15 / c.n + 0.85 * (coalesce(f.flow, 0) + (SELECT coalesce(sum(score), 0) FROM r{k} WHERE node NOT IN (SELECT src FROM {links})) / c.n) AS score"
            f" FROM r{k} r CROSS JOIN (SELECT count(*) AS n FROM nation) c LEFT JOIN (SELECT l.dst, sum(p.score / o.fan) AS flow FROM (SELECT DISTINCT src, dst FROM {links}) l"
            f" JOIN (SELECT src, count(DISTINCT dst) AS fan FROM {links} GROUP BY src) o ON l.src = o.src JOIN r{k} p ON p.node = l.src GROUP BY l.dst) f ON f.dst = r.node)"
        )
    return f"WITH {_TRADE}, {', '.join(steps)} {final.format(r=f'r{n}')}"


def _ppr(n: int = 20) -> str:
    steps = [
        "both_ways AS (SELECT src, dst, refs::DOUBLE AS w FROM strong UNION ALL SELECT dst, src, refs::DOUBLE FROM strong)",
        "share AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS s FROM both_ways)",
        "seed AS (SELECT * FROM (VALUES (0, 1.0 / 1.5), (7, 0.5 / 1.5)) v(node, p))",
        "p0 AS MATERIALIZED (SELECT node, p::DOUBLE AS score FROM seed)",
    ]
    for k in range(n):
        steps.append(
            f"p{k + 1} AS MATERIALIZED (SELECT coalesce(f.node, seed.node) AS node, 0.4 * coalesce(p::DOUBLE, 0) + 0.6 * coalesce(flow, 0) AS score"
            f" FROM (SELECT dst AS node, sum(score * s) AS flow FROM share JOIN p{k} ON src = node GROUP BY dst) f FULL JOIN seed ON f.node = seed.node)"
        )
    return f"WITH {_TRADE}, {', '.join(steps)} SELECT node, round(score, 9) AS score FROM p{n}"


_LOG = """log AS (SELECT o_custkey AS path, o_orderkey AS seq, md5(o_orderpriority || ':' || o_orderkey) AS etag, o_orderstatus = 'F' AS deleted, o_orderdate AS day FROM orders),
last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)"""
_FLAGS = """count(*) AS total, count_if(n < 50) AS stub, count_if(n >= 50 AND n < 300) AS thin, count_if(NOT contains(t, '[[')) AS no_link,
 count_if(NOT regexp_matches(t, '(?m)^#{1,3} ')) AS no_heading, count_if(NOT starts_with(t, '---' || chr(10))) AS no_frontmatter, count_if(n > 20000) AS long, count_if(contains(t, chr(10))) AS multiline"""

ORACLES = {
    "bm25_topk": _bm25(0.75, "least(tf, 255)"),
    "bm25_server_topk": _bm25(0.55, "tf", f"s * sqrt(m::DOUBLE / {len(TERMS)})"),
    "bm25_app_topk": _bm25(0.75, "tf", f"least(s * sqrt(m::DOUBLE / {len(TERMS)}) / (1.1 * cap), 1.0)"),
    "tfidf_bot_topk": f"""WITH {_LOW}, s AS (SELECT doc_id, {_sum([
        f"(SELECT ln(1 + (count(*) - count_if(contains(body, '{q}')) + 0.5) / (count_if(contains(body, '{q}')) + 0.5)) FROM low) * (CASE WHEN contains(name, '{q}') THEN 3.0 ELSE 0.0 END + least(0.5 * {_occ(q)}, 3.0))" for q in TERMS])} AS s FROM low)
        SELECT doc_id, round(s, 6) AS score FROM s WHERE s > 0 ORDER BY score DESC, doc_id LIMIT 10""",
    "direct_search": f"""WITH {_LOW}, c AS (SELECT doc_id, {_sum([f"contains(name, '{q}')::INT" for q in ["src1", *TERMS]])} / 5.0::DOUBLE AS a, {_sum([f"contains(body, '{q}')::INT" for q in ["src1", *TERMS]])} / 5.0::DOUBLE AS b FROM low),
        s AS (SELECT doc_id, CASE WHEN a > 0 THEN 0.3 + 0.7 * (0.6 * a + 0.4 * b) ELSE 0.6 * a + 0.4 * b END AS s FROM c)
        SELECT doc_id, round(s::DOUBLE, 6) AS score FROM s WHERE s > 0 ORDER BY score DESC, doc_id LIMIT 20""",
    "keyword_fallback": f"""WITH {_LOW}, c AS (SELECT doc_id, {_sum([f"(CASE WHEN contains(name, '{q}') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {_occ(q)} > 0 THEN 0.1::DOUBLE * (1 + ln({_occ(q)})) ELSE 0 END)" for q in ["src2", *TERMS]])} AS s,
        {_sum([f"(contains(name, '{q}') OR {_occ(q)} > 0)::INT" for q in ["src2", *TERMS]])} / 5.0::DOUBLE AS cover FROM low)
        SELECT doc_id, round(0.6::DOUBLE * least(s, 1.0) + 0.4::DOUBLE * cover, 6) AS score FROM c WHERE cover > 0 ORDER BY score DESC, doc_id LIMIT 20""",
    "doc_freq": f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term",
    "doc_len_stats": f"WITH d AS (SELECT len({TOKENS}) AS dl FROM documents) SELECT count(*) AS n, sum(dl)::BIGINT AS tokens, max(dl) AS longest, round(avg(dl), 6) AS avgdl FROM d",
    "vocab_top": f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM t GROUP BY term ORDER BY cf DESC, term LIMIT 50",
    "source_keywords": f"""WITH t AS (SELECT doc_id, source, unnest({TOKENS}) AS term FROM documents), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term),
        s AS (SELECT source, term, count(*) AS tf FROM t GROUP BY 1, 2), r AS (SELECT source, s.term, round(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 6) AS score FROM s JOIN df ON s.term = df.term)
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM r QUALIFY rank <= 10""",
    "corpus_fingerprint": "SELECT count(*) AS n, sum(('0x' || substr(md5(doc_id || ':' || n_chars), 1, 8))::BIGINT)::BIGINT AS fingerprint FROM documents",
    "exact_duplicates": "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "vector_topk": f"WITH {_VEC} SELECT query_id, vec_id, score, rank FROM best WHERE rank <= 10",
    "label_centroids": "WITH c AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) SELECT label, dim::INT AS dim, round(avg(x::DOUBLE), 6) AS mean FROM c GROUP BY 1, 2",
    "maxpool_label": f"WITH {_VEC} SELECT query_id, label, max(score) AS score FROM best GROUP BY 1, 2",
    "rrf_fusion": f"""WITH {_BM25}, {_VEC}, s AS (SELECT doc_id, round(sum(idf * least(tf, 255) * 2.5 / (least(tf, 255) + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS s FROM w GROUP BY doc_id),
        a AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM s QUALIFY r <= 50), b AS (SELECT vec_id AS doc_id, rank AS r FROM best WHERE query_id = 0 AND rank <= 50)
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 9) AS score, a.r IS NOT NULL AS lexical, b.r IS NOT NULL AS semantic FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "hotness_rerank": f"""WITH {_BM25}, s AS (SELECT doc_id, sum(idf * least(tf, 255) * 2.5 / (least(tf, 255) + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM w GROUP BY doc_id),
        u AS (SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY 1), now AS (SELECT max(ts) AS now FROM events), m AS (SELECT max(s) AS m FROM s),
        r AS (SELECT doc_id, m * (0.85 * s / m + 0.15 * coalesce(1 / (1 + exp(-ln(1 + n))) * pow(0.5, greatest((floor(epoch(now)) - floor(epoch(last))) / 86400.0, 0) / 7.0), 0)) AS x FROM s LEFT JOIN u ON doc_id = user_id, now, m)
        SELECT doc_id, round(x, 6) AS score FROM r ORDER BY score DESC, doc_id LIMIT 20""",
    "session_search": f"WITH s AS (SELECT conv_id, turn, {_sum([f'''contains(lower(coalesce(text, '')), '{q}')::INT''' for q in TERMS])} / 4.0::DOUBLE AS score FROM conversations) SELECT * FROM s WHERE score > 0",
    "context_terms": f"WITH t AS (SELECT DISTINCT conv_id, turn, unnest({TOKENS}) AS term FROM conversations WHERE role = 'user') SELECT conv_id, term, count(*) AS turns FROM t WHERE length(term) > 3 GROUP BY 1, 2 HAVING count(*) >= 2",
    "pmi_synonyms": f"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL), s AS (SELECT row_number() OVER () AS i, list_distinct({TOKENS}) AS t FROM l),
        h AS (SELECT i, unnest(t) AS term FROM s WHERE len(t) >= 2), n AS (SELECT count(DISTINCT i) AS n FROM h), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1 HAVING count(*) >= 3),
        r AS (SELECT i, h.term, df FROM h JOIN df ON h.term = df.term QUALIFY row_number() OVER (PARTITION BY i ORDER BY df, h.term) <= 60),
        p AS (SELECT a.term AS a, b.term AS b, a.df AS da, b.df AS db, count(*) AS c FROM r a JOIN r b ON a.i = b.i AND a.term < b.term GROUP BY ALL HAVING count(*) >= 3 AND count(*) >= 0.5 * least(a.df, b.df)),
        m AS (SELECT a, b, round(log2(c * n / (da * db)), 6) AS pmi FROM p, n), e AS (SELECT a AS term, b AS synonym, pmi FROM m WHERE pmi >= 2 UNION ALL SELECT b, a, pmi FROM m WHERE pmi >= 2)
        SELECT *, row_number() OVER (PARTITION BY term ORDER BY pmi DESC, synonym) AS rank FROM e QUALIFY rank <= 3""",
    "leak_windows": """WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM benchmark),
        w AS (SELECT item_id, substr(t, unnest(range(1, length(t) - 38, 4)), 40) AS w FROM b WHERE length(t) >= 40)
        SELECT DISTINCT item_id AS private_id, doc_id AS probe_id FROM d, w WHERE contains(t, w)""",
    "similar_documents": f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), m AS (SELECT doc_id, list(term || ' ' || tf ORDER BY term) AS bag FROM p GROUP BY 1),
        r AS (SELECT min(doc_id) AS doc_id FROM m GROUP BY bag), n AS (SELECT count(DISTINCT doc_id) AS n FROM p), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
        w AS (SELECT p.doc_id, p.term, tf * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w FROM p JOIN r ON p.doc_id = r.doc_id JOIN df ON p.term = df.term, n), u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w)
        SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8""",
    "best_line": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
        h AS (SELECT doc_id, pos, {_sum([f"contains(lower(t), '{q}')::BIGINT" for q in TERMS])}::BIGINT AS hits FROM l) SELECT doc_id, pos, hits FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos) = 1""",
    "index_coverage": """WITH c AS (SELECT source, count(*) AS total, count_if(doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)) AS embedded FROM documents GROUP BY 1)
        SELECT source, total, embedded, total - embedded AS pending, embedded >= 0.8::DOUBLE * total AS ready FROM c""",
    "recommended_feed": """WITH post AS (SELECT event_id AS post_id, user_id AS author_id, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS likes FROM events), u AS (SELECT DISTINCT user_id AS reader FROM events),
        f AS (SELECT reader, reader + k AS author_id FROM u, (VALUES (1), (2), (3)) v(k)), own AS (SELECT reader, post_id, row_number() OVER (PARTITION BY reader ORDER BY post_id DESC) AS n FROM f JOIN post USING (author_id)),
        top AS (SELECT post_id, row_number() OVER (ORDER BY likes DESC, post_id) AS n FROM post QUALIFY n <= 10), a AS (SELECT reader, post_id, -n AS at_ FROM own WHERE n <= 20 UNION ALL SELECT reader, post_id, 1000000000 + n FROM u, top),
        o AS (SELECT reader, post_id, min(at_) AS at_ FROM a GROUP BY 1, 2) SELECT reader, post_id, row_number() OVER (PARTITION BY reader ORDER BY at_, post_id) AS place FROM o QUALIFY place <= 15""",
    "page_links": f"WITH {_HREF} SELECT page_id, count(*) AS links, count(DISTINCT target) AS targets FROM h GROUP BY 1",
    "page_inlinks": f"WITH {_HREF} SELECT target, count(DISTINCT page_id) AS referrers FROM h GROUP BY 1",
    "phantom_targets": f"WITH {_HREF} SELECT target, count(DISTINCT page_id) AS referrers FROM h WHERE target NOT IN (SELECT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) FROM pages WHERE url IS NOT NULL) GROUP BY 1 HAVING count(DISTINCT page_id) >= 6",
    "page_titles": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n_html FROM pages",
    "host_pages": "SELECT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, count(*) AS pages, sum(length(html))::BIGINT AS chars FROM pages GROUP BY 1",
    "trade_degrees": f"""WITH {_TRADE}, o AS (SELECT src AS node, count(DISTINCT dst) AS out_degree, sum(refs) AS refs_out FROM strong GROUP BY 1), i AS (SELECT dst AS node, count(DISTINCT src) AS in_degree, sum(refs) AS refs_in FROM strong GROUP BY 1)
        SELECT coalesce(o.node, i.node) AS node, coalesce(out_degree, 0) AS out_degree, coalesce(refs_out, 0)::BIGINT AS refs_out, coalesce(in_degree, 0) AS in_degree, coalesce(refs_in, 0)::BIGINT AS refs_in FROM o FULL JOIN i ON o.node = i.node""",
    "trade_strength": f"WITH {_TRADE} SELECT src, dst, refs, round(0.15::DOUBLE + 0.85::DOUBLE * refs / (SELECT max(refs) FROM trade), 9) AS strength FROM trade",
    "trade_hubs": f"WITH {_TRADE} SELECT src AS node, count(*) AS degree FROM near GROUP BY 1 ORDER BY degree DESC, node LIMIT 5",
    "pagerank_directed": _pagerank("strong", 20, "SELECT node, round(score, 9) AS score FROM {r}"),
    "pagerank_undirected": _pagerank("near", 20, "SELECT node, round(score / (SELECT max(score) FROM {r}), 9) AS score FROM {r}"),
    "personalised_pagerank": _ppr(),
    "part_supplier_components": """WITH RECURSIVE sold AS (SELECT l_orderkey, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem WHERE l_quantity = 50 GROUP BY 1 HAVING min(l_suppkey) <> max(l_suppkey)),
        e AS (SELECT a AS u, b AS v FROM sold UNION SELECT b, a FROM sold), r(node, seen) AS (SELECT u, u FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u) SELECT node, min(seen) AS root FROM r GROUP BY node""",
    "bfs_hops": f"""WITH RECURSIVE {_TRADE}, r(node, hops) AS (SELECT 0, 0 UNION SELECT dst, hops + 1 FROM r JOIN near ON src = node WHERE hops < 3) SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY node""",
    "bridge_nations": f"WITH {_TRADE} SELECT src AS node, count(DISTINCT n_regionkey) AS spans FROM near JOIN nation ON dst = n_nationkey GROUP BY src HAVING count(DISTINCT n_regionkey) >= 2",
    "co_cited_nations": f"""WITH {_TRADE}, c AS (SELECT dst AS node, count(DISTINCT src) AS cited FROM strong WHERE src < 5 GROUP BY 1 HAVING count(DISTINCT src) >= 2)
        SELECT c.node, cited, (SELECT count(DISTINCT src) FROM strong WHERE dst = c.node) AS in_degree FROM c WHERE c.node >= 5""",
    "cdc_latest": f"WITH {_LOG} SELECT path, seq, etag, deleted FROM last",
    "cdc_live": f"WITH {_LOG} SELECT path, seq FROM last WHERE NOT deleted",
    "cdc_page": f"WITH {_LOG} SELECT seq, path, deleted FROM log WHERE seq > 1000 ORDER BY seq LIMIT 500",
    "version_retention": f"WITH {_LOG} SELECT path, seq, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS age FROM log QUALIFY age <= 5",
    "previous_version": f"WITH {_LOG} SELECT path, seq, lag(seq) OVER (PARTITION BY path ORDER BY seq) AS previous_seq FROM log",
    "cache_actions": f"""WITH {_LOG}, old AS (SELECT * FROM (SELECT * FROM log WHERE seq <= (SELECT max(seq) / 2 FROM log) QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) WHERE NOT deleted), new AS (SELECT * FROM last WHERE NOT deleted)
        SELECT coalesce(old.path, new.path) AS path, CASE WHEN new.path IS NULL THEN 'remove' WHEN old.etag = new.etag THEN 'reuse' ELSE 'read' END AS action FROM old FULL JOIN new ON old.path = new.path""",
    "changes_by_month": f"WITH {_LOG} SELECT strftime(day, '%Y-%m') AS month, count(*) AS changes, count_if(deleted) AS deletes, count(DISTINCT path) AS paths FROM log GROUP BY 1",
    "running_budget": "SELECT conv_id, turn, (sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM conversations QUALIFY used <= 3000",
    "last_turns": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations QUALIFY age <= 4",
    "turn_growth": "SELECT conv_id, turn, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS growth FROM conversations",
    "quality_audit": f"WITH d AS (SELECT lang, coalesce(text, '') AS t, length(trim(coalesce(text, ''))) AS n FROM documents) SELECT lang, {_FLAGS} FROM d GROUP BY lang",
    "size_histogram": "SELECT (floor(length(coalesce(text, '')) / 1000) * 1000)::BIGINT AS from_chars, count(*) AS n FROM documents GROUP BY 1",
    "grouping_statistics": "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "label_quality": "SELECT lang, quality, toxic, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3",
    "unlabelled_by_source": "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1",
    "lang_pivot": "SELECT source, " + ", ".join(f"count_if(lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM documents GROUP BY source",
    "natural_order": "WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) SELECT source, row_number() OVER (ORDER BY regexp_replace(source, '[0-9]+$', ''), nullif(regexp_extract(source, '([0-9]*)$', 1), '')::BIGINT NULLS FIRST) AS place FROM s",
    "tumbling_hour": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding_hour": """WITH w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s, event_type FROM events)
        SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""",
    "session_debounce": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "cooldown": "WITH g AS (SELECT event_id, user_id, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS gap FROM events) SELECT event_id, user_id FROM g WHERE gap IS NULL OR gap >= 21600",
    "activity_heat": """WITH n AS (SELECT max(ts) AS now FROM events), h AS (SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'click' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END * pow(0.5, (floor(epoch(now)) - floor(epoch(ts))) / 86400.0 / 7.0)) AS heat FROM events, n GROUP BY 1)
        SELECT user_id, round(heat / (SELECT max(heat) FROM h), 6) AS heat FROM h""",
    "usage_cost": "SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value * CASE event_type WHEN 'click' THEN 0.1::DOUBLE WHEN 'view' THEN 0.01::DOUBLE WHEN 'purchase' THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END), 4) AS cost, count(*) AS n FROM events GROUP BY 1",
    "json_props": "WITH p AS (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) SELECT event_type, sum(k)::BIGINT AS k, count(k) AS n FROM p GROUP BY 1",
    "star_revenue": """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "rollup_segments": "SELECT n_regionkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)",
    "cube_lines": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "idle_customers": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "set_operations": """WITH c AS (SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000), s AS (SELECT DISTINCT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000)
        SELECT nation, 'customers' AS side FROM (SELECT * FROM c EXCEPT SELECT * FROM s) UNION ALL SELECT nation, 'suppliers' FROM (SELECT * FROM s EXCEPT SELECT * FROM c) UNION ALL SELECT nation, 'both' FROM (SELECT * FROM c INTERSECT SELECT * FROM s)""",
    "member_scope": "SELECT lang, count(*) AS n FROM documents WHERE coalesce(lang = 'fr', false) OR (coalesce(source = 'src3', false) AND doc_id IS NOT NULL) GROUP BY lang",
    "visible_rows": "SELECT source, count(*) AS n FROM documents WHERE regexp_extract(source, '([0-9]+)$', 1)::INT % 5 <> 0 OR source = 'src5' GROUP BY 1",
}
ORACLES["blended_hits"] = f"""SELECT doc_id, round(max(score) + CASE WHEN count(*) = 2 THEN 0.3::DOUBLE * min(score) ELSE 0 END, 9) AS score
    FROM (SELECT doc_id, score FROM ({ORACLES["direct_search"]}) UNION ALL SELECT doc_id, score FROM ({ORACLES["keyword_fallback"]})) GROUP BY doc_id"""
ORACLES.update({**vault_oracles.ORACLES, **notes_oracles.ORACLES, **upkeep.ORACLES})
ORACLES.update({**ranking.ORACLES, **streams.ORACLES, **index.oracles(TOKENS), **histories.oracles(TOKENS), **contexts.oracles(_bm25(0.75, "least(tf, 255)").replace("{", "{{").replace("}", "}}").replace("LIMIT 10", "LIMIT {k}")), "expanded_turns": ranking.expanded_turns_oracle(ORACLES["pmi_synonyms"])})
