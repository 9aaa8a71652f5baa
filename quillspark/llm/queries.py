"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import blas_search, decontam, html_extract, ngram_lm, packing, pii, prefix_trie, quality, secrets, simhash, slots, tool_calls, url_filter
from quillspark.llm.common import stored, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a call or a result.

    A system turn is read as a call of the tool `configure`, a user's turn as a call of `reply`, which must say how many
    lines its prompt has: turns of a single line leave that out, and such calls are invalid. A call's parents are the
    latest user turn and the latest system turn before it; any other turn is a result for the latest call before it. Of
    several results the first counts; the others, and those before any call, follow as rows without arguments.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = lambda role: F.when(F.col("role") == role, F.col("turn"))
    turns = stored(tool_calls.with_earlier(turns, {"_user": said("user"), "_system": said("system")}), "turns")
    id_of = lambda turn: F.when(F.col(turn).isNotNull(), F.concat_ws(":", F.col("conv_id").cast("string"), F.col(turn).cast("string")))
    user, lines = F.col("role") == "user", F.size(F.split("text", "\n"))
    calls = turns.where("role in ('user', 'system')").select(
        "conv_id", "turn", F.lit(0).alias("pos"), id_of("turn").alias("call_id"), F.when(user, "reply").otherwise("configure").alias("name"),
        F.when(user, F.to_json(F.struct("turn", F.col("text").alias("prompt"), F.when(lines > 1, lines).alias("lines")))).otherwise(F.to_json(F.struct(F.col("text").alias("rules")))).alias("arguments"),
        F.array_compact(F.array(id_of("_user"), id_of("_system"))).alias("parent_ids"),
    )
    results = turns.where("role is null or role not in ('user', 'system')").withColumn("_call", F.greatest("_user", "_system")).select("conv_id", id_of("_call").alias("call_id"), "turn", F.col("text").alias("content"))
    string, long = "string", "integer"
    schemas = spark.createDataFrame([("reply", ["prompt", "turn", "lines"], {"prompt": string, "turn": long, "lines": long}), ("configure", ["rules"], {"rules": string})], "name string, required array<string>, types map<string,string>")
    linked = tool_calls.serialised(tool_calls.link(calls, results, schemas)).withColumn("valid", F.size("errors") == 0)
    lost = tool_calls.unlinked(calls, results).withColumnRenamed("content", "result")
    columns = ["conv_id", "turn", "call_id", "name", "arguments", "valid", "result", "level", "rank", "json"]
    return linked.select(*columns).unionByName(lost.select("conv_id", "turn", "call_id", "result"), allowMissingColumns=True)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op4_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", ngram_lm.held_out(F.col("doc_id")).alias("held_out"), "text")
    model = ngram_lm.fit(docs.where("not held_out"))
    scored = ngram_lm.score(docs, model, ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"), simhash.SimHashParams(shingle=4, bits=4))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), packing.PackParams(public_tokenizers.path("word_bpe_49k.json"), size=4096))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


#: The stated rules: the longest that fits decides.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.suffix_rule(*r) for r in URL_RULES] + url_filter.general_rules()
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8, n=5)


def op11_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = slots.sharded(table(spark, sf_dir, "documents"), slots.SlotParams(slots=8192, shards=24))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op12_blas_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blas_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_html_extraction, op2_tool_calls, op3_pii, op4_ngram_trie, op5_simhash_dedup, op6_secret_scan, op7_packing, op8_quality_rules, op9_url_filter, op10_decontamination, op11_virtual_slots, op12_blas_search, op13_prefix_trie)}

_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))"
ORACLES: dict[str, str] = {
    "op2_tool_calls": """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER w AS pu, max(CASE WHEN role = 'system' THEN turn END) OVER w AS ps
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT * FROM p WHERE role IN ('user', 'system')),
r AS (SELECT *, greatest(pu, ps) AS own, row_number() OVER (PARTITION BY conv_id, greatest(pu, ps) ORDER BY turn, text) AS n FROM p WHERE role NOT IN ('user', 'system')),
e AS (SELECT conv_id, turn, unnest([pu, ps]) AS above FROM c),
lv(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0::BIGINT FROM c
  UNION SELECT e.conv_id, e.turn, level + 1 FROM lv JOIN e ON e.conv_id = lv.conv_id AND e.above = lv.turn),
l AS (SELECT conv_id, turn, max(level) AS level FROM lv GROUP BY 1, 2),
o AS (SELECT c.conv_id, c.turn, c.conv_id || ':' || c.turn AS call_id, CASE c.role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name,
  CASE WHEN c.role = 'user' AND contains(c.text, chr(10)) THEN json_object('lines', len(string_split(c.text, chr(10))), 'prompt', c.text, 'turn', c.turn) WHEN c.role = 'user' THEN json_object('prompt', c.text, 'turn', c.turn) ELSE json_object('rules', c.text) END::VARCHAR AS arguments, coalesce(CASE WHEN c.role = 'user' THEN contains(c.text, chr(10)) ELSE c.text IS NOT NULL END, false) AS valid, r.text AS result, level,
  row_number() OVER (PARTITION BY c.conv_id ORDER BY level, c.turn) - 1 AS rank
  FROM c JOIN l ON c.conv_id = l.conv_id AND c.turn = l.turn LEFT JOIN r ON r.conv_id = c.conv_id AND r.own = c.turn AND r.n = 1)
SELECT *, CASE WHEN result IS NULL THEN json_object('arguments', arguments, 'id', call_id, 'level', level, 'name', name, 'rank', rank)
  ELSE json_object('arguments', arguments, 'id', call_id, 'level', level, 'name', name, 'rank', rank, 'result', result) END::VARCHAR AS json FROM o
UNION ALL SELECT conv_id, turn, conv_id || ':' || own, NULL, NULL, NULL, text, NULL, NULL, NULL FROM r WHERE n > 1 OR own IS NULL""",
    "op9_url_filter": """
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
w AS (SELECT *,
  CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN list_has_any(list_transform(string_split_regex(host, '[^a-z0-9]+'), lambda x: regexp_replace(x, '[0-9]+$', '')), ['casino', 'casinos', 'poker', 'roulette', 'jackpot', 'slots', 'lottery', 'bet', 'bets', 'betting', 'bookmaker',
    'adult', 'porn', 'xxx', 'sex', 'escort', 'escorts', 'pills', 'viagra', 'cialis', 'spam', 'spammer', 'warez', 'ad', 'ads', 'adserver', 'adservice', 'banner', 'banners', 'doubleclick', 'popunder', 'track', 'tracker', 'trackers', 'tracking']) THEN 'block'
  WHEN list_has_any(list_transform(list_slice(string_split(lower(path), '/'), 2, NULL), lambda x: regexp_replace(x, '[.][a-z]+$', '')),
    ['login', 'signin', 'signup', 'logout', 'register', 'cart', 'checkout', 'basket', 'wishlist', 'unsubscribe']) THEN 'block'
  ELSE 'allow' END AS verdict FROM w""",
    "op10_decontamination": f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM dw WHERE len(w) >= 5), b AS (SELECT item_id, unnest({_SHINGLES}) AS s FROM bw WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY 1), hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared::DOUBLE / n_item AS containment FROM hit JOIN n USING (item_id) WHERE n_shared::DOUBLE / n_item >= 0.8""",
    "op12_blas_search": """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM b) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY term, docs),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // total) AS m FROM d, g),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM b JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_prefix_trie": """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT c, count(*) AS n, own_h AS h FROM (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS own_h FROM t) GROUP BY c, own_h),
e AS (SELECT k.c, least(k.h, coalesce(b.n, 0)) AS head, k.h FROM k LEFT JOIN k AS b ON b.c = k.c - k.c % 5),
x AS (SELECT e.c, t.i + 1 AS d, role, text FROM e JOIN t ON t.c = e.c - e.c % 5 AND t.i < e.head UNION ALL SELECT e.c, e.head + t.i - e.h + 1, role, text FROM e JOIN t ON t.c = e.c AND t.i >= e.h),
r AS (SELECT c, d, octet_length(encode(text)) AS bytes, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, ';') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS p, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM x
  UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM x) FROM k),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends FROM r GROUP BY p, d),
u AS (SELECT DISTINCT a.p AS up, b.p AS down FROM r AS a JOIN r AS b ON a.c = b.c AND b.d = a.d + 1),
s AS (SELECT DISTINCT a.p AS top, b.p AS p FROM r AS a JOIN r AS b ON a.c = b.c AND b.d >= a.d),
a AS (SELECT top, sum((n_convs - 1) * bytes)::BIGINT AS saved, count(*) FILTER (p NOT IN (SELECT up FROM u)) AS leaves FROM s JOIN n USING (p) GROUP BY top)
SELECT n.conv_id, n.d AS depth, y.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM u WHERE up = n.p) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN a ON a.top = n.p LEFT JOIN u ON u.down = n.p LEFT JOIN n AS y ON y.p = u.up""",
}
