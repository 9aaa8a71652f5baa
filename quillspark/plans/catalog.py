"""The registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import audit, chunks, feeds, graph, index, search, social, terms
from quillspark.operators.index import Bm25
from quillspark.plans import index as index_plans
from quillspark.plans import contexts, histories, notes, ranking, streams, upkeep, vault
from quillspark.session import cut, table
from quillspark.streaming import events as E

#: Fixed search terms.
TERMS = ["thing", "then", "de", "enheit"]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _known(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null")


# --- retrieval ---------------------------------------------------------------------------------------------------


def bm25_topk(spark, d):
    return index.top(index.bm25(_docs(spark, d), TERMS, Bm25(cap=255)), 10).select("doc_id", "score")


def bm25_server_topk(spark, d):
    return index.top(index.bm25(_docs(spark, d), TERMS, Bm25(b=0.55, coverage=True)), 10).select("doc_id", "score")


def bm25_app_topk(spark, d):
    """Scores on an absolute scale: over 1.1 times the most that the query's terms could give, at most 1."""
    docs = _docs(spark, d)
    posted = docs.select(F.explode(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda x: x.isin(TERMS)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    caps = posted.agg(F.sum(index.idf(F.lit(n), F.col("df")) * 2.5).alias("cap"))
    scored = index.bm25(docs, TERMS, Bm25(coverage=True)).join(F.broadcast(caps))  # one row
    return index.top(scored.withColumn("score", F.least(F.col("score") / (1.1 * F.col("cap")), F.lit(1.0))), 10).select("doc_id", "score")


def tfidf_bot_topk(spark, d):
    return index.top(search.substring_tfidf(_docs(spark, d), TERMS, F.col("source")), 10)


def direct_search(spark, d):
    return index.top(search.direct(_docs(spark, d), ["src1", *TERMS], F.col("source")), 20)


def keyword_fallback(spark, d):
    return index.top(search.keyword(_docs(spark, d), ["src2", *TERMS], F.col("source")), 20)


def doc_freq(spark, d):
    return index.document_frequency(index.postings(_docs(spark, d)))


def doc_len_stats(spark, d):
    dl = index.lengths(_docs(spark, d))
    return dl.agg(F.count("*").alias("n"), F.sum("dl").alias("tokens"), F.max("dl").alias("longest"), F.round(F.avg("dl"), 6).alias("avgdl"))


def vocab_top(spark, d):
    return index.document_frequency(index.postings(_docs(spark, d))).orderBy(F.desc("cf"), "term").limit(50).select("term", "cf", "df")


def source_keywords(spark, d):
    """Each source's ten strongest terms by count times ln((N + 1) / (df + 1)).

    One pass over the texts: a document's terms keep its source, so counts and documents of a term come from one aggregate.
    """
    docs = _docs(spark, d)
    n = docs.count()
    posted = docs.select("doc_id", "source", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("source", "term", "doc_id").agg(F.count("*").alias("tf"))
    by_source = cut(posted.groupBy("source", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("docs")))
    df = by_source.groupBy("term").agg(F.sum("docs").alias("df"))
    scored = by_source.join(df, "term")
    scored = scored.withColumn("score", F.round(F.col("tf") * F.log((F.lit(n) + 1) / (F.col("df") + 1)), 6))
    w = Window.partitionBy("source").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10").select("source", "term", "score", "rank")


def corpus_fingerprint(spark, d):
    """An order-free digest of (id, length), summed where the rows are."""
    bits = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    return _docs(spark, d).agg(F.count("*").alias("n"), F.sum(bits(key)).alias("fingerprint"))


def exact_duplicates(spark, d):
    same = _docs(spark, d).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return same.where("copies > 1")


def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    return search.vector_top(v, v.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", "score", "rank")


def label_centroids(spark, d):
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return cells.groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def maxpool_label(spark, d):
    """For each query vector the best score of each label, over all vectors."""
    v = table(spark, d, "embeddings")
    return search.vector_pool(v, v.where("vec_id % 50 = 0"), "label")


def rrf_fusion(spark, d):
    docs, v = _docs(spark, d), table(spark, d, "embeddings")
    lexical = search.rank(index.bm25(docs, TERMS, Bm25(cap=255)).withColumn("score", F.round("score", 6)), 50)
    semantic = search.vector_top(v, v.where("vec_id = 0"), 50).select(F.col("vec_id").alias("doc_id"), "rank")
    return search.fuse(lexical, semantic).withColumn("score", F.round("score", 9))


def hotness_rerank(spark, d):
    e = table(spark, d, "events")
    seen = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    scored = index.bm25(_docs(spark, d), TERMS, Bm25(cap=255))
    return index.top(search.hotness(scored, seen, F.lit(now).cast("timestamp")), 20)


def session_search(spark, d):
    """Turns by the share of the query's words that they contain."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    share = sum((F.contains("t", F.lit(q)).cast("int") for q in TERMS), F.lit(0)) / len(TERMS)
    return turns.select("conv_id", "turn", share.alias("score")).where("score > 0")


def context_terms(spark, d):
    """The terms of each conversation's user turns that occur in two turns or more."""
    turns = table(spark, d, "conversations").where("role = 'user'")
    terms = turns.select("conv_id", "turn", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).where(F.length("term") > 3)
    return terms.groupBy("conv_id", "term").agg(F.count("*").alias("turns")).where("turns >= 2")


def pmi_synonyms(spark, d):
    lines = _docs(spark, d).select(F.explode(F.split("text", "\n")).alias("text"))
    return terms.synonyms(lines).select("term", "synonym", "pmi", "rank")


def leak_windows(spark, d):
    """Documents that hold 40 characters in a row of a benchmark item (from every fourth character)."""
    private = table(spark, d, "benchmark").select(F.col("item_id").alias("private_id"), "text")
    return terms.leaks(private, _docs(spark, d).select(F.col("doc_id").alias("probe_id"), "text"))


def text_chunks(spark, d):
    return chunks.chunk(_docs(spark, d).select("doc_id", F.col("source").alias("section_id"), "text")).select("doc_id", "idx", "id", F.length("content").alias("n"))


def similar_documents(spark, d):
    """Pairs of different documents with a cosine of 0.8 or more; documents with equal term counts are one, named by the smallest id."""
    # Dealt by document, texts move once and their postings no more.
    posted = index.postings(_known(_docs(spark, d)).repartition("doc_id"))
    return graph.similar_pairs(posted, 0.8).withColumn("similarity", F.round("similarity", 6))


def best_line(spark, d):
    """Each document's line with the most search terms."""
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return search.best_section(lines.withColumn("pos", F.col("pos").cast("long")), TERMS)


def blended_hits(spark, d):
    """The best 20 of substring and keyword search in one list."""
    docs = _docs(spark, d)
    one = index.top(search.direct(docs, ["src1", *TERMS], F.col("source")), 20)
    return search.blend(one, index.top(search.keyword(docs, ["src2", *TERMS], F.col("source")), 20)).withColumn("score", F.round("score", 9))


def index_coverage(spark, d):
    """How much of each source has a vector."""
    held = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return audit.coverage(_docs(spark, d), held, ["source"])


def recommended_feed(spark, d):
    """Events as posts (likes: their JSON count); each user follows the three users after them."""
    e = table(spark, d, "events")
    posts = e.select(F.col("event_id").alias("post_id"), F.col("user_id").alias("author_id"), F.col("event_id").alias("seq"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("likes"))
    users = e.select(F.col("user_id").alias("reader")).distinct()
    follows = users.select("reader", F.explode(F.array(*[F.col("reader") + k for k in (1, 2, 3)])).alias("author_id"))
    return social.feed(posts, follows)


# --- pages and graphs --------------------------------------------------------------------------------------------


def _hrefs(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


def page_links(spark, d):
    return _hrefs(spark, d).groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("target").alias("targets"))


def page_inlinks(spark, d):
    return _hrefs(spark, d).distinct().groupBy("target").agg(F.count("*").alias("referrers"))


def phantom_targets(spark, d):
    """Link targets that no page has as its path, with six referrers or more."""
    paths = table(spark, d, "pages").select(F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("target")).distinct()
    hot = page_inlinks(spark, d).where("referrers >= 6")
    return hot.join(paths, "target", "left_anti")


def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("n_html"))


def host_pages(spark, d):
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    return table(spark, d, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html").cast("long")).alias("chars"))


def _trade(spark, d) -> DataFrame:
    """Directed edges between nations: customers' orders of suppliers' goods."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = lines.groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    src = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    dst = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    joined = pairs.join(src, F.col("o_custkey") == F.col("c_custkey")).join(dst, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("refs"))


def _strong(spark, d) -> DataFrame:
    """Trade edges of more than the mean number of lines, so that the graph is no clique."""
    e = _trade(spark, d)
    return e.join(F.broadcast(e.agg(F.avg("refs").alias("mean")))).where("refs > mean").drop("mean")  # one row


def trade_degrees(spark, d):
    return graph.degrees(_strong(spark, d))


def trade_strength(spark, d):
    return graph.strength(_trade(spark, d)).withColumn("strength", F.round("strength", 9))


def trade_hubs(spark, d):
    near = graph.undirected(_strong(spark, d))
    return near.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(5)


def _nations(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))


def pagerank_directed(spark, d):
    return graph.pagerank(_strong(spark, d), _nations(spark, d), iterations=20).withColumn("score", F.round("score", 9))


def pagerank_undirected(spark, d):
    found = graph.pagerank(graph.undirected(_strong(spark, d)), _nations(spark, d), iterations=20)
    best = found.agg(F.max("score").alias("most"))
    return found.join(F.broadcast(best)).select("node", F.round(F.col("score") / F.col("most"), 9).alias("score"))  # one row


def personalised_pagerank(spark, d):
    edges = _strong(spark, d).select("src", "dst", F.col("refs").cast("double").alias("weight"))
    seeds = spark.createDataFrame([(0, 1.0), (7, 0.5)], "node int, score double")
    return graph.personalised(edges, seeds).select("node", F.round("score", 9).alias("score"))


def part_supplier_components(spark, d):
    """Components of suppliers that met in an order's largest lines (quantity 50): the first and the last of an order are linked."""
    large = table(spark, d, "lineitem").where("l_quantity = 50").groupBy("l_orderkey")
    met = large.agg(F.min("l_suppkey").alias("src"), F.max("l_suppkey").alias("dst")).where("src <> dst")
    return graph.components(met.select("src", "dst"))


def bfs_hops(spark, d):
    return graph.hops(_strong(spark, d), _nations(spark, d).where("node = 0"), 3).select("node", F.col("hops").cast("long").alias("hops"))


def bridge_nations(spark, d):
    regions = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return graph.bridges(_strong(spark, d), regions)


def co_cited_nations(spark, d):
    return graph.co_citations(_strong(spark, d), _nations(spark, d).where("node < 5"), 2)


def trade_communities(spark, d):
    edges = _strong(spark, d)
    weighted = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "refs").groupBy("src", "dst").agg(F.sum("refs").cast("double").alias("weight"))
    return graph.communities(weighted)


# --- change logs -------------------------------------------------------------------------------------------------


def _log(spark, d) -> DataFrame:
    """Orders as a change log: a customer's record, in the order of order keys; finished orders are tombstones."""
    return table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("seq"), F.md5(F.concat_ws(":", "o_orderpriority", F.col("o_orderkey").cast("string"))).alias("etag"), (F.col("o_orderstatus") == "F").alias("deleted"), F.col("o_orderdate").alias("at"))


def cdc_latest(spark, d):
    return feeds.latest(_log(spark, d), "path").select("path", "seq", "etag", "deleted")


def cdc_live(spark, d):
    return feeds.live(_log(spark, d), "path").select("path", "seq")


def cdc_page(spark, d):
    return feeds.page(_log(spark, d), 1000, 500).select("seq", "path", "deleted")


def version_retention(spark, d):
    return feeds.retain(_log(spark, d), "path", "seq", 5).select("path", "seq", "age")


def previous_version(spark, d):
    return feeds.with_previous(_log(spark, d), "path", "seq", ["seq"]).select("path", "seq", "previous_seq")


def cache_actions(spark, d):
    """What a cache of the first half of the log must do to catch up."""
    log = _log(spark, d)
    half = log.agg((F.max("seq") / 2).alias("half")).first()["half"]
    before = feeds.live(log.where(F.col("seq") <= half), "path")
    return feeds.classify(before, feeds.live(log, "path"), "path", "etag")


def changes_by_month(spark, d):
    month = F.date_format("at", "yyyy-MM")
    return _log(spark, d).groupBy(month.alias("month")).agg(F.count("*").alias("changes"), F.count_if("deleted").alias("deletes"), F.countDistinct("path").alias("paths"))


def running_budget(spark, d):
    """The leading turns of each conversation within 3000 characters."""
    turns = table(spark, d, "conversations").withColumn("n", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return search.within_budget(turns, ["conv_id"], ["turn"], F.col("n"), 3000).select("conv_id", "turn", "used")


def last_turns(spark, d):
    """Each conversation's last four turns."""
    return feeds.retain(table(spark, d, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "age")


def turn_growth(spark, d):
    turns = table(spark, d, "conversations").withColumn("n", F.length("text").cast("long"))
    return feeds.with_previous(turns, "conv_id", "turn", ["n"]).select("conv_id", "turn", (F.col("n") - F.col("previous_n")).alias("growth"))


# --- audits ------------------------------------------------------------------------------------------------------


def quality_audit(spark, d):
    return audit.counts(_docs(spark, d), ["lang"])


def size_histogram(spark, d):
    return audit.size_histogram(_docs(spark, d))


def grouping_statistics(spark, d):
    return audit.statistics(_docs(spark, d), ["lang", "source"])


def label_quality(spark, d):
    labels = table(spark, d, "labels")
    return _docs(spark, d).join(labels, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def unlabelled_by_source(spark, d):
    return _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


def lang_pivot(spark, d):
    return _docs(spark, d).groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


def natural_order(spark, d):
    """Sources in numeric-aware name order."""
    names = _docs(spark, d).select("source").distinct().where("source is not null")
    key = F.struct(F.regexp_replace("source", "[0-9]+$", "").alias("a"), F.regexp_extract("source", "([0-9]*)$", 1).cast("long").alias("b"))
    return names.select("source", F.row_number().over(Window.orderBy(key)).cast("long").alias("place"))


# --- events ------------------------------------------------------------------------------------------------------


def _events(spark, d) -> DataFrame:
    return E.timed(table(spark, d, "events"))


def _ntz(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def tumbling_hour(spark, d):
    return E.windows(_events(spark, d), "1 hour").select(_ntz("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_hour(spark, d):
    return E.windows(_events(spark, d), "1 hour", "30 minutes").select(_ntz("start").alias("start"), "event_type", "n")


def session_debounce(spark, d):
    return E.sessions(_events(spark, d), "30 minutes").select("user_id", _ntz("start").alias("start"), "n")


def cooldown(spark, d):
    """Events that come six hours or more after the user's event before."""
    return feeds.cooled(table(spark, d, "events"), "user_id", "ts", 6 * 3600).select("event_id", "user_id")


def activity_heat(spark, d):
    """Each user's decayed activity over the largest: weights by event type, halved every seven days."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    weight = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.6).otherwise(0.5)
    age = (F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 86400.0
    heat = e.join(F.broadcast(now)).groupBy("user_id").agg(F.sum(graph.decayed(weight, age)).alias("heat"))  # one row
    return heat.join(F.broadcast(heat.agg(F.max("heat").alias("most")))).select("user_id", F.round(F.col("heat") / F.col("most"), 6).alias("heat"))


def usage_cost(spark, d):
    """Event values at a price for each type, by day."""
    prices = spark.createDataFrame([("click", 0.1), ("view", 0.01), ("purchase", 1.0)], "event_type string, price double")
    priced = table(spark, d, "events").join(F.broadcast(prices), "event_type", "left")
    return priced.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.sum(F.col("value") * F.coalesce("price", F.lit(0.05))), 4).alias("cost"), F.count("*").alias("n"))


def json_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(k).alias("n"))


# --- relations ---------------------------------------------------------------------------------------------------


def star_revenue(spark, d):
    t = lambda n: table(spark, d, n)
    sums = t("lineitem").groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    named = sums.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


def rollup_segments(spark, d):
    joined = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def cube_lines(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def idle_customers(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def set_operations(spark, d):
    """Nations that only have suppliers of high balance, only such customers, or both."""
    c = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    tag = lambda df, x: df.withColumn("side", F.lit(x))
    return tag(c.distinct().subtract(s), "customers").union(tag(s.distinct().subtract(c), "suppliers")).union(tag(c.intersect(s), "both"))


def visible_rows(spark, d):
    """Documents that a viewer may see: every fifth source is personal."""
    path = F.when(F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 5 == 0, F.concat(F.lit("_personal/"), "source", F.lit("/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")))
    return feeds.visible(_docs(spark, d).withColumn("path", path), "src5").groupBy("source").agg(F.count("*").alias("n"))


def member_scope(spark, d):
    """Documents of one source or one language, as a member's folder and tag, counted by language."""
    rows = _docs(spark, d).withColumns({"path": F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")), "tags": F.array("lang")})
    return feeds.in_scope(rows, ["src3"], ["fr"]).groupBy("lang").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_topk, bm25_server_topk, bm25_app_topk, tfidf_bot_topk, direct_search, keyword_fallback, doc_freq, doc_len_stats, vocab_top, source_keywords,
        corpus_fingerprint, exact_duplicates, vector_topk, label_centroids, maxpool_label, rrf_fusion, hotness_rerank, session_search, context_terms, pmi_synonyms, leak_windows, text_chunks, similar_documents, best_line, blended_hits, index_coverage, recommended_feed,
        page_links, page_inlinks, phantom_targets, page_titles, host_pages, trade_degrees, trade_strength, trade_hubs, pagerank_directed, pagerank_undirected,
        personalised_pagerank, part_supplier_components, bfs_hops, bridge_nations, co_cited_nations, trade_communities,
        cdc_latest, cdc_live, cdc_page, version_retention, previous_version, cache_actions, changes_by_month, running_budget, last_turns, turn_growth,
        quality_audit, size_histogram, grouping_statistics, label_quality, unlabelled_by_source, lang_pivot, natural_order,
        tumbling_hour, sliding_hour, session_debounce, cooldown, activity_heat, usage_cost, json_props,
        star_revenue, rollup_segments, cube_lines, idle_customers, set_operations, visible_rows, member_scope,
    )
}
QUERIES.update({**vault.QUERIES, **notes.QUERIES, **upkeep.QUERIES, **ranking.QUERIES, **streams.QUERIES, **index_plans.QUERIES, **contexts.QUERIES, **histories.QUERIES})
