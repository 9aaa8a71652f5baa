"""Graph operators over edge tables (src, dst, and refs or weight where they count)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import link_key
from quillspark.operators.similar import similar_pairs  # noqa: F401
from quillspark.session import cut

MEDIA = "(?i)\\.(png|jpe?g|gif|svg|webp|bmp|pdf|mp4|mov|mp3|wav|zip)$"


def link_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, refs) and phantoms (target, label, referrer) of parsed documents.

    A link meets the first document in path order that has its key; links to oneself and to media are left out.
    """
    links = docs.select(F.col("doc_id").alias("src"), F.explode("links").alias("label")).where(~F.regexp_replace("label", "[|#].*$", "").rlike(MEDIA))
    links = links.withColumn("key", link_key(F.col("label"))).where("key <> ''")
    titles = docs.groupBy("key").agg(F.min_by("doc_id", "path").alias("dst"))
    met = links.join(titles, "key", "left")
    edges = met.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("refs"))
    phantoms = met.where("dst is null").groupBy(F.col("key").alias("target"), F.col("src").alias("referrer")).agg(F.min("label").alias("label"))
    return edges, phantoms


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of linked nodes once in either direction."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree and in_degree in distinct partners, refs_out and refs_in in references."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("out_degree"), F.sum("refs").alias("refs_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("in_degree"), F.sum("refs").alias("refs_in"))
    both = out.join(into, "node", "full_outer")
    return both.na.fill(0, ["out_degree", "refs_out", "in_degree", "refs_in"])


def strength(edges: DataFrame) -> DataFrame:
    """Edges with strength 0.15 + 0.85 refs / max refs."""
    most = edges.agg(F.max("refs").alias("_most"))
    return edges.join(F.broadcast(most)).withColumn("strength", 0.15 + 0.85 * F.col("refs") / F.col("_most")).drop("_most")  # one row


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int = 25, dangling: bool = True, tolerance: float | None = None, every: int = 5) -> DataFrame:
    """node and score of distinct directed edges; pass undirected() edges for the undirected variant.

    With `dangling`, the rank of nodes without an out-edge is spread over all. Plans are cut every few iterations.
    """
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    links = cut(edges.select("src", "dst").distinct())  # each pass reads them, so what they come from is computed once
    fan = links.groupBy("src").agg(F.count("*").alias("fan"))
    links = cut(links.join(fan, "src"))
    ranks = cut(nodes.select("node", F.lit(1.0 / n).alias("score")).join(fan.select(F.col("src").alias("node"), "fan"), "node", "left"))
    for k in range(iterations):
        flow = links.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("score") / links["fan"]).alias("flow"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("fan").isNull(), F.col("score"))), F.lit(0.0)).alias("lost")) if dangling else None
        now = ranks.join(flow, F.col("node") == F.col("dst"), "left").select("node", "fan", F.col("score").alias("before"), F.coalesce("flow", F.lit(0.0)).alias("flow"))
        spread = F.col("flow")
        if dangling:
            now = now.join(F.broadcast(lost))  # one row
            spread = F.col("flow") + F.col("lost") / n
        now = now.select("node", "fan", ((1 - damping) / n + damping * spread).alias("score"), "before")
        if (k + 1) % every == 0 or k == iterations - 1:
            now = cut(now)
            if tolerance and (now.agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0) < tolerance:
                ranks = now.drop("before")
                break
        ranks = now.drop("before")
    return ranks.select("node", "score")


def personalised(edges: DataFrame, seeds: DataFrame, restart: float = 0.4, iterations: int = 20, every: int = 5) -> DataFrame:
    """node and score of weighted undirected edges (src, dst, weight): restart at the seeds (node, score), by their share."""
    edges = cut(edges.select("src", "dst", "weight"))
    both = edges.union(edges.select("dst", "src", "weight"))
    total = both.groupBy("src").agg(F.sum("weight").alias("total"))
    both = cut(both.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    start = seeds.select("node", F.greatest("score", F.lit(0.01)).alias("p"))
    start = cut(start.join(F.broadcast(start.agg(F.sum("p").alias("all")))).select("node", (F.col("p") / F.col("all")).alias("p")))  # one row
    ranks = start.select("node", F.col("p").alias("score"))
    for k in range(iterations):
        flow = both.join(ranks, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        ranks = flow.join(start, "node", "full_outer").select("node", (restart * F.coalesce("p", F.lit(0.0)) + (1 - restart) * F.coalesce("flow", F.lit(0.0))).alias("score"))
        if (k + 1) % every == 0:
            ranks = cut(ranks)
    return ranks


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of nodes with an edge, by alternating star contraction."""
    edges = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    while True:
        both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src"))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").union(low.select("src", "m")).distinct()
        now = cut(small)
        if now.count() == edges.count() and now.exceptAll(edges).isEmpty():
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(now.select("dst", "dst").distinct())
        edges = now


def hops(edges: DataFrame, seeds: DataFrame, most: int = 3) -> DataFrame:
    """node and hops (fewest edges from a seed, up to `most`) along undirected edges; seeds: node."""
    both = cut(undirected(edges))
    seen = cut(seeds.select("node", F.lit(0).alias("hops")).distinct())
    for k in range(1, most + 1):
        front = both.join(seen.where(F.col("hops") == k - 1), F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        new = front.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(k))
        seen = cut(seen.union(new))
    return seen


def bridges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """node and spans (groups among its neighbours) of nodes whose neighbours belong to two groups or more."""
    near = undirected(edges).join(membership.select(F.col("node").alias("dst"), "community"), "dst")
    return near.groupBy(F.col("src").alias("node")).agg(F.countDistinct("community").alias("spans")).where("spans >= 2")


def cut_points(edges: DataFrame) -> DataFrame:
    """node and stranded (nodes cut off but for the largest piece) of articulation points.

    A breadth-first tree reaches every component from its smallest node. Each edge outside the tree closes a cycle with the
    two ways up to where they meet, so the tree edges on these (named by their lower node) belong to one block. A node whose
    tree edges belong to two blocks or more is a cut point, and each block is a piece without it. All steps are rounds of
    joins, as many as the tree is deep. Loops and repeated edges count nothing; no edges give no rows.
    """
    both = cut(undirected(edges.where("src is not null and dst is not null")))
    root = components(both.where("src < dst"))
    kind = both.schema["src"].dataType
    front = cut(root.where("node = root").select("node", "root", F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("depth")))
    levels, tree = [], front
    while not front.isEmpty():
        levels.append(front)
        met = both.join(front, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("_n")).agg(F.min("root").alias("root"), F.min("node").alias("parent"))
        front = cut(met.join(tree.select("node"), F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("node"), "root", "parent", F.lit(len(levels)).alias("depth")))
        tree = cut(tree.unionByName(front))
    up = lambda c: tree.select(F.col("node").alias(f"_{c}"), F.col("parent").alias(f"{c}_up"), F.col("depth").alias(f"{c}_depth"))
    placed = both.where("src < dst").toDF("x", "y").join(up("x"), F.col("x") == F.col("_x")).join(up("y"), F.col("y") == F.col("_y")).drop("_x", "_y")
    closing = placed.where("not (x_up <=> y) and not (y_up <=> x)")
    pairs = cut(closing)
    # Depths differ by one at most: first the deeper end goes up, then both in step, until they have one parent.
    links = pairs.where("x_depth > y_depth").select("x", "x_up").union(pairs.where("y_depth > x_depth").select("y", "y_up")).toDF("src", "dst")
    level = pairs.select(F.when(F.col("x_depth") > F.col("y_depth"), F.col("x_up")).otherwise(F.col("x")).alias("x"), F.when(F.col("y_depth") > F.col("x_depth"), F.col("y_up")).otherwise(F.col("y")).alias("y"))
    level = cut(level.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    links = cut(links.union(level).distinct())
    while not level.isEmpty():
        apart = level.join(up("x"), F.col("x") == F.col("_x")).join(up("y"), F.col("y") == F.col("_y")).where("x_up <> y_up")
        apart = cut(apart.select("x", "y", "x_up", "y_up"))
        links = cut(links.union(apart.select("x", "x_up")).union(apart.select("y", "y_up")).distinct())
        level = cut(apart.select(F.least("x_up", "y_up").alias("x"), F.greatest("x_up", "y_up").alias("y")).distinct())
    block = components(links).select(F.col("node").alias("_b"), F.col("root").alias("block"))
    sizes, measured = None, []
    for here in reversed(levels):
        if sizes is None:
            below = here.select("node", "parent", F.lit(1).cast("long").alias("size"))
        else:
            held = sizes.groupBy(F.col("parent").alias("_p")).agg(F.sum("size").alias("held"))
            below = here.join(held, F.col("node") == F.col("_p"), "left").select("node", "parent", (1 + F.coalesce("held", F.lit(0))).cast("long").alias("size"))
        sizes = cut(below)
        measured.append(sizes)
    if sizes is None:
        return both.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("stranded"))
    sized = reduce(DataFrame.unionByName, measured)
    sized = cut(sized.join(block, F.col("node") == F.col("_b"), "left").select("node", "parent", "size", F.coalesce("block", "node").alias("block")))
    own = tree.select(F.col("node").alias("_n"), "root").join(sized.select(F.col("node").alias("_m"), F.col("block").alias("upward")), F.col("_n") == F.col("_m"))
    total = sized.where("parent is null").select(F.col("node").alias("_r"), F.col("size").alias("total"))
    pieces = sized.where("parent is not null").groupBy("parent", "block").agg(F.sum("size").alias("n"))
    # Pieces below a node, but for the block that also goes up; what is left of the component is the piece above.
    joined = pieces.join(own, F.col("parent") == F.col("_n")).join(total, F.col("root") == F.col("_r"))
    lower = F.when((F.col("parent") == F.col("root")) | (F.col("block") != F.col("upward")), F.col("n"))
    found = joined.groupBy(F.col("parent").alias("node")).agg(F.count(lower).alias("k"), F.sum(lower).alias("cut_off"), F.max(lower).alias("most"), F.first("total").alias("total"), F.first(F.col("parent") == F.col("root")).alias("top"))
    above = F.when(F.col("top"), 0).otherwise(F.col("total") - 1 - F.col("cut_off"))
    return found.where("k > 1 or (k = 1 and not top)").select("node", (F.col("total") - 1 - F.greatest("most", above)).cast("long").alias("stranded"))


def communities(edges: DataFrame, resolution: float = 1.0, passes: int = 50) -> DataFrame:
    """node and community (its smallest node) by Louvain moves on weighted undirected edges (src, dst, weight).

    In each round the nodes whose hash is even or odd in turn move to the neighbouring community of the largest gain (ties:
    the smallest), all at once, by joins and sums. A round that doesn't raise modularity ends its level after one more try;
    communities then become the nodes of the next level. Loops and rows with nulls are left out.
    """
    known = edges.where("src is not null and dst is not null and weight is not null and src <> dst")
    one = cut(known.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight")))
    near = cut(one.union(one.select("dst", "src", "weight")))
    twice = near.agg(F.sum("weight")).first()[0] or 1.0
    member = cut(near.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct())

    def modularity(labels: DataFrame) -> float:
        a, b = (labels.select(F.col("node").alias(f"_{c}"), F.col("label").alias(f"_l{c}")) for c in "ab")
        inside = near.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).where("_la = _lb").agg(F.sum("weight")).first()[0] or 0.0
        held = labels.groupBy("label").agg(F.sum("degree").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0] or 0.0
        return inside / twice - resolution * held / (twice * twice)

    def moves(labels: DataFrame, turn: int) -> DataFrame:
        there = labels.select(F.col("node").alias("_n"), F.col("label").alias("to"))
        totals = labels.groupBy(F.col("label").alias("_t")).agg(F.sum("degree").alias("total"))
        drawn = near.where("src <> dst").join(there, F.col("dst") == F.col("_n")).groupBy(F.col("src").alias("_s"), "to").agg(F.sum("weight").alias("w"))
        mine = labels.where(F.pmod(F.xxhash64("node") + turn, F.lit(2)) == 0)
        # Its own community is a choice even if no neighbour is in it.
        stay = mine.select(F.col("node").alias("_s"), F.col("label").alias("to"), F.lit(0.0).alias("w"))
        choices = drawn.unionByName(stay).groupBy("_s", "to").agg(F.sum("w").alias("w"))
        scored = choices.join(mine, F.col("_s") == F.col("node")).join(totals, F.col("to") == F.col("_t"))
        rest = F.col("total") - F.when(F.col("to") == F.col("label"), F.col("degree")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * rest * F.col("degree") / twice, 9)
        scored = scored.select("node", "to", gain.alias("gain"), (F.col("to") == F.col("label")).alias("same"))
        best = scored.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("g"), (~F.col("same")).alias("s"), "to")).alias("_b")).select(F.col("node").alias("_n"), F.col("_b.to").alias("_to"))
        return labels.join(best, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("_to", "label").alias("label"), "degree")

    while True:
        degree = near.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))
        labels = start = cut(degree.select("node", F.col("node").alias("label"), "degree"))
        score, idle = modularity(labels), 0
        for turn in range(passes):
            moved = cut(moves(labels, turn))
            now = modularity(moved)
            if now > score + 1e-9:
                labels, score, idle = moved, now, 0
            else:
                idle += 1
                if idle == 2:
                    break
        if labels is start:
            break
        names = labels.select(F.col("node").alias("_n"), "label")
        member = cut(member.join(names, F.col("community") == F.col("_n")).select("node", F.col("label").alias("community")))
        a, b = (labels.select(F.col("node").alias(f"_{c}"), F.col("label").alias(f"_l{c}")) for c in "ab")
        near = cut(near.join(a, F.col("src") == F.col("_a")).join(b, F.col("dst") == F.col("_b")).groupBy(F.col("_la").alias("src"), F.col("_lb").alias("dst")).agg(F.sum("weight").alias("weight")))
    low = member.groupBy(F.col("community").alias("_c")).agg(F.min("node").alias("low"))
    return member.join(low, F.col("community") == F.col("_c")).select("node", F.col("low").alias("community"))


def copies(posted: DataFrame) -> DataFrame:
    """doc_id and representative: the smallest id with the same terms and counts (by two order-free sums of their hashes)."""
    row = F.struct("term", "tf")
    bits = [F.xxhash64(F.lit(seed), row).cast("decimal(20,0)") for seed in (1, 2)]
    marks = posted.groupBy("doc_id").agg(F.count("*").alias("_k"), F.sum(bits[0]).alias("_x"), F.sum(bits[1]).alias("_y"))
    least = marks.groupBy(F.col("_k").alias("_k2"), F.col("_x").alias("_x2"), F.col("_y").alias("_y2")).agg(F.min("doc_id").alias("representative"))
    return marks.join(least, (F.col("_k") == F.col("_k2")) & (F.col("_x") == F.col("_x2")) & (F.col("_y") == F.col("_y2"))).select("doc_id", "representative")


def co_citations(edges: DataFrame, seeds: DataFrame, least: int = 2) -> DataFrame:
    """node, cited (by how many seeds) and in_degree of what at least `least` seeds link to, other than seeds."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("in_degree"))
    named = seeds.select(F.col("node").alias("src")).distinct()
    cited = edges.join(named, "src").groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("cited")).where(F.col("cited") >= least)
    return cited.join(named.withColumnRenamed("src", "node"), "node", "left_anti").join(into, "node")


def decayed(value: Column, age_days: Column, half_life: float = 7.0) -> Column:
    """A value halved every half-life; ages before now count as zero weight."""
    return F.when(age_days < 0, 0.0).otherwise(value * F.pow(F.lit(0.5), age_days / half_life))
