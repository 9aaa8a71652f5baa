"""Main text of web pages, by deducing each host's template from equivalence classes of its tokens.

A page's tokens are its elements, told apart by the path of the elements around them, and its whole runs of text, told
apart by their path. Spark groups the tokens of a host whose occurrence vectors (how often each page has them) are the
same; an occurrence vector is summed up as support, total and two order-free hashes. A class is valid if enough pages
support it, it has enough tokens, and it nests: the elements around all its tokens belong to the class itself or to one
other class, its parent in the tree of classes that is the host's template. Its elements and runs are the template; text
of other runs is slot text. The main element is an article, if there is one, else the innermost element of the template
that holds most of the slot text, so that menus and footers fall away whatever their names are. Its slots are the text.

Nothing is cut out of a run: words that all pages happen to share stay. A whole run of the main element goes only if it is
template, has `notice_words` words or more and is no heading (a notice under every article), and only while such runs are
a small part of the page's main text: pages that copy one another keep theirs. Menus, headers, adverts, comments and so on
that vary from page to page are slots, too: elements of such kinds or names are left out, but never one that stands around
the main element.

Defined results: null and empty html give an empty text; markup that never ends is text up to its end; elements nested
deeper than 512 are read as siblings; a url without a host shares one template with its like; hosts with fewer than
`min_pages` pages have no template; repeated rows give one row each; copies of a page are evidence as often as they occur;
an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import small_side, stored
from quillspark.llm.html_tree import HEADINGS, INLINE, Node, Page


@dataclass(frozen=True)
class TemplateParams:
    """A class needs so many tokens, pages and share of the host's pages; main_share: of the slot text of a page.

    notice_words, notice_share: template runs of the main element that go have so many words, and are so much of its text at most.
    """

    min_tokens: int = 3
    min_pages: int = 8
    support: float = 0.9
    main_share: float = 0.6
    notice_words: int = 3
    notice_share: float = 0.2


def key_of(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=seed)


def signed(key: int) -> int:
    return key - (1 << 63)


def run_key(text: str, node: Node) -> int:
    return key_of(f"\n{text}", node.key)


def tokens(source: str) -> list[tuple[int, int, bool, bool, int, int, int]]:
    """(key, key of the element around, is_text, is_main, depth, count, characters inside that are no boilerplate by kind or name) of a page's tokens."""
    page = Page(source)
    count, info, inside = Counter(), {}, Counter()
    mains = set(page.main_nodes())
    kept = page.kept()
    slots = dict.fromkeys(page.nodes, 0)
    for text, node in kept:
        slots[node] += len(text)
        inside[run_key(text, node)] += len(text)
    for node in reversed(page.nodes):
        if node.parent is not None:
            slots[node.parent] += slots[node]
        if node.parent is not None and node.tag not in INLINE and node.tag != "p":
            count[node.key] += 1
            inside[node.key] += slots[node]
            info[node.key] = (node.parent.key, False, node in mains, node.depth)
    for text, node in page.blocks:
        k = run_key(text, node)
        count[k] += 1
        info[k] = (node.key, True, False, node.depth)
    return [(k, *info[k], n, inside[k]) for k, n in count.items()]


def heading(node: Node) -> bool:
    while node.tag in INLINE and node.parent is not None:
        node = node.parent
    return node.tag in HEADINGS


def main_text(source: str, main_key: int | None = None, template: frozenset[int] = frozenset(), p: TemplateParams = TemplateParams()) -> str:
    """The slots of a page's main element, joined; without one, of its article, else of the whole page."""
    page = Page(source)
    found = page.kept()

    def within(ok) -> list[tuple[str, Node]]:
        inside: dict[Node, bool] = {}
        for node in page.nodes:
            inside[node] = ok(node) or node.parent is not None and inside[node.parent]
        return [b for b in found if inside[b[1]]]

    chosen = within(lambda x: x.parent is not None and x.key == main_key) if main_key is not None else []
    mains = set(page.main_nodes())
    chosen = chosen or (within(mains.__contains__) if mains else []) or found
    slots = [t for t, node in chosen if run_key(t, node) not in template or t.count(" ") + 1 < p.notice_words or heading(node)] if template else []
    whole = [t for t, _ in chosen]
    return " ".join(slots if slots and sum(map(len, whole)) - sum(map(len, slots)) <= p.notice_share * sum(map(len, whole)) else whole)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


NAMES = ("host", "page", "key", "around", "is_text", "is_main", "depth", "n", "inside")
KINDS = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())


def page_tokens(pages: DataFrame) -> DataFrame:
    """The tokens of every page with its host and a hash of its html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, source in zip(b.column("host"), b.column("html")):
                source = source.as_py() or ""
                page = signed(key_of(source))
                rows += [(h.as_py(), page, signed(k), signed(around), *rest) for k, around, *rest in tokens(source)]
                if len(rows) > 50_000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=NAMES)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=NAMES)

    schema = "host string, page long, key long, around long, is_text boolean, is_main boolean, depth int, n long, inside long"
    return pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, schema)


def common_tokens(pages: DataFrame, p: TemplateParams = TemplateParams()) -> DataFrame:
    """The tokens that enough of a host's pages have, with class: a hash of the occurrence vector."""
    # Occurrence vectors, summed up: the sum over pages of a hash of page and count, beside an exclusive or of another.
    vectors = page_tokens(pages).groupBy("host", "key").agg(
        F.min("around").alias("around"),
        F.first("is_text").alias("is_text"),
        F.max("is_main").alias("is_main"),
        F.min("depth").alias("depth"),
        F.count("*").alias("support"),
        F.sum("n").alias("total"),
        F.sum("inside").alias("inside"),
        F.bit_xor(F.xxhash64("page", "n")).alias("mixed"),
        F.sum(F.xxhash64("n", "page").bitwiseAND((1 << 40) - 1)).alias("vector"),
    )
    vectors = stored(vectors, "token-vectors")
    hosts = vectors.groupBy(F.col("host").alias("_h")).agg(F.max("support").alias("pages"))
    hosts = small_side(stored(hosts, "template-hosts"))
    # What too few pages hold can't be template; most tokens are such, so the classes are formed from few rows.
    common = vectors.join(hosts, F.col("host") == F.col("_h")).where((F.col("pages") >= p.min_pages) & (F.col("support") >= p.support * F.col("pages")))
    return stored(common.select("*", F.xxhash64("support", "total", "mixed", "vector").alias("class")).drop("_h"), "common-tokens")


def _with_parents(common: DataFrame, p: TemplateParams, how: str) -> DataFrame:
    """Add `parent` and `tokens` of a token's class where it is valid."""
    # Whatever holds a common token is common, so the element around is among these rows (but for the root).
    outer = common.where("not is_text").select(F.col("host").alias("_h"), F.col("key").alias("_k"), F.col("class").alias("outer"))
    nested = common.join(outer, (F.col("host") == F.col("_h")) & (F.col("around") == F.col("_k")), "left")
    other = F.when(F.col("outer") != F.col("class"), F.col("outer"))
    sound = nested.groupBy(F.col("host").alias("_h"), F.col("class").alias("_c")).agg(F.count("*").alias("tokens"), F.min(other).alias("parent"), F.max(other).alias("_last"))
    sound = sound.where((F.col("tokens") >= p.min_tokens) & F.col("parent").eqNullSafe(F.col("_last"))).drop("_last")
    return common.join(sound, (F.col("host") == F.col("_h")) & (F.col("class") == F.col("_c")), how).drop("_h", "_c")


def classes(pages: DataFrame, p: TemplateParams = TemplateParams()) -> DataFrame:
    """The tokens of every host's valid classes: host, key, class (a hash of its vector), parent (the class around, null at the top) and what the token is."""
    return _with_parents(common_tokens(pages, p), p, "inner")


def main_element(rows: list[tuple[int, int, bool, bool, int, bool, int, bool]], share: float) -> int | None:
    """The key of a host's main element: an article, else the innermost that holds most slot text.

    rows: (key, key of the element around, is_text, is_main, depth, once a page, characters, in a valid class) of common tokens.
    Slot text of an element is its characters without those of the template's runs inside it.
    """
    slots = {k: inside for k, _, is_text, _, _, _, inside, _ in rows if not is_text}
    up = {k: around for k, around, is_text, *_ in rows if not is_text}
    for _, at, is_text, _, _, _, inside, valid in rows:
        while is_text and valid and at in slots:
            slots[at] -= inside
            at = up[at]
    most = max(slots.values(), default=0)
    found = [(is_main, depth, slots[k], k) for k, _, is_text, is_main, depth, once, _, valid in rows if not is_text and once and valid and (is_main or most > 0 and slots[k] >= share * most)]
    return max(found)[3] if found else None


def templates(pages: DataFrame, p: TemplateParams = TemplateParams()) -> DataFrame:
    """host, main_key and text_keys (the template's runs) of every host. A host's template has no more tokens than a page has."""

    def of_host(t: pa.Table) -> pa.Table:
        rows = list(zip(*[t.column(c).to_pylist() for c in ("key", "around", "is_text", "is_main", "depth", "once", "inside", "valid")]))
        runs = [r[0] for r in rows if r[2] and r[7]]
        return pa.table({"host": t.column("host").slice(0, 1), "main_key": pa.array([main_element(rows, p.main_share)], pa.int64()), "text_keys": pa.array([runs], pa.list_(pa.int64()))})

    found = _with_parents(common_tokens(pages, p), p, "left")
    found = found.select("host", "key", "around", "is_text", "is_main", "depth", (F.col("total") == F.col("support")).alias("once"), "inside", F.col("tokens").isNotNull().alias("valid"))
    return found.groupBy("host").applyInArrow(of_host, "host string, main_key long, text_keys array<long>")


def extract(pages: DataFrame, p: TemplateParams = TemplateParams()) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    # A template has no more keys than a page has tokens over `support`.
    found = small_side(stored(templates(pages, p), "templates").withColumnRenamed("host", "_host"), 20_000, F.size("text_keys") * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, before, keys = [], None, frozenset()
            for source, main, words in zip(*(b.column(c) for c in ("html", "main_key", "text_keys"))):
                words = tuple(words.as_py() or ())
                if words != before:
                    before, keys = words, frozenset(k + (1 << 63) for k in words)
                main = main.as_py()
                texts.append(main_text(source.as_py() or "", None if main is None else main + (1 << 63), keys, p))
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = pages.select("page_id", "url", "html", host(F.col("url")).alias("_h")).join(found, F.col("_h") == F.col("_host"), "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "main_key", "text_keys").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
