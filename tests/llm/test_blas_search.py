"""The tiled product against scoring every document by hand."""

import math
import random
import re
from collections import Counter

import numpy as np

from quillspark.llm import blas_search as B
from tests.llm.test_edges import LONG, docs, items

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, wanted, k=10):
    found = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, total = sum(bool(c) for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out, by_item = [], {}
    for i, t in dict.fromkeys(wanted):
        by_item.setdefault(i, Counter()).update(terms(t))
    for i, words in by_item.items():
        scored = []
        for doc, c in found:
            if not c:
                continue
            m = 25 + (75 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) * times for t, times in words.items() if c[t])
            if s:
                scored.append((-s, doc is None, doc or 0))
        out += [(i, r + 1, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scored)[:k])]
    return out


def plain(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_odd_rows(spark):
    assert plain(B.search(docs(spark), items(spark))) == sorted(brute([(r["doc_id"], r["text"]) for r in docs(spark).collect()], [(r["item_id"], r["text"]) for r in items(spark).collect()]), key=repr)
    assert B.search(docs(spark, []), items(spark)).collect() == [] and B.search(docs(spark), items(spark, [])).collect() == []


def test_random_texts_in_small_tiles_and_passes(spark):
    r = random.Random(5)
    words = [w for w in "a B c1 Äh äh zwölf x_y un-do 漢字 λ É é z9 Q q 0 ı İ".split()] + [f"w{k}" for k in range(40)]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", "\n", ", ", "  ", "..", "\x7f"]) for _ in range(n))
    rows = [(k, text(r.randrange(30))) for k in range(150)] + [(k, "same tie words w1") for k in range(200, 230)] + [(7, None), (7, ""), (300, LONG), (301, "a " * 5000)]
    wanted = [(k, text(r.randrange(1, 12))) for k in range(12)] + [(3, "w1 w1 w1"), (3, "w1 w1 w1"), (50, "tie"), (51, "word1 token nothing"), (None, "w2 w3"), (52, None)]
    d, i = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(wanted, "item_id long, text string")
    want = sorted(brute(rows, wanted), key=repr)
    assert plain(B.search(d, i)) == want
    assert plain(B.search(d, i, B.SearchParams(pass_items=4, pass_terms=20, tile_terms=3, tile_docs=7))) == want


def test_tiles_bound_their_sums():
    r = random.Random(7)
    weight = [r.randrange(0, 20) for _ in range(30)]
    rows = sorted({(r.randrange(5), r.randrange(30)) for _ in range(90)}, key=lambda x: (x[1], x[0]))
    rows = [(i, t, r.choice([1, 2, 50, 400])) for i, t in rows]
    limit = 5_000 * B.MOST
    cut = B.tiles(rows, weight, 4, limit)
    back = Counter()
    for tile in cut:
        assert len(tile.columns) <= 4
        reach = Counter()
        for item, column, n in tile.counts:
            back[item, tile.columns[column]] += n
            reach[item] += n * weight[tile.columns[column]] * B.MOST
        assert max(reach.values()) < limit
    assert back == Counter({(i, t): n for i, t, n in rows if weight[t]})


def test_sums_beyond_float64_stay_exact(spark):
    """An item that repeats a term so often that its score passes 2^53."""
    n = 3_000_000
    rows = [(1, "rare " * 50), (2, "rare two two"), (3, "other")] + [(k, "filler words") for k in range(10, 200)]
    wanted = [(1, "rare " * n + "two")]
    got = plain(B.search(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(wanted, "item_id long, text string")))
    assert got == sorted(brute(rows, wanted), key=repr) and max(s for *_, s in got) > 1 << 53


def test_the_byte_table_is_the_pattern():
    assert [i for i in range(128) if B.BYTES[i] == 32] == [i for i in range(128) if not TERM.match(chr(i))]
    assert np.array_equal(np.frombuffer(B.BYTES, np.uint8)[128:], np.arange(128, 256))
