"""The trie against one built turn by turn, in blocks of a few turns and behind sketches that are far too small."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillspark.llm import count_min
from quillspark.llm import prefix_trie as T

FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        kids = [out[k] for k in children[node]]
        ends = [c for c in members[node] if len(built[c]) == len(node)]
        n = len(members[node])
        saved = (n - 1) * len(node[-1][1].encode()) if node else 0
        out[node] = (members[node][0], len(node), members[node[:-1]][0] if node else None, n, len(kids), sum(k[5] for k in kids) or 1, saved + sum(k[6] for k in kids), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(out.values(), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, rank long, d long, t string, len long")


def got(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=repr)


def sample(seed, convs=60, texts=3):
    r = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(r.randrange(1, 12)):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["ä" * k for k in range(texts)])))
    return rows


@pytest.mark.parametrize("p", [T.TrieParams(), T.TrieParams(block=3, width=1 << 16, part=2)])
def test_random_conversations(spark, p):
    rows = sample(1)
    assert got(T.trie(frame(spark, rows).repartition(5), p)) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "a"), (0, None, None, None), (0, 1, "user", "b"), (0, 1, "user", "b"), (1, 0, None, ""), (1, 5, "x", "long " * 30_000), (None, 1, "user", "lost"), (3, 2, "user", "b"),
        *[(10, k, "user", f"t{k % 3}") for k in range(40)], *[(15, k, "user", f"t{k % 3}") for k in range(41)], (12, 0, "user", "only"), (13, None, "", ""), (-4, 1, "user", "minus"),
    ]
    plain = [x for x in rows if x[0] is None or x[0] >= 0]
    assert got(T.trie(frame(spark, plain), T.TrieParams(block=4, part=3))) == brute(plain)
    assert T.trie(frame(spark, rows)).where("depth = 0").first()["n_convs"] == 8
    assert T.trie(frame(spark, [])).collect() == []
    one = [(12, 0, "user", "only")]
    assert got(T.trie(frame(spark, one))) == brute(one)


def test_hot_beginnings_and_copies(spark):
    rows = [(c, k, "user", f"turn {k}" if k < 3 or c % 7 else f"own {c} {k}") for c in range(0, 1500, 5) for k in range(6)]
    assert got(T.trie(frame(spark, rows), T.TrieParams(block=2, part=16))) == brute(rows)


def test_what_continues_a_single_prefix_is_single_whatever_its_counters_say(spark):
    rows = [(c, k, "user", "same" if k < 2 else f"own {c} {k}") for c in range(0, 1000, 5) for k in range(60)]
    assert got(T.trie(frame(spark, rows))) == brute(rows)


def test_large_blocks_keep_the_order_of_turns(spark):
    rows = [(c, k + at, "user", f"turn {k}") for c, at in ((10, -9), (20, 0)) for k in range(18)]
    assert got(T.trie(frame(spark, rows), T.TrieParams(block=6))) == brute(rows)


def test_no_single_estimate_is_wrong(spark):
    r = np.random.default_rng(3)
    a, b = r.integers(-(1 << 62), 1 << 62, 5000), r.integers(-(1 << 62), 1 << 62, 5000)
    a, b = np.concatenate([a, a[:700]]), np.concatenate([b, b[:700]])
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long").repartition(6)
    for width in (1 << 10, 1 << 16):
        wide = max(width, count_min.PIECE)
        bits = count_min.repeated(df, "a", "b", wide)
        once = count_min.once(bits, a, b, wide)
        assert not once[:700].any() and not once[5000:].any()
        assert once[700:5000].mean() > 0.99


def test_width_follows_the_rows_up_to_its_bound():
    assert count_min.width_for(0) == 1 << 16 and count_min.width_for(1_000_000) == 1 << 23 and count_min.width_for(10**12) == 1 << 27
