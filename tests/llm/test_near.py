"""Near-duplicates against the Jaccard similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from quillspark.llm import near
from tests.llm.test_brute import WORD, closure, fingerprint, frame, prose


def shingle_set(t, n=5):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def changed(r, text, k):
    w = text.split()
    for i in r.sample(range(len(w)), k):
        w[i] = f"changed{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    """Copies on both sides of the threshold, a large group of near copies, a common passage, empty and short texts."""
    r = random.Random(11)
    base = [prose(r, r.randint(30, 300)) for _ in range(60)]
    out = base + [changed(r, t, max(1, len(t.split()) * k // 1000)) for t in base for k in (10, 18, 22, 26, 30)]
    hub = prose(r, 200)
    out += [changed(r, hub, k) for k in (1, 2, 3, 4) for _ in range(15)] + [hub] * 5
    passage = prose(r, 40)
    out += [f"{passage} {prose(r, 20)}" for _ in range(40)] + ["", " \n", None, "one two", "One two"]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("sample", [20_000, 50])
def test_groups(spark, texts, sample):
    held = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if similar(held[a], held[b])]
    assert len(pairs) > 500
    got = {r["doc_id"]: r["component_id"] for r in near.groups(frame(spark, list(enumerate(texts))), near.NearParams(sample=sample)).collect()}
    assert [got[i] for i in range(len(texts))] == closure(len(texts), pairs)


def test_near_in_bits_alone_stays(spark):
    """Long texts whose fingerprints are within 8 bits, but whose similarity is below 0.8."""
    r = random.Random(2)
    base = [prose(r, 300) for _ in range(30)]
    rows = list(enumerate(base + [changed(r, t, 12) for t in base]))
    low = [i for i in range(30) if not similar(shingle_set(rows[i][1]), shingle_set(rows[i + 30][1]))]
    assert low
    kept = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert all(i + 30 in kept for i in low)


def test_just_over_the_threshold_goes(spark):
    """Pairs between 0.8 and 0.85: over a quarter differ in more than 8 bits of each of three fingerprints."""
    r = random.Random(4)
    pairs = [(t, changed(r, t, 6)) for t in (prose(r, 300) for _ in range(60))]
    pairs = [(a, b) for a, b in pairs if similar(shingle_set(a), shingle_set(b))]
    assert len(pairs) > 30
    rows = list(enumerate([a for a, _ in pairs] + [b for _, b in pairs]))
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()} == set(range(len(pairs)))


def test_different_texts_of_one_id_stay(spark):
    r = random.Random(6)
    a, b, c = (prose(r, 50) for _ in range(3))
    kept = corpus_pipeline.near_dedup(spark, frame(spark, [(1, a), (1, b), (1, b), (2, a), (2, c)]), "").collect()
    assert sorted(tuple(x) for x in kept) == sorted([(1, a), (1, b), (2, c)])


def test_fingerprints_find_near_copies_that_whole_sets_confirm(spark, monkeypatch):
    """Without the prefix filter the links are those of fingerprints, and of them those that reach the similarity."""
    r = random.Random(8)
    base = [prose(r, 300) for _ in range(60)]
    texts = base + [changed(r, t, 1 + i % 10) for i, t in enumerate(base)]
    fp, held = [fingerprint(t, 5) for t in texts], [shingle_set(t) for t in texts]
    near_by = [(i, i + 60) for i in range(60) if (fp[i] ^ fp[i + 60]).bit_count() <= 4]
    links = [(b, a) for a, b in near_by if similar(held[a], held[b])]
    assert len(links) > 8
    monkeypatch.setattr(near, "candidates", lambda tokens, p: spark.createDataFrame([], "token long, large boolean, a long, b long, need long, one long"))
    got = {x["doc_id"]: x["component_id"] for x in near.groups(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == closure(len(texts), links)
