"""Personal data in texts: fixed detectors, and a character BiLSTM-CRF that is trained on their labelled spans.

The model is trained on windows of a bounded sample: the spans that the detectors find there, the same spans written in
disguised forms that the detectors miss (`pii_forms`), and numbers that are no personal data. A third of the disguised
windows is held out; on it the certainty is chosen that a span needs. Spans of the model must hold what their kind says
(four numbers up to 255, a card's check digit, a telephone's count of digits, an "@" or "at" and a "." or "dot").

A span counts only if it holds what its kind must: digits, "@" or the word "at". So decoding looks at every window that holds
one of these; no other window could give a span.
Windows are decoded on their own and reconciled over the whole text: of all windows' spans the compatible set with the
largest total evidence stays. Base spans always stay; the model adds spans that touch none of them.

Defined results: null and empty texts have no spans; repeated rows give one row each; with an empty table, or none
with personal data, the model adds nothing; runs of digits of any length take linear time. Offsets count code points.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bilstm_crf as nn
from quillspark.llm.pii_forms import digits_of, disguise, holds, innocent, luhn

KINDS = ("email", "ip", "card", "phone")
# The stated patterns. A match of IP starts with a whole run of digits, whose length must not be tried anew
# from each of its digits.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What every span that `holds` accepts has in it.
TRIGGER = re.compile(r"[0-9@]|\bat\b")
#: Where training looks for labelled spans and for what looks like them.
LABELLED = re.compile(r"[0-9@]|[(\[{](?:at|dot)[)\]}]")


@dataclass(frozen=True)
class PiiParams:
    """train_docs and train_windows bound the labelled rows that training collects; `forms`: disguised copies of a labelled window."""

    window: int = 64
    stride: int = 16
    train_docs: int = 600
    train_windows: int = 1200
    forms: int = 4
    epochs: int = 8
    precision: float = 0.98


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: each starts at the run of local characters before its "@"."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found = {k: [] for k in KINDS}
    if not TRIGGER.search(text):
        return found
    found["email"] = emails(text)
    found["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    found["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() <= 38 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return found


def windows(text: str, p: PiiParams, trigger: re.Pattern = TRIGGER) -> list[tuple[int, int]]:
    """Overlapping (start, end) that cover every trigger with all windows of the stride's grid that hold its cell."""
    # Of a grid's cell the windows are the same for all its characters.
    cells = {m.start() // p.stride for m in trigger.finditer(text)}
    starts = {s for c in cells for s in range(max(0, (c + 1) * p.stride - p.window), c * p.stride + 1, p.stride)}
    return [(s, min(s + p.window, len(text))) for s in sorted(starts)]


def _tags(n: int, spans: dict[str, list[tuple[int, int]]], start: int) -> np.ndarray:
    """0: outside; 2k + 1 and 2k + 2: the first and a further character of kind k. Cut spans stay unlabelled."""
    tags = np.zeros(n, dtype=np.int64)
    for k, kind in enumerate(KINDS):
        for a, b in spans[kind]:
            if a >= start and b <= start + n and not tags[a - start : b - start].any():
                tags[a - start : b - start] = 2 * k + 2
                tags[a - start] = 2 * k + 1
    return tags


def training_windows(docs: DataFrame, p: PiiParams) -> list[tuple[str, np.ndarray]]:
    """(characters, tags by the base spans) of a bounded sample of windows of texts that hold a digit or "@"."""
    picked = docs.where(F.col("text").rlike("[0-9@]")).select(F.col("doc_id").alias("_id"), F.xxhash64("doc_id", F.length("text")).alias("_pick"))
    picked = picked.orderBy("_pick", "_id").limit(p.train_docs).select("_id").distinct()
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")  # bounded by the limit

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"].dropna():
                found = base_spans(text)
                for s, e in windows(text, p, LABELLED):
                    # A window that cuts a span would teach that its characters are clean.
                    if not any(a < s < z or a < e < z for k in KINDS for a, z in found[k]):
                        rows.append((text[s:e], _tags(e - s, found, s).astype(np.int8).tobytes()))
            yield pd.DataFrame(rows, columns=["chars", "tags"])

    cut_up = sample.mapInPandas(cut, "chars string, tags binary")
    rows = cut_up.distinct().withColumn("_pick", F.xxhash64("chars", "tags")).orderBy("_pick", "chars").limit(p.train_windows).collect()
    return [(r["chars"], np.frombuffer(r["tags"], dtype=np.int8).astype(np.int64)) for r in rows]


def disguised(chars: str, tags: np.ndarray, r: random.Random, size: int) -> tuple[str, np.ndarray] | None:
    """The window with its first span in another form, cut to the size around it; None without a span, or if it can't be cut."""
    spans = _spans(tags)
    if not spans:
        return None
    k, a, b = spans[0]
    form = disguise(KINDS[k], chars[a:b], r)
    if form is None or len(form) > size:
        return None
    # What stands around varies in length, so that a span's place in its window tells nothing.
    before, after = chars[:a], "" if len(spans) > 1 else chars[b:]
    before = before[-min(len(before), r.randint(0, size - len(form))) :] if before and len(form) < size else ""
    text = (before + form + after)[:size]
    new = np.zeros(len(text), dtype=np.int64)
    new[len(before) : len(before) + len(form)] = 2 * k + 2
    new[len(before)] = 2 * k + 1
    return text, new


def padded(rows: list[tuple[str, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, tags = np.zeros((len(rows), size), dtype=np.int64), np.zeros((len(rows), size), dtype=np.int64)
    for k, (chars, own) in enumerate(rows):
        codes[k, : len(chars)], tags[k, : len(chars)] = nn.encode(chars), own
    return codes, tags, np.array([len(c) for c, _ in rows], dtype=np.int64)


def train(docs: DataFrame, p: PiiParams = PiiParams()) -> dict:
    """The model's weights, with `sure`, the certainty that a span needs, from held-out disguised windows."""
    r, rows, held = random.Random(7), [], []
    for chars, tags in training_windows(docs, p):
        rows.append((chars, tags))
        clean = not tags.any()
        for n in range(p.forms):
            if clean:
                # A number that is no personal data stands in for what the window held, at another place.
                at = r.randint(0, max(0, len(chars) - 12))
                text = (chars[:at] + " " + innocent(r) + " " + chars[at:])[: p.window] if n == 0 else None
                new = text and (text, np.zeros(len(text), dtype=np.int64))
                new = new if new and not any(base_spans(new[0]).values()) else None
            else:
                new = disguised(chars, tags, r, p.window)
            if new:
                (held if n == p.forms - 1 or clean and r.random() < 0.3 else rows).append(new)
    model = nn.train(*padded(rows, p.window), 2 * len(KINDS) + 1, p.epochs)
    model["sure"] = certainty(model, held, p)
    return model


def certainty(model: dict, held: list[tuple[str, np.ndarray]], p: PiiParams) -> float:
    """The least certainty at which the held-out windows' spans have the wanted precision."""
    found = []
    for (chars, tags), spans in zip(held, predicted(model, [c for c, _ in held], p)):
        want = {(KINDS[k], a, b) for k, a, b in _spans(tags)}
        found += [(sure, (k, a, b) in want) for k, a, b, sure in spans]
    right, least = 0, 1.0  # between a half and 0.99
    for n, (sure, ok) in enumerate(sorted(found, reverse=True), 1):
        right += ok
        if right >= p.precision * n:
            least = sure
    return min(max(least, 0.5), 0.99)


def predicted(model: dict, cut: list[str], p: PiiParams) -> list[list[tuple[str, int, int, float]]]:
    """The spans (kind, start, end, certainty) of each window, those aside that can't be what they say."""
    out: list[list] = [[] for _ in cut]
    for at in range(0, len(cut), 512):
        own = cut[at : at + 512]
        codes, _, lengths = padded([(c, np.zeros(len(c), np.int64)) for c in own], p.window)
        scores, _ = nn.emissions(model, codes)
        tags = nn.viterbi(model, scores, lengths)
        some = np.flatnonzero(tags.any(axis=1))
        if not len(some):
            continue
        _, marginal, _ = nn.posteriors(model, scores[:, some], lengths[some])
        for j, i in enumerate(some):
            for kind, a, b in _spans(tags[i, : lengths[i]]):
                # A span takes no white space at its ends.
                sure = float(marginal[np.arange(a, b), j, tags[i, a:b]].min())
                if not own[i][a].isspace() and not own[i][b - 1].isspace() and holds(KINDS[kind], own[i][a:b]):
                    out[at + i].append((KINDS[kind], a, b, sure))
    return out


def decode(model: dict, texts: list[str], p: PiiParams) -> list[list[tuple[str, int, int, float]]]:
    """For each text the spans of its windows (kind, start, end, evidence), reconciled over the whole text."""
    found: list[list] = [[] for _ in texts]
    cut = [(k, s, e) for k, t in enumerate(texts) for s, e in windows(t, p)]
    for first in range(0, len(cut), 4096):
        own = cut[first : first + 4096]
        for (k, s, e), spans in zip(own, predicted(model, [texts[k][s:e] for k, s, e in own], p)):
            for kind, a, b, sure in spans:
                # A span at a window's edge may go on outside; another window holds it whole.
                if sure >= model["sure"] and (a > 0 or s == 0) and (b < e - s or e == len(texts[k])):
                    found[k].append((kind, s + a, s + b, sure))
    return [reconcile(x) for x in found]


def _spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, at = [], 0
    while at < len(tags):
        if tags[at] % 2 == 1:
            end = at + 1
            while end < len(tags) and tags[end] == tags[at] + 1:
                end += 1
            out.append(((int(tags[at]) - 1) // 2, at, end))
            at = end
        else:
            at += 1
    return out


def reconcile(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Of all windows' spans the set without overlaps whose summed evidence (votes times length) is largest."""
    votes: dict[tuple, float] = {}
    for kind, a, b, sure in spans:
        votes[kind, a, b] = votes.get((kind, a, b), 0.0) + sure * (b - a)
    rows = sorted(votes.items(), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    ends, best = [x[0][2] for x in rows], [(0.0, ())]
    for i, ((kind, a, b), w) in enumerate(rows):
        before = best[bisect_right(ends, a, 0, i)]
        best.append(max((before[0] + w, (before, (kind, a, b, w))), best[-1], key=lambda x: x[0]))
    out, now = [], best[-1]
    while now[1]:
        out.append(now[1][1])
        now = now[1][0]
    return out[::-1]


def find(texts: list[str], model: dict, p: PiiParams) -> list[tuple[dict, list[tuple[str, int, int]]]]:
    """For each text its base spans and all spans, the latter by kind as listed, then by start."""
    base = [base_spans(t) for t in texts]
    out = []
    for own, more in zip(base, decode(model, texts, p)):
        taken = sorted(s for k in KINDS for s in own[k])
        extra = [(k, a, b) for k, a, b, _ in more if not any(a < z and x < b for x, z in taken)]
        spans = sorted([(k, a, b) for k in KINDS for a, b in own[k]] + extra, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
        out.append((own, spans))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_found (all spans) and n_model (the model's) of every row."""
    model = train(docs, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = find([t or "" for t in b.column("text").to_pylist()], model, p)
            counts = [pa.array([len(own[k]) for own, _ in rows], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined([(k, a, z) for k in KINDS for a, z in own[k]]).encode()).hexdigest() for own, _ in rows]
            spans = [joined(s) for _, s in rows]
            more = [[len(s) for _, s in rows], [len(s) - sum(map(len, own.values())) for own, s in rows]]
            columns = [b.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(spans, pa.string()), *[pa.array(x, pa.int64()) for x in more]]
            yield pa.record_batch(columns, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_found", "n_model"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long, n_model long")


def redact(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """The rows with every span of their text replaced by its kind in brackets."""
    model = train(docs, p)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = []
            for text, (_, spans) in zip(texts, find([t or "" for t in texts], model, p)):
                end, parts = 0, []
                for k, a, z in sorted(spans, key=lambda x: (x[1], x[2])):
                    if a >= end:
                        parts += [text[end:a], f"[{k}]"]
                    end = max(end, z)
                new.append(None if text is None else "".join(parts) + text[end:])
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
