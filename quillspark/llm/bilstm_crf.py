"""A character-level bidirectional LSTM with CRF transitions, trained and run in numpy.

Shapes: B windows of T characters, E embedding, H hidden, K tags. A window shorter than T is padded; padding is
masked in the loss and never decoded.
"""

from __future__ import annotations

import numpy as np

VOCABULARY = 132


def encode(text: str) -> np.ndarray:
    """A class for each character: itself in ASCII; else letters, white space, digits and the rest share one each."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    for i in np.flatnonzero(codes >= 128):
        c = text[i]
        codes[i] = 128 if c.isalpha() else 129 if c.isspace() else 130 if c.isdigit() else 131
    return codes


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def init(tags: int, embed: int = 12, hidden: int = 16, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"emb": r.normal(0, 0.3, (VOCABULARY, embed)), "out": r.normal(0, 0.2, (2 * hidden, tags)), "bias": np.zeros(tags), "trans": r.normal(0, 0.1, (tags, tags))}
    for side in "fb":
        p[f"w{side}"] = r.normal(0, 1 / np.sqrt(embed + hidden), (embed + hidden, 4 * hidden))
        p[f"b{side}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
    return p


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states [T, B, H] of inputs [T, B, E], and what the backward pass needs."""
    t, n, e = x.shape
    hidden = w.shape[1] // 4
    h, c, out, kept = np.zeros((n, hidden), x.dtype), np.zeros((n, hidden), x.dtype), [], []
    projected = x.reshape(t * n, e) @ w[:e] + b
    projected = projected.reshape(t, n, -1)
    for k in range(t):
        z = projected[k] + h @ w[e:]
        i, f, o, g = _sigmoid(z[:, :hidden]), _sigmoid(z[:, hidden : 2 * hidden]), _sigmoid(z[:, 2 * hidden : 3 * hidden]), np.tanh(z[:, 3 * hidden :])
        before, old = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        out.append(h)
        kept.append((i, f, o, g, before, tc, old))
    return np.stack(out), kept


def _lstm_back(grad: np.ndarray, x: np.ndarray, w: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, n, e = x.shape
    gw, gb, gx = np.zeros_like(w), np.zeros_like(w[0]), np.zeros_like(x)
    hidden = w.shape[1] // 4
    dh, dc = np.zeros((n, hidden), x.dtype), np.zeros((n, hidden), x.dtype)
    for k in reversed(range(t)):
        i, f, o, g, before, tc, old = kept[k]
        dh = dh + grad[k]
        dc = dc + dh * o * (1 - tc * tc)
        z = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        gw[:e] += x[k].T @ z
        gw[e:] += old.T @ z
        gb += z.sum(axis=0)
        gx[k] = z @ w[:e].T
        dh, dc = z @ w[e:].T, dc * f
    return gx, gw, gb


def emissions(p: dict, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Tag scores [T, B, K] of windows [B, T]."""
    x = p["emb"][codes.T]
    hf, kf = _lstm(x, p["wf"], p["bf"])
    hb, kb = _lstm(x[::-1], p["wb"], p["bb"])
    h = np.concatenate([hf, hb[::-1]], axis=2)
    return h @ p["out"] + p["bias"], (x, h, kf, kb)


def posteriors(p: dict, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log Z [B], tag marginals [T, B, K] and the summed expected transitions [K, K]."""
    t, n, k = scores.shape
    a, b = np.zeros_like(scores), np.zeros_like(scores)
    a[0] = scores[0]
    for i in range(1, t):
        step = _logsum(a[i - 1][:, :, None] + p["trans"][None], 1) + scores[i]
        a[i] = np.where((i < lengths)[:, None], step, a[i - 1])
    z = _logsum(a[-1], 1)
    for i in range(t - 2, -1, -1):
        step = _logsum(p["trans"][None] + (scores[i + 1] + b[i + 1])[:, None, :], 2)
        b[i] = np.where((i + 1 < lengths)[:, None], step, 0)
    marginal = np.exp(np.clip(a + b - z[None, :, None], -50, 0)) * (np.arange(t)[:, None] < lengths[None])[:, :, None]
    moves = np.zeros((k, k), scores.dtype)
    for i in range(1, t):
        on = i < lengths
        if on.any():
            joint = a[i - 1][on][:, :, None] + p["trans"][None] + (scores[i] + b[i])[on][:, None, :] - z[on][:, None, None]
            moves += np.exp(np.clip(joint, -50, 0)).sum(axis=0)
    return z, marginal, moves


def step(p: dict, codes: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the tags [B, T] and its gradients."""
    n, t = codes.shape
    scores, (x, h, kf, kb) = emissions(p, codes)
    z, marginal, moves = posteriors(p, scores, lengths)
    on = (np.arange(t)[:, None] < lengths[None]).astype(scores.dtype)
    rows, cols = np.meshgrid(np.arange(t), np.arange(n), indexing="ij")
    gold = (scores[rows, cols, tags.T] * on).sum(axis=0)
    pairs = on[1:] > 0
    before, after = tags.T[:-1][pairs], tags.T[1:][pairs]
    gold_moves = np.zeros_like(p["trans"])
    np.add.at(gold_moves, (before, after), 1)
    loss = (z.sum() - gold.sum() - (gold_moves * p["trans"]).sum()) / n
    ds = marginal.copy()
    ds[rows, cols, tags.T] -= on
    ds /= n
    flat = ds.reshape(t * n, -1)
    g = {"trans": (moves - gold_moves) / n, "out": h.reshape(t * n, -1).T @ flat, "bias": flat.sum(axis=0)}
    dh = ds @ p["out"].T
    hidden = p["wf"].shape[1] // 4
    gxf, g["wf"], g["bf"] = _lstm_back(dh[:, :, :hidden], x, p["wf"], kf)
    gxb, g["wb"], g["bb"] = _lstm_back(dh[::-1, :, hidden:], x[::-1], p["wb"], kb)
    g["emb"] = np.zeros_like(p["emb"])
    np.add.at(g["emb"], codes.T, gxf + gxb[::-1])
    return float(loss), g


def train(codes: np.ndarray, tags: np.ndarray, lengths: np.ndarray, kinds: int, epochs: int = 6, batch: int = 96, rate: float = 0.015, seed: int = 7) -> dict:
    """Adam on shuffled batches, in single precision; with no windows the model stays at its start and decodes to nothing."""
    p = {k: v.astype(np.float32) for k, v in init(kinds, seed=seed).items()}
    p["bias"][0] = 2.0
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    r, n = np.random.default_rng(seed), 0
    for _ in range(epochs if len(codes) else 0):
        order = r.permutation(len(codes))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            _, g = step(p, codes[own], tags[own], lengths[own])
            n += 1
            norm = np.sqrt(sum((v * v).sum() for v in g.values()))
            for k, v in g.items():
                v = v * np.float32(min(1.0, 5.0 / (norm + 1e-9)))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                p[k] -= rate * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)
    return p


def viterbi(p: dict, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags [B, T]; 0 in the padding."""
    t, n, k = scores.shape
    best, back = scores[0], np.zeros((t, n, k), dtype=np.int8)
    for i in range(1, t):
        all_moves = best[:, :, None] + p["trans"][None]
        back[i] = np.where((i < lengths)[:, None], all_moves.argmax(axis=1), np.arange(k)[None])
        best = np.where((i < lengths)[:, None], all_moves.max(axis=1) + scores[i], best)
    tags = np.zeros((n, t), dtype=np.int64)
    now = best.argmax(axis=1)
    for i in range(t - 1, -1, -1):
        tags[:, i] = now
        now = back[i][np.arange(n), now]
    tags[np.arange(t)[None] >= lengths[:, None]] = 0
    return tags
