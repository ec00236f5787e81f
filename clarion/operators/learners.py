"""Small learners for one fit of a model search (M1-M5): numpy, one thread, bounded rows.

A fit gets a matrix of standardised features and 0/1 labels and gives a dict of
arrays that ``predict`` turns into probabilities of class 1.  ``search`` runs
many of them as Spark tasks; here is what one task does.

Trees of all kinds come from one grower, ``grow``: histograms of gradients over
binned features, many trees at once.  A forest's trees and a boosted model's
rounds do not depend on how many follow, so a short model is a prefix of a long
one and one fit serves all lengths.
"""

from __future__ import annotations

import io

import numpy as np

BINS, CHUNK = 32, 20  # bins of a feature; trees grown together
NO_LIMIT = 60         # levels of a tree without a depth limit
KERNEL_FEATURES = 128
MLP = {"batch": 200, "epochs": 1_000, "patience": 10, "tol": 1e-4, "held": 0.1}


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def edges_of(x: np.ndarray) -> np.ndarray:
    """(features, BINS - 1) cut points at quantiles."""
    return np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T


def codes_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def grow(codes, g, h, depth, least, shrink, mask_of=None):
    """Trees for the rows of ``g`` and ``h`` (trees x rows), level by level; returns their nodes.

    Nodes: feature (-1: leaf), bin (go left up to it), left child (the right one
    follows), value -G / (H + shrink).  The first nodes are the roots.  A side needs
    ``least`` of h.  ``mask_of(nodes)`` chooses the features a node may split on.
    """
    trees, n = g.shape
    cell, row = np.repeat(np.arange(trees), n), np.tile(np.arange(n), trees)
    g, h = g.ravel(), h.ravel()
    live = h > 0
    cell, row, g, h = cell[live], row[live], g[live], h[live]
    parts, base, nodes = [], 0, trees
    for level in range(depth + 1):
        total_g, total_h = np.bincount(cell, g, nodes), np.bincount(cell, h, nodes)
        best = np.full(nodes, 1e-12)
        feature, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
        if level < depth and len(cell):
            allowed = mask_of(nodes) if mask_of else None
            whole = total_g ** 2 / (total_h + shrink + 1e-300)
            for f in range(codes.shape[1]):
                key = cell * BINS + codes[row, f]
                left_g = np.cumsum(np.bincount(key, g, nodes * BINS).reshape(nodes, BINS), axis=1)[:, :-1]
                left_h = np.cumsum(np.bincount(key, h, nodes * BINS).reshape(nodes, BINS), axis=1)[:, :-1]
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g ** 2 / (left_h + shrink + 1e-300) + right_g ** 2 / (right_h + shrink + 1e-300) - whole[:, None]
                gain[(left_h < least) | (right_h < least)] = -np.inf
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                if allowed is not None:
                    top = np.where(allowed[:, f], top, -np.inf)
                better = top > best
                best, feature, cut = np.where(better, top, best), np.where(better, f, feature), np.where(better, at, cut)
        split = feature >= 0
        rank = np.cumsum(split) - 1
        left = np.where(split, base + nodes + 2 * rank, -1)
        parts.append((feature, cut, left, -total_g / (total_h + shrink + 1e-300)))
        go = split[cell]
        cell, row, g, h = cell[go], row[go], g[go], h[go]
        if not len(cell):
            break
        cell = 2 * rank[cell] + (codes[row, feature[cell]] > cut[cell])
        base, nodes = base + nodes, 2 * int(split.sum())
    return [np.concatenate(p) for p in zip(*parts)]


def leaf_values(nodes, roots, codes):
    """(roots, rows) values of the leaves that rows fall into."""
    feature, cut, left, value = nodes
    at = np.repeat(np.asarray(roots)[:, None], len(codes), axis=1)
    rows = np.arange(len(codes))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return value[at]
        step = left[at] + (codes[rows, np.maximum(f, 0)] > cut[at])
        at = np.where(inner, step, at)


def fit_forest(x, y, lengths, max_depth=None, min_samples_leaf=1, seed=42):
    """Bootstrapped trees on the square root of the features a node: {length: model}."""
    edges = edges_of(x)
    codes, d = codes_of(x, edges), x.shape[1]
    few = max(1, int(np.sqrt(d)))
    parts, roots, base, out = [], [], 0, {}
    for done in range(0, max(lengths), CHUNK):
        rng = np.random.default_rng([seed, done])  # a chunk does not depend on what follows
        w = np.stack([np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)) for _ in range(CHUNK)]).astype(float)
        nodes = grow(codes, -w * y, w, NO_LIMIT if max_depth is None else max_depth, min_samples_leaf, 0.0,
                        lambda k: rng.random((k, d)).argsort(axis=1).argsort(axis=1) < few)
        nodes[2] = np.where(nodes[2] >= 0, nodes[2] + base, -1)
        parts.append(nodes)
        roots += range(base, base + CHUNK)
        base += len(nodes[0])
        for n in lengths:
            if done < n <= done + CHUNK:
                out[n] = {"kind": "forest", "edges": edges, "roots": np.array(roots[:n]), **dict(zip(("feature", "cut", "left", "value"), (np.concatenate(p) for p in zip(*parts))))}
    return out


def fit_boosted(x, y, lengths, max_depth=3, learning_rate=0.1, subsample=1.0, seed=42):
    """Second-order boosting of the logistic loss: {length: model}."""
    edges = edges_of(x)
    codes = codes_of(x, edges)
    margin, parts, roots, base, out = np.zeros(len(y)), [], [], 0, {}
    rng = np.random.default_rng(seed)
    for done in range(1, max(lengths) + 1):
        p = sigmoid(margin)
        used = rng.random(len(y)) < subsample
        nodes = grow(codes, ((p - y) * used)[None], (p * (1 - p) * used)[None], max_depth, 1.0, 1.0)
        nodes[3] = nodes[3] * learning_rate
        margin = margin + leaf_values(nodes, [0], codes)[0]
        nodes[2] = np.where(nodes[2] >= 0, nodes[2] + base, -1)
        parts.append(nodes)
        roots.append(base)
        base += len(nodes[0])
        if done in lengths:
            out[done] = {"kind": "boosted", "edges": edges, "roots": np.array(roots), **dict(zip(("feature", "cut", "left", "value"), (np.concatenate(q) for q in zip(*parts))))}
    return out


def newton_logistic(x, y, c, start=None, rounds=100):
    """Weights and intercept of L2-penalised logistic regression (penalty 1 / c, none on the intercept)."""
    z = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], 1.0 / c), 1e-10)
    w = np.zeros(z.shape[1]) if start is None else start
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * ridge @ w ** 2
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-8:
            size /= 2
        w = w - size * step
        if np.abs(step).max() * size < 1e-9:
            break
    return w


def fit_logistic(x, y, cs, seed=42):
    """{c: model}; each starts from its weaker neighbour's weights."""
    out, w = {}, None
    for c in sorted(cs):
        w = newton_logistic(x, y, c, w)
        out[c] = {"kind": "logistic", "w": w}
    return out


def _kernel(x, w, b):
    return np.sqrt(2.0 / len(b)) * np.cos(x @ w + b)


def fit_svm(x, y, c=1.0, gamma=None, seed=42):
    """Squared-hinge machine on random Fourier features of the RBF kernel, then a logistic curve over its margins."""
    d = x.shape[1]
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * (gamma or 1.0 / d)), (d, KERNEL_FEATURES)), rng.uniform(0, 2 * np.pi, KERNEL_FEATURES)
    z, s = np.column_stack([_kernel(x, w, b), np.ones(len(x))]), 2.0 * y - 1
    ridge = np.append(np.ones(KERNEL_FEATURES), 1e-10)
    v = np.zeros(z.shape[1])
    loss = lambda v: 0.5 * ridge @ v ** 2 + c * (np.maximum(0, 1 - s * (z @ v)) ** 2).sum()
    for _ in range(50):
        near = s * (z @ v) < 1
        zs = z[near]
        step = np.linalg.solve(np.diag(ridge) + 2 * c * zs.T @ zs, ridge * v + 2 * c * zs.T @ (zs @ v - s[near]))
        size, now = 1.0, loss(v)
        while loss(v - size * step) > now and size > 1e-8:
            size /= 2
        v = v - size * step
        if np.abs(step).max() * size < 1e-8:
            break
    return {"kind": "svm", "w": w, "b": b, "v": v, "platt": newton_logistic((z @ v)[:, None], y, 1e6)}


def _forward(x, layers):
    acts = [x]
    for i, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        acts.append(np.maximum(z, 0) if i < len(layers) - 1 else sigmoid(z))
    return acts


def fit_mlp(x, y, hidden_layer_sizes=(64,), alpha=1e-4, learning_rate_init=1e-3, seed=42):
    """ReLU network by Adam on mini-batches, stopped when a held tenth no longer gets better."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, own = order[: max(1, int(MLP["held"] * len(y)))], order[max(1, int(MLP["held"] * len(y))):]
    sizes = [x.shape[1], *hidden_layer_sizes, 1]
    layers = [(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    flat = [p for layer in layers for p in layer]
    m, v, t = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat], 0
    best, best_score, idle = [p.copy() for p in flat], -np.inf, 0
    for _ in range(MLP["epochs"]):
        rng.shuffle(own)
        for at in range(0, len(own), MLP["batch"]):
            part = own[at : at + MLP["batch"]]
            acts = _forward(x[part], layers)
            delta, grads = (acts[-1] - y[part, None]) / len(part), []
            for i in range(len(layers) - 1, -1, -1):
                w = layers[i][0]
                grads[:0] = [acts[i].T @ delta + alpha * w / len(part), delta.sum(axis=0)]
                delta = (delta @ w.T) * (acts[i] > 0)
            t += 1
            for p, grad, mi, vi in zip(flat, grads, m, v):
                mi += 0.1 * (grad - mi)
                vi += 0.001 * (grad ** 2 - vi)
                p -= learning_rate_init * (mi / (1 - 0.9 ** t)) / (np.sqrt(vi / (1 - 0.999 ** t)) + 1e-8)
        score = np.mean((_forward(x[held], layers)[-1][:, 0] > 0.5) == (y[held] > 0.5))
        idle = 0 if score > best_score + MLP["tol"] else idle + 1
        if score > best_score:
            best, best_score = [p.copy() for p in flat], score
        if idle > MLP["patience"]:
            break
    return {"kind": "mlp", "layers": np.array([len(layers)]), **{f"p{i}": p for i, p in enumerate(best)}}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of class 1."""
    kind = str(model["kind"])
    if kind == "logistic":
        return sigmoid(x @ model["w"][:-1] + model["w"][-1])
    if kind == "svm":
        margin = _kernel(x, model["w"], model["b"]) @ model["v"][:-1] + model["v"][-1]
        return sigmoid(margin * model["platt"][0] + model["platt"][1])
    if kind == "mlp":
        return _forward(x, [(model[f"p{2 * i}"], model[f"p{2 * i + 1}"]) for i in range(int(model["layers"][0]))])[-1][:, 0]
    codes, nodes, sums = codes_of(x, model["edges"]), [model[k] for k in ("feature", "cut", "left", "value")], np.zeros(len(x))
    for at in range(0, len(model["roots"]), CHUNK):
        sums += leaf_values(nodes, model["roots"][at : at + CHUNK], codes).sum(axis=0)
    return sums / len(model["roots"]) if kind == "forest" else sigmoid(sums)


def to_bytes(model: dict) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **{k: np.asarray(v) for k, v in model.items()})
    return out.getvalue()


def from_bytes(blob: bytes) -> dict:
    with np.load(io.BytesIO(blob), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}
