"""A brute-force model of the flow on dense numpy matrices, written for the tests."""

import numpy as np


def stochastic(edges, n):
    m = np.zeros((n, n))
    for c, r, v in edges:
        if v > 0:
            m[r, c] = max(m[r, c], v)
    for c in range(n):
        off = np.delete(m[:, c], c)
        if m[:, c].any():
            m[c, c] = off.max() if off.any() else 1.0
    return m / np.where(m.sum(0) > 0, m.sum(0), 1)


def step(m, a, inflation=2.0, cutoff=1e-4, select=50, auto=False):
    e = m @ a
    out, stats = np.zeros_like(e), dict(cutoff=0, prune=0, attractors=0, homogen=0, kmax=0, chaos=0.0)
    for c in range(e.shape[1]):
        rows = np.flatnonzero(e[:, c])
        if not len(rows):
            continue
        v = e[rows, c] ** inflation if auto else e[rows, c]
        if len(rows) > 1:
            t = min(max(0.9 * v.mean() * (1 - 2.0 * (v.max() - v.mean())), 1e-7), v.max()) if auto else cutoff
            keep = np.round(v, 12) >= round(t, 12)
            stats["cutoff"] += int((~keep).sum())
            rows, v = rows[keep], v[keep]
        if len(rows) > select:
            stats["prune"] += len(rows) - select
            best = np.lexsort((rows, -np.round(v, 12)))[:select]
            rows, v = rows[best], v[best]
        if not len(rows):
            stats["homogen"] += 1
            continue
        w = v if auto else v**inflation
        w = w / w.sum()
        out[rows, c] = w
        chaos = (w.max() - (w * w).sum()) * len(w) if len(w) > 1 else 0.0
        stats["chaos"] = max(stats["chaos"], chaos)
        stats["kmax"] = max(stats["kmax"], len(w))
        stats["attractors"] += w.max() > 0.5
        stats["homogen"] += chaos < 1e-4
    return out, stats


def clusters(m):
    n = m.shape[0]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for c in range(n):
        if m[:, c].any():
            a, b = find(c), find(int(np.argmax(np.round(m[:, c], 12))))
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


def triangles():
    edges = [(i, i, 0.5) for i in range(6)]
    for a, b, v in ((0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (3, 4, 1.0), (3, 5, 1.0), (4, 5, 1.0), (2, 3, 0.1)):
        edges += [(a, b, v), (b, a, v)]
    return edges
