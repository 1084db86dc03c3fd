"""Quality rules: gradient-boosted trees over document statistics (operator 1).

Statistics are counted from whole texts, one Arrow batch at a time and without a shuffle. A booster with
histogram splits and Newton steps is fitted on the driver from a bounded sample of labelled rows
(``sample_rows``); its trees are flattened into numpy node arrays, so that scoring is a few array operations for each
level of a tree over a batch. Features that must not speak for a text (symbols, repeated lines, repeated words, capitals)
carry monotonic constraints: a larger value never raises the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphflow.llm.common import WHITE, hashed_sample, small_batches, texts_of

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_FOLLOW = bytes(range(0x80, 0xC0))
_NARROW = bytes(range(0xC0))
_DIGITS = b"0123456789"
_UPPER = bytes(range(65, 91))
_MARKS = b"!?.,;:\"'()[]{}-_/\\=+@^~`"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and their monotonic constraint: -1 a larger value never raises the score, 0 free.
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", -1),
    ("digit_share", 0), ("mark_share", 0), ("shout_share", -1), ("distinct_share", 0), ("line_words", 0), ("wide_share", 0), ("bar_share", -1),
)
MONOTONE = np.array([m for _, m in FEATURES])


def _repeated(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows that are found twice or more, first included; distinct words."""
    n = len(words)
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    if n < 4:
        return 0, len(names)
    size = len(names)
    if size >= 2_000_000:  # three numbers no longer fit into one
        pair = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        keys = pair[:-1].astype(np.int64) * size + ids[2:]
    else:
        keys = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0, size
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum()), size


def measure(text: bytes) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Base counts and features of one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n = len(words)
    word_chars = len(text.translate(None, WHITE + _FOLLOW))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    dup = len(lines) - len(set(lines))
    repeat, distinct = _repeated(words)
    chars = max(word_chars, 1)
    share = lambda table: (len(text) - len(text.translate(None, table))) / chars
    wide = len(text.translate(None, _NARROW))
    features = (
        float(np.log1p(n)), word_chars / max(n, 1), symbols / chars, dup / max(len(lines), 1), repeat / max(n, 1), share(_UPPER),
        share(_DIGITS), share(_MARKS), share(b"!"), distinct / max(n, 1), n / max(len(lines), 1), wide / chars, share(b"|"),
    )
    return (n, word_chars, symbols, dup, repeat), features


def base_failed(counts: np.ndarray) -> np.ndarray:
    """Fixed rules over rows of BASE counts: too short, or over half of the words in repeated windows."""
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


@dataclass
class Trees:
    """A boosted ensemble as node arrays: one row for each tree, one column for each node of a full binary tree."""

    bias: float
    feature: np.ndarray  # int, -1 at a leaf
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]))
            out += value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss with histogram splits under monotonic constraints.

    Ties between splits go to the lower feature, then to the lower cut. One class only gives an ensemble without splits.
    """
    p0 = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    size = 2 ** (depth + 1) - 1
    out = Trees(float(np.log(p0 / (1 - p0))), np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size)), depth)
    if not len(y):
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    score = np.full(len(y), out.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(y), np.int64)
        low, high = np.full(size, -np.inf), np.full(size, np.inf)
        for node in range(size):
            mine = np.flatnonzero(at == node)
            if not len(mine):
                continue
            gs, hs = g[mine].sum(), h[mine].sum()
            out.value[t, node] = rate * np.clip(-gs / (hs + ridge), low[node], high[node])
            if node >= size // 2:
                continue
            best = (1e-6, -1, 0.0, 0.0, 0.0)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[mine, j], g[mine], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[mine, j], h[mine], len(c) + 1))[:-1]
                gr, hr = gs - gl, hs - hl
                left = np.clip(-gl / (hl + ridge), low[node], high[node])
                right = np.clip(-gr / (hr + ridge), low[node], high[node])
                gain = -(gl * left + 0.5 * (hl + ridge) * left**2) - (gr * right + 0.5 * (hr + ridge) * right**2) - 0.5 * gs * gs / (hs + ridge)
                gain[(hl < least) | (hr < least) | (monotone[j] * (right - left) < 0)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, float(c[k]), float(left[k]), float(right[k]))
            if best[1] >= 0:
                _, j, cut, left, right = best
                out.feature[t, node], out.cut[t, node] = j, cut
                mid = (left + right) / 2
                for child, sign in ((2 * node + 1, 1), (2 * node + 2, -1)):  # below the cut, above it
                    low[child], high[child] = low[node], high[node]
                    if monotone[j] * sign > 0:
                        high[child] = mid
                    elif monotone[j] * sign < 0:
                        low[child] = mid
                at[mine] = 2 * node + 1 + (x[mine, j] > cut)
        score += out.value[t, at]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> Trees:
    """An ensemble from at most ``sample_rows`` labelled documents, those whose hashed id is smallest.

    Labels without an id or quality are left out; of several labels of one id the lowest counts, and of several documents the one with the smallest hashed text. With no labelled
    document the ensemble keeps every text.
    """
    small_batches(docs.sparkSession)
    few = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = hashed_sample(few, sample_rows, "doc_id", "quality")

    def rows(batches):
        for b in batches:
            got = [measure(t) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array([list(f) for _, f in got], pa.list_(pa.float64()))], ["quality", "x"])

    # at most sample_rows rows of two numbers are broadcast
    labelled = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # of rows that repeat an id one is learned from, so that what is collected has sample_rows rows at most
    one = F.min(F.struct(F.xxhash64("text").alias("order"), "quality", "text")).alias("one")
    labelled = labelled.groupBy("doc_id").agg(one).select("one.quality", "one.text")
    got = labelled.mapInArrow(rows, "quality int, x array<double>").collect()
    if not got:
        return fit_trees(np.zeros((0, len(FEATURES))), np.zeros(0), MONOTONE)
    x, y = np.array([r["x"] for r in got]), np.array([r["quality"] for r in got], float)
    order = np.lexsort((*x.T[::-1], y))  # rows come in any order
    return fit_trees(x[order], y[order], MONOTONE)


def judge(counts: np.ndarray, x: np.ndarray, trees: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, log-odds and kept of each row; a text is kept at even odds or better."""
    failed = base_failed(counts)
    score = trees.score(x)
    return failed, score, ~failed & (score >= 0 if trees.feature.max(initial=-1) >= 0 else np.ones(len(x), bool))


def _judged(texts: list[bytes], trees: Trees):
    got = [measure(t) for t in texts]
    counts = np.array([c for c, _ in got], np.int64).reshape(-1, len(BASE))
    x = np.array([f for _, f in got], float).reshape(-1, len(FEATURES))
    return counts, *judge(counts, x, trees)


def assess(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, the base counts, base_failed, score (log-odds of good quality) and kept of every row.

    A null text counts as empty, which fails the base rules; repeated rows are judged alike; other columns are left out.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for b in batches:
            counts, failed, score, kept = _judged(texts_of(b, "text"), trees)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(kept)], ["doc_id", *BASE, "base_failed", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, {', '.join(f'{n} long' for n in BASE)}, base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns."""
    small_batches(docs.sparkSession)

    def rows(batches):
        for b in batches:
            yield b.filter(pa.array(_judged(texts_of(b, "text"), trees)[-1]))

    return docs.mapInArrow(rows, docs.schema)
