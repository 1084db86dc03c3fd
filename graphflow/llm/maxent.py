"""LM scoring by a hashed maximum-entropy model (operator 3).

The probability of a token is that of its class, times that of its cell within the class, times its share of the cell:

    P(w | h) = P(class | h) * P(cell | class, h) * (c(w) + 1) / (N_cell + V_cell + 1)

Classes come from a word's shape (last character, length, other letters than a-z), cells from its hash. The first two factors are softmaxes over hashed features of the history h: the previous word,
the word before it (skipping one), and both together, with a bias from corpus counts. The third comes from counts over all training tokens, with one part of each cell left for unknown words.

Counts are made by one grouped sum over all training tokens. Weights are trained by distributed gradient updates in synchronous rounds: every training text is in the fold of one round, the tasks sum the
gradient of their texts under the round's common weights, the sums of all tasks are added up, and one damped step by its ratio to the curvature (the row's tokens times the class's or cell's prior share) gives the next weights. So the
model depends on the texts alone, not on their partitions or the cluster. The tables of hashed rows, classes and cells have fixed sizes; what the model tells apart within a cell are the counts, which grow
with the corpus. Scoring is one pass; only words outside a bounded set of frequent ones are joined with their counts, so no key is hot.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphflow.llm.common import WHITE, id_text, small_batches, texts_of
from graphflow.scratch import Scratch

CLASSES = 32
CELLS = 32
#: Hashed rows of each feature for the class, and for the cell within a class.
ROWS = 1 << 13
CELL_ROWS = 1 << 14
#: Features: the previous word, the one before it, both.
KINDS = 3
#: Tokens whose rows are gathered at once, and rows of a block of summed gradients.
STEP = 1 << 15
BLOCK_ROWS = 512
#: Rounds, the share of a step that a feature takes, and tokens that damp a rare row.
ROUNDS, RATE, DAMP = 3, 0.6, 5.0
#: Bound of a weight.
MOST = 10.0
#: Frequent words whose counts every task holds.
FREQUENT = 1 << 18
_PIECE = 1 << 19
#: Bytes from which a text is cut at white space; its history goes on behind the cut.
_LONG = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_END = np.uint64(0xC3A5C85C97CB3127)
_START = np.uint64(0x9AE16A3B2F90404F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


_VALUES = _mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_WHITE = np.zeros(256, bool)
_WHITE[list(WHITE)] = True
#: Kinds of a word's last byte: letters, digits, other bytes, and a few marks by themselves.
_TAIL = np.full(256, 2, np.int64)
_TAIL[97:123], _TAIL[48:58], _TAIL[128:] = 0, 1, 3
for _k, _c in enumerate(b".,!?%*$&#|:;", 4):
    _TAIL[_c] = _k

_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * _PIECE)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


@dataclass
class Tokens:
    """Tokens of some texts in order: hash, cell (class * CELLS + place), owner (index of the text); every text ends with an end token. before: the two tokens before the first, nearest first."""

    hash: np.ndarray
    cell: np.ndarray
    owner: np.ndarray
    before: tuple[np.uint64, np.uint64] = (_START, _START)


def tokens_of(texts: list[bytes]) -> Tokens:
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    ends_at = np.cumsum([len(t) + 1 for t in texts])
    gap = _WHITE[data]
    edge = np.diff(np.r_[True, gap].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers_to(len(data) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_VALUES[data] * down[: len(data)])]
    words = _mix((sums[end] - sums[start]) * up[start] + (end - start).astype(np.uint64))
    owner = np.searchsorted(ends_at, start, side="right")
    wide = np.r_[0, np.cumsum(data >= 128)]
    shape = (_TAIL[data[end - 1]] * 2 + (wide[end] > wide[start])) * 4 + np.searchsorted([3, 5, 9], end - start, side="right")
    per = np.bincount(owner, minlength=len(texts))
    total = len(words) + len(texts)
    last = np.cumsum(per + 1) - 1
    out = Tokens(np.empty(total, np.uint64), np.empty(total, np.int64), np.repeat(np.arange(len(texts)), per + 1))
    is_word = np.ones(total, bool)
    is_word[last] = False
    out.hash[is_word], out.hash[last] = words, _END
    classes = np.where(is_word, 0, CLASSES - 1)
    classes[is_word] = _mix(shape.astype(np.uint64) + np.uint64(77)) % np.uint64(CLASSES)
    out.cell = classes * CELLS + (out.hash >> np.uint64(59)).astype(np.int64) % CELLS
    return out


def _pieces(texts: list[bytes]):
    """(index of the first text, texts, whether the last one ends here): long texts are cut at white space so that arrays stay small."""
    at, size, group = 0, 0, []
    for i, t in enumerate(texts):
        if group and size + len(t) > _PIECE:
            yield at, group, True
            at, size, group = i, 0, []
        if len(t) > _LONG:
            lo = 0
            while len(t) - lo > _LONG:
                cut = _GAP.search(t, lo + _PIECE)
                if not cut or cut.end() >= len(t):
                    break
                yield i, [t[lo : cut.start()]], False
                lo = cut.end()
            yield i, [t[lo:]], True
            at, size, group = i + 1, 0, []
        else:
            group.append(t)
            size += len(t)
    if group:
        yield at, group, True


def token_pieces(texts: list[bytes]):
    """(index of the first text, Tokens) over all texts; a piece that its text continues after has no end token, and the next one knows the tokens before."""
    before = (_START, _START)
    for at, group, ends in _pieces(texts):
        t = tokens_of(group)
        if ends:
            yield at, Tokens(t.hash, t.cell, t.owner, before)
            before = (_START, _START)
        else:
            cut = Tokens(t.hash[:-1], t.cell[:-1], t.owner[:-1], before)
            yield at, cut
            before = (*cut.hash[:-3:-1], *before)[:2]


def features(t: Tokens) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each kind, the row of the class weights and a number that with the class gives the row of the cell weights."""
    n = len(t.hash)
    before = []
    for back in (1, 2):
        h = np.full(n, _START)
        if n > back:
            same = t.owner[back:] == t.owner[:-back]
            h[back:][same] = t.hash[:-back][same]
        first = min(back, n, int(np.searchsorted(t.owner, t.owner[0], side="right"))) if n else 0
        for i in range(first):
            h[i] = t.before[back - 1 - i]
        before.append(h)
    mixed = [before[0] ^ np.uint64(0x1234567), _mix(before[1] + np.uint64(0x51ED27)), _mix(before[0] * np.uint64(3) + before[1])]
    return [((m >> np.uint64(20)) % np.uint64(ROWS)).astype(np.intp) for m in mixed], mixed


def cell_rows(mixed: list[np.ndarray], classes: np.ndarray) -> list[np.ndarray]:
    return [(_mix(m + classes.astype(np.uint64) * np.uint64(_BASE)) % np.uint64(CELL_ROWS)).astype(np.intp) for m in mixed]


#: Rows and columns of the two tables of weights, which have KINDS layers each.
SHAPES = ((ROWS, CLASSES), (CELL_ROWS, CELLS))


@dataclass
class Model:
    """Weights (kind, hashed feature, class; kind, hashed feature, cell) and priors from the mass of classes and cells."""

    weights: list[np.ndarray]
    class_prior: np.ndarray
    cell_prior: np.ndarray

    @staticmethod
    def start(mass: np.ndarray) -> Model:
        """Without weights the model is that of the mass of the cells alone."""
        m = mass.reshape(CLASSES, CELLS)
        by = m.sum(1)
        return Model([np.zeros((KINDS, *shape), np.float32) for shape in SHAPES], (by / by.sum()).astype(np.float32), (m / by[:, None]).astype(np.float32))

    def stepped(self, sums: list[np.ndarray]) -> Model:
        """The model after one step; sums: by kind and row the gradient, and in the last column the row's tokens."""
        new = []
        for w, s, prior in zip(self.weights, sums, (self.class_prior, np.full(CELLS, 1 / CELLS)), strict=True):
            g = s[..., :-1]
            step = np.sign(g) * np.log1p(np.abs(g) / (s[..., -1:] * prior + DAMP))
            new.append(np.clip(w + RATE * step, -MOST, MOST).astype(np.float32))
        return Model(new, self.class_prior, self.cell_prior)


class Batches:
    """Goes through tokens in sparse batches: only rows that a batch's features name are read and written."""

    def __init__(self, model: Model):
        self.model = model
        self.odds = [np.exp(w) for w in model.weights]  # a softmax is a product of rows of these, then
        self.sums: list[np.ndarray] = []

    def _steps(self, t: Tokens):
        """Slice, and for both softmaxes (rows by kind, the right column, odds, their sums)."""
        rows, mixed = features(t)
        for at in range(0, len(t.hash), STEP):
            cut = slice(at, at + STEP)
            classes, places = np.divmod(t.cell[cut], CELLS)
            pick = [r[cut] for r in rows], cell_rows([m[cut] for m in mixed], classes)
            out = []
            for hit, y, table, odds in zip(pick, (classes, places), self.odds, (None, np.take(self.model.cell_prior, classes, axis=0)), strict=True):
                if odds is None:
                    odds = np.repeat(self.model.class_prior[None], len(classes), 0)
                for k, r in enumerate(hit):
                    odds *= np.take(table[k], r, axis=0)
                out.append((hit, y, odds, odds @ np.ones(odds.shape[1], np.float32)))
            yield cut, out

    def log10(self, t: Tokens) -> np.ndarray:
        """log10 of P(class | h) * P(cell | class, h) for each token."""
        out = np.zeros(len(t.hash))
        for cut, both in self._steps(t):
            for _, y, odds, total in both:
                out[cut] += np.log10(odds[np.arange(len(y)), y] / total.astype(float))
        return out

    def learn(self, t: Tokens) -> None:
        """Add the gradient of the tokens' log-likelihood to the sums: what is there less what the model expects."""
        self.sums = self.sums or [np.zeros((KINDS, columns + 1, rows)) for rows, columns in SHAPES]
        for _, both in self._steps(t):
            for (hit, y, odds, total), sums in zip(both, self.sums, strict=True):
                odds *= (-1 / total)[:, None]
                odds[np.arange(len(y)), y] += 1
                columns = np.ascontiguousarray(odds.T)
                for k, r in enumerate(hit):
                    n = sums.shape[2]
                    for j, c in enumerate(columns):
                        sums[k, j] += np.bincount(r, c, n)
                    sums[k, -1] += np.bincount(r, minlength=n)

    def blocks(self):
        """(table, kind, first row, packed sums) of blocks of rows that occurred."""
        for table, sums in enumerate(self.sums):
            for kind in range(KINDS):
                rows = np.ascontiguousarray(sums[kind].T, "<f4")
                for at in range(0, len(rows), BLOCK_ROWS):
                    if rows[at : at + BLOCK_ROWS, -1].any():
                        yield table, kind, at, rows[at : at + BLOCK_ROWS].tobytes()


def _counted(docs: DataFrame, most: int = 1_500_000) -> DataFrame:
    """h, cell, c of every training token's hash: counts of a task first, then of all."""
    def rows(batches):
        have: list[tuple] = []
        size = 0

        def merged():
            h, cell, c = (np.concatenate([x[i] for x in have]) for i in range(3))
            h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            return h, cell[first], np.bincount(inverse, c, len(h)).astype(np.int64)

        def batch():
            h, cell, c = merged()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(cell.astype(np.int32)), pa.array(c)], ["h", "cell", "c"])

        for b in batches:
            for _, t in token_pieces(texts_of(b, "text")):
                h, first, c = np.unique(t.hash, return_index=True, return_counts=True)
                have.append((h, t.cell[first], c))
                size += len(h)
                if size > most:
                    have = [merged()]
                    size = len(have[0][0])
                    if size > most // 2:
                        yield batch()
                        have, size = [], 0
        if have:
            yield batch()

    return docs.select("text").mapInArrow(rows, "h long, cell int, c long").groupBy("h").agg(F.first("cell").alias("cell"), F.sum("c").alias("c"))


def _round(docs: DataFrame, model: Model, tasks: int) -> Model:
    """One synchronous round of updates over ``docs``."""
    names = ["table", "kind", "at", "packed"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    def learn(batches):
        learner = Batches(model)
        for b in batches:
            for _, t in token_pieces(texts_of(b, "text")):
                learner.learn(t)
        for x in learner.blocks():
            yield batch([x])

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, packed in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                x = np.frombuffer(packed, "<f4").astype(float)
                key = tuple(key)
                sums[key] = sums[key] + x if key in sums else x
        for key, x in sums.items():
            yield batch([(*key, x.astype("<f4").tobytes())])

    schema = "table int, kind int, at int, packed binary"
    # as large as the weights, whatever the corpus
    got = docs.select("text").coalesce(tasks).mapInArrow(learn, schema).repartition("table", "kind", "at").mapInArrow(add, schema).collect()
    sums = [np.zeros((KINDS, rows, columns + 1)) for rows, columns in SHAPES]
    for r in got:
        x = np.frombuffer(r["packed"], "<f4").reshape(-1, sums[r["table"]].shape[2])
        sums[r["table"]][r["kind"], r["at"] : r["at"] + len(x)] = x
    return model.stepped(sums)


def score_documents(docs: DataFrame, held_out, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``; the model learns from rows where ``held_out`` (a column) is false.

    A null text counts as empty: its one token is the end. Texts of any length are read whole, with their history. Repeated rows are scored, and learned from, each. Without training rows every count is zero. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    training = rows.where("not held_out")
    counts = scratch.keep(_counted(training))
    cells = counts.groupBy("cell").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # at most CLASSES * CELLS rows
    mass = np.ones(CLASSES * CELLS)
    for r in cells:
        mass[r["cell"]] += r["n"] + r["v"]
    n_all, v_all = sum(r["n"] for r in cells), sum(r["v"] for r in cells)

    # the smallest power of two that the counts of at most ``frequent`` words reach
    size = F.floor(F.log2(F.col("c").cast("double"))).cast("int")
    levels = {r["k"]: r["n"] for r in counts.groupBy(size.alias("k")).agg(F.count("*").alias("n")).collect()}  # at most 63 rows
    above = [k for k in range(64) if sum(n for j, n in levels.items() if j >= k) <= frequent]
    head = counts.where(F.col("c") >= F.lit(1 << min(above)).cast("long")).select("h", "c").toArrow()
    known, known_c = head["h"].to_numpy().view(np.uint64), head["c"].to_numpy()
    order = np.argsort(known)
    known, known_c = known[order], known_c[order]

    model = Model.start(mass)
    if n_all:
        fold = F.pmod(F.xxhash64(id_text("doc_id")), F.lit(rounds))
        splits = training.rdd.getNumPartitions()
        # a task takes as many splits as there are folds, if that leaves one for every core
        tasks = max(-(-splits // rounds), min(splits, spark.sparkContext.defaultParallelism))
        for k in range(rounds):
            model = _round(training.where(fold == k), model, tasks)
            scratch.tidy()
    log_mass = np.log10(mass)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        scorer = Batches(model)
        for b in batches:
            texts = texts_of(b, "text")
            n, near, sums, seen = (np.zeros(len(texts), k) for k in (np.int64, float, float, np.int64))
            rare: list[list] = [[] for _ in texts]
            for at, t in token_pieces(texts):
                who = t.owner + at
                n += np.bincount(who, minlength=len(texts))
                near += np.bincount(who, scorer.log10(t) - log_mass[t.cell], len(texts))
                place = np.minimum(np.searchsorted(known, t.hash), max(len(known) - 1, 0))
                hit = known[place] == t.hash if len(known) else np.zeros(len(t.hash), bool)
                sums += np.bincount(who[hit], np.log10(known_c[place[hit]] + 1.0), len(texts))
                seen += np.bincount(who[hit], minlength=len(texts))
                ids, words = who[~hit], t.hash[~hit].view(np.int64)
                cut = np.searchsorted(ids, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    if cut[i] < cut[i + 1]:
                        rare[i].append(words[cut[i] : cut[i + 1]])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(n), pa.array(near), pa.array(sums), pa.array(seen), pa.array([np.concatenate(x) if x else np.zeros(0, np.int64) for x in rare], pa.list_(pa.int64()))],
                ["doc_id", "held_out", "n_tokens", "near", "sums", "seen", "rare"],
            )

    parts = rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, near double, sums double, seen long, rare array<long>")
    parts = scratch.keep(parts.withColumn("row", F.monotonically_increasing_id()))
    rare = parts.select("row", F.explode("rare").alias("h")).join(counts, "h").groupBy("row").agg(F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("more"), F.count("*").alias("also"))
    out = parts.drop("rare").join(rare, "row", "left").na.fill(0, ["more", "also"])
    total = F.col("sums") + F.col("more")
    scratch.tidy()
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.col("also")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * math.log10(n_all + v_all + 1)).alias("base_score"), (total + F.col("near")).alias("score"),
    )


def remainder(column: str = "doc_id"):
    """crc32 of the id as text, modulo 7."""
    return F.pmod(F.crc32(id_text(column).cast("binary")), F.lit(7))
