import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphflow.llm import maxent

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


def slow(rows):
    tokens = [[*WORD.findall(lower(t or "")), ""] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(w in c for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), ws, h in zip(rows, tokens, held, strict=True)]


def compare(df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted(map(tuple, maxent.score_documents(df, maxent.remainder() == 2, **options).collect()), key=str)
    want = sorted(slow(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want] or sorted(g[:5] for g in map(lambda x: tuple(map(str, x)), got)) == sorted(tuple(map(str, w))[:5] for w in want)
    key = lambda x: (str(x[0]), x[2], round(x[5], 4))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
    return got


def test_base_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for frequent in (1 << 18, 50):
        got = compare(docs, frequent=frequent)
        held = [g for g in got if g[1]]
        assert len(held) > 50 and all(g[6] < 0 for g in got)
        assert sum(g[6] for g in held) > 0.975 * sum(g[5] for g in held)  # log10: the model is better than counts alone


def test_odd_rows(make, odd_rows):
    df = make([(i, t, "x") for i, t, _ in odd_rows], "doc_id long, text string, score string")
    compare(df)
    compare(make([(2, "a b"), (2, None)], "doc_id long, text string"))
    assert maxent.score_documents(make([], "doc_id long, text string"), maxent.remainder() == 2).count() == 0


MASK = (1 << 64) - 1


def mix(x):
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 32)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 29)


def slow_scores(rows, folds, known):
    """The model in plain loops: rows (text, fold or None if held out); known: hash and cell of a word."""
    c, k = maxent.CLASSES, maxent.CELLS
    texts = [[known(w) for w in [*WORD.findall(lower(t or "")), None]] for t, _ in rows]
    counts = Counter(w for ws, (_, f) in zip(texts, rows, strict=True) if f is not None for w in ws)
    mass = np.ones(c * k)
    for (_, cell), n in counts.items():
        mass[cell] += n + 1
    by = mass.reshape(c, k).sum(1)
    priors = by / by.sum(), mass.reshape(c, k) / by[:, None]
    weights = [np.zeros((3, r, n)) for r, n in maxent.SHAPES]
    start = int(maxent._START)

    def steps(ws):
        for i, (_, cell) in enumerate(ws):
            one, two = (ws[i - j][0] if i >= j else start for j in (1, 2))
            mixed = one ^ 0x1234567, mix((two + 0x51ED27) & MASK), mix((one * 3 + two) & MASK)
            y, place = divmod(cell, k)
            hits = [(m >> 20) % maxent.ROWS for m in mixed], [mix((m + y * maxent._BASE) & MASK) % maxent.CELL_ROWS for m in mixed]
            for table, (hit, right, prior) in enumerate(zip(hits, (y, place), (priors[0], priors[1][y]), strict=True)):
                odds = prior * np.exp(sum(weights[table][j, r] for j, r in enumerate(hit)))
                yield table, hit, right, odds / odds.sum()

    for fold in range(folds):
        sums = [np.zeros((3, r, n + 1)) for r, n in maxent.SHAPES]
        for ws, (_, f) in zip(texts, rows, strict=True):
            if f == fold:
                for table, hit, right, p in steps(ws):
                    for j, r in enumerate(hit):
                        sums[table][j, r, :-1] -= p
                        sums[table][j, r, right] += 1
                        sums[table][j, r, -1] += 1
        for table, prior in enumerate((priors[0], np.full(k, 1 / k))):
            g, n = sums[table][..., :-1], sums[table][..., -1:]
            weights[table] += maxent.RATE * np.sign(g) * np.log1p(abs(g) / (n * prior + maxent.DAMP))
    return [sum(math.log10(p[right]) for _, _, right, p in steps(ws)) + sum(math.log10((counts[w] + 1) / mass[w[1]]) for w in ws) for ws in texts]


def test_score_is_the_models(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 400 and doc_id < 300")
    rows = docs.select("doc_id", "text", maxent.remainder().alias("k"), F.pmod(F.xxhash64(maxent.id_text("doc_id")), F.lit(2)).alias("fold")).collect()

    def known(word):
        t = maxent.tokens_of([word.encode() if word else b""])
        return int(t.hash[0]), int(t.cell[0])

    want = slow_scores([(r["text"], None if r["k"] == 2 else r["fold"]) for r in rows], 2, known)
    got = {r["doc_id"]: r["score"] for r in maxent.score_documents(docs, maxent.remainder() == 2, rounds=2).collect()}
    assert len(got) == len(rows) > 10
    for r, w in zip(rows, want, strict=True):
        assert math.isclose(got[r["doc_id"]], w, rel_tol=1e-4), (r["doc_id"], got[r["doc_id"]], w)


def test_score_depends_on_texts_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    scores = [{r["doc_id"]: r["score"] for r in maxent.score_documents(docs.repartition(n), maxent.remainder() == 2).collect()} for n in (1, 16)]
    assert scores[0].keys() == scores[1].keys()
    assert all(math.isclose(scores[0][d], scores[1][d], rel_tol=1e-6) for d in scores[0])


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    model = maxent.Model.start(rng.exponential(size=maxent.CLASSES * maxent.CELLS))
    model.weights = [rng.normal(size=w.shape).astype(np.float32) for w in model.weights]
    t = maxent.tokens_of([b"some words here", b"x"])
    batches, total = maxent.Batches(model), np.zeros(len(t.hash))
    for cell in range(maxent.CLASSES * maxent.CELLS):
        total += 10 ** batches.log10(maxent.Tokens(t.hash, np.full(len(t.hash), cell), t.owner))
    assert np.allclose(total, 1, atol=1e-3)


def test_training_learns_a_history():
    t = maxent.tokens_of([b"a b c d " * 400])
    model = maxent.Model.start(np.ones(maxent.CLASSES * maxent.CELLS) + np.bincount(t.cell, minlength=maxent.CLASSES * maxent.CELLS))
    before = maxent.Batches(model).log10(t).mean()
    for _ in range(3):
        learner = maxent.Batches(model)
        learner.learn(t)
        model = model.stepped([np.moveaxis(s, 1, 2) for s in learner.sums])
    assert maxent.Batches(model).log10(t).mean() > before + 0.1


def test_history_goes_on_behind_a_cut(monkeypatch):
    text = b" ".join(b"w%d" % (i * i % 23) for i in range(3000))
    model = maxent.Model.start(np.ones(maxent.CLASSES * maxent.CELLS))
    rng = np.random.default_rng(4)
    model.weights = [rng.normal(size=w.shape).astype(np.float32) for w in model.weights]
    whole = maxent.Batches(model).log10(maxent.tokens_of([text]))
    monkeypatch.setattr(maxent, "_PIECE", 40)
    monkeypatch.setattr(maxent, "_LONG", 80)
    parts = [(at, t) for at, t in maxent.token_pieces([b"x y", text, b"z"])]
    assert len(parts) > 50
    got = np.concatenate([maxent.Batches(model).log10(t)[t.owner + at == 1] for at, t in parts])
    assert np.allclose(got, whole, atol=1e-5)


def test_words_and_long_texts(monkeypatch):
    texts = [b"", b" \t ", b"One  two\x0bTHREE\n", "é ü x".encode(), b"end"]
    t = maxent.tokens_of(texts)
    assert np.bincount(t.owner).tolist() == [1, 1, 4, 4, 2]
    assert len(set(t.hash.tolist())) == 8  # seven words and the end
    monkeypatch.setattr(maxent, "_PIECE", 64)
    monkeypatch.setattr(maxent, "_LONG", 128)
    long = b" ".join(b"w%d" % (i % 9) for i in range(500))
    parts = [(at, x) for at, x in maxent.token_pieces([b"a", long, b"b"])]
    got = Counter(int(o) + at for at, x in parts for o in x.owner)
    assert got == {0: 2, 1: 501, 2: 2}
    whole = maxent.tokens_of([long])
    assert np.array_equal(np.concatenate([x.hash[x.owner + at == 1] for at, x in parts]), whole.hash)
