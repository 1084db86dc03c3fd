import re
from collections import Counter

import numpy as np

from graphflow.llm import quality

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts(spark, make, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(make([(i, t) for i, t, _ in odd_rows], "doc_id long, text string"))
    trees = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = Counter((r["doc_id"], *(r[c] for c in quality.BASE), r["base_failed"]) for r in quality.assess(docs, trees).collect())
    want = Counter()
    for d, t in docs.collect():
        c = slow(t or "")
        want[d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]] += 1
    assert got == want
    assert all(not r["kept"] for r in quality.assess(docs, trees).where("base_failed").collect())


def test_verdict_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    trees = quality.fit(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.assess(docs, trees).join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").collect()
    assert len(rows) > 80
    assert np.mean([r["kept"] == bool(r["quality"]) for r in rows]) > 0.95
    assert np.mean([r["kept"] for r in rows if r["quality"]]) > 0.97


def test_scores_never_rise_with_a_constrained_feature():
    rng = np.random.default_rng(4)
    x = rng.random((600, 4))
    y = ((x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) - x[:, 2] + 0.2 * rng.normal(size=600)) > 0.2).astype(float)
    trees = quality.fit_trees(x, y, np.array([-1, 0, -1, 1]))
    grid = np.linspace(0, 1, 60)
    for j, sign in ((0, -1), (2, -1), (3, 1)):
        for _ in range(40):
            rows = np.repeat(rng.random((1, 4)), 60, 0)
            rows[:, j] = grid
            assert (sign * np.diff(trees.score(rows)) >= -1e-12).all()
    free = quality.fit_trees(x, y, np.zeros(4, int))
    assert np.mean((free.score(x) > 0) == y) > 0.9


def test_no_labels_empty_tables_and_extra_columns(spark, make):
    text = " ".join(f"w{i}" for i in range(60))
    df = make([(1, text, "x"), (None, None, "y"), (1, text, "x")], "doc_id long, text string, kept string")
    none = make([(None, 1), (1, None), (99, 1)], "doc_id long, quality int")
    trees = quality.fit(df, none)
    assert Counter(r["kept"] for r in quality.assess(df, trees).collect()) == {True: 2, False: 1}
    kept = quality.keep_good(df, trees)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, text, "x")] * 2
    empty = make([], "doc_id long, text string")
    assert quality.assess(empty, quality.fit(empty, none)).count() == 0
    one_class = quality.fit(df, make([(1, 1)], "doc_id long, quality int"))
    assert quality.keep_good(df, one_class).count() == 2


def test_repeated_ids_are_learned_from_once(spark, make, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit_trees", lambda x, y, *_: seen.append(len(y)))
    rows = [(i % 10, f"text {i} " * (20 + i)) for i in range(500)]
    quality.fit(make(rows, "doc_id long, text string"), make([(i, 1) for i in range(10)] * 3, "doc_id long, quality int"), 8)
    assert seen == [8]
