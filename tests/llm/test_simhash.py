import os
import random

import numpy as np
import pytest
import xxhash

from graphflow.llm import simhash

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(rows):
    """rows of (doc_id, fingerprint); the smallest id reachable."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f, least.get(find(i))) for i, (d, f) in enumerate(rows)), key=str)


def test_fingerprint():
    for t in ("", None, "a", "A b", "a b c", "a b c a b c a b c d", "é ü\tx\x0bY z é ü x y"):
        assert simhash.fingerprint((t or "").encode().lower().split()) == slow_fingerprint(t)


def test_code_covers_pairs():
    tables = simhash.code_tables()
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 4000)
    index, counts = simhash.codeword_indices(v, tables)
    for bit in range(23):
        other, other_counts = simhash.codeword_indices(v ^ (1 << bit), tables)
        for k in range(0, len(v), 37):
            assert set(index[k][counts[k]]) & set(other[k][other_counts[k]])


def test_keys_find_all_pairs_within_two_bits():
    tables, rng = simhash.code_tables(), random.Random(5)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randint(0, 2)):
            b ^= 1 << rng.randrange(64)
        at, keys = simhash.golay_keys(np.array([a, b], np.uint64), tables)
        assert set(keys[at == 0]) & set(keys[at == 1])


@pytest.mark.parametrize("few", [2, 48])
def test_near_duplicates(spark, make, odd_rows, few):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(make([((i + 5000) if i else i, t) for i, t, _ in odd_rows], "doc_id long, text string"))
    rows = [(r[0], slow_fingerprint(r[1])) for r in docs.collect()]
    got = sorted(((r[0], r[1] & (2**64 - 1), r[2]) for r in simhash.near_duplicates(docs, few=few).collect()), key=str)
    assert got == slow_components(rows)


def test_dense_groups_link_without_pairs(spark):
    rng = random.Random(9)
    start = rng.getrandbits(64)
    fps = {start}
    for _ in range(400):  # a dense ball and a chain that leaves it
        fps.add(start ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    chain = start
    for i in range(0, 60, 2):
        chain ^= 3 << i
        fps.add(chain)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(signed, "least long, fp long")
    from graphflow.operators.components import components
    from graphflow.scratch import Scratch

    scratch = Scratch(spark)
    for few in (4, 48):
        got = {r[0]: r[1] for r in components(simhash.links(df, scratch, few), scratch).collect()}
        want = slow_components([(i, f & (2**64 - 1)) for i, f in signed])
        name = {f & (2**64 - 1): i for i, f in signed}
        groups = {}
        for i, f in signed:
            groups.setdefault(got.get(f, f), []).append(i)
        least = {i: min(g) for g in groups.values() for i in g}
        assert {(i, least[i]) for i, _ in signed} == {(i, c) for i, f, c in want} and len(name) == len(signed)


def test_keep_first(make):
    t = " ".join(f"w{i}" for i in range(30))
    df = make([(1, t, "x"), (1, t, "x"), (2, t, "y"), (3, t + " zz", "z"), (4, "other words here now", "q"), (None, t, "n")], "doc_id long, text string, fp string")
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 4 in ids and None in ids


def test_empty(make):
    assert simhash.near_duplicates(make([], "doc_id long, text string")).count() == 0


def slow_similar(rows, similar):
    """Ids that stay of (doc_id, text): two-bit links and pairs whose five-word shingle sets are similar."""
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    fps, root = [slow_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (fps[i] ^ fps[j]).bit_count() <= 2 or a | b and len(a & b) >= similar * len(a | b) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def test_stage_drops_near_copies_beyond_two_bits(make):
    import corpus_pipeline

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    line = " ".join(rng.choices(vocabulary, k=40))
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice((6, 30, 120, 300))) + line.split() * (g % 2)
        for k in range(60 if g == 3 else 8):
            copy = list(base)
            for _ in range(k % 16):  # from equal to far, with similarities around the bound
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    want = slow_similar(rows, 0.8)
    df = make(rows, "doc_id long, text string")
    assert len(want) < simhash.keep_first(df).count()  # two bits alone leave some
    got = corpus_pipeline.near_dedup(df.sparkSession, df, "")
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == want


def test_stage_writes_less_than_its_texts(make, monkeypatch, tmp_path):
    import corpus_pipeline
    from graphflow.scratch import Scratch

    rng = random.Random(6)
    rows = [(i, " ".join(f"{rng.getrandbits(24):06x}" for _ in range(3000))) for i in range(120)]
    rows += [(1000 + i, t.replace(t[:6], "changed", 1)) for i, t in rows[:20]]
    live, most, keep, drop = {}, [], Scratch.keep, Scratch.drop

    def watched(self, df):
        back = keep(self, df)
        path = back._scratch_path.removeprefix("file://")
        live[path] = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path))
        most.append(sum(live.values()))
        return back

    def dropped(self, *tables):
        for t in tables:
            live.pop(getattr(t, "_scratch_path", "").removeprefix("file://"), None)
        drop(self, *tables)

    monkeypatch.setattr(Scratch, "keep", watched)
    monkeypatch.setattr(Scratch, "drop", dropped)
    df = make(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(df.sparkSession, df, "").collect()) == list(range(120))
    assert max(most) < 0.8 * sum(len(t) for _, t in rows)  # the whole sets take 1.1


def test_parity_tells_long_sets_apart():
    rng = np.random.default_rng(2)
    for n in (1, 64, 65, 3000, 9000):
        a, b = (np.unique(rng.integers(-(2**63), 2**63, n)) for _ in range(2))
        pa, pb = simhash.parity(a), simhash.parity(b)
        assert len(pa) * 64 >= n and len(pa) == len(pb)
        apart = int(np.bitwise_count((pa ^ pb).view(np.uint64)).sum())
        assert apart <= 2 * n and (n < 64 or apart * 1.8 > 0.2 * 2 * n)


@pytest.mark.parametrize("most", [500_000, 3])
def test_similar_sets_of_any_sample_and_size(make, monkeypatch, most):
    """Sets with parity bits of different sizes, copies, and an order of shingles from few documents."""
    monkeypatch.setattr(simhash, "SAMPLE", 20)
    monkeypatch.setattr(simhash, "MOST", most)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    line = " ".join(rng.choices(vocabulary, k=12))
    rows = []
    for size in (64, 512, 1020):
        for _ in range(4):
            base = rng.choices(vocabulary, k=size) + line.split()
            for k in (0, 0, 3, size // 9, size // 7, size // 6, size // 5):
                rows.append((len(rows), " ".join(base[: len(base) - k])))
    got = simhash.keep_first(make(rows, "doc_id long, text string"), similar=0.8)
    assert sorted(r["doc_id"] for r in got.collect()) == slow_similar(rows, 0.8)
