import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphflow.llm import suffix

SF = "/root/testdata/sf0.001"


def slow(texts, length):
    where = defaultdict(int)
    for t in texts:
        for i in range(len(t) - length + 1):
            where[t[i : i + length]] += 1
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if where[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0 if len(t) else np.zeros(0, bool)
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(df, length, gram, hot):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in df.collect()]
    want = Counter((d, *x) for (d, _), x in zip(rows, slow([t for _, t in rows], length), strict=True))
    assert Counter(tuple(r) for r in suffix.dedup_bytes(df, length, gram, hot).collect()) == want


@pytest.mark.parametrize("hot", [60_000, 1])
def test_documents(spark, make, odd_rows, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(make([(i, t) for i, t, _ in odd_rows], "doc_id long, text string"))
    check(docs, 200, 32, hot)


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 7, 8, 12, 200])
def test_suffix_ranks_are_byte_order(length):
    rng = random.Random(length)
    for data in (bytes(rng.choice(b"ab\xff\x00") for _ in range(900)), b"a" * 500, bytes(rng.randrange(256) for _ in range(600))):
        got = suffix.suffix_ranks(np.frombuffer(data, np.uint8), length).tolist()
        cuts = [data[i : i + length] for i in range(len(data) - length + 1)]
        names = {c: k for k, c in enumerate(sorted(set(cuts)))}
        assert got == [names[c] for c in cuts]


def test_many_places_do_not_fit_one_number():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 1 << 28, 4000), rng.integers(0, 1 << 28, 4000)
    low[1000:2000], high[1000:2000] = low[:1000], high[:1000]
    pairs = list(zip(high.tolist(), low.tolist(), strict=True))
    names = {p: k for k, p in enumerate(sorted(set(pairs)))}
    assert suffix._ranked(high, low, 28).tolist() == [names[p] for p in pairs]


def test_small_alphabet_and_periods(make):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, "a" * 50), (101, "ab" * 30), (102, "abc" * 4 + "é" * 30), (103, rows[3][1] + rows[4][1]), (103, rows[3][1] + rows[4][1])]
    for length, gram, hot in ((8, 3, 100), (12, 4, 2), (9, 9, 1), (5, 1, 50)):
        check(make(rows, "doc_id long, text string"), length, gram, hot)


def test_long_texts_are_read_in_stretches(make, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(suffix, "_PIECE", 700)
    texts = [bytes(rng.choice(b"abcdefgh") for _ in range(3000)).decode() for _ in range(3)]
    texts.append(texts[0][500:1500] + texts[1][:900] + texts[2][2000:])
    b = [t.encode() for t in texts]
    # the same phrases' windows, in stretches
    seen = Counter()
    for _, part, _ in suffix._pieces(b, 50):
        _, s, n, _, _ = suffix.phrases_of(part, 50, 10)
        seen["windows"] += int(n.sum())
    assert seen["windows"] == sum(len(t) - 49 for t in b)


def test_very_long_texts(make):
    rng = random.Random(11)
    long = [" ".join(f"{rng.randrange(10**9)}" for _ in range(250_000)) for _ in range(2)]  # 2.4 MB each: several stretches
    long.append(long[0][1_000_000:1_000_400] + long[1][-300:] + "tail")
    got = {r["doc_id"]: r for r in suffix.dedup_bytes(make(list(enumerate(long)), "doc_id long, text string")).collect()}
    assert [(got[i]["n_removed"], got[i]["n_spans"]) for i in range(3)] == [(400, 1), (300, 1), (700, 1)]
    kept = [long[0][:1_000_000] + long[0][1_000_400:], long[1][:-300], "tail"]
    assert [got[i]["kept_sha256"] for i in range(3)] == [hashlib.sha256(k.encode()).hexdigest() for k in kept]


def test_empty_tables_and_kept_bytes(make):
    assert suffix.dedup_bytes(make([], "doc_id long, text string")).count() == 0
    t = "".join(chr(97 + i * i % 23) for i in range(400))
    df = make([(1, t + "x", 1), (2, t, 2), (None, None, 3)], "doc_id long, text string, at long")
    got = {r["doc_id"]: r["kept"] for r in suffix.dedup_bytes(df, texts=True).collect()}
    assert bytes(got[1]) == b"x" and bytes(got[2]) == b"" and bytes(got[None]) == b""
