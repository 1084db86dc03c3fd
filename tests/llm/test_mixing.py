import math
from collections import Counter, defaultdict

import pytest

from graphflow.llm import mixing

SF = "/root/testdata/sf0.001"


def edf(blocks, weights, period):
    """Slot by slot over whole phases, shares and periods as the operator makes them."""
    left, done, slots, t = {s: n for s, n in blocks.items() if n}, Counter(), {}, 0
    while left:
        span = max(period, 10 * len(left)) if len(left) * 2 > period else period
        a = mixing.shares({s: weights[s] for s in left}, span)
        run, u = Counter(), 0
        while True:
            released = [(math.ceil((run[s] + 1) * span / a[s]), s) for s in left if run[s] * span // a[s] <= u]
            s = min(released)[1]
            slots[s, done[s] + run[s]] = t
            run[s] += 1
            t += 1
            u += 1
            for x in left:  # less than one block ahead or behind
                assert abs(run[x] - u * a[x] / span) < 1
            if run[s] == left[s]:
                break
        for x in run:
            left[x] -= run[x]
            done[x] += run[x]
        left = {x: n for x, n in left.items() if n}
    return slots


@pytest.mark.parametrize("period", [20, 97])
def test_phases_equal_slot_by_slot_edf(period):
    for blocks in ({"a": 5}, {"a": 40, "b": 13, "c": 1}, {"a": 300, "b": 100, "c": 7, "d": 50}, {"x": 9, "y": 9}):
        weights = {s: (i + 1) ** 1.3 for i, s in enumerate(blocks)}
        want = edf(blocks, weights, period)
        got = {}
        for p in mixing.phases(blocks, weights, period):
            for i in range(p["lo"], p["hi"]):
                j = i - p["lo"]
                got[p["source"], i] = p["start"] + j // p["a"] * p["span"] + p["slots"][j % p["a"]]
        assert got == want
        assert sorted(got.values()) == list(range(sum(blocks.values())))


def test_shares_are_whole_and_cover_the_period():
    for n in (1, 3, 20):
        a = mixing.shares({f"s{i}": 10.0**i % 7 + 0.001 for i in range(n)}, 100)
        assert sum(a.values()) == 100 and min(a.values()) >= 1


def test_every_row_is_placed_once(spark, make, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").union(make(odd_rows, "doc_id long, text string, source string"))
    got = mixing.mix(docs, block=4, period=50).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(tuple(r) for r in docs.collect())
    by = defaultdict(list)
    for r in got:
        by[r["source"] or "", r["block"], r["slot"]].append(r["in_block"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(s for _, _, s in by) == list(range(len(by)))
    counts = Counter(r["source"] or "" for r in docs.collect())
    want = edf({s: -(-n // 4) for s, n in counts.items()}, {s: n**0.5 for s, n in counts.items()}, 50)
    assert {(s, b): t for s, b, t in by} == want


def test_weights_must_cover_sources(make):
    df = make([(1, "a"), (2, "b")], "doc_id long, source string")
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 1.0})


def test_empty_and_clashing_columns(make):
    df = make([], "doc_id long, source string, slot string")
    assert mixing.mix(df).count() == 0
    df = make([(1, "a", "x", 1, 2), (1, "a", "x", 1, 2)], "doc_id long, source string, block string, lo int, start int")
    assert mixing.mix(df).columns == ["doc_id", "source", "lo", "start", "block", "slot", "in_block"] and mixing.mix(df).count() == 2


def test_many_sources_are_scheduled(make):
    rows = [(i, f"s{k:03}") for i, k in enumerate(k for k in range(450) for _ in range(1 + (k * 7) % 23))]
    got = mixing.mix(make(rows, "doc_id long, source string"), block=4, period=50).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(rows)
    counts = Counter(s for _, s in rows)
    want = edf({s: -(-n // 4) for s, n in counts.items()}, {s: n**0.5 for s, n in counts.items()}, 50)
    assert {(r["source"], r["block"]): r["slot"] for r in got} == want
    places = defaultdict(list)
    for r in got:
        places[r["slot"]].append(r["in_block"])
    assert sorted(places) == list(range(len(want))) and all(sorted(v) == list(range(len(v))) for v in places.values())
