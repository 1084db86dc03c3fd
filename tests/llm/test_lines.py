import random
import re
from collections import Counter

from graphflow.llm import lines
from graphflow.scratch import Scratch

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(rows, least):
    """Per document (id, text): deleted places among all lines, by comparing passages as tuples."""
    docs = sorted({(i if i is not None else lines.NO_ID, t) for i, t in rows if t is not None})
    seen, gone = set(), {}
    table = [(d, t, [(r, x, len(WORDS.findall(x))) for r, x in enumerate(t.split("\n")) if WORDS.search(x)]) for d, t in docs]
    for d, t, ls in table:
        out = set()
        for i in range(len(ls)):
            total, j = 0, i
            while j < len(ls) and total < least:
                total += ls[j][2]
                j += 1
            if total >= least:
                key = tuple(x for _, x, _ in ls[i:j])
                if key in seen:
                    out |= set(range(i, j))
                seen.add(key)
        gone[d, t] = sorted(out), ls
    return gone


def check(df, rows, least):
    gone = brute(rows, least)
    got = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_deleted"], r["n_runs"]) for r in lines.dedup_lines(df, least).collect())
    want = Counter()
    for i, t in rows:
        if t is None:
            want[i, None, 0, 0, 0] += 1
            continue
        cut, ls = gone[i if i is not None else lines.NO_ID, t]
        places = {ls[k][0] for k in cut}
        text = "\n".join(x for r, x in enumerate(t.split("\n")) if r not in places)
        want[i, text, len(ls), len(cut), sum(1 for k in cut if k - 1 not in cut)] += 1
    assert got == want


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    for least in (3, 50):
        check(docs, rows, least)


def test_odd_rows(make, odd_rows):
    rows = [(i, t) for i, t, _ in odd_rows]
    for least in (1, 5, 50, 200):
        check(make(rows, "doc_id long, text string"), rows, least)


def test_runs_within_a_document_keep_the_first(make):
    rows = [(1, "a b\na b\na b\nc"), (2, "c\na b"), (3, "x\n\na b\nc d e")]
    check(make(rows, "doc_id long, text string"), rows, 2)
    check(make(rows, "doc_id long, text string"), rows, 4)


def test_empty_table_and_clashing_columns(make):
    df = make([], "doc_id long, text string, n_lines string")
    assert lines.dedup_lines(df).count() == 0
    df = make([(1, "a", "x")], "doc_id long, text string, n_runs string")
    assert lines.dedup_lines(df).columns == ["doc_id", "text", "n_lines", "n_deleted", "n_runs"]


def test_suffix_and_lcp_arrays_match_brute_force(make, spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 5)
    rng = random.Random(5)
    stretches = [(d, 0, 100 * s, [rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randint(1, 30))]) for d in range(6) for s in range(2)] + [(9, d, 0, [1, 2] * 12) for d in range(3)]
    for depth in (1, 2, 7, 12):
        rows = [(d, th, at + k, at + k, x, depth if len(xs) - k >= depth else None, len(xs) - k) for d, th, at, xs in stretches for k, x in enumerate(xs)]
        got = lines.suffix_array(make(rows, "d long, th long, i int, r int, rank long, m int, e int"), depth, Scratch(spark)).orderBy("s").collect()
        size = 1
        while size < depth:
            size *= 2
        want = sorted((tuple(xs[k : k + size]), (d, th, at + k)) for d, th, at, xs in stretches for k in range(len(xs) - depth + 1))
        assert [(r["d"], r["th"], r["i"]) for r in got] == [place for _, place in want]
        assert [r["s"] for r in got] == list(range(len(want)))
        shared = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for (a, _), (b, _) in zip(want, want[1:])]
        assert [r["lcp"] for r in got] == [0, *shared]


def test_intervals_go_on_over_blocks(make, odd_rows, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", 2)
    rows = [(i, t) for i, t, _ in odd_rows] + [(100 + i, f"a b\nc d\ne{i % 2}") for i in range(9)]
    for least in (4, 50):
        check(make(rows, "doc_id long, text string"), rows, least)
