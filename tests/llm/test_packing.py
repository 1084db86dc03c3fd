import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphflow.llm import packing

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_tokenizer(spark, tokenizer, odd_rows, monkeypatch):
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [t or "" for _, t, _ in odd_rows]
    texts += ["a b\nc d", "a b c", " lead", "trail ", "a  b", "a\n\nb", "don't we'll\nx's", "<|endoftext|> x", "x <|endoftext|> y", "a<|endoftext|>\n\nb", "a \t\tb \r\nc\x0b\x0cd", "\n\n  x  \n", "\t", "  ", "é è\nüx y", "a\x1cb c", "a\x85b c\x85", "\n", "a \nb", "😀 é́ b"]
    monkeypatch.setattr(packing, "CACHE", 500)
    enc = packing.Encoder(PATH)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in map(enc.encode, texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'sdAé1.,<|_\xa0\x85"), st.characters(codec="utf-8"))))
def test_encoder_equals_tokenizer_on_any_text(text):
    enc = packing.encoder(PATH)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_long_text(make, tokenizer):
    text = "\n".join(f"word{i % 977} of line  {i}" for i in range(60_000))
    got = packing.pack(make([(1, text, "x")], "doc_id long, text string, span string"), PATH).collect()
    assert check(got, [(1, text)], tokenizer, packing.ROOM) <= 1 + -(-sum(r["length"] for r in got) // packing.ROOM)


def test_spans_are_packed_apart_and_in_order(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = packing.pack(docs, PATH, 256, span=F.col("doc_id") % 3).collect()
    check(got, [tuple(r) for r in docs.collect()], tokenizer, 256)
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], set()).add(r["doc_id"] % 3)
    order = [spans[k] for k in sorted(spans)]
    assert all(len(x) == 1 for x in order) and [min(x) for x in order] == sorted(min(x) for x in order)


def test_clashing_columns(make, tokenizer):
    rows = [(i, f"text {i} of several words", 7, "a", 1, 2, 3) for i in range(50)]
    got = packing.pack(make(rows, "doc_id long, text string, part int, length string, span int, rank int, lo int"), PATH, 32).collect()
    check(got, [r[:2] for r in rows], tokenizer, 32)


def check(got, rows, tokenizer, room):
    want = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % room or room
        bounds = [0, *range(first, len(ids) + 1, room)] if len(ids) > room else [0, len(ids)]
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[d, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= room
    return len(bins)


@pytest.mark.parametrize("room", [1024, 64])
def test_pack(spark, make, odd_rows, tokenizer, room):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(make([(i, t) for i, t, _ in odd_rows], "doc_id long, text string"))
    got = packing.pack(docs, PATH, room).collect()
    n = check(got, [tuple(r) for r in docs.collect()], tokenizer, room)
    assert n <= 1.02 * -(-sum(r["length"] for r in got) // room) + 1


def test_empty(make):
    assert packing.pack(make([], "doc_id long, text string, length string"), PATH).count() == 0


def test_histogram_packs_everything_tightly():
    rng = random.Random(2)
    for room in (10, 100, 1024):
        for _ in range(20):
            counts = Counter(rng.randint(1, room) for _ in range(rng.randint(1, 3000)))
            bins = packing.best_two_fit(dict(counts), room)
            used = Counter()
            for lengths, times in bins:
                assert sum(lengths) <= room and times > 0
                for n in lengths:
                    used[n] += times
            assert used == counts


def test_two_documents_replace_the_smallest():
    # greedy takes 6 + 3 of 10; 2 + 2 fill the widened gap of 4 exactly
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)
