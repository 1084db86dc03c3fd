"""Best-two-fit packing of tokenised documents into sequences of bounded length (operator 8).

Tokens: words are encoded by themselves and kept in a bounded cache as the little-endian bytes of their ids, so a
text costs one lookup a word.

Packing works on the histogram of piece lengths (at most ``room`` counts, whatever the corpus). A bin is opened with the longest length left and filled
greedily with the longest that fits; then its smallest document is replaced by the two unpacked ones that fill the widened gap best, if they fill
it better. The same decisions hold while the same lengths last, so a finished bin becomes a pattern that is applied as often as counts
allow at once: a run of equal bins costs one step. Pieces find their place by their rank among pieces of equal length, which is counted in two
levels, so no length is one group.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphflow.llm.common import small_batches
from graphflow.scratch import Scratch

ROOM = 1024
END = 2
#: Words that a worker keeps.
CACHE = 400_000

#: White space other than the six characters that every pattern language agrees on.
_OTHER_SPACE = re.compile(r"[^\S\t-\r ]")
#: Words of long-standing scripts, whose characters have the same classes in every version of Unicode.
_USUAL = re.compile(r" ?[!-~\u00a1-\u017f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5\uac00-\ud7a3]+")
#: Fixed value: how a byte-level pre-tokeniser splits.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GAP = re.compile(r"([\t-\r ]+)")


def _byte_of() -> dict[str, int]:
    """The byte of each character that byte-level vocabularies are written in: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Ids of pieces as packed bytes, looked up by the piece; a piece that is not kept is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(self) < CACHE:
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts as packed little-endian unsigned 32-bit numbers.

    The pre-tokeniser of the file never joins characters across white space, except that a single space, or the last one of a run, belongs to the word after it. So
    a text is cut there and its words and gaps are encoded by themselves; words of usual characters in a library that merges by the same ranks and is faster for short texts.
    Texts that hold an added token or white space of other kinds are encoded whole, and so is every text if the file is not a byte-level vocabulary with its usual pattern.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", ()))
        self.merger = self._merger(spec["model"]) if self.by_word else None
        self.firsts, self.words, self.gaps = _Words(self._piece), _Words(self._word), _Words(self.whole)

    @staticmethod
    def _merger(model: dict):
        """Ids by the other library, if the vocabulary's ids rise in the order of the merges."""
        import tiktoken

        vocabulary, byte = model["vocab"], _byte_of()
        merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", ""), -1) for m in model["merges"]]
        made = set(merged)
        if model.get("type") != "BPE" or merged != sorted(made) or (merged and merged[0] < 256) or model.get("ignore_merges"):
            return None
        known = {bytes(map(byte.get, w)): i for w, i in vocabulary.items() if byte.keys() >= set(w) and (len(w) == 1 or i in made)}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else b""

    def _piece(self, word: str) -> bytes:
        return _packed(self.merger(word)) if self.merger and _USUAL.fullmatch(word) else self.whole(word)

    def _word(self, word: str) -> bytes:
        """A word after one space; one that begins with a line feed stands for that and the word."""
        return self.gaps["\n"] + self._piece(word[1:]) if word[0] == "\n" else self._piece(" " + word)

    def encode(self, text: str) -> bytes:
        if not self.by_word or any(x in text for x in self.added) or _OTHER_SPACE.search(text):
            return self.whole(text)
        if not (text[:1].isspace() or text[-1:].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(x in text for x in "\t\r\v\f")):
            if not text:
                return b""
            words = text.replace("\n", " \n").split(" ")
            return self.firsts[words[0]] + b"".join(map(self.words.__getitem__, words[1:]))
        parts = _GAP.split(text)
        out = [self.firsts[parts[0]] if parts[0] else b""]
        for gap, word in zip(parts[1::2], parts[2::2], strict=True):
            if not word:  # the text ends here
                out.append(self.gaps[gap])
            elif gap[-1] == " ":
                out += (self.gaps[gap[:-1]], self.words[word])
            else:
                out += (self.gaps[gap[:-1]], self.gaps[gap[-1]], self.firsts[word])
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    """doc_id, span, piece, start, length, ids_crc32 of every piece of ``docs`` (doc_id, span, text): a document's ids and then END, in pieces of ``room`` ids of which the first may be shorter."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        enc, end = encoder(tokenizer), np.array([END], "<u4").tobytes()
        for b in batches:
            texts = pc.fill_null(b.column("text"), "").to_pylist()
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(map(enc.encode, texts)):
                ids += end
                n, lo, k = len(ids) // 4, 0, 0
                while lo < n:
                    hi = lo + ((n - lo) % room or room)
                    at.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
                    lo, k = hi, k + 1
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), b.column("span").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "span", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "span", "text").mapInArrow(rows, f"doc_id {kind}, span long, piece int, start long, length long, ids_crc32 long")


def _better_two(counts: np.ndarray, gap: int, least: int) -> tuple[int, int] | None:
    """The two unpacked lengths that fill ``gap`` best and better than ``least`` does; the pair with the longer document first among ties."""
    best, pair, low = least, None, 1
    sizes = np.flatnonzero(counts[: gap + 1])
    if not len(sizes):
        return None
    for a in sizes[::-1]:
        low = gap - int(a)
        if low < 1 or 2 * int(a) < best:
            if 2 * int(a) < best:
                break
            continue
        k = int(np.searchsorted(sizes, min(low, int(a)), side="right")) - 1
        if k >= 0 and int(sizes[k]) == a and counts[a] < 2:
            k -= 1
        if k >= 0 and int(a) + int(sizes[k]) > best:
            best, pair = int(a) + int(sizes[k]), (int(a), int(sizes[k]))
    return pair


def best_two_fit(histogram: dict[int, int], room: int = ROOM) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a bin, longest first) and how many bins have each; all pieces of the histogram are placed."""
    counts = np.zeros(room + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    out = []
    while counts.any():
        left = counts.copy()
        bin_, gap = [], room
        while gap and len(fits := np.flatnonzero(left[: gap + 1])):
            n = int(fits[-1])
            # as many of this length as fit and exist
            k = int(min(gap // n, left[n]))
            bin_ += [n] * k
            left[n] -= k
            gap -= n * k
        if gap and len(bin_) > 1 and (pair := _better_two(left, gap + bin_[-1], bin_[-1])):
            bin_ = sorted([*bin_[:-1], *pair], reverse=True)
        need = Counter(bin_)
        times = int(min(counts[n] // k for n, k in need.items()))
        for n, k in need.items():
            counts[n] -= k * times
        out.append((bin_, times))
    return out


def places(patterns: list[tuple[list[int], int]]) -> list[dict]:
    """Rows (length, lo, hi, first, per, offsets): pieces of that length with rank lo .. hi-1 go to sequences first + j div per, at offsets[j mod per], for j = rank - lo."""
    used: Counter = Counter()
    first, out = 0, []
    for lengths, times in patterns:
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, where in offsets.items():
            out.append({"length": n, "lo": used[n], "hi": used[n] + len(where) * times, "first": first, "per": len(where), "offsets": where})
            used[n] += len(where) * times
        first += times
    return out


def _plans(histograms: DataFrame, room: int) -> DataFrame:
    """span and the rows of ``places`` for each span of ``histograms`` (span, length, n): at most ``room`` rows a span, so one task holds a whole one."""
    def plan(span, got):
        rows = places(best_two_fit(dict(zip(got["length"].to_pylist(), got["n"].to_pylist(), strict=True)), room))
        kinds = [("length", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("first", pa.int64()), ("per", pa.int64()), ("offsets", pa.list_(pa.int64()))]
        return pa.table({"span": pa.array([span[0].as_py()] * len(rows), pa.int64())} | {c: pa.array([r[c] for r in rows], k) for c, k in kinds})

    return histograms.groupBy("span").applyInArrow(plan, "span long, length long, lo long, hi long, first long, per long, offsets array<long>")


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, span: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A null or empty text is one piece that holds END only. Repeated rows are packed each, ties of equal pieces are broken by doc_id, piece and checksum. A text of any length is
    cut into pieces, all of which are packed. Other columns, whatever their names, are ignored; an empty table gives an empty result.

    With ``span`` (a non-negative long below 2**31) documents of different spans are never put into one sequence, and sequences are numbered in the order of their spans: so where spans are
    stretches of a mix, the sequences follow it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    named = docs.select("doc_id", (F.lit(0) if span is None else span).cast("long").alias("span"), "text")
    cut = scratch.keep(pieces(named, tokenizer, room).withColumn("part", F.spark_partition_id()))
    key = ["span", "length"]
    counted = scratch.keep(cut.groupBy(*key, "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted_before = counted.select(*key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    plan = scratch.keep(_plans(counted.groupBy(*key).agg(F.sum("n").alias("n")), room))
    within = Window.partitionBy(*key, "part").orderBy("doc_id", "piece", "ids_crc32")
    # both sides are tables of many rows at scale: joined the same way at every size
    ranked = cut.withColumn("row", F.row_number().over(within) - 1).join(counted_before.hint("merge"), [*key, "part"])
    ranked = ranked.select("doc_id", "piece", "start", "ids_crc32", *key, (F.col("row") + F.col("before")).alias("rank"))
    if span is None:  # a few rows for each length at most: bounded by room, not by the data
        at = ranked.drop("span").join(F.broadcast(plan.drop("span").withColumnRenamed("length", "len")), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        first = F.col("first")
    else:
        mine = plan.withColumnsRenamed({"span": "of", "length": "len"}).hint("merge")
        at = ranked.join(mine, (F.col("span") == F.col("of")) & (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        first = F.shiftleft(F.col("span"), 32) + F.col("first")
    j = F.col("rank") - F.col("lo")
    return at.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (first + F.floor(j / F.col("per"))).cast("long").alias("sequence_id"), F.element_at("offsets", (j % F.col("per") + 1).cast("int")).alias("offset"),
    )
