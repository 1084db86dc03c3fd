"""Repeated byte strings by prefix-free parsing (operator 4).

A byte is removed if a string of ``length`` bytes that covers it starts anywhere else in the corpus too.

*Parse.* The trigger of a window of ``length`` bytes is the leftmost of its k-grams with the smallest rolling hash, so equal windows have equal triggers in equal
places. Windows in a row that share a trigger's position start in one phrase; a phrase is extended by length - 1 bytes, so that each of its windows lies within it, as phrases overlap in prefix-free parsing, and
every occurrence of a phrase is one entry of the parse: a document, a place, the trigger and a hash of the extended phrase.

*Dictionary.* Phrases whose trigger occurs once cannot hold a repeated window and go first. Equal phrases are one dictionary entry, and the parse says how often it occurs; if that is twice,
all its windows repeat, however many copies there are. What is left are different entries with a common trigger: copies that part within a phrase. Only their texts are read again, and a suffix array puts the
suffixes of these entries into the order of their first ``length`` bytes: prefix doubling from ranks of 4 bytes to ranks of ``length``, all from the bytes themselves. Entries meet the occurrences
that the parse counts for them, so an interval of equal suffixes has its size in the corpus; an interval of two or more repeats. As each entry holds the whole of its windows, the order of the parse
behind it would only order the suffixes within an interval, of which nothing is asked, and it is not made.
A trigger with very many different phrases is spread by its windows, named by 128 bits each.

The union of repeated windows is cut out of each text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphflow.llm.common import flat, small_batches, texts_of
from graphflow.scratch import Scratch

LENGTH = 200
GRAM = 32
#: Different phrases of one trigger, some 7 MB of text for a task, beyond which its windows are spread one by one.
HOT = 20_000
NO_ID = -(2**63)
_PIECE = 1 << 21
#: Bytes of dictionary entries whose suffixes are ordered at once; entries of a trigger stay together.
_DICTIONARY = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def _byte_values() -> np.ndarray:
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_VALUES = _byte_values()


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each place, by doubling; one value for each full window."""
    now, have, out, done = _VALUES[data], 1, None, 0
    rest = length
    while rest:
        if rest & 1:
            if out is None:
                out, done = now, have
            else:
                shift = np.uint64(pow(_BASE, have, 1 << 64))
                n = max(0, min(len(out), len(now) - done))
                out, done = out[:n] * shift + now[done : done + n], done + have
        rest >>= 1
        if rest:
            n = max(0, len(now) - have)
            now = now[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + now[have : have + n]
            have *= 2
    out = out ^ (out >> np.uint64(31))
    return out * np.uint64(0xD6E8FEB86659FD93)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each place."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def phrases_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Arrays (text, start, windows, trigger hash, phrase hash) of the phrases of all texts."""
    data, offsets = flat(texts)
    if len(data) < length:
        return None
    hashes = rolling(data, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    low = sliding_min((hashes & ~np.uint64((1 << 24) - 1)) | place, length - gram + 1)
    starts = np.arange(len(low))
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(low)]
    starts = starts[starts + length <= offsets[owner + 1]]
    if not len(starts):
        return None
    trigger = (low[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(trigger) != 0) | (np.diff(starts) != 1) | (np.diff(owner[starts]) != 0)])
    first, last = starts[new], starts[np.r_[new[1:], len(starts)] - 1]
    whole = data.tobytes()
    h64 = xxhash.xxh64_intdigest
    names = np.array([h64(whole[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
    who = owner[first]
    return who, first - offsets[who], last - first + 1, hashes[trigger[new]].view(np.int64), names.view(np.int64)


def _pieces(texts: list[bytes], length: int):
    """(first text, texts, place of the first byte): groups of whole texts, and overlapping stretches of very long ones."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if len(t) > _PIECE:
            if at < i:
                yield at, texts[at:i], 0
            for a in range(0, len(t) - length + 1, _PIECE):
                yield i, [t[a : a + _PIECE + length - 1]], a
            at, size = i + 1, 0
        elif size + len(t) > _PIECE:
            yield at, texts[at:i], 0
            at, size = i, len(t)
        else:
            size += len(t)
    if at < len(texts):
        yield at, texts[at:], 0


def _keys() -> list[Column]:
    """Rows that agree on doc_id and text share a key; each still counts as a document."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th")]


def parse(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """d, th, s (start), n (windows), kg (trigger), eh (extended phrase) of every phrase of every row."""
    def rows(batches):
        for b in batches:
            d, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("d", "th"))
            for first, texts, base in _pieces(texts_of(b, "text"), length):
                found = phrases_of(texts, length, gram)
                if found:
                    who, s, n, kg, eh = found
                    yield pa.RecordBatch.from_arrays([pa.array(d[first + who]), pa.array(th[first + who]), pa.array(s + base, pa.int64()), pa.array(n, pa.int32()), pa.array(kg), pa.array(eh)], ["d", "th", "s", "n", "kg", "eh"])

    return docs.select(*_keys(), "text").where(F.octet_length("text") >= length).mapInArrow(rows, "d long, th long, s long, n int, kg long, eh long")


def _ranked(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Dense ranks of the pairs (high, low), whose low parts have ``bits`` bits."""
    n = len(high)
    key = (high.astype(np.uint64) << np.uint64(bits)) | low.astype(np.uint64)
    index = max(1, int(n - 1).bit_length())
    if 2 * bits + index <= 64:  # one sort of whole numbers carries the places along
        key = np.sort((key << np.uint64(index)) | np.arange(n, dtype=np.uint64))
        order = (key & np.uint64((1 << index) - 1)).astype(np.int64)
        key >>= np.uint64(index)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
    return out


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the suffix at each place by its first ``length`` bytes, equal ones alike; for places with so many bytes left."""
    have = min(4, length)
    x = data.astype(np.int64)
    high = x[: len(x) - have + 1]
    for k in range(1, have):
        high = high << 8 | x[k : len(x) - have + 1 + k]
    rank = _ranked(high >> 16, high & 0xFFFF, 16)
    while have < length:
        step = min(have, length - have)
        n = len(rank) - step
        rank = _ranked(rank[:n], rank[step : step + n], max(1, int(rank.max(initial=0)).bit_length()))
        have += step
    return rank


def _repeated_windows(kept: list, length: int):
    """Of rows (d, th, s, n, c, text) with common triggers: runs (d, th, s, n) of window starts that occur twice, of rows whose phrase occurs once."""
    data, offsets = flat([r[5] for r in kept])
    counts = np.array([r[3] for r in kept])
    row = np.repeat(np.arange(len(kept)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    rank = suffix_ranks(data, length)[offsets[row] + place]
    once = np.array([r[4] == 1 for r in kept])
    hit = np.flatnonzero((np.bincount(rank) > 1)[rank] & once[row])
    if not len(hit):
        return []
    new = np.flatnonzero(np.r_[True, (np.diff(row[hit]) != 0) | (np.diff(place[hit]) != 1)])
    ends = np.r_[new[1:], len(hit)]
    return [(kept[row[hit[a]]][0], kept[row[hit[a]]][1], kept[row[hit[a]]][2] + int(place[hit[a]]), int(b - a)) for a, b in zip(new, ends, strict=True)]


def _with_lists(docs: DataFrame, lists: DataFrame, kind: str) -> DataFrame:
    return docs.withColumns(dict(zip(("d", "th"), _keys(), strict=True))).join(lists, ["d", "th"], kind)


def _open_texts(docs: DataFrame, open_: DataFrame, length: int, hot: int) -> DataFrame:
    """The extended phrases of ``open_`` with their bytes; those of hot triggers as single windows (w1, w2: their hash)."""
    lists = open_.groupBy("d", "th").agg(F.collect_list(F.struct("s", "n", "kg", F.least("c", F.lit(2)).cast("int").alias("c"), (F.col("kinds") > hot).alias("hot"))).alias("at"))

    def rows(batches):
        names = ["kg", "d", "th", "s", "n", "c", "bytes", "w1", "w2"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            out = []
            for t, d, th, at in zip(texts_of(b, "text"), b.column("d").to_pylist(), b.column("th").to_pylist(), b.column("at").to_pylist(), strict=True):
                for p in at:
                    s, n = p["s"], p["n"]
                    if not p["hot"]:
                        out.append((p["kg"], d, th, s, n, p["c"], t[s : s + n + length - 1], None, None))
                    else:
                        for i in range(s, s + n):
                            w = xxhash.xxh3_128_intdigest(t[i : i + length])
                            out.append((p["kg"], d, th, i, 1, p["c"], None, (w >> 64) - (1 << 63), (w & (2**64 - 1)) - (1 << 63)))
                    if len(out) >= 20_000:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)

    return _with_lists(docs.select("doc_id", "text"), lists, "inner").select("d", "th", "text", "at").mapInArrow(rows, "kg long, d long, th long, s long, n int, c int, bytes binary, w1 long, w2 long")


def repeated_starts(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """d, th, s, n: runs of n windows from byte s whose strings occur elsewhere too."""
    small_batches(docs.sparkSession)
    parsed = scratch.keep(parse(docs, length, gram))
    # counts are written before they are joined: then the join's two sides are plain exchanges, and a hot trigger's side is split
    shared = scratch.keep(parsed.groupBy("kg").agg(F.count("*").alias("_")).where("_ > 1").select("kg"))
    live = scratch.keep(parsed.join(shared, "kg"))
    scratch.drop(parsed, shared)
    scratch.tidy()
    entries = scratch.keep(live.groupBy("kg", "eh").agg(F.count("*").alias("c"), F.min(F.struct("d", "th", "s", "n")).alias("at")))
    copies = scratch.keep(live.join(entries.where("c > 1").select("kg", "eh"), ["kg", "eh"]).select("d", "th", "s", "n"))
    scratch.drop(live)
    several = scratch.keep(entries.groupBy("kg").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    open_ = scratch.keep(entries.join(several, "kg").select("kg", "at.*", "c", "kinds"))
    scratch.drop(entries, several)
    scratch.tidy()
    texts = scratch.keep(_open_texts(docs, open_, length, hot))
    scratch.drop(open_)
    scratch.tidy()

    def compare(batches):
        names = ["d", "th", "s", "n"]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names)

        kept, size, last = [], 0, None
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("kg", "d", "th", "s", "n", "c", "bytes")]
            for kg, *r in zip(*columns, strict=True):
                if kg != last and size > _DICTIONARY:
                    yield batch(_repeated_windows(kept, length))
                    kept, size = [], 0
                kept.append(r)
                size += len(r[5])
                last = kg
        if kept:
            yield batch(_repeated_windows(kept, length))

    by_trigger = texts.where("bytes is not null").select("kg", "d", "th", "s", "n", "c", "bytes").repartition("kg").sortWithinPartitions("kg").mapInArrow(compare, "d long, th long, s long, n int")
    alone = texts.where("bytes is null").select("d", "th", "s", "n", "c", "w1", "w2")
    often = alone.groupBy("w1", "w2").agg(F.count("*").alias("_")).where("_ > 1").select("w1", "w2")
    spread = alone.join(often, ["w1", "w2"]).where("c = 1").select("d", "th", "s", "n")
    out = scratch.keep(copies.union(by_trigger).union(spread))
    scratch.drop(texts, copies)
    scratch.tidy()
    return out


def cut_spans(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans (from, to) covered by runs (s, n) of windows."""
    out: list[list[int]] = []
    for s, n in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n - 1 + length)
        else:
            out.append([s, s + n - 1 + length])
    return [(a, b) for a, b in out]


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of every row of ``docs``; with ``texts`` also kept (the remaining bytes).

    A null text counts as empty. Repeated rows are documents each, so all their strings of ``length`` bytes repeat. Strings are judged on the input and never cross documents.
    """
    scratch = Scratch(docs.sparkSession)
    starts = repeated_starts(docs, scratch, length, gram, hot)
    lists = starts.groupBy("d", "th").agg(F.collect_list(F.struct("s", "n")).alias("at"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts

    def rows(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for t, at in zip(texts_of(b, "text"), b.column("at").to_pylist(), strict=True):
                spans = cut_spans([(p["s"], p["n"]) for p in at or ()], length)
                edges = [0, *(x for s in spans for x in s), len(t)]
                kept = b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if spans else t
                for column, value in zip(out, (len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            arrays = [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[4], pa.binary())] * texts, names + ["kept"] * texts)

    return _with_lists(docs.select("doc_id", "text"), lists, "left").select("doc_id", "text", "at").mapInArrow(rows, schema)
