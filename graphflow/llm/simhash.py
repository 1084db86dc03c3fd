"""SimHash near-duplicates found by Golay-code fuzzy hashing (operator 7).

A fingerprint has 64 bits by majority over the XXH64 of a text's word shingles. Two fingerprints link when at most two bits
differ. Candidates come from keys: a fingerprint is cut into segments of 22, 21 and 21 bits, each seen as a word of the perfect
binary Golay code (23, 12, 7). A segment is decoded to the indices of all codewords within four bits of it (one, or six), so that segments that
differ in one bit always share an index. With at most two wrong bits in three segments, some segment is without
error while the next in the cycle 0 > 1 > 2 > 0 has one error at most: three kinds of key, the exact segment together with an index of the next one,
find every pair.

Equal fingerprints are merged before keys are made, pairs are formed only under keys with few fingerprints, and each is verified.
Fingerprints under fuller keys are linked exactly and without pairs: each stands under itself and its 64 one-bit neighbours, and two
fingerprints share one of those words if and only if at most two bits differ, so a star per word carries all links.

On request (``similar``) texts also link when the sets of their five-word shingles have at least that Jaccard similarity, whatever their fingerprints. Shingles are ordered
from rare to common; two such sets share one of the first n - ceil(similar * n) + 1 of either (prefix filter), so no pair is missed by any order; parity bits, which cannot differ in more places than the sets, spare most candidates, and the others are compared in full.
Only these first shingles and the bits are written; whole sets are made again from the texts, for candidates alone.
Under each shared shingle all sets are first compared with one of them, and then only those left outside its group with the others, so a large group of near copies costs no pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphflow.llm.common import small_batches, texts_of
from graphflow.operators.components import components
from graphflow.scratch import Scratch

#: Fixed value: a generator polynomial of the binary Golay code of length 23.
GOLAY = 0xAE3
LENGTH, CHECK = 23, 11
#: (shift, bits) of the three segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Keys with more fingerprints than this are linked by stars instead of pairs.
FEW = 48
#: Words of a shingle whose sets are compared, documents that tell common shingles (all up to the first number, beyond it that many or this share), how many of those must hold one, and the most that the driver gets.
WIDE, SAMPLE, SHARE, COMMON, MOST = 5, 5000, 10, 3, 500_000
#: Parity bits of a set, at least.
LEAST_BITS = 1024
#: Bits of the sieve that passes the texts whose sets are compared in full, and some others.
SIEVE = 1 << 22

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_COLUMN = (np.arange(8) * 256).astype(np.int64)


def fingerprint(words: list[bytes], shingle: int = 3) -> int:
    """64 majority bits over the hashes of all shingles, repeats included; zero without words."""
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [h64(b" ".join(words), 42)]
    else:
        hashes = [h64(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    cells = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8) + _COLUMN
    ones = np.einsum("cv,vb->cb", np.bincount(cells.ravel(), minlength=2048).reshape(8, 256), _BITS)
    return int.from_bytes(np.packbits((2 * ones > len(hashes)).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null text has no words."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        for b in batches:
            got = [fingerprint(t.lower().split(), shingle) for t in texts_of(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, fp long")


def shingle_set(words: list[bytes], shingle: int = WIDE) -> np.ndarray:
    """Distinct hashes of all shingles, in order; a shorter text is one shingle, and one without words has none."""
    grams = [b" ".join(s) for s in zip(*(words[i:] for i in range(shingle)), strict=False)] or ([b" ".join(words)] if words else [])
    return np.unique(np.array([xxhash.xxh64_intdigest(g, 7) for g in grams], np.uint64).view(np.int64))


def node_of(h: np.ndarray) -> int:
    """The name of a set of shingles."""
    return xxhash.xxh64_intdigest(h.tobytes(), 7)


def common_shingles(docs: DataFrame, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a sample hold, ordered, and in how many; they only set the order in which shingles are tried.

    The sample follows the table, so the documents that an unknown common shingle brings together do not grow with it. The driver gets the most common ones, MOST at most.
    """
    n = docs.count()
    size = max(SAMPLE, n // SHARE)
    value = F.xxhash64("doc_id", "text")
    few = docs.where(value < F.lit(int(size / n * 2**64) - 2**63).cast("long")) if n > size else docs

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(shingle_set(t.lower().split()) for t in texts_of(b, "text"))]))], ["key"])

    several = scratch.keep(few.select("text").mapInArrow(rows, "key long").groupBy("key").count().where(F.col("count") >= COMMON))
    scratch.tidy()
    least, kept = COMMON, 0
    for level, keys in sorted(several.groupBy(F.least("count", F.lit(1000))).agg(F.count("*")).collect(), reverse=True):
        kept += keys
        if kept > MOST:
            least = min(level + 1, 1000)
            break
    got = several.where(F.col("count") >= least).limit(MOST).toArrow()
    scratch.drop(several)
    keys, counts = (got.column(c).to_numpy() for c in ("key", "count"))
    order = np.argsort(keys)
    return keys[order], counts[order]


def parity(h: np.ndarray) -> np.ndarray:
    """How many shingles fall on each of some bits, modulo two, as longs: a power of two, LEAST_BITS and the number of shingles at least."""
    size = max(LEAST_BITS, 1 << (len(h) - 1).bit_length())
    return np.packbits(np.bincount(h & (size - 1), minlength=size).astype(np.uint8) & 1).view(np.int64)


def marks(docs: DataFrame, similar: float, scratch: Scratch, shingle: int = 3) -> DataFrame:
    """Of every row doc_id, fp, node (name of the set of five-word shingles), text_hash, n (shingles in the set), keys (the first of them that two similar sets share, rare ones first) and bits (parity)."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    common, counts = common_shingles(docs, scratch)

    def rows(batches):
        for b in batches:
            fps, nodes, sizes, bits, keys = [], [], [], [], []
            for t in texts_of(b, "text"):
                words = t.lower().split()
                fps.append(fingerprint(words, shingle))
                h = shingle_set(words)
                nodes.append(node_of(h))
                sizes.append(len(h))
                bits.append(parity(h))
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.lexsort((h, np.where(common[at] == h, counts[at], 0)))]
                keys.append(h[: len(h) - math.ceil(similar * len(h) - 1e-9) + 1])
            long = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, nodes)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *long, b.column("text_hash"), pa.array(sizes, pa.int32()), _lists(keys), _lists(bits)], ["doc_id", "fp", "node", "text_hash", "n", "keys", "bits"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(rows, f"doc_id {kind}, fp long, node long, text_hash long, n int, keys array<long>, bits array<long>")


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(v) for v in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *values])))


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and h (the set) of at least the nodes of ``wanted`` (node, text_hash), made from the texts again, where a text may come once from each partition.

    A sieve of fixed size lets all wanted texts pass and few others, so neither texts nor sets are shuffled to find them.
    """
    small_batches(docs.sparkSession)
    place = F.col("text_hash").bitwiseAND(F.lit(SIEVE - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    got = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    sieve = np.zeros(SIEVE // 64, np.int64)
    sieve[got.column("word").to_numpy()] = got.column("bits").to_numpy()

    def rows(batches):
        seen = set()
        for b in batches:
            hashes = b.column("text_hash").to_numpy()
            places = hashes & (SIEVE - 1)
            fresh = []
            for i in np.nonzero(sieve[places >> 6] >> (places & 63) & 1)[0]:
                if hashes[i] not in seen:
                    seen.add(hashes[i])
                    fresh.append(i)
            sets = [shingle_set(t.lower().split()) for t in texts_of(b.take(pa.array(fresh, pa.int64())), "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([node_of(h) for h in sets], np.uint64).view(np.int64)), _lists(sets)], ["node", "h"])

    return docs.where("text is not null").select("text", F.xxhash64("text").alias("text_hash")).mapInArrow(rows, "node long, h array<long>")


def _folded(bits: str, other: str) -> Column:
    """Parity bits over as many bits as the other side has, if that has fewer."""
    to = F.size(other)
    fold = F.transform(F.slice(bits, F.lit(1), to), lambda _, i: F.aggregate(F.sequence(i, F.size(bits) - 1, to), F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.get(bits, k))))
    return F.when(F.size(bits) > to, fold).otherwise(F.col(bits))


def _verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, similar: float, scratch: Scratch) -> DataFrame:
    """Those of the pairs a, b whose sets are similar, with fa and fb: a fingerprint of each.

    Parity bits differ in no more places than the sets do, so a pair with too many such places is not similar: most others are never compared in full.
    """
    side = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"b{x}"))
    apart = F.aggregate(F.zip_with(_folded("ba", "bb"), _folded("bb", "ba"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    pairs = scratch.keep(both.where(apart * (1 + similar) <= (1 - similar) * (F.col("na") + F.col("nb")) + 1e-9).select("a", "b"))
    scratch.tidy()
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = scratch.keep(known.join(nodes.hint("merge"), "node", "left_semi").select("node", "fp", "text_hash"))
    some = scratch.keep(whole_sets(docs, wanted).join(wanted.select("node", "fp").hint("merge"), "node"))
    full = scratch.keep(some.groupBy("node").agg(F.first("fp").alias("fp"), F.first("h").alias("h")))
    scratch.drop(some, wanted)
    scratch.tidy()
    side = lambda x: full.select(F.col("node").alias(x), F.col("fp").alias(f"f{x}"), F.col("h").alias(f"h{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("same", F.size(F.array_intersect("ha", "hb")))
    out = scratch.keep(both.where(F.col("same") >= similar * (F.size("ha") + F.size("hb") - F.col("same")) - 1e-9).select("a", "b", "fa", "fb"))
    scratch.drop(full, pairs)
    scratch.tidy()
    return out


def similar_links(marked: DataFrame, distinct: DataFrame, docs: DataFrame, similar: float, scratch: Scratch) -> DataFrame:
    """Edges a, b between fingerprints of ``marked`` (fp, node of every text) that join all texts of ``docs`` whose shingle sets are equal or have a Jaccard similarity of ``similar``.

    Equal sets are one row of ``distinct``, which is deleted. Only the keys travel first; those that two sets share are few, and what is known of a set meets them alone.
    """
    keyed = distinct.select("node", "n", F.posexplode("keys").alias("at", "key"))
    shared = scratch.keep(keyed.groupBy("key").agg(F.min("node").alias("p"), F.max("node").alias("z")).where("p <> z").drop("z"))
    scratch.tidy()
    hits = scratch.keep(keyed.join(shared.hint("merge"), "key"))
    known = scratch.keep(distinct.join(hits.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "fp", "text_hash", "n", "bits"))
    scratch.drop(distinct, shared)
    scratch.tidy()
    pivots = hits.where("node = p").select("key", F.col("n").alias("pn"), F.col("at").alias("pat"))

    def may(x, y):
        """Sizes, and what can follow the first shared shingle, leave room for enough shared ones."""
        most = F.least(x["n"] - x["at"], y["n"] - y["at"])
        return most * (1 + similar) >= similar * (x["n"] + y["n"]) - 1e-9

    one, pivot = {c: F.col(c) for c in ("n", "at")}, {"n": F.col("pn"), "at": F.col("pat")}
    star = scratch.keep(hits.where("node <> p").join(pivots, "key").where(may(one, pivot)).select(F.col("p").alias("a"), F.col("node").alias("b")).distinct())
    scratch.tidy()
    near = _verified(star, known, docs, similar, scratch)
    group = scratch.keep(components(near.select("a", "b"), scratch))
    named = hits.join(group.select("node", F.col("component").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    named = named.join(group.select(F.col("node").alias("p"), F.col("component").alias("pc")), "p", "left").withColumn("pc", F.coalesce("pc", "p"))
    named = scratch.keep(named.select("key", "node", "n", "at", "c", "pc"))
    scratch.drop(hits, group)
    scratch.tidy()
    # a pair in two groups has a side outside the group of its shingle's pivot
    rest = named.where("c <> pc")
    a, b = rest.alias("a"), named.alias("b")
    side = {x: {c: F.col(f"{x}.{c}") for c in ("node", "n", "at", "c")} for x in "ab"}
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (side["a"]["c"] != side["b"]["c"]) & may(side["a"], side["b"]))
    pairs = scratch.keep(pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    scratch.drop(named, star)
    scratch.tidy()
    more = _verified(pairs, known, docs, similar, scratch)
    ends = scratch.keep(marked.groupBy("node").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").drop("z"))
    equal = marked.select("node", "fp").join(ends, "node").where("a <> fp").select("a", F.col("fp").alias("b"))
    out = scratch.keep(near.union(more).select(F.col("fa").alias("a"), F.col("fb").alias("b")).union(equal).distinct())
    scratch.drop(near, pairs, more, ends, known)
    scratch.tidy()
    return out


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders modulo the generator of the low 12 and the high 11 bits of a word."""
    def rest(v: int) -> int:
        for i in range(LENGTH - 1, CHECK - 1, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - CHECK)
        return v

    return np.array([rest(v) for v in range(1 << 12)]), np.array([rest(v << 12) for v in range(1 << 11)])


def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome tables, and for each syndrome its error patterns of up to four bits (first repeated to fill six)."""
    low, high = _syndromes()
    found: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            found.setdefault(int(low[e & 0xFFF] ^ high[e >> 12]), []).append(e)
    return low, high, np.array([found[s] + [found[s][0]] * (6 - len(found[s])) for s in range(1 << CHECK)])


def codeword_indices(words: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words the indices of all codewords within four bits, six columns, and which columns count."""
    low, high, errors = tables
    e = errors[low[words & 0xFFF] ^ high[words >> 12]]
    counts = np.ones(e.shape, bool)
    counts[:, 1:] = e[:, 1:] != e[:, :1]
    return (words[:, None] ^ e) >> CHECK, counts


def golay_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) for all keys of all fingerprints."""
    parts = [(fps >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    at, keys = [], []
    for kind in range(3):
        index, counts = codeword_indices(parts[(kind + 1) % 3], tables)
        row, col = np.nonzero(counts)
        at.append(row)
        keys.append((kind << 34) | (parts[kind][row] << 12) | index[row, col])
    return np.concatenate(at), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def rows(batches):
        tables = code_tables()
        for b in batches:
            v = b.column("fp").to_numpy(zero_copy_only=False)
            at, keys = golay_keys(v.view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(v[at])], ["key", "fp"])

    return fps.select("fp").mapInArrow(rows, "key long, fp long")


def links(fps: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) that join all those within two bits of each other.

    Every edge is a real link; under full keys the edges of a star stand for all links, so components are the same.
    """
    keyed = scratch.keep(_keyed(fps))
    shared = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    hits = scratch.keep(keyed.join(shared.hint("merge"), "key"))
    scratch.drop(keyed, shared)
    thin = hits.where(F.col("n") <= few)
    pairs = thin.select("key", F.col("fp").alias("a")).join(thin.select("key", F.col("fp").alias("b")), "key")
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    full = hits.where(F.col("n") > few).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)))
    around = scratch.keep(full.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")))
    star = around.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = scratch.keep(star)
    stars = around.join(star, "word").where("a <> fp").select("a", F.col("fp").alias("b"))
    out = scratch.keep(pairs.union(stars).distinct())
    scratch.drop(hits, around, star)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, few: int = FEW, similar: float | None = None) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (columns doc_id, text; others are ignored).

    component_id is the smallest doc_id reachable over links, the row's own included. Null and wordless texts have the fingerprint
    zero, which links like any other. Repeated rows and ids are kept. A null doc_id is no candidate for the smallest: a group of such rows only has
    a null component_id. An empty table gives an empty result. With ``similar``, texts of that Jaccard similarity over five-word shingles link too.
    """
    scratch = Scratch(docs.sparkSession)
    if similar is None:
        marked = scratch.keep(fingerprints(docs, shingle))
    else:
        whole = scratch.keep(marks(docs, similar, scratch, shingle))
        one = [F.min("fp").alias("fp"), F.min("text_hash").alias("text_hash"), *(F.first(c).alias(c) for c in ("n", "keys", "bits"))]
        distinct = scratch.keep(whole.where("n > 0").groupBy("node").agg(*one))
        marked = scratch.keep(whole.select("doc_id", "fp", F.when(F.col("n") > 0, F.col("node")).alias("node")))
        scratch.drop(whole)
        scratch.tidy()
    kinds = scratch.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(kinds, scratch, few)
    if similar is not None:
        edges = edges.union(similar_links(marked.where("node is not null"), distinct, docs, similar, scratch))
    group = components(edges, scratch)
    rooted = kinds.join(group.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = scratch.keep(rooted)
    named = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    # joined the same way at every size: fingerprints grow with the corpus
    of_kind = scratch.keep(rooted.join(named.hint("merge"), "root").select("fp", "component_id"))
    scratch.drop(kinds, rooted, named)
    scratch.tidy()
    return marked.join(of_kind.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, similar: float | None = None) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, that with the smallest doc_id, with all columns.

    Of rows that repeat that id, the one with the smallest hashed text stays. Rows without an id go into no group: all of them stay.
    """
    scratch = Scratch(docs.sparkSession)
    named = docs.where("doc_id is not null")
    found = near_duplicates(named.select("doc_id", "text"), shingle, similar=similar)
    heads = scratch.keep(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")))
    # one way at every size: a small right side would otherwise be broadcast until it is too large for it
    kept = named.join(heads.where("rows = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    many = heads.where("rows > 1").select("doc_id")
    if not many.isEmpty():
        # a minimum is combined before its shuffle, however often an id repeats
        first = F.min(F.struct(F.xxhash64("text").alias("order"), F.struct(*(F.col(c) for c in docs.columns)).alias("row"))).alias("least")
        once = named.join(many.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(first).select("least.row.*")
        kept = kept.select(*docs.columns).unionByName(once)
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
