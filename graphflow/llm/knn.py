"""Nearest neighbours by a block matrix join (operator 10).

Vectors are packed into blocks of int8 codes with one scale each, beside the original numbers. A group of query blocks, whose size is checked, meets every candidate block
once: the product of two tiles of codes gives all inner products up to a bound on the quantisation error that is known for each pair. A pair survives if its upper bound reaches the
query's k-th largest lower bound so far; survivors are computed again from the original numbers in double precision. Every task keeps the k best of each of its
queries, and the lists of all tasks are merged by heaps. The bounds are exact, so no neighbour is lost.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphflow.scratch import Scratch

#: Vectors of a packed block, and bytes of queries that meet the candidates at once.
BLOCK = 512
GROUP_BYTES = 16_000_000

_PACKED = "dim int, n int, ids binary, vectors binary"


def pack_blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Usable vectors (not null, empty or zero, all components finite, with an id) in packed blocks of one dimension."""
    def pack(batches):
        waiting: dict[int, list] = {}

        def block(dim, take):
            ids, vectors = np.array([i for i, _ in take], "<i8"), np.stack([v for _, v in take]).astype("<f8")
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist(), strict=True):
                if i is None or not v or None in v:
                    continue
                v = np.array(v, float)
                if np.isfinite(v).all() and v.any():
                    waiting.setdefault(len(v), []).append((i, v))
            for dim, have in waiting.items():
                while len(have) >= size:
                    yield block(dim, have[:size])
                    del have[:size]
        for dim, have in waiting.items():
            if have:
                yield block(dim, have)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(pack, _PACKED)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes in -127 .. 127, the scale of each row, and the sum of absolute codes of each row."""
    scale = np.abs(v).max(1) / 127
    codes = np.clip(np.rint(v / np.where(scale > 0, scale, 1)[:, None]), -127, 127).astype(np.int8)
    return codes, scale, np.abs(codes.astype(np.int64)).sum(1)


def bounded_products(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the codes of two quantised tiles, and a bound on their error for each pair."""
    (qa, sa, na), (qb, sb, nb) = a, b
    dim = qa.shape[1]
    kind = np.float32 if dim * 127 * 127 < 2**24 else np.float64  # whole numbers are exact in it
    units = sa[:, None] * sb[None, :]
    near = (qa.astype(kind) @ qb.astype(kind).T).astype(float) * units
    error = units * (0.5 * (na[:, None] + nb[None, :]) + 0.25 * dim)
    return near, error * (1 + 1e-9) + 1e-12 * np.abs(near)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of a with the same row of b, summed from the first component to the last, so that equal vectors get equal scores everywhere."""
    out = a[:, 0] * b[:, 0]
    for k in range(1, a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Best:
    """The k best candidates of each query of a block: larger score first, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.codes = quantise(vectors)
        self.lists: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray, codes) -> None:
        near, error = bounded_products(self.codes, codes)
        own = self.ids[:, None] == ids[None, :]
        low = np.where(own, -np.inf, near - error)
        floor = self.floor
        if len(ids) >= self.k:
            floor = np.maximum(floor, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        row, col = np.nonzero((near + error >= floor[:, None]) & ~own)
        for at in range(0, len(row), 200_000):
            r, c = row[at : at + 200_000], col[at : at + 200_000]
            scores = inner_products(self.vectors[r], vectors[c])
            for i, s, j in zip(r.tolist(), scores.tolist(), ids[c].tolist(), strict=True):
                have = self.lists[i]
                if len(have) < self.k:
                    heapq.heappush(have, (s, -j))
                elif (s, -j) > have[0]:
                    heapq.heapreplace(have, (s, -j))
        self.floor = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.lists])


def _unpack(ids: bytes, vectors: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(n, -1)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``queries`` the k rows of ``rows`` with the largest inner product, nearest first, ties to the smaller id.

    Both tables have vec_id and embedding. Rows with a query's own id are no candidates of it; vectors of another dimension neither. Null, empty and zero vectors, those
    that hold a null or non-finite component and rows without an id take no part. Repeated rows count each. Fewer candidates than k are all returned.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    # a block has its number from when it is written, whatever ids it holds
    every, asked = (scratch.keep(pack_blocks(x, block).withColumn("block", F.monotonically_increasing_id())) for x in (rows, queries))
    blocks, size = asked.agg(F.count("*"), F.sum(F.octet_length("vectors"))).first()
    groups = max(1, -(-(size or 0) // group_bytes))
    while True:  # hashed groups differ in size: each is checked before it is broadcast
        grouped = asked.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
        most = grouped.groupBy("g").agg(F.sum(F.octet_length("vectors")).alias("b")).agg(F.max("b")).first()[0] or 0
        # blocks are bounded by themselves, so with that many groups the largest is of a few blocks
        if groups == 1 or most <= 2 * group_bytes or groups > 16 * blocks:
            break
        groups *= 2

    def meet(batches):
        found: dict[int, Best] = {}
        last, codes = None, None
        for b in batches:
            for r in b.to_pylist():
                if r["qdim"] != r["dim"]:
                    continue
                key = r["qblock"]
                if key not in found:
                    found[key] = Best(*_unpack(r["qids"], r["qvectors"], r["qn"]), k)
                if last != r["block"]:
                    last = r["block"]
                    ids, vectors = _unpack(r["ids"], r["vectors"], r["n"])
                    codes = quantise(vectors)
                found[key].meet(ids, vectors, codes)
        for key, best in found.items():
            lists = [sorted(x, reverse=True) for x in best.lists]
            yield pa.RecordBatch.from_pydict(
                {"qblock": pa.array([key], pa.int64()), "qids": [best.ids.astype("<i8").tobytes()], "sizes": [np.array([len(x) for x in lists], "<i4").tobytes()],
                 "ids": [np.array([-j for x in lists for _, j in x], "<i8").tobytes()], "scores": [np.array([s for x in lists for s, _ in x], "<f8").tobytes()]}
            )

    def merge(batches):
        now, parts = None, []

        def told():
            ids = np.frombuffer(now[1], "<i8").tolist()
            out = [[], [], [], []]
            for i, q in enumerate(ids):
                best = islice(heapq.merge(*(p[i] for p in parts)), k)
                for rank, (s, j) in enumerate(best, 1):
                    for column, value in zip(out, (q, rank, j, -s), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], ["query_id", "rank", "vec_id", "score"])

        for b in batches:
            for r in b.to_pylist():
                if not now or now[0] != r["qblock"]:
                    if now:
                        yield told()
                    now, parts = (r["qblock"], r["qids"]), []
                sizes = np.frombuffer(r["sizes"], "<i4")
                pairs = list(zip((-np.frombuffer(r["scores"], "<f8")).tolist(), np.frombuffer(r["ids"], "<i8").tolist(), strict=True))
                ends = np.cumsum(sizes)
                parts.append([pairs[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)])
                if len(parts) == 64:  # lists never pile up
                    parts = [[list(islice(heapq.merge(*(p[i] for p in parts)), k)) for i in range(len(sizes))]]
        if now:
            yield told()

    def found(g: int) -> DataFrame:
        few = grouped.where(F.col("g") == g).select(*(F.col(c).alias(f"q{c}") for c in ("block", "dim", "n", "ids", "vectors")))
        tiles = every.crossJoin(F.broadcast(few)).mapInArrow(meet, "qblock long, qids binary, sizes binary, ids binary, scores binary")
        return tiles.repartition("qblock").sortWithinPartitions("qblock").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")

    # one group is one plan; of several, each is a job of its own whose lists are written
    return found(0) if groups == 1 else scratch.gather(found(g) for g in range(groups))
