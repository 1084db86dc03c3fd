"""Mixing sources to target weights by Pfair scheduling (operator 9, native).

A source's documents, in a shuffled order that depends on the ids only, are cut into blocks of ``block`` documents. Weights become
fractions a/q of a fixed period q. Block i of a source is released at floor(i*q/a) and due at ceil((i+1)*q/a); in every time slot the released block
with the earliest deadline runs. The sum of the weights is one, so every block meets its window and a source is never a whole block ahead of or behind
its target. As all releases repeat after q slots, the schedule is made for one period (at most ``q`` rows, whatever the data) and each
block's slot follows in closed form: a join with the period and arithmetic, no pass over slots. When a source has no blocks left, the period is made anew
for the remaining ones, so there are no more phases than sources, and every document is placed. Of a phase that ends within its first period only the
slots up to its end are made, so the schedule has no more of them than there are blocks. With many sources it is written as a table and joined by block.

Ranks within a source are counted in two levels, cells of (source, leading digits of the hashed id) and then rows within a cell: a hot source is as many groups as there are cells.
"""

from __future__ import annotations

import heapq
import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphflow.scratch import Scratch

#: Up to so many sources the schedule is a literal that every task holds; with more it is a table of blocks.
FEW_SOURCES = 300


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period for each source, at least one each, by largest remainders; ties to the smaller name."""
    names = sorted(weights)
    free = period - len(names)
    if free < 0:
        raise ValueError("period is shorter than the number of sources")
    total = sum(weights.values())
    exact = {s: weights[s] / total * period for s in names}
    out = {s: max(1, math.floor(exact[s])) for s in names}
    over = sum(out.values()) - period
    if over > 0:
        most = [(out[s] <= 1, exact[s] - out[s], s) for s in names]
        heapq.heapify(most)
        for _ in range(over):
            s = most[0][2]
            out[s] -= 1
            heapq.heapreplace(most, (out[s] <= 1, exact[s] - out[s], s))
    for s in sorted(names, key=lambda s: (out[s] - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    while sum(out.values()) < period:
        out[max(names, key=lambda s: exact[s])] += 1
    return out


def one_period(a: dict[str, int], period: int, left: dict[str, int] | None = None) -> list[str]:
    """The source that runs in each slot of a period: earliest deadline first among released blocks, ties to the smaller name.

    With ``left``, blocks by source, the list ends with the slot in which the first source runs out, if that is within the period.
    """
    waiting = [(0, s, 0) for s in sorted(a)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // a[s]), s, i))
        _, s, i = heapq.heappop(ready)
        out.append(s)
        if left and i + 1 == left[s]:
            break
        if i + 1 < a[s]:
            heapq.heappush(waiting, ((i + 1) * period // a[s], s, i + 1))
    return out


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[dict]:
    """Rows (source, from, to, a, start, slots) by phase: blocks from .. to-1 of a source run in the phase that begins at slot start, the j-th of them at slots[j mod a] + j div a * period.

    A phase ends with the slot in which the first of its sources runs out.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        span = max(period, 10 * len(left)) if len(left) * 2 > period else period
        a = shares({s: weights[s] for s in left}, span)
        slots: dict[str, list[int]] = {s: [] for s in left}
        made = one_period(a, span, left)
        for t, s in enumerate(made):
            slots[s].append(t)
        end = len(made)
        if end == span:
            end = min(slots[s][(n - 1) % a[s]] + (n - 1) // a[s] * span for s, n in left.items()) + 1
        for s in sorted(left):
            n = len(slots[s]) if end < span else end // span * a[s] + sum(1 for t in slots[s] if t < end % span)
            if n:
                out.append({"source": s, "lo": done[s], "hi": done[s] + n, "a": a[s], "start": start, "span": span, "slots": slots[s]})
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n > 0}
        start += end
    return out


def _table(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table made from a literal, so that plans hold no Python rows."""
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _block_table(docs: DataFrame, rows: list[dict]) -> DataFrame:
    """__s, block and __slot of every block, from a written table of the phases' rows."""
    kinds = pa.schema([("source", pa.string()), *((c, pa.int64()) for c in ("lo", "hi", "a", "start", "span")), ("slots", pa.list_(pa.int64()))])
    plan = Scratch(docs.sparkSession).keep(docs.sparkSession.createDataFrame(pa.Table.from_pylist(rows, kinds)))
    each = plan.select("*", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("block"))
    return each.select(F.col("source").alias("__s"), "block", _slot(*(F.col(c) for c in ("block", "lo", "a", "start", "span", "slots"))).alias("__slot"))


def _slot(block: Column, lo: Column, a: Column, start: Column, span: Column, slots: Column) -> Column:
    j = block - lo
    return start + F.floor(j / a) * span + F.element_at(slots, (j % a + 1).cast("int"))


def source_of(column: str = "source") -> Column:
    """A row without a source belongs to the source with the empty name."""
    return F.coalesce(F.col(column), F.lit(""))


def ranked(docs: DataFrame, digits: int) -> DataFrame:
    """``docs`` with __s (source), __rank (place of the row within its source by hashed id, then id, then text)."""
    named = docs.withColumns({"__s": source_of(), "__h": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))}).withColumn("__cell", F.substring("__h", 1, digits))
    cells = named.groupBy("__s", "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__s").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("__s", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    tie = [F.xxhash64("text")] if "text" in docs.columns else []
    within = Window.partitionBy("__s", "__cell").orderBy("__h", "doc_id", *tie)
    return named.withColumn("__row", F.row_number().over(within) - 1).join(cells, ["__s", "__cell"]).withColumn("__rank", F.col("__before") + F.col("__row")).drop("__before", "__row", "__cell", "__h")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 8, period: int = 1000, temper: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with block (of its source), slot (time of the block, from 0 without gaps) and in_block (place in it).

    ``weights``: target weight of each source; by default a source's row count to the power ``temper``. A source without a weight, or with one of zero, is an error rather
    than a loss of rows. Rows without a source form the source named "". Ties of equal ids are ordered by hashed text; equal rows are kept. Columns named block, slot or in_block are replaced.
    """
    plain = docs.drop("block", "slot", "in_block")
    counts = {r["s"]: r["n"] for r in plain.groupBy(source_of().alias("s")).agg(F.count("*").alias("n")).collect()}  # a row for each source
    weights = weights or {s: n**temper for s, n in counts.items()}
    if missing := sorted(s for s in counts if not weights.get(s, 0) > 0):
        raise ValueError(f"sources without a weight: {missing[:5]}")
    plan = phases({s: -(-n // block) for s, n in counts.items()}, weights, period)
    digits = max(1, min(6, math.ceil(math.log(max(1, sum(counts.values()) / 20_000), 16))))
    at = ranked(plain, digits).withColumn("block", F.floor(F.col("__rank") / block))
    if len(counts) > FEW_SOURCES:
        at = at.join(_block_table(docs, plan).hint("merge"), ["__s", "block"])
        slot = F.col("__slot")
    else:
        rows = _table(docs, plan, "source:string,lo:long,hi:long,a:long,start:long,span:long,slots:array<long>")
        # at most one row for each source and phase
        rows = F.broadcast(rows.select(F.col("source").alias("__s"), *(F.col(c).alias(f"__{c}") for c in ("lo", "hi", "a", "start", "span", "slots"))))
        at = at.join(rows, (at["__s"] == rows["__s"]) & (at["block"] >= rows["__lo"]) & (at["block"] < rows["__hi"]))
        slot = _slot(F.col("block"), *(F.col(f"__{c}") for c in ("lo", "a", "start", "span", "slots")))
    return at.select(*(at[c] for c in plain.columns), at["block"].cast("long").alias("block"), slot.cast("long").alias("slot"), (F.col("__rank") % block).cast("int").alias("in_block"))
