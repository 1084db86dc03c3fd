"""Line dedup: repeated runs of whole lines, found by a suffix array over line-ID sequences (operator 5, native).

A document is its sequence of lines that have a word. A *passage* at a line is the shortest run of whole lines from there with at least
``min_words`` words. Every line of a passage that occurred before in corpus order (doc_id, then line; overlaps count) is deleted, so
maximal repeated runs lose all copies but the first. What follows the last passage that fits into a run, fewer than ``min_words`` words from each line on, stays.

*Lines.* A line is named by a 128-bit hash; its ID is the rank of this name among those that occur in two places. Other lines end a stretch, and so do
lines outside all passages of such lines: no repeated passage holds them.

*Suffix array.* Prefix doubling: round k ranks all runs of 2^k lines, a run of twice the length by the pair of its halves' ranks. Distinct pairs are sorted, so ranks are in the order of the runs;
a run ends with its stretch, and an end stands before all lines. A passage has min_words lines at most, which bounds the rounds by its logarithm whatever the corpus. Sorted by the last rank, then by place, the
suffixes at which a passage starts are the suffix array; beyond the lines of the longest passage its order is that of places.

*LCP array.* Neighbours share 2^k lines if their ranks of round k agree. From there on the ranks of the places behind these lines are compared in the same way, until no line agrees.

*Intervals.* Suffixes in a row that share a passage of m lines, all LCP values between them being m or more, are an interval; its first place in corpus order stays, the lines of its other passages go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphflow.scratch import Scratch

#: Fixed value: white space that separates words.
WORD_GAP = r"[\x20\x09-\x0D]+"


#: A null doc_id stands first in corpus order.
NO_ID = -(2**63)
PLACE = ("d", "th", "i")
#: Places of the suffix array that one window holds, in a row; it changes no result.
BLOCK = 4096


def _ids(docs: DataFrame) -> list:
    """Rows that agree on doc_id and text are one document, named by the id and a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th")]


def line_table(docs: DataFrame) -> DataFrame:
    """Lines with a word: d, th, i (place among them), r (place among all lines), h1, h2 (the line's name), n (words)."""
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda x, r: F.struct(r.alias("r"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("line"), x).alias("h2"), F.size(F.filter(F.split(x, WORD_GAP), lambda w: w != "")).alias("n")),
    )
    full = docs.where("text is not null").select(*_ids(docs), F.filter(lines, lambda x: x["n"] > 0).alias("lines"))
    return full.select("d", "th", F.posexplode("lines").alias("i", "x")).select("d", "th", "i", "x.r", "x.h1", "x.h2", "x.n")


def _first(rows: DataFrame, name: list[str], scratch: Scratch) -> DataFrame:
    """Rows whose name occurs in another place too, with f: the first place of that name.

    Places are combined before the shuffle, and written before they are joined: the join's sides are then plain exchanges, of which a hot line's is split.
    """
    place = F.struct(*PLACE)
    found = scratch.keep(rows.groupBy(*name).agg(F.min(place).alias("f"), F.max(place).alias("z")).where("f <> z").drop("z"))
    return rows.join(found.hint("merge"), name)


def _ranked(names: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Distinct ``names`` with their rank: from 1, in the order of the keys, with gaps between partitions."""
    return scratch.keep(names.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id() + 1))


def stretches(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """Lines of all passages whose lines repeat: d, th, i, r, rank (the line's ID), m (lines of the passage that starts here, or null), e (lines up to the end of the stretch)."""
    lines = scratch.keep(line_table(docs))
    place = F.struct(*PLACE)
    names = lines.groupBy("h1", "h2").agg(F.min(place).alias("f"), F.max(place).alias("z")).where("f <> z").select("h1", "h2")
    names = _ranked(names, ["h1", "h2"], scratch)
    twice = lines.join(names.hint("merge"), ["h1", "h2"])
    doc = Window.partitionBy("d", "th")
    # repeated rows name the same places again
    twice = twice.withColumn("before", F.lag("i").over(doc.orderBy("i"))).where("before is null or before <> i")
    # cumulative words over lines that repeat at all: a passage holds no others
    summed = twice.withColumn("c", F.sum("n").over(doc.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    ahead = doc.orderBy("c").rangeBetween(0, min_words - 1)
    sized = summed.select(*PLACE, "r", "rank", F.count("*").over(ahead).alias("k"), F.max("i").over(ahead).alias("last"), F.sum("n").over(ahead).alias("w"))
    m = F.when((F.col("w") >= min_words) & (F.col("last") == F.col("i") + F.col("k") - 1), F.col("k").cast("int"))
    sized = sized.select(*PLACE, "r", "rank", m.alias("m"))
    covered = sized.withColumn("reach", F.max(F.col("i") + F.col("m")).over(doc.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).where("i < reach")
    covered = covered.withColumn("stretch", F.col("i") - F.row_number().over(doc.orderBy("i")))
    e = F.max("i").over(Window.partitionBy("d", "th", "stretch")) - F.col("i") + 1
    base = scratch.keep(covered.select(*PLACE, "r", "rank", "m", e.alias("e")))
    scratch.drop(lines, names)
    return base


def rungs_of(base: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """Prefix doubling: d, th, i, m, e and ranks, those of the runs of 1, 2, 4 .. lines from here, up to ``depth`` lines or more."""
    doc = Window.partitionBy("d", "th").orderBy("i")

    def halves(rungs: DataFrame, size: int) -> DataFrame:
        a = rungs.withColumn("a", F.element_at("ranks", -1))
        then = F.first("a").over(doc.rangeBetween(size, size))
        return a.withColumn("b", F.when(F.col("e") > size, then).otherwise(0))

    rungs, size = base.select(*PLACE, "m", "e", F.array("rank").alias("ranks")), 1
    if size >= depth:
        return scratch.keep(rungs)
    pairs = scratch.keep(halves(rungs, size))
    while size < depth:
        names = _ranked(pairs.select("a", "b").distinct(), ["a", "b"], scratch)
        rungs = pairs.join(names.hint("merge"), ["a", "b"]).select(*PLACE, "m", "e", F.concat("ranks", F.array("rank")).alias("ranks"))
        size *= 2
        new = scratch.keep(halves(rungs, size) if size < depth else rungs)
        scratch.drop(names, pairs)
        pairs = new
    return pairs


def _block(s: Column) -> Column:
    return F.floor(s / BLOCK)


def _equal(x: str | Column, y: str | Column) -> Column:
    """Number of rounds in which two places have the same rank; it is so in all rounds before, too."""
    return F.coalesce(F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same)), F.lit(0))


def suffix_array(base: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """Suffixes at which a passage starts in their order: s (from 0, without gaps), d, th, i, m, lcp (lines shared with the one before, up to ``depth`` exactly)."""
    rungs = rungs_of(base, depth, scratch)
    order = rungs.where("m is not null").orderBy(F.element_at("ranks", -1), *PLACE)
    sorted_ = scratch.keep(order.withColumn("at", F.monotonically_increasing_id()))
    # an id holds the partition and the place there
    sizes = dict(sorted_.groupBy(F.shiftright("at", 33).cast("int")).count().collect())
    starts, n = [], 0
    for p in range(max(sizes, default=0) + 1):
        starts.append(n)
        n += sizes.get(p, 0)
    s = F.get(F.lit(starts).cast("array<long>"), F.shiftright("at", 33).cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1)
    own = sorted_.select(s.alias("s"), *PLACE, "m", "e", "ranks")
    # the last one of a block stands before the next block, too
    guests = own.where((F.col("s") + 1) % BLOCK == 0).withColumn("block", _block(F.col("s")) + 1)
    rows = own.withColumn("block", _block(F.col("s"))).union(guests)
    rows = rows.withColumn("p", F.lag(F.struct(*PLACE, "e", "ranks")).over(Window.partitionBy("block").orderBy("s"))).where(_block(F.col("s")) == F.col("block"))

    def further(pairs: DataFrame, same: Column) -> DataFrame:
        """``lcp`` with 2^(same - 1) lines more; ``open`` says in how many rounds more lines may agree."""
        lcp = F.least(F.col("lcp") + F.expr("CASE WHEN same > 0 THEN shiftleft(1, same - 1) ELSE 0 END"), "most")
        pairs = pairs.withColumn("same", same).withColumn("lcp", lcp)
        more = (F.col("same") > 1) & (F.col("same") < F.col("open")) & (F.col("lcp") < F.col("most"))
        return pairs.select("s", *PLACE, "m", "pd", "pth", "pi", "most", "lcp", F.when(more, F.col("same")).otherwise(0).alias("open"))

    pairs = rows.select("s", *PLACE, "m", F.col("p.d").alias("pd"), F.col("p.th").alias("pth"), F.col("p.i").alias("pi"), F.coalesce(F.least("e", "p.e"), F.lit(0)).alias("most"), F.lit(0).alias("lcp"), F.size("ranks").alias("open"), F.col("ranks").alias("x"), F.col("p.ranks").alias("y"))
    parts = []
    while True:
        seen = Observation()
        pairs = scratch.keep(further(pairs, _equal("x", "y")).observe(seen, F.max("open").alias("open")))
        parts.append(pairs)
        if not seen.get.get("open"):
            break
        pairs = pairs.where("open > 0").withColumns({"j": F.col("i") + F.col("lcp"), "pj": F.col("pi") + F.col("lcp")})
        here = rungs.select("d", "th", F.col("i").alias("j"), F.col("ranks").alias("x"))
        there = rungs.select(F.col("d").alias("pd"), F.col("th").alias("pth"), F.col("i").alias("pj"), F.col("ranks").alias("y"))
        pairs = pairs.join(here.hint("merge"), ["d", "th", "j"]).join(there.hint("merge"), ["pd", "pth", "pj"])
    done = parts[0].where("open = 0")
    for part in parts[1:]:
        done = done.union(part.where("open = 0"))
    out = scratch.keep(done.select("s", *PLACE, "m", "lcp"))
    scratch.drop(rungs, sorted_, *parts)
    return out


def intervals(array: DataFrame, scratch: Scratch) -> DataFrame:
    """The suffix array with v: where the interval starts whose suffixes share the passage."""
    marked = array.withColumns({"block": _block(F.col("s")), "v": F.when(F.col("lcp") < F.col("m"), F.col("s"))})
    inside = F.max("v").over(Window.partitionBy("block").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    # an interval that began in an earlier block: one row for each block
    ends = marked.groupBy("block").agg(F.max("v").alias("z"))
    ends = ends.select("block", F.max("z").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("z"))
    found = marked.withColumn("v", inside).join(ends.hint("merge"), "block")
    return scratch.keep(found.select("s", *PLACE, "m", F.coalesce("v", "z").alias("v")))


def later_lines(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """d, th, i, r of all lines that lie in a passage which occurred before."""
    base = stretches(docs, min_words, scratch)
    longest = base.agg(F.max("m")).first()[0] or 0
    array = suffix_array(base, longest, scratch)
    groups = intervals(array, scratch)
    found = scratch.keep(_first(groups, ["v"], scratch).where(F.col("f") < F.struct(*PLACE)).select(*PLACE, F.col("m").alias("len")))
    scratch.drop(array, groups)
    doc = Window.partitionBy("d", "th").orderBy("i")
    reach = F.max(F.col("i") + F.col("len")).over(doc.rowsBetween(Window.unboundedPreceding, 0))
    out = base.select(*PLACE, "r").join(found.hint("merge"), list(PLACE), "left")
    return out.withColumn("reach", reach).where("i < reach").select(*PLACE, "r")


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``docs`` with all columns, text without repeated passages, and n_lines (with a word, before), n_deleted, n_runs (maximal deleted runs).

    Lines are equal if their characters are. Lines without a word take no part and stay. Null texts stay null and empty ones empty, with zero counts.
    Rows that agree on doc_id and text count as one document and get the same result; rows without an id stand first in corpus order.
    Columns named n_lines, n_deleted or n_runs are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    doc = Window.partitionBy("d", "th").orderBy("i")
    gone = later_lines(docs, min_words, scratch).withColumn("start", (F.coalesce(F.lag("i").over(doc), F.lit(-2)) != F.col("i") - 1).cast("int"))
    gone = gone.groupBy("d", "th").agg(F.sort_array(F.collect_list("r")).alias("__gone"), F.sum("start").alias("__runs"))
    gone = scratch.keep(gone.select(F.col("d").alias("__d"), F.col("th").alias("__th"), "__gone", "__runs"))
    scratch.tidy()
    d, th = _ids(docs)
    plain = docs.drop("n_lines", "n_deleted", "n_runs")
    # one way at every size: a small right side would otherwise be broadcast until it is too large for it
    joined = plain.withColumns({"__d": d, "__th": th}).join(gone.hint("merge"), ["__d", "__th"], "left")
    lines = F.split("text", "\n", -1)
    bounds = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform("__gone", lambda r: r + 1)).alias("s"),
        F.concat(F.col("__gone"), F.array(F.size(lines))).alias("e"),
    )
    kept = F.flatten(F.transform(bounds, lambda b: F.slice(lines, b["s"] + 1, b["e"] - b["s"])))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    full = F.coalesce(F.size(F.filter(lines, lambda x: F.length(F.regexp_replace(x, WORD_GAP, "")) > 0)), F.lit(0))
    full = F.when(F.col("text").isNull(), 0).otherwise(full)
    out = joined.withColumns({"n_lines": full.cast("long"), "n_deleted": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), "n_runs": F.coalesce("__runs", F.lit(0)).cast("long"), "__t": text})
    out = out.withColumn("n_deleted", F.when(F.col("__gone").isNull(), 0).otherwise(F.col("n_deleted")).cast("long")).withColumn("text", F.col("__t"))
    return out.select(*plain.columns, "n_lines", "n_deleted", "n_runs")
