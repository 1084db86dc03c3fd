"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio (operator 6, native).

Two first-order character chains are trained from labelled samples, one of random strings and one of ordinary words and identifiers; what
training gathers is one count for each label and pair of characters. A candidate, a long token of letters and digits, is a secret if random strings explain it better
by at least ``margin`` nats. Scanning is one projection over the texts: matches and the pieces between them give positions, the chains'
log-ratios stand in the plan as one literal array, and nothing is shuffled.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphflow.llm.common import hashed_sample

#: The patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
HEX_LONG = r"[0-9a-f]{32,}"
#: Longest runs that can be a secret by their characters alone: a letter, a digit, ``least`` characters.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{%d,}"
KINDS = ("assign", "access", "hex", "markov")
#: Characters of the chains.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


#: Rows of a block: arrays that grow by one row at a time are no longer than that.
BLOCK = 256
_SPAN = "struct<b:int,k:int,e:int,v:string>"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(rows: Column, first: Column, kind: str, step) -> Column:
    """The outputs (of type ``kind``) of ``step``, which makes (state, output) from a state and a row, over all rows in order; in time that is linear in the rows but for the list of blocks."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["s"], x)
        return F.struct(state.alias("s"), F.concat(acc["out"], F.array(out)).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        return _let(F.aggregate(b, F.struct(acc["s"].alias("s"), none.alias("out")), one), lambda g: F.struct(g["s"].alias("s"), F.concat(acc["out"], F.array(g["out"])).alias("out")))

    def whole(r: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(r) / BLOCK).cast("int")), lambda k: F.slice(r, k * BLOCK + 1, F.lit(BLOCK)))
        return F.aggregate(blocks, F.struct(first.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out")), block, lambda acc: F.flatten(acc["out"]))

    return _let(rows, whole)


def _spans(text: Column, pattern: str, kind: int, least: int, group: int, when: Column) -> Column:
    """Structs (b, k, e, v) of the matches of ``pattern`` whose group has ``least`` characters, where ``when`` holds."""
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(gaps.alias("g"), whole.alias("w"), part.alias("v"))

    def step(at: Column, x: Column):
        b = at + x["g"]
        e = b + F.coalesce(F.length(x["w"]), F.lit(0))
        return e, F.struct(b.alias("b"), F.lit(kind).alias("k"), e.alias("e"), x["v"].alias("v"))

    found = F.filter(_scan(rows, F.lit(0), _SPAN, step), lambda x: F.length(x["v"]) >= least)
    return F.when(when, found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _free(base: Column, more: Column) -> Column:
    """Those of ``more`` that no span of ``base`` overlaps: one pass from the left with the furthest end of the base so far, and one from the right with the nearest start."""
    kind = f"struct<b:int,x:{_SPAN},ok:boolean>"
    row = lambda x, ok: F.struct(x["b"].alias("b"), x.alias("x"), ok.alias("ok"))
    left = _scan(F.array_sort(F.concat(base, more)), F.lit(0), kind, lambda end, x: (F.when(x["k"] < 3, F.greatest(end, x["e"])).otherwise(end), row(x, (x["k"] == 3) & (end <= x["b"]))))
    far = F.lit(2**31 - 1)
    right = _scan(F.reverse(left), far, kind, lambda start, y: (F.when(y["x"]["k"] < 3, F.least(start, y["b"])).otherwise(start), row(y["x"], y["ok"] & (start >= y["x"]["e"]))))
    return F.when((F.size(base) > 0) & (F.size(more) > 0), F.transform(F.filter(right, lambda y: y["ok"]), lambda y: y["x"])).otherwise(more)


def fit_chains(samples: DataFrame, pseudo: float = 0.5) -> list[float]:
    """Log-ratio of the two chains for each pair of ALPHABET characters, row by row: random over ordinary.

    ``samples``: sample string, random boolean. Pairs with other characters, short and null samples don't count; a label without samples is a uniform chain.
    At most two counts for each pair of characters come to the driver.
    """
    pairs = samples.where("sample is not null and random is not null and length(sample) > 1").select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: F.substr("sample", i, F.lit(2)))).alias("pair")
    )
    size = len(ALPHABET)
    counts = {kind: [[pseudo] * size for _ in range(size)] for kind in (True, False)}
    for r in pairs.where(F.col("pair").rlike("^[A-Za-z0-9+/_=-]{2}$")).groupBy("random", "pair").count().collect():
        counts[r["random"]][ALPHABET.index(r["pair"][0])][ALPHABET.index(r["pair"][1])] += r["count"]
    out = []
    for a in range(size):
        rows = [counts[kind][a] for kind in (True, False)]
        sums = [sum(x) for x in rows]
        out += [math.log(rows[0][b] / sums[0]) - math.log(rows[1][b] / sums[1]) for b in range(size)]
    return out


def labelled_samples(docs: DataFrame, documents: int = 2000, strings: int = 6000) -> DataFrame:
    """Samples for ``fit_chains``: random hexadecimal, base64 and upper-case strings made by hashing numbers, and ordinary identifiers made from the words of
    ``documents`` documents (those whose hashed id and text are smallest): words, words with a number, and words joined by a hyphen or an underscore."""
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    code = F.translate(F.base64(F.unhex(digest)), "\r\n", "")
    made = docs.sparkSession.range(strings).select(F.explode(F.array(F.substring(digest, 1, 40), code, F.regexp_replace(F.upper(code), "[^A-Z0-9]", ""))).alias("sample"))
    few = hashed_sample(docs.select("doc_id", "text").where("text is not null"), documents, "doc_id", "text")
    # ordinary text is what the fixed patterns leave
    plain_text = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS + "|" + HEX_LONG, " "), r"[\x20\x09-\x0D]+", " ")
    words = F.filter(F.split(plain_text, " "), lambda w: F.length(w) > 3)
    word = few.select(F.posexplode(words).alias("i", "w")).select("i", F.regexp_replace("w", "[^A-Za-z]", "").alias("w")).where("length(w) > 3")
    number = F.pmod(F.hash("w"), F.lit(100)).cast("string")
    plain = word.select(F.explode(F.array("w", F.concat("w", number), F.concat_ws("_", "w", "w"), F.concat_ws("-", number, "w"))).alias("sample"))
    return made.withColumn("random", F.lit(True)).union(plain.withColumn("random", F.lit(False)))


def log_ratio(token: Column, table: Column) -> Column:
    """Nats by which the random chain explains ``token`` better; one pass over its characters."""
    places = F.from_json(F.lit(json.dumps([ALPHABET.find(chr(c)) + 1 for c in range(128)])), "array<int>")
    codes = F.filter(F.transform(F.split(token, ""), lambda c: F.get(places, F.ascii(c))), lambda p: p > 0)

    def step(acc: Column, p: Column) -> Column:
        more = F.when(acc["p"] > 0, F.element_at(table, (acc["p"] - 1) * len(ALPHABET) + p)).otherwise(0.0)
        return F.struct(p.alias("p"), (acc["r"] + more).alias("r"))

    return F.aggregate(codes, F.struct(F.lit(0).alias("p"), F.lit(0.0).alias("r")), step, lambda acc: acc["r"])


def scan(docs: DataFrame, ratios: list[float], least: int = 16, margin: float = 14.0) -> DataFrame:
    """All columns of ``docs`` and found: structs (b, k, e, v) of every secret, by start, then kind (0 assign, 1 access, 2 hex, 3 markov).

    Positions are code points, the end is exclusive; a null text has no secrets. Fixed patterns are matched leftmost and without overlap within a kind, and matches that are too
    short drop out afterwards. Texts and tokens may be very long, and a text may hold very many spans: the work grows with both in proportion. Markov spans are added where no fixed one overlaps. A column named found is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    digit = text.rlike("[0-9]")
    assign = (F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(r"(?i)passw|secret|token|api_?key")
    # cheap tests spare most texts the patterns
    base = F.concat(
        _spans(text, ASSIGN, 0, 8, 2, assign), _spans(text, ACCESS, 1, 16, 0, F.contains(text, F.lit("AKIA"))), _spans(text, HEX, 2, 32, 0, text.rlike("[0-9a-f]{32}")),
    )
    tokens = F.filter(_spans(text, TOKEN % least, 3, least, 0, digit), lambda x: log_ratio(x["v"], table) >= margin)
    found = _let(F.struct(base.alias("base"), tokens.alias("more")), lambda x: F.array_sort(F.concat(x["base"], _free(x["base"], x["more"]))))
    return docs.drop("found").withColumn("found", found)


def digest(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["b"], x["e"])), ",")


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["k"] == KINDS.index(kind))).cast("long")
