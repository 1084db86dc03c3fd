"""A corpus pipeline: quality rules, line dedup, near-duplicates, mixing and packing, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphflow.llm import lines, mixing, packing, quality, simhash
from graphflow.llm.common import table
from graphflow.llm.queries import tokenizer_path
from graphflow.scratch import Scratch

#: Documents of a stretch of the mix that is packed by itself.
SPAN_ROWS = 100_000
#: The stages tokenise and train, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated passages; n_chars follows the text, documents of which nothing is left go."""
    out = lines.dedup_lines(docs).where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints within two bits, or 0.8 of the five-word shingles shared."""
    return simhash.keep_first(docs, similar=0.8)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: rows follow the schedule from file to file."""
    return mixing.mix(docs).orderBy("slot", "in_block").select(*docs.columns)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences.

    Stretches of the mix, files in a row with about SPAN_ROWS documents together, are packed by themselves and their sequences numbered in the order of
    the mix, so the sequences follow the schedule.
    """
    file = F.coalesce(F.regexp_extract(F.input_file_name(), r"part-(\d+)[^/]*$", 1).try_cast("long"), F.lit(0))
    rows, last = docs.select(file.alias("file")).agg(F.count("*"), F.max("file")).first()
    files = (last or 0) + 1
    return packing.pack(docs, tokenizer_path(), span=F.floor(file / max(1, round(files * SPAN_ROWS / max(rows, 1)))))


STAGES = [("quality", quality_rules), ("lines", line_dedup), ("near_duplicates", near_dedup), ("mixing", source_mix), ("packing", best_fit)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage keeps is written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        new = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
