"""Graphs and images derived from relational tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Width and height of the part raster: columns of floor(sqrt(parts)) pixels."""
    n = load(spark, sf_dir, "part").count()
    h = math.isqrt(n)
    return n // h if h else 0, h


def part_raster(spark: SparkSession, sf_dir: str, w: int, h: int) -> DataFrame:
    """The parts as an image: x, y, c0 (price), c1 (size), c2 (0); parts beyond the last full column are left out."""
    parts = load(spark, sf_dir, "part").where(F.col("p_partkey") < w * h)
    return parts.select(
        F.floor(F.col("p_partkey") / h).cast("int").alias("x"), (F.col("p_partkey") % h).cast("int").alias("y"),
        F.col("p_retailprice").alias("c0"), F.col("p_size").cast("double").alias("c1"), F.lit(0.0).alias("c2"),
    )


def part_frame(spark: SparkSession, sf_dir: str, w: int, h: int) -> DataFrame:
    """The parts as a time-of-flight frame: node, X, Y, Z, I."""
    parts = load(spark, sf_dir, "part").where(F.col("p_partkey") < w * h)
    return parts.select(
        F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / h).cast("double").alias("X"), (F.col("p_partkey") % h).cast("double").alias("Y"),
        (F.col("p_size") / 10.0).alias("Z"), (F.col("p_retailprice") * 50.0).alias("I"),
    )


def nation_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """col (customer's nation), row (supplier's nation), val (line items between them).

    The small sides are joined before their keys are summed, so that the largest table is read once with two columns.
    """
    customer = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("col"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(customer, "o_custkey")
    supplier = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("row"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(supplier, "l_suppkey")
    return lines.join(orders, "l_orderkey").groupBy("col", "row").agg(F.count("*").cast("double").alias("val"))


def supplier_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Suppliers that share orders: col, row, val (orders), the k strongest of each col, ties to the lower row."""
    pairs = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    left, right = pairs.select("l_orderkey", F.col("l_suppkey").alias("col")), pairs.select("l_orderkey", F.col("l_suppkey").alias("row"))
    counts = left.join(right, "l_orderkey").groupBy("col", "row").agg(F.count("*").cast("double").alias("val"))
    best = Window.partitionBy("col").orderBy(F.desc("val"), "row")
    return counts.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("col", "row", "val")


def event_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """col, row, val: how often an event type (numbered by name) is followed by another for the same user."""
    events = load(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    names = events.select("event_type").distinct().withColumn("i", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("long"))  # a handful of types
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = events.select("event_type", after.alias("next")).where("next is not null").groupBy("event_type", "next").agg(F.count("*").cast("double").alias("val"))
    a, b = names.select("event_type", F.col("i").alias("col")), names.select(F.col("event_type").alias("next"), F.col("i").alias("row"))
    return steps.join(a, "event_type").join(b, "next").select("col", "row", "val")
