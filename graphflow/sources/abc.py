"""Edge lists, stored matrices and clusterings as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphflow.operators import matrix
from graphflow.schema import ABC, MatrixMeta, StepStats, as_row


def read_abc(spark: SparkSession, path: str) -> DataFrame:
    """col, row, val of tab-separated lines."""
    return spark.read.schema(ABC).option("sep", "\t").csv(path)


def write_abc(m: DataFrame, path: str, one_file: bool = False) -> int:
    """Write lines col, row, val and return how many; files of a folder, or one file in it."""
    from pyspark.sql import Observation

    seen = Observation()
    lines = m.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in ("col", "row", "val"))).alias("value")).observe(seen, F.count("*").alias("n"))
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)
    return seen.get["n"]


def write_graph(m: DataFrame, path: str) -> str:
    """A similarity graph with weights to six digits, under <path>/matrix.abc unless the path ends so; returns where."""
    path = path if path.endswith(".abc") else f"{path.rstrip('/')}/matrix.abc"
    lines = m.select(F.concat_ws("\t", F.col("col").cast("string"), F.col("row").cast("string"), F.format_string("%.6f", "val")).alias("value"))
    lines.write.mode("overwrite").text(path)
    return path


def analyse_abc(abc: DataFrame) -> tuple[int, int]:
    """Dimension and most entries of a column."""
    r = matrix.analyse(abc).first()
    return r["n"], r["kmax"]


def build_matrix(abc: DataFrame, scale: int = 1, nsub: int = 128, missing_diagonal: str = "error") -> tuple[DataFrame, MatrixMeta]:
    """A column-stochastic matrix of an edge list, ``scale`` times along the diagonal, and its metadata."""
    n, kmax = analyse_abc(abc)
    if not n:
        raise ValueError("no entry above zero")
    kept = matrix.positive(abc)
    if scale != 1:
        kept = matrix.replicate_diagonal(kept, n, scale)
    return matrix.build(kept, missing_diagonal), MatrixMeta(n * scale, nsub, kmax).check()


def save_matrix(m: DataFrame, meta: MatrixMeta, path: str, buckets: int | None = None) -> None:
    """Parquet under <path>/data, clustered by column, and metadata beside it. An earlier matrix is replaced."""
    placed = m.select("col", "row", "val")
    placed = placed.repartition(buckets, "col") if buckets else placed.repartition("col")
    placed.sortWithinPartitions("col", "row").write.mode("overwrite").parquet(f"{path}/data")
    m.sparkSession.range(1).select(F.lit(json.dumps(as_row(meta.check()))).alias("value")).write.mode("overwrite").text(f"{path}/meta")


def load_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, MatrixMeta]:
    meta = MatrixMeta(**json.loads(spark.read.text(f"{path}/meta").first()[0])).check()
    return spark.read.schema(ABC).parquet(f"{path}/data"), meta


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """node, cluster of lines of tab-separated nodes; a cluster's number is its smallest node."""
    nodes = F.transform(F.filter(F.split("value", "\t"), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("long"))
    lines = spark.read.text(path).select(nodes.alias("nodes")).where(F.size("nodes") > 0)
    named = lines.select("nodes", F.array_min("nodes").alias("cluster"))  # once a line: beside explode it would be found for each node
    return named.select(F.explode("nodes").alias("node"), "cluster")


def write_clusters(c: DataFrame, path: str) -> None:
    """A line of tab-separated nodes for each cluster, smallest node first."""
    lines = c.groupBy("cluster").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    lines.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), "\t").alias("value")).write.mode("overwrite").text(path)


def numbered(c: DataFrame) -> DataFrame:
    """Clusters renumbered 0, 1, .. in the order of their smallest node."""
    order = c.select("cluster").distinct().withColumn("number", F.row_number().over(Window.orderBy("cluster")) - 1)
    return c.join(order, "cluster").select("node", F.col("number").cast("long").alias("cluster"))


def counters(spark: SparkSession, stats: list[StepStats]) -> DataFrame:
    """iteration, job, group, counter, value of every iteration."""
    rows = [dict(zip(("iteration", "job", "group", "counter", "value"), r, strict=True)) for s in stats for r in s.counters()]
    kind = "array<struct<iteration:int,job:string,group:string,counter:string,value:long>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def write_counters(spark: SparkSession, stats: list[StepStats], path: str) -> None:
    counters(spark, stats).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
