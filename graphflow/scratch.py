"""Intermediate tables in the folder that the cluster shares.

Iterative operators cut their lineage by writing a Parquet table into the folder
named by ``spark.checkpoint.dir`` and reading it back: an executor can be lost at any time
without losing an iterate, and a table can be dropped as soon as its successor exists.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one where none is configured and all tasks run on this machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="graphflow-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


class Scratch:
    """Tables that one operator call writes; ``drop`` removes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/graphflow/{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read back, so that later plans start from files."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def gather(self, tables: Iterable[DataFrame]) -> DataFrame:
        """The rows of all ``tables`` (of one schema, one at least), each written by a job of its own before the next one is made."""
        self._n += 1
        path, schema = f"{self.root}/{self._n}", None
        for df in tables:
            df.write.mode("append").parquet(path)
            schema = df.schema
        back = self.spark.read.schema(schema).parquet(path)
        back._scratch_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``keep`` returned; shuffle files of finished jobs go with them."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)

    def tidy(self) -> None:
        """Let the driver forget finished plans, which frees their shuffle files on the executors."""
        gc.collect()
        self.spark._jvm.System.gc()
