"""What the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that Python workers get: texts can be long.
BATCH_ROWS = 512

#: The white space that separates words, as bytes.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; only ever lowers the session's setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(column: str | Column) -> Column:
    """The id as text; a null id counts as empty text."""
    return F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))


def hashed_sample(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """The ``most`` distinct rows (in ``columns``) whose hashed columns are smallest, each once; all of them, if there are fewer.

    Only hashes are ordered; rows beyond the last one wanted are dropped where they are read, and copies are combined before they are shuffled.
    """
    value = F.xxhash64(*columns)
    last = rows.select(value.alias("v")).distinct().orderBy("v").limit(most).agg(F.max("v")).first()[0]
    few = rows.where(value <= F.lit(last)).groupBy(value.alias("v")).agg(F.min(F.struct(*columns)).alias("row"))
    return few.select("row.*")


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return pc.fill_null(batch.column(name), "").cast(pa.large_binary()).to_pylist()


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and the offsets (one more than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def slices(texts: list[bytes], most: int = 2_000_000):
    """Ranges (from, to) of texts of about ``most`` bytes together; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
