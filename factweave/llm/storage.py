"""Intermediate tables in the cluster's shared folder, and small bitmaps of keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.session import work_dir

#: Bits of a bitmap of keys: a fixed bound on what is sent to all executors, 512 KB at any size of the data.
BITMAP_BITS = 1 << 22
#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker and its task hold at once; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    at = int(spark.conf.get(name))
    if not 0 < at <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes a table below spark.checkpoint.dir and reads it again: later steps don't depend on lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS)).cast("int")


def bitmap(df: DataFrame, key: str, slots: bool = False) -> np.ndarray:
    """Bits of the slots that the keys fall into; a superset of the keys, of fixed size. slots: the keys are slots already."""
    s = df.select((F.col(key).cast("int") if slots else slot(F.col(key))).alias("s"))
    words = s.groupBy(F.shiftright("s", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, s & 31)")).alias("b"))
    out = np.zeros(BITMAP_BITS // 32, np.uint32)
    got = words.toArrow()  # BITMAP_BITS / 32 rows at most
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return out


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 5] >> (slots & 31).astype(np.uint32)) & np.uint32(1) != 0
