"""Ordered-neighbour and running-total operators that never put one key's whole history into one task.

A key may hold a large share of all rows, so its history is cut into chunks by a pure function of the row
(a calendar month, a block of turns, ...). Windows run inside (key, chunk); one small row per chunk carries
first, last and total across chunk borders. Results equal the plain window over the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _meet(rows: DataFrame, borders: DataFrame, keys: list[str]) -> DataFrame:
    """Join that keeps rows with a NULL key or chunk."""
    right = borders.withColumnsRenamed({k: f"_{k}_r" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}_r"))
        on = same if on is None else on & same
    return rows.join(right, on, "left").drop(*[f"_{k}_r" for k in keys])


def with_neighbors(df: DataFrame, keys: list[str], chunk: Column, order: list[str], payload: list[str]) -> DataFrame:
    """Adds struct columns ``prior`` and ``next`` holding the payload of the neighbouring rows of the key."""
    row = F.struct(*payload)
    w = W.partitionBy(*keys, "_chunk").orderBy(*order)
    inner = df.withColumn("_chunk", chunk).withColumn("_row", row).withColumn("_prev", F.lag("_row").over(w)).withColumn("_next", F.lead("_row").over(w))
    # the rows at a chunk's ends come from the same shuffled windows
    edge = inner.groupBy(*keys, "_chunk").agg(F.first(F.when(F.col("_prev").isNull(), F.col("_row")), ignorenulls=True).alias("_first"), F.first(F.when(F.col("_next").isNull(), F.col("_row")), ignorenulls=True).alias("_last"))
    wk = W.partitionBy(*keys).orderBy("_chunk")
    edge = edge.select(*keys, "_chunk", F.lag("_last").over(wk).alias("_before"), F.lead("_first").over(wk).alias("_after"))
    out = _meet(inner, edge, [*keys, "_chunk"])
    return out.select(*df.columns, F.coalesce("_prev", "_before").alias("prior"), F.coalesce("_next", "_after").alias("next"))


def with_running(df: DataFrame, keys: list[str], chunk: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the running sum of ``value`` up to and including the row; a running count is the sum of ones."""
    w = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    x = df.withColumn("_chunk", chunk).withColumn("_v", value).withColumn("_s", F.sum("_v").over(w))
    totals = x.groupBy(*keys, "_chunk").agg(F.max_by("_s", F.struct(*order)).alias("_t"))
    wk = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_chunk", F.coalesce(F.sum("_t").over(wk), F.lit(0)).alias("_offset"))
    out = _meet(x, totals, [*keys, "_chunk"])
    return out.select(*df.columns, (F.col("_s") + F.col("_offset")).alias(name))
