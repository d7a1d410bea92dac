"""State of a stream kept in blocks with a summary each: a micro-batch reads and rewrites the blocks that its rows fall into.

Below a base folder, ``blocks/gen=N/part=P`` and ``summaries/gen=N/part=P`` hold what batch N made of part P, and the batch log
``rows/batch=N`` names the parts that it touched. Files are never changed: the newest generation of a part counts. Batch N
reads generations before N only, so a batch that is replayed writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def newest(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """(part, gen): the newest generation of each part."""
    log = spark.read.schema("part string, batch int").parquet(f"{base}/rows")
    log = log if before is None else log.where(F.col("batch") < before)
    return log.groupBy("part").agg(F.max("batch").alias("gen"))


def kept(spark: SparkSession, base: str, name: str, schema: T.StructType, parts: DataFrame) -> DataFrame:
    """The rows of parts(part, gen); part and generation are folders, so Spark reads only the files that the small side names."""
    whole = T.StructType([*schema.fields, T.StructField("gen", T.IntegerType()), T.StructField("part", T.StringType())])
    return spark.read.schema(whole).parquet(f"{base}/{name}").join(parts, ["part", "gen"]).select(*schema.names)


def keep(batch: DataFrame, batch_id: int, base: str, part: Column, merge: Callable[[DataFrame], DataFrame], summary: Callable[[DataFrame], DataFrame], first: bool) -> DataFrame:
    """Merges a batch into its blocks, writes them with their summaries, and returns the touched parts for the batch log.

    merge makes one row of the rows of one key and must not depend on their order or repetition. first: nothing is kept yet.
    """
    spark, own = batch.sparkSession, batch.columns
    rows = batch
    if not first:
        touched = batch.select(part.alias("part")).distinct()
        rows = rows.unionByName(kept(spark, base, "blocks", batch.schema, newest(spark, base, batch_id).join(touched, "part", "left_semi")))
    merged = merge(rows).select(*own).withColumn("part", part)
    merged.write.mode("overwrite").partitionBy("part").parquet(f"{base}/blocks/gen={batch_id}")
    schema = T.StructType([*batch.schema.fields, T.StructField("part", T.StringType())])
    again = spark.read.schema(schema).parquet(f"{base}/blocks/gen={batch_id}")
    summary(again).write.mode("overwrite").partitionBy("part").parquet(f"{base}/summaries/gen={batch_id}")
    return again.select("part").distinct()
