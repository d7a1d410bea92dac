"""Writers: partitioned Parquet with skip-existing, manifests, corpus index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.scalars import safe_name_dash
from factweave.session import work_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table below spark.checkpoint.dir and reads it again: its lineage ends there, and lost executors don't matter."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filing_path(df: DataFrame) -> DataFrame:
    """Adds ``output``: folder and file name of a filing."""
    name = F.concat_ws("-", safe_name_dash(F.col("ticker")), F.concat(F.lit("FY"), F.col("fiscal_year")), safe_name_dash(F.col("form")),
                       safe_name_dash(F.col("filing_date").cast("string")), safe_name_dash(F.col("accession")))
    return df.withColumn("output", F.concat(F.lit("filings/"), safe_name_dash(F.col("ticker")), F.lit("/"), name, F.lit(".md")))


def new_filings(filings: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Filings whose output is not there yet."""
    x = filing_path(filings)
    return x if existing is None else x.join(existing.select("output").distinct(), "output", "left_anti")


def write_filings(filings: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Appends by ticker and year. Rows are spread by accession first, so no ticker's rows meet in one task."""
    new = new_filings(filings, existing)
    new.withColumn("year", F.col("fiscal_year")).repartition("ticker", "year", F.pmod(F.xxhash64("accession"), F.lit(16))).write.mode("append").partitionBy("ticker", "year").parquet(path)


def write_facts(facts: DataFrame, path: str) -> None:
    facts.write.mode("overwrite").partitionBy("ticker").parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One status row per file. Files stay parallel; a reader takes the folder."""
    manifest.write.mode("overwrite").option("header", True).csv(path)


def write_index(parts: dict[str, DataFrame], path: str) -> None:
    """Counts, companies, nodes and id-to-path as JSON lines below one folder."""
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
