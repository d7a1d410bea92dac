"""Column helpers and readers and writers that no registered query passes through."""

import datetime

import pytest
from pyspark.sql import functions as F

from factweave.functions import scalars as sc
from factweave.sources import acquisition, sinks


@pytest.mark.parametrize(("helper", "text", "want"), [
    (sc.ticker_loose, "brk.b $", "BRK.B"), (sc.ticker_dashed, "brk.b", "BRK-B"), (sc.safe_name, " Größe: 5/6 ", "Größe_5_6"), (sc.safe_name, "??", "unknown"), (sc.safe_name, "a..b-c", "a..b-c"),
    (sc.fiscal_year_in_name, "x-FY2024-10K.md", "2024"), (sc.fiscal_year_in_name, "x-2024.md", "unknown"),
])
def test_names(spark, helper, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(helper(F.col("c"))).first()[0] == want


def test_numbers_and_days(spark):
    x = spark.sql("SELECT CAST(12.345 AS DECIMAL(10,3)) AS r, CAST(86399 AS BIGINT) AS s, CAST(NULL AS DECIMAL(10,3)) AS n")
    got = x.select(sc.percent_text(F.col("r")), sc.epoch_date(F.col("s")), sc.percent_text(F.col("n"))).first()
    assert got[:] == ("12.34%", datetime.date(1970, 1, 1), None)


def test_written_tables_come_back(spark, tmp_path):
    facts = spark.createDataFrame([("A", "1"), ("B", "2"), ("A", "3")], "ticker string, value string")
    sinks.write_facts(facts, str(tmp_path / "facts"))
    assert sorted((r.ticker, r.value) for r in sinks.read_back(spark, str(tmp_path / "facts")).collect()) == [("A", "1"), ("A", "3"), ("B", "2")]
    sinks.write_manifest(facts, str(tmp_path / "manifest"))
    assert spark.read.csv(str(tmp_path / "manifest"), header=True).count() == 3
    sinks.write_index({"companies": facts.select("ticker").distinct(), "paths": facts}, str(tmp_path / "index"))
    assert sorted(r.ticker for r in spark.read.json(str(tmp_path / "index" / "companies")).collect()) == ["A", "B"]


def test_macro_and_submission_files(spark, tmp_path):
    (tmp_path / "GDP.csv").write_text("date,value,realtime_start,realtime_end\n2024-01-01,1.5,2024-02-01,2024-03-01\n2024-04-01,.,,\n")
    got = sorted(map(tuple, acquisition.read_macro(spark, str(tmp_path / "GDP.csv")).select("series_id", "date", "value").collect()), key=str)
    assert got == [("GDP", datetime.date(2024, 1, 1), 1.5), ("GDP", datetime.date(2024, 4, 1), None)]
    (tmp_path / "s.json").write_text('{"cik": "1", "name": "N"}')
    assert acquisition.read_submissions(spark, str(tmp_path / "s.json")).count() == 1
