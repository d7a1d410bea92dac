"""Filing tables: structure, negatives, scales."""

import pytest

from pyspark.sql import functions as F

from factweave.functions import cells as ce
from factweave.operators import tables as op

CASES = {
    "units row": ("| 2024 | Cost | Gains |\n| --- | --- | --- |\n|  | (In millions) |  |\n| Cash | $ 12 | 3 |\n",
                  ["|  | (In millions) | (In millions) |", "| Cash | $ 12M | $ 3M |"]),
    "per share": ("| In millions, except per share data | 2025 |\n| --- | --- |\n| Net income | $ 101 |\n| Per Share Data |  |\n| Basic | $ 0.81 |\n| Average Shares Outstanding |  |\n| Basic | 126 |\n",
                  ["| Net income | $ 101M |", "| Basic | $ 0.81 |", "| Basic | 126M |"]),
    "row scales": ("| Metric | 2025 | Change |\n| --- | --- | --- |\n| Revenue (in millions) | $ 32 | 3 % |\n| AUM (in billions) | $ 22 | — % |\n| AUC (in trillions) | $ 4.1 | 1 % |\n",
                   ["| Revenue (in millions) | $ 32M | 3 % |", "$ 22B", "$ 4.1T"]),
    "split tokens": ("(in millions)\n\n| Line | 2020 | 2019 | Change |  |\n| --- | --- | --- | --- | --- |\n| Sales | $ 28 | $ 29 | (3 | )% |\n| Profit | 11 | ( 4 ) | (10 | ) |\n",
                     ["| Line | 2020 | 2019 | Change |\n", "| Sales | $ 28M | $ 29M | -3 % |", "| Profit | $ 11M | -$ 4M | -10 |"]),
    "spare columns": ("|  |  |  |  |\n| --- | --- | --- | --- |\n| Period | (thousands) |  | Price |\n| Jan | 281 | $ | 480.30 |\n", ["| Jan | 281K | $480.30 |"]),
    "wrong letter": ("**(amounts in millions)**\n\n|  | 2025 |\n| --- | --- |\n| NET INCOME | $ 20M |\n| Shares used in calculation (000s): |  |\n| Basic | 443,837M |\n", ["| Basic | 443,837K |", "| NET INCOME | $ 20M |"]),
    "share wording": ("Activity (in millions, except number of shares, which are reflected in thousands):\n\n| Period | Number of Shares | Paid |\n| --- | --- | --- |\n| July | 41 | $ 60 |\n", ["| July | 41K | $ 60M |"]),
    "ranking": ("| Metrics (in millions, except ranking data, ratios and employees) | 2024 |\n| --- | --- |\n| 1 year ranking | 73 |\n| Total assets | $ 25 |\n| Employees | 29 |\n| Loans to period-end loans | 0.3 |\n",
                ["| 1 year ranking | 73 |", "| Total assets | $ 25M |", "| Employees | 29 |", "| Loans to period-end loans | 0.3 |"]),
    "untouched": ("Before\n\n| Year | Revenue |\n| --- | --- |\n| 2025 | $ 42 |\n\nAfter\n", ["| 2025 | $ 42 |\n\nAfter\n"]),
    "broken": ("| a | b |\n| --- | --- |\n| 1 |\n", ["| 1 |\n"]),
    "no table": ("just text", ["just text"]),
}


@pytest.fixture(scope="module")
def repaired(spark):
    df = spark.createDataFrame([(n, c[0]) for n, c in CASES.items()], "doc_id string, body string")
    first = op.repair_documents(df).collect()
    again = spark.createDataFrame([(r.doc_id, r.new_body) for r in first], "doc_id string, body string")
    return {r.doc_id: r for r in first}, {r.doc_id: r.new_body for r in op.repair_documents(again).collect()}


@pytest.mark.parametrize("case", CASES)
def test_expected_rows(repaired, case):
    for line in CASES[case][1]:
        assert line in repaired[0][case].new_body


def test_second_pass_changes_nothing(repaired):
    assert {n: r.new_body for n, r in repaired[0].items()} == repaired[1]


def test_report_counts(repaired):
    r = repaired[0]
    assert (r["split tokens"].negatives, r["split tokens"].removed_columns) == (3, 1)
    assert r["spare columns"].moved == 1 and r["broken"].skip_reasons == "inconsistent source row widths"
    assert r["untouched"].changed_tables == 0 and not r["untouched"].changed and r["untouched"].new_body == CASES["untouched"][0]


@pytest.mark.parametrize(("row", "cells", "negatives", "moved"), [
    (["x", "$", "5"], ["x", "", "$5"], 0, 1), (["x", "(", "5", ")"], ["x", "", "-5", ""], 1, 0), (["x", "1", ",", "234"], ["x", "1,234", "", ""], 0, 0),
    (["x", "$", "(5", ")"], ["x", "", "-$5", ""], 1, 1), (["x", "3", "%"], ["x", "3 %", ""], 0, 0), (["x", "(3", ")%"], ["x", "-3 %", ""], 1, 0), (["x", "$", "", "-7"], ["x", "", "", "-$7"], 0, 1),
    (["x", "$", "—"], ["x", "", "—"], 0, 0), (["x", "3 %", "%"], ["x", "3 %", ""], 0, 0), (["x", "$ (9", ")", "$", "4"], ["x", "-$9", "", "", "$4"], 1, 1), (["x", "text", ",", "note"], ["x", "text", "", "note"], 0, 0),
    (["$", "("], ["", ""], 0, 0), (["x", "", "5"], ["x", "", "5"], 0, 0), ([], [], 0, 0),
])
def test_signs_join_their_values(spark, row, cells, negatives, moved):
    r = spark.createDataFrame([(row,)], "r array<string>").select(ce.merged_row(F.col("r")).alias("m")).first().m
    assert (list(r.cells), r.negatives, r.moved) == (cells, negatives, moved)

def test_texts_without_lines_or_tables(spark):
    df = spark.createDataFrame([("null", None), ("empty", ""), ("break", "\n"), ("long", "a\n" * 20_000 + "| x | y |\n| --- | --- |\n" + "| r | 1 |\n" * 500)], "doc_id string, body string")
    r = {x.doc_id: x for x in op.repair_documents(df).collect()}
    assert r["null"].new_body is None and not r["null"].changed
    assert [r[n].new_body for n in ("empty", "break")] == ["", "\n"]
    assert r["long"].new_body.count("\n") == 20_502 and r["long"].skipped_tables == 0


def test_repair_stays_in_the_row(spark):
    df = spark.createDataFrame([("a", "| x | y |\n")], "doc_id string, body string")
    plan = op.repair_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
