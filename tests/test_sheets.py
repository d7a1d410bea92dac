"""Tables in plain Python: the rules of the column expressions, in one pass over a document."""

import random

import pytest
from pyspark.sql import functions as F

from factweave.functions import cells as ce
from factweave.functions import fixed, sheets
from factweave.operators import tables as op
from tests.test_cell_patterns import TEXTS

MORE = ["revenué", "sales²", "cash́flow", "x́ cash ́fee", "_́cash", "sharesｘ", "in millions½", "in millions of dollars²", "(in billions) \xa0except ratios", "in Khousands", "$ 5 K", "０５", "12 %", "bps٠", "$dollar€", "Ⅷshare count",
        "a<*br>b", "thou*sands of shares", "5-", "( 4 ) %", "€ (4)", "$ ( £ 4 )", "-$ 7M (1)", "+ € 5 *", "shares; in thousands of shares in billions", "in millions except bps and days)", "Loans to period-end loans", "1 year rank", "headcount"]


def test_cells_are_read_as_by_the_columns(spark):
    t = F.col("t")
    pairs = {n: (getattr(ce, n)(t), getattr(sheets, n)) for n in ("strip", "clean", "plain", "is_value", "is_year", "scale_in", "share_scale_in", "exceptions_in", "accounting_negative")}
    pairs["is_percent"] = (ce.like(t, fixed.PERCENT), sheets.is_percent)
    for name, pattern in {"UNITS_EXCEPTION": fixed.UNITS_EXCEPTION_CLAUSE, "UNITS": fixed.UNITS_CELL, "MONETARY": fixed.MONETARY, "DOLLARS": fixed.DOLLAR_WORDING, "SHARE_COUNT": fixed.SHARE_COUNT, "PER_SHARE": fixed.PER_SHARE,
                          "TIME_METRIC": fixed.TIME_METRIC, "CHANGE": fixed.CHANGE_COLUMN, "RATIO": fixed.RATIO_WORDS, "RELATION": fixed.RATIO_RELATION, "RANKING": fixed.RANKING_WORDS, "EMPLOYEE": fixed.EMPLOYEE_WORDS}.items():
        pairs[name] = (ce.like(t, pattern), lambda x, words=getattr(sheets, name): words.search(x) is not None)
        pairs[f"without {name}"] = (F.regexp_replace(t, pattern, ""), getattr(sheets, name).without)
    texts = [x for x in TEXTS + MORE if x is not None and "\n" not in x and "\x1c" not in x]
    texts += [f"{a} {b}" for a in texts[:40:3] for b in MORE]
    for r in spark.createDataFrame([(x,) for x in texts], "t string").select("t", *[c.alias(n) for n, (c, _) in pairs.items()]).collect():
        for n, (_, f) in pairs.items():
            assert f(r.t) == r[n], (n, r.t)


def test_rows_are_read_as_by_the_columns(spark):
    rng = random.Random(3)
    cells = ["", "", "5", "(5", ")", "(", "$", ")%", ") %", "%", ",", "234", "$ (9", "-7", "—", "text", "2024", "(In millions)", "in thousands", "7 %", ")x", "5 %"]
    rows = [[rng.choice(cells) for _ in range(rng.randrange(1, 7))] for _ in range(600)]
    x = spark.createDataFrame([(r,) for r in rows], "r array<string>")
    x = x.select("r", ce.merged_row(F.col("r")).alias("m"), op.spread_units(F.col("r")).alias("u"), op.first_data_row(F.array("r", "r", "r", "r")).alias("d"))
    for r in x.collect():
        assert (list(r.m.cells), r.m.negatives, r.m.moved) == sheets.merged_row(list(r.r)), r.r
        assert list(r.u) == sheets.spread_units(list(r.r)) and r.d == sheets.first_data_row([list(r.r)] * 4)


def chain(spark):
    df = spark.createDataFrame([(1, "(in millions)\n\n| a | b |\r\n| --- | --- |\n| Cash | 5 |\n| x\\|y | $ 6 |\n"), (2, None), (3, "no table")], "doc_id int, body string")
    return op.scale_cells(op.with_policy(op.repair_structure(op.parse_tables(op.with_context(op.segments(df))))))


@pytest.mark.parametrize("result", [lambda d: op.each_row(d).where("section <> ''"), lambda d: op.each_cell(d).where("new_value <> value"), lambda d: op.each_segment(d).where("rows is not null")])
def test_steps_are_one_pass_over_a_document(spark, result):
    plan = result(chain(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython [") == 1 and "lambda" not in plan


def test_kept_segments_go_on(spark):
    d = chain(spark)
    kept = spark.createDataFrame(d.collect(), d.schema)  # rows, as from a written table
    for unfold in (op.each_row, op.each_cell, op.each_segment):
        assert sorted(map(str, unfold(kept).collect())) == sorted(map(str, unfold(d).collect()))
    assert [(r.row_no, r.col_no, r.value, r.scale, r.new_value) for r in op.each_cell(d).where("scale is not null").collect()] == [(2, 1, "5", "M", "$ 5M"), (3, 1, "$ 6", "M", "$ 6M")]
    assert [[c.new_value for c in r.cells] for r in op.each_row(d).collect()] == [["a", "b"], ["---", "---"], ["Cash", "$ 5M"], ["x\\|y", "$ 6M"]]


def test_filters_on_repaired_texts_are_one_pass(spark):
    df = spark.createDataFrame([(1, "| a | b |\n| --- | --- |\n| (in millions) |  |\n| Cash | (5) |\n"), (2, None), (3, "no table")], "doc_id int, body string")
    x = op.repair_documents(df)
    assert x.where("changed")._jdf.queryExecution().executedPlan().toString().count("EvalPython [") == 1
    assert {r.doc_id: (r.changed, r.changed_tables, r.negatives) for r in x.collect()} == {1: (True, 1, 1), 2: (False, None, None), 3: (False, 0, 0)}
