"""Growth of a period: only facts that questions ask for are dealt out, and the rows stay those of all facts."""

import datetime

from factweave.operators import facts as op

PERIOD = "struct<start:date,end:date,kind:string,fiscal_year:int,fiscal_period:string>"
FACTS = f"id string, ticker string, concept string, roles array<string>, value string, scale string, unit string, currency string, path string, dimensions map<string,string>, period {PERIOD}, ordinal long"


def fact(n, year, value, role="revenue", fp="FY", fy="same", end="year"):
    end = datetime.date(year, 12, 31) if end == "year" else end
    return (f"f{n}", "A", "us-gaap:Revenues", [role], value, "1", "USD", "USD", "p", None, (None, end, "duration", year if fy == "same" else fy, fp), n)


def growth(spark, asked):
    rows = [fact(1, 2020, "100"), fact(2, 2021, "150"), fact(3, 2021, "160"), fact(4, 2022, "300", fy=None), fact(5, 2023, "9", end=None), fact(6, 2021, "7", role="cost"), fact(7, 2020, "50", fp="Q1"), fact(8, 2021, "0", role="net_income"), fact(9, 2022, "5", role="net_income")]
    return op.period_growth(spark.createDataFrame(asked, "question_id string, ticker string, role string, year int, fiscal_period string"), spark.createDataFrame(rows, FACTS))


def test_each_kind_of_question_meets_its_facts(spark):
    asked = [("year", "A", "revenue", 2021, "FY"), ("any year", "A", "revenue", None, "FY"), ("any", "A", "revenue", None, None), ("any period", "A", "revenue", 2020, None), ("quarter", "A", "revenue", None, "Q1"),
             ("no end", "A", "revenue", 2023, "FY"), ("zero", "A", "net_income", None, "FY"), ("company", "B", "revenue", 2021, "FY"), ("role", "A", None, 2021, "FY"), ("no role", "A", "equity", None, None)]
    got = {r.question_id: (r.fact and r.fact.id, r.prior and r.prior.id, r.status, r.growth and round(r.growth, 6)) for r in growth(spark, asked).collect()}
    none = (None, None, "two comparable periods are required", None)
    assert got == {
        "year": ("f2", "f1", "ok", 50.0), "any year": ("f4", "f2", "ok", 100.0), "any": ("f4", "f2", "ok", 100.0), "any period": ("f1", None, "no prior comparable period is bound", None),
        "quarter": ("f7", None, "no prior comparable period is bound", None), "no end": ("f5", None, "no prior comparable period is bound", None), "zero": ("f9", "f8", "not exact", None),
        "company": none, "role": none, "no role": none}
    keys = {r.question_id: (r.fact.period_key, r.prior.period_key) for r in growth(spark, asked).where("status = 'ok'").collect()}
    assert keys["year"] == ("?|2021-12-31|duration|2021|FY", "?|2020-12-31|duration|2020|FY")


def test_facts_that_nobody_asks_for_are_not_dealt_out(spark):
    plan = growth(spark, [("q", "A", "revenue", 2021, "FY")])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "slot_period, *" not in plan
    under = plan[plan.index("Aggregate"):]
    assert under.count("Join Inner") == 1 and under.count("Join LeftSemi") == 1
