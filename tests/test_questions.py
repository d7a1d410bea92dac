"""Wording: intents, years, roles, classes and company mentions."""

from pyspark.sql import functions as F

from factweave.operators import questions as qop

ANNUAL = {
    "Assess consolidated operating leverage and compare FY2023, FY2024 and FY2025": ("operating_leverage", [2023, 2024, 2025]),
    "How did gross margin change from FY2023 to FY2025?": ("gross_margin", [2023, 2024, 2025]),
    "What was the CFO / net income in FY2024?": ("cash_conversion", [2024]),
    "What was the cash conversion and margin by segment in FY2024?": (None, [2024]),
    "What was the gross margin and cash conversion in FY2024?": (None, [2024]),
    "What was the operating margin in Q3 2024?": (None, [2024]),
    "Net margin in FY2024": (None, [2024]),
    "What is the net margin?": ("net_margin", None),
    "Compare net margin in 2019, 2020, 2021, 2022, 2023 and 2024": ("net_margin", None),
}


def test_annual_wording(spark):
    df = spark.createDataFrame([(q,) for q in ANNUAL], "q string")
    got = {r.q: (r.i, r.y) for r in df.select("q", qop.annual_intent(F.col("q")).alias("i"), qop.annual_years(F.col("q")).alias("y")).collect()}
    assert got == ANNUAL


def test_scalar_wording(spark):
    cases = {
        "What was revenue in FY2024?": ("revenue", None, "direct_fact", "FY"),
        "What was the diluted earnings per share in 2024?": ("net_income", None, "direct_fact", "FY"),
        "How much revenue growth in Q2 2024?": ("revenue", None, "period_growth_percent", "Q2"),
        "What is the gross margin this quarter?": (None, "gross_profit", "divide_percent", None),
        "Why did revenue fall?": ("revenue", None, "refused: needs synthesis", "FY"),
        "What is the weather?": (None, None, "refused: no financial role", "FY"),
    }
    df = spark.createDataFrame([(q,) for q in cases], "q string")
    p = qop.scalar_program(F.col("q"))
    got = {r.q: (r.role, r.margin_role, r.operation, r.fiscal_period) for r in df.select("q", *[c.alias(n) for n, c in p.items()]).collect()}
    assert got == cases


def test_question_class_is_first_match_by_substring(spark):
    df = spark.createDataFrame([("Which sector is it in?",), ("Compare margins",), ("Tell me more",)], "q string")
    got = [r[0] for r in df.select(qop.question_skill(F.col("q"))["skill"]).collect()]
    assert got == ["source-lookup", "margin-lookup", "markdown-traversal"]


def test_company_mentions(spark):
    companies = spark.createDataFrame(
        [("MSFT", "Microsoft Corp"), ("AAPL", "Apple Inc."), ("COST", "Costco Wholesale Corp"), ("BRK.B", "Berkshire Hathaway Inc"), ("UAL", "United Airlines Holdings"), ("UPS", "United Parcel Service")],
        "ticker string, title string")
    texts = ["How is Microsoft doing against msft?", "BRK-B or BRK.B?", "Apple's cost of revenue", "AAPL and COST", "United results", "unitedly nothing", "Tesla then apple"]
    q = spark.createDataFrame([(i, t, "UAL" if i == 5 else None) for i, t in enumerate(texts)], "question_id long, question string, selected string")
    got = {}
    for r in qop.company_mentions(q, companies).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append(r.ticker)
    assert got == {0: ["MSFT"], 1: ["BRK.B"], 2: ["AAPL"], 3: ["AAPL", "COST"], 5: ["UAL"], 6: ["TSLA", "AAPL"]}
