"""Filing-evidence tables derived by Spark from the given tables, with the same derivation as SQL text.

``facts``      lineitem summed by supplier ("S<key>"), fiscal year, quarter and return flag (= segment)
``questions``  one annual question per order
``scalars``    one single-number question per order
Years are moved by +20 because question wording only knows years 20xx.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.sources.tables import table

AMOUNT = "decimal(24,4)"


def fact_grains(spark: SparkSession, root: str) -> DataFrame:
    """One pass over lineitem, then grouping sets over the much smaller partial sums."""
    li = table(spark, root, "lineitem").select(
        "l_suppkey",
        (F.year("l_shipdate") + 20).alias("fy"),
        F.quarter("l_shipdate").alias("q"),
        F.col("l_returnflag").alias("seg"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("p"),
        F.col("l_discount").cast("decimal(4,2)").alias("d"),
        F.col("l_tax").cast("decimal(4,2)").alias("t"),
        F.col("l_quantity").cast("decimal(8,2)").alias("n"),
    )
    one = F.lit(1).cast("decimal(4,2)")
    base = li.groupBy("l_suppkey", "fy", "q", "seg").agg(
        F.sum("p").cast(AMOUNT).alias("rev"),
        F.sum(F.col("p") * (one - F.col("d"))).cast(AMOUNT).alias("cost"),
        F.sum(F.col("p") * (F.col("d") - F.col("t"))).cast(AMOUNT).alias("oi"),
        F.sum(F.col("p") * F.col("d")).cast(AMOUNT).alias("disc"),
        F.sum("n").cast(AMOUNT).alias("qty"),
    )
    seg_rev = lambda s: F.sum(F.when(F.col("seg") == s, F.col("rev"))).cast(AMOUNT)
    sets = [["l_suppkey", "fy"], ["l_suppkey", "fy", "q"], ["l_suppkey", "fy", "seg"]]
    # grouping columns are NULLed per set, so the share of a segment is summed over copies of the columns
    flat = base.withColumn("seg2", F.col("seg"))
    cols = [F.col(c) for c in ("l_suppkey", "fy", "q", "seg")]
    return flat.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.sum("rev").cast(AMOUNT).alias("rev"),
        F.sum("cost").cast(AMOUNT).alias("cost"),
        F.sum("oi").cast(AMOUNT).alias("oi"),
        F.sum("disc").cast(AMOUNT).alias("disc"),
        F.sum("qty").cast(AMOUNT).alias("qty"),
        *[F.sum(F.when(F.col("seg2") == s, F.col("rev"))).cast(AMOUNT).alias(f"rev_{s.lower()}") for s in "RAN"],
    )


def facts(spark: SparkSession, root: str) -> DataFrame:
    """The canonical fact table: value and scale as text, roles array, dimensions map, period struct."""
    g = fact_grains(spark, root)
    fy_grain = F.col("q").isNull() & F.col("seg").isNull()
    share = F.lit("0.42").cast("decimal(4,2)")
    heavy = lambda s: fy_grain & F.coalesce(F.col(f"rev_{s}") > F.col("rev") * share, F.lit(False))
    g = g.select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        "fy", "q", "seg", "rev", "cost", "oi",
        (F.col("oi") - F.col("qty") * 10).cast(AMOUNT).alias("ni"),
        (F.col("disc") - F.col("qty") * 20).cast(AMOUNT).alias("cfo"),
        fy_grain.alias("is_fy"),
        heavy("r").alias("restated"), heavy("a").alias("foreign"), heavy("n").alias("short"),
    )
    txt = lambda c: F.col(c).cast("string")
    row = lambda n, keep, concept, role, value, scale="1": F.struct(
        F.lit(n).cast("long").alias("ordinal"), keep.alias("keep"), F.lit(concept).alias("concept"),
        F.lit(role).alias("role"), value.alias("value"), F.lit(scale).alias("scale"),
    )
    yes = F.lit(True)
    rows = F.array(
        row(1, F.col("fy") < 2019, "us-gaap:SalesRevenueNet", "revenue", txt("rev")),
        row(2, yes, "us-gaap:Revenues", "revenue", txt("rev")),
        row(3, F.col("restated"), "us-gaap:Revenues", "revenue", (F.col("rev") + 1).cast(AMOUNT).cast("string")),
        row(4, yes, "us-gaap:CostOfRevenue", "cost_of_revenue", txt("cost")),
        row(5, yes, "us-gaap:OperatingIncomeLoss", "operating_income",
            (F.col("oi") * 100).cast(AMOUNT).cast("string"), "0.01"),
        row(6, yes, "ext:AdjustedOperatingIncome", "operating_income", txt("oi")),
        row(7, yes, "us-gaap:NetIncomeLoss", "net_income", txt("ni")),
        row(8, yes, "us-gaap:NetCashProvidedByUsedInOperatingActivities", "operating_cash_flow",
            F.when(~F.col("is_fy") & (F.col("cfo") < 0), F.lit("NaN")).otherwise(txt("cfo"))),
    )
    x = g.select("*", F.explode(rows).alias("f")).where("f.keep")  # no lambda: rows are made in generated code
    month = F.when(F.col("short"), F.lit(4)).otherwise(F.coalesce(F.col("q") * 3 - 2, F.lit(1)))
    start = F.make_date("fy", month, F.lit(1))
    end = F.last_day(F.make_date("fy", F.coalesce(F.col("q") * 3, F.lit(12)), F.lit(1)))
    fp = F.coalesce(F.concat(F.lit("Q"), F.col("q")), F.lit("FY"))
    return x.select(
        F.concat_ws(":", "ticker", F.col("fy").cast("string"), fp, F.coalesce("seg", F.lit("all")),
                    F.col("f.ordinal").cast("string")).alias("id"),
        "ticker",
        F.col("f.concept").alias("concept"),
        F.array(F.col("f.role")).alias("roles"),
        F.col("f.value").alias("value"),
        F.col("f.scale").alias("scale"),
        F.lit("USD").alias("unit"),
        F.when(F.col("foreign"), "EUR").otherwise("USD").alias("currency"),
        F.when(F.col("seg").isNotNull(), F.create_map(F.lit("segment"), F.col("seg")))
        .otherwise(F.expr("map()").cast("map<string,string>")).alias("dimensions"),
        F.struct(start.alias("start"), end.alias("end"), F.lit("duration").alias("kind"),
                 F.col("fy").cast("int").alias("fiscal_year"), fp.alias("fiscal_period")).alias("period"),
        F.concat(F.lit("filings/"), F.col("ticker"), F.lit("/FY"), F.col("fy"), F.lit(".yml")).alias("path"),
        F.sha2(F.col("f.value"), 256).alias("content_hash"),
        F.col("f.ordinal").alias("ordinal"),
    )


FACTS_SQL = """
base AS (
  SELECT l_suppkey, year(l_shipdate) + 20 AS fy, quarter(l_shipdate) AS q, l_returnflag AS seg,
         CAST(sum(p) AS DECIMAL(24,4)) AS rev, CAST(sum(p * (CAST(1 AS DECIMAL(4,2)) - d)) AS DECIMAL(24,4)) AS cost,
         CAST(sum(p * (d - t)) AS DECIMAL(24,4)) AS oi, CAST(sum(p * d) AS DECIMAL(24,4)) AS disc,
         CAST(sum(n) AS DECIMAL(24,4)) AS qty
  FROM (SELECT l_suppkey, l_shipdate, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS p,
               CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS t,
               CAST(l_quantity AS DECIMAL(8,2)) AS n FROM lineitem)
  GROUP BY ALL),
grains AS (
  SELECT 'S' || l_suppkey AS ticker, fy, q, seg, CAST(sum(rev) AS DECIMAL(24,4)) AS rev,
         CAST(sum(cost) AS DECIMAL(24,4)) AS cost, CAST(sum(oi) AS DECIMAL(24,4)) AS oi,
         CAST(sum(oi) - sum(qty) * 10 AS DECIMAL(24,4)) AS ni, CAST(sum(disc) - sum(qty) * 20 AS DECIMAL(24,4)) AS cfo,
         (q IS NULL AND seg IS NULL) AS is_fy,
         (q IS NULL AND seg IS NULL) AND coalesce(sum(rev) FILTER (s2 = 'R') > sum(rev) * CAST(0.42 AS DECIMAL(4,2)), FALSE) AS restated,
         (q IS NULL AND seg IS NULL) AND coalesce(sum(rev) FILTER (s2 = 'A') > sum(rev) * CAST(0.42 AS DECIMAL(4,2)), FALSE) AS foreign_ccy,
         (q IS NULL AND seg IS NULL) AND coalesce(sum(rev) FILTER (s2 = 'N') > sum(rev) * CAST(0.42 AS DECIMAL(4,2)), FALSE) AS short
  FROM (SELECT *, seg AS s2 FROM base)
  GROUP BY GROUPING SETS ((l_suppkey, fy), (l_suppkey, fy, q), (l_suppkey, fy, seg))),
facts AS (
  SELECT concat_ws(':', ticker, fy, fiscal_period, coalesce(seg, 'all'), ordinal) AS id, ticker, concept, role, value, scale,
         'USD' AS unit, CASE WHEN foreign_ccy THEN 'EUR' ELSE 'USD' END AS currency, seg AS segment,
         make_date(fy::INT, (CASE WHEN short THEN 4 ELSE coalesce(q * 3 - 2, 1) END)::INT, 1) AS p_start,
         last_day(make_date(fy::INT, coalesce(q * 3, 12)::INT, 1)) AS p_end, 'duration' AS kind,
         fy::INT AS fiscal_year, fiscal_period, 'filings/' || ticker || '/FY' || fy || '.yml' AS path,
         sha256(value) AS content_hash, ordinal,
         TRY_CAST(CASE WHEN lower(value) = 'nan' THEN NULL ELSE value END AS DECIMAL(24,4)) * TRY_CAST(scale AS DECIMAL(8,2)) AS amount
  FROM (
    SELECT *, coalesce('Q' || q, 'FY') AS fiscal_period, unnest([
        {'ordinal': 1, 'keep': fy < 2019, 'concept': 'us-gaap:SalesRevenueNet', 'role': 'revenue', 'value': rev::VARCHAR, 'scale': '1'},
        {'ordinal': 2, 'keep': true, 'concept': 'us-gaap:Revenues', 'role': 'revenue', 'value': rev::VARCHAR, 'scale': '1'},
        {'ordinal': 3, 'keep': restated, 'concept': 'us-gaap:Revenues', 'role': 'revenue', 'value': (rev + 1)::DECIMAL(24,4)::VARCHAR, 'scale': '1'},
        {'ordinal': 4, 'keep': true, 'concept': 'us-gaap:CostOfRevenue', 'role': 'cost_of_revenue', 'value': cost::VARCHAR, 'scale': '1'},
        {'ordinal': 5, 'keep': true, 'concept': 'us-gaap:OperatingIncomeLoss', 'role': 'operating_income', 'value': (oi * 100)::DECIMAL(24,4)::VARCHAR, 'scale': '0.01'},
        {'ordinal': 6, 'keep': true, 'concept': 'ext:AdjustedOperatingIncome', 'role': 'operating_income', 'value': oi::VARCHAR, 'scale': '1'},
        {'ordinal': 7, 'keep': true, 'concept': 'us-gaap:NetIncomeLoss', 'role': 'net_income', 'value': ni::VARCHAR, 'scale': '1'},
        {'ordinal': 8, 'keep': true, 'concept': 'us-gaap:NetCashProvidedByUsedInOperatingActivities', 'role': 'operating_cash_flow',
         'value': CASE WHEN NOT is_fy AND cfo < 0 THEN 'NaN' ELSE cfo::VARCHAR END, 'scale': '1'}], recursive := true)
    FROM grains)
  WHERE keep),
priorities(role, concept, priority) AS (VALUES
  ('revenue', 'us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax', 0), ('revenue', 'us-gaap:Revenues', 1),
  ('revenue', 'us-gaap:SalesRevenueNet', 2), ('operating_income', 'us-gaap:OperatingIncomeLoss', 0),
  ('net_income', 'us-gaap:NetIncomeLoss', 0), ('net_income', 'us-gaap:ProfitLoss', 1),
  ('operating_cash_flow', 'us-gaap:NetCashProvidedByUsedInOperatingActivities', 0),
  ('cost_of_revenue', 'us-gaap:CostOfRevenue', 0), ('cost_of_revenue', 'us-gaap:CostOfGoodsAndServicesSold', 1),
  ('cost_of_revenue', 'us-gaap:CostOfGoodsSold', 2)),
annual AS (
  SELECT f.*, p.priority FROM facts f JOIN priorities p USING (role, concept)
  WHERE segment IS NULL AND fiscal_period = 'FY' AND kind = 'duration' AND p_end - p_start + 1 BETWEEN 350 AND 380)
"""


def questions(spark: SparkSession, root: str) -> DataFrame:
    """question_id, ticker, question: one annual question per order."""
    y = F.year("o_orderdate") + 20
    o = table(spark, root, "orders")
    subject = F.concat(F.lit(" S"), F.col("o_custkey"), F.lit("'s consolidated "))
    verb = F.when(F.col("o_orderstatus") == "F", "How did").when(F.col("o_orderstatus") == "O", "Compare").otherwise("What was")
    phrase = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "operating leverage")
        .when(F.col("o_orderpriority") == "2-HIGH", "gross margin")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "cash conversion")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "net margin")
        .otherwise("operating margin")
    )
    years = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" change across FY"), y - 1, F.lit(" and FY"), y))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit(" from FY"), y - 2, F.lit(" to FY"), y))
        .otherwise(F.concat(F.lit(" for FY"), y))
    )
    tail = F.when(F.col("o_totalprice") > 450000, " by segment?").when(F.col("o_totalprice") > 440000, " and total assets?").otherwise("?")
    return o.select(
        F.col("o_orderkey").alias("question_id"),
        F.concat(F.lit("S"), F.col("o_custkey")).alias("ticker"),
        F.concat(verb, subject, phrase, years, tail).alias("question"),
    )


QUESTIONS_SQL = """
questions AS (
  SELECT o_orderkey AS question_id, 'S' || o_custkey AS ticker,
    CASE o_orderstatus WHEN 'F' THEN 'How did' WHEN 'O' THEN 'Compare' ELSE 'What was' END
    || ' S' || o_custkey || '''s consolidated '
    || CASE o_orderpriority WHEN '1-URGENT' THEN 'operating leverage' WHEN '2-HIGH' THEN 'gross margin'
         WHEN '3-MEDIUM' THEN 'cash conversion' WHEN '4-NOT SPECIFIED' THEN 'net margin' ELSE 'operating margin' END
    || CASE o_orderstatus WHEN 'F' THEN ' change across FY' || (year(o_orderdate) + 19) || ' and FY' || (year(o_orderdate) + 20)
         WHEN 'O' THEN ' from FY' || (year(o_orderdate) + 18) || ' to FY' || (year(o_orderdate) + 20)
         ELSE ' for FY' || (year(o_orderdate) + 20) END
    || CASE WHEN o_totalprice > 450000 THEN ' by segment?' WHEN o_totalprice > 440000 THEN ' and total assets?' ELSE '?' END AS question
  FROM orders)
"""


def scalar_questions(spark: SparkSession, root: str) -> DataFrame:
    """question_id, ticker, question: one single-number question per order."""
    y = F.year("o_orderdate") + 20
    phrase = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "revenue")
        .when(F.col("o_orderpriority") == "2-HIGH", "net income")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "gross margin")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "operating cash flow growth")
        .otherwise("net margin")
    )
    s = F.concat(F.lit("S"), F.col("o_custkey"))
    text = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("What was "), s, F.lit("'s "), phrase, F.lit(" in "), y, F.lit("?")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("What was "), s, F.lit("'s "), phrase, F.lit(" in Q"),
                                                      F.quarter("o_orderdate"), F.lit(" "), y, F.lit("?")))
        .otherwise(F.when(F.col("o_totalprice") > 450000, F.concat(F.lit("Why did "), s, F.lit(" report weak "), phrase, F.lit("?")))
                   .otherwise(F.concat(F.lit("How much "), phrase, F.lit(" did "), s, F.lit(" report?"))))
    )
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("question_id"), s.alias("ticker"), text.alias("question")
    )


SCALARS_SQL = """
scalars AS (
  SELECT o_orderkey AS question_id, 'S' || o_custkey AS ticker,
    CASE o_orderstatus WHEN 'F' THEN 'What was S' || o_custkey || '''s ' || phrase || ' in ' || y || '?'
      WHEN 'O' THEN 'What was S' || o_custkey || '''s ' || phrase || ' in Q' || quarter(o_orderdate) || ' ' || y || '?'
      ELSE CASE WHEN o_totalprice > 450000 THEN 'Why did S' || o_custkey || ' report weak ' || phrase || '?'
           ELSE 'How much ' || phrase || ' did S' || o_custkey || ' report?' END END AS question
  FROM (SELECT *, year(o_orderdate) + 20 AS y, CASE o_orderpriority WHEN '1-URGENT' THEN 'revenue' WHEN '2-HIGH' THEN 'net income'
         WHEN '3-MEDIUM' THEN 'gross margin' WHEN '4-NOT SPECIFIED' THEN 'operating cash flow growth' ELSE 'net margin' END AS phrase
        FROM orders))
"""
