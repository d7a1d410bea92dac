"""Queries on question wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import facts as op
from factweave.operators import questions as qop
from factweave.plans import facts as pf
from factweave.plans import standins as st
from factweave.plans.base import Area
from factweave.sources.tables import table

area = Area()
QUERIES, ORACLES, query = area.queries, area.oracles, area.query


TEXTS_SQL = f"""WITH {st.QUESTIONS_SQL}, {st.SCALARS_SQL},
texts AS (SELECT 'q' || question_id AS text_id, question AS t FROM questions UNION ALL SELECT 's' || question_id, question FROM scalars
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)
"""


def texts(spark, d):
    """Question log: both question kinds and all conversation turns."""
    c = table(spark, d, "conversations")
    return (
        st.questions(spark, d).select(F.concat(F.lit("q"), "question_id").alias("text_id"), F.col("question").alias("t"))
        .unionByName(st.scalar_questions(spark, d).select(F.concat(F.lit("s"), "question_id").alias("text_id"), F.col("question").alias("t")))
        .unionByName(c.select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("text_id"), F.col("text").alias("t")))
    )


@query("question_skill", TEXTS_SQL + """
SELECT text_id, CASE WHEN contains(q, 'margin') THEN 'margin-lookup'
  WHEN contains(q, 'compare') OR contains(q, 'versus') OR contains(q, 'vs') OR contains(q, 'change') OR contains(q, 'yoy') OR contains(q, 'year over year') OR contains(q, 'prior period') THEN 'period-comparison'
  WHEN contains(q, 'ratio') OR contains(q, 'percent') OR contains(q, 'per share') OR contains(q, 'eps') THEN 'ratio-reconstruction'
  WHEN contains(q, 'source') OR contains(q, 'sec') OR contains(q, 'pdf') OR contains(q, 'filing') OR contains(q, 'document') THEN 'source-lookup'
  ELSE 'markdown-traversal' END AS skill,
  CASE WHEN contains(q, 'margin') THEN 4
  WHEN contains(q, 'compare') OR contains(q, 'versus') OR contains(q, 'vs') OR contains(q, 'change') OR contains(q, 'yoy') OR contains(q, 'year over year') OR contains(q, 'prior period') THEN 4
  WHEN contains(q, 'ratio') OR contains(q, 'percent') OR contains(q, 'per share') OR contains(q, 'eps') THEN 4
  WHEN contains(q, 'source') OR contains(q, 'sec') OR contains(q, 'pdf') OR contains(q, 'filing') OR contains(q, 'document') THEN 2 ELSE 3 END AS chain_length
FROM (SELECT *, lower(t) AS q FROM texts)""")
def question_skill(spark, d):
    s = qop.question_skill(F.col("t"))
    return texts(spark, d).select("text_id", s["skill"].alias("skill"), F.size(F.split(s["chain"], " > ")).alias("chain_length"))


@query("question_flags", TEXTS_SQL + """
SELECT text_id,
  CAST(regexp_matches(q, 'compare|comparison|versus| vs |relative to|against|than') AS INT) AS is_comparison,
  CAST(regexp_matches(q, 'stock growth|stock performance|share price|price growth|return|last year') AND regexp_matches(q, 'stock|share|price|return|growth|performance') AS INT) AS is_price_growth,
  CAST(regexp_matches(q, 'good stock|invest|buy|hold|sell|valuation|bull|bear') AS INT) AS is_investment,
  CAST(regexp_matches(q, 'price|worth|market.cap|valuation|buy|return') AS INT) AS is_market
FROM (SELECT *, lower(t) AS q FROM texts)""")
def question_flags(spark, d):
    return texts(spark, d).select("text_id", *[c.cast("int").alias(n) for n, c in qop.question_flags(F.col("t")).items()])


@query("annual_intent", pf.REQ_SQL + "SELECT question_id, intent FROM intents")
def annual_intent(spark, d):
    return st.questions(spark, d).select("question_id", qop.annual_intent(F.col("question")).alias("intent"))


@query("question_years", pf.REQ_SQL + """
SELECT question_id, array_to_string(CASE WHEN len(years) BETWEEN 1 AND 5 THEN years END, ',') AS years FROM (
  SELECT *, CASE WHEN len(ys) = 2 AND regexp_matches(q, '(?:fy)?20\\d{2}\\s*(?:-|–|through|to)\\s*(?:fy)?20\\d{2}') THEN generate_series(ys[1], ys[2]) ELSE ys END AS years FROM intents)""")
def question_years(spark, d):
    return st.questions(spark, d).select("question_id", F.array_join(qop.annual_years(F.col("question")).cast("array<string>"), ",").alias("years"))


@query("question_role", pf.PROGRAM_SQL + "SELECT question_id, role, margin_role, year, fiscal_period, operation FROM programs")
def question_role(spark, d):
    return pf._programs(spark, d).select("question_id", "role", "margin_role", "year", "fiscal_period", "operation")


MENTION_SQL = """
WITH q AS (
  SELECT o_orderkey AS question_id, 'S' || o_custkey AS selected, CASE o_orderpriority
    WHEN '1-URGENT' THEN 'Compare S' || o_custkey || ' with supplier ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || ' in FY2019'
    WHEN '2-HIGH' THEN 'How does Supplier#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '''s margin compare to Microsoft and s1?'
    WHEN '3-MEDIUM' THEN 'Net income of (S2), S7; s11: BRK-B and Apple' WHEN '4-NOT SPECIFIED' THEN 'Which supplier grew?'
    ELSE 'S3 S4 S5 S6 S7 growth' END AS question FROM orders),
al AS (SELECT DISTINCT * FROM (
    SELECT lower('S' || s_suppkey) AS alias, 'S' || s_suppkey AS ticker FROM supplier
    UNION ALL SELECT 'supplier ' || regexp_extract(s_name, '#(\\d+)', 1), 'S' || s_suppkey FROM supplier
    UNION ALL SELECT * FROM (VALUES ('alphabet','GOOGL'),('google','GOOGL'),('amazon','AMZN'),('apple','AAPL'),('berkshire','BRK.B'),('facebook','META'),
      ('meta','META'),('microsoft','MSFT'),('nvidia','NVDA'),('tesla','TSLA'),('googl','GOOGL'),('amzn','AMZN'),('aapl','AAPL'),('brk.b','BRK.B'),('msft','MSFT'),('nvda','NVDA'),('tsla','TSLA')))),
n AS (SELECT *, ' ' || regexp_replace(lower(regexp_replace(question, '\\b([A-Za-z]+)-([A-Za-z])\\b', '\\1.\\2', 'g')), '[^a-z0-9&. ]+', ' ', 'g') || ' ' AS t FROM q),
h AS (SELECT question_id, ticker, min(strpos(t, ' ' || alias || ' ')) - 1 AS position FROM n, al WHERE contains(t, ' ' || alias || ' ') GROUP BY ALL),
a AS (SELECT * FROM h UNION ALL SELECT question_id, selected, -1 FROM q WHERE question_id NOT IN (SELECT question_id FROM h))
SELECT question_id, ticker, CAST(position AS INT) AS position, CAST(row_number() OVER (PARTITION BY question_id ORDER BY position, ticker) AS INT) AS rank FROM a
QUALIFY rank <= 4
"""


def mention_questions(spark, d):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    s = F.concat(F.lit("S"), F.col("o_custkey"))
    p = F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", F.concat(F.lit("Compare "), s, F.lit(" with supplier "), pad("o_orderkey"), F.lit(" in FY2019")))
        .when(p == "2-HIGH", F.concat(F.lit("How does Supplier#"), pad("o_custkey"), F.lit("'s margin compare to Microsoft and s1?")))
        .when(p == "3-MEDIUM", "Net income of (S2), S7; s11: BRK-B and Apple").when(p == "4-NOT SPECIFIED", "Which supplier grew?")
        .otherwise("S3 S4 S5 S6 S7 growth")
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("question_id"), s.alias("selected"), text.alias("question"))


@query("company_mentions", MENTION_SQL)
def company_mentions(spark, d):
    companies = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("ticker"), F.col("s_name").alias("title"))
    return qop.company_mentions(mention_questions(spark, d), companies).select("question_id", "ticker", F.col("position").cast("int").alias("position"), "rank")


@query("multi_company", (pf.REQ_SQL + pf.ROWS_SQL).replace("questions AS (\n  SELECT o_orderkey AS question_id, 'S' || o_custkey AS ticker,", "questions AS (\n  SELECT o_orderkey AS question_id, 'S' || o_custkey AS ticker0, unnest(['S' || o_custkey, 'S' || (o_custkey // 2)]) AS ticker,")
 .replace("SELECT question_id, ticker, question, intent, years FROM (", "SELECT question_id, ticker, ticker0, question, intent, years FROM (") + """,
pos AS (SELECT o_orderkey AS question_id, unnest(['S' || o_custkey, 'S' || (o_custkey // 2)]) AS ticker, unnest([1, 2]) AS position FROM orders WHERE o_custkey > 0),
per AS (SELECT question_id, ticker, min(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) AS hit, arg_min(reason, fiscal_year) FILTER (reason IS NOT NULL) AS reason, count(*) AS n_years FROM ratios GROUP BY ALL),
x AS (SELECT pos.question_id, pos.ticker, position, coalesce(hit, 0) AS hit, reason, n_years FROM pos LEFT JOIN per USING (question_id, ticker))
SELECT question_id, count(*) AS n_companies, min(hit) AS hit, arg_min(ticker || ': ' || coalesce(reason, 'unsupported question'), position) FILTER (hit = 0) AS reason,
  CAST(sum(CASE WHEN hit = 1 THEN n_years * 2 ELSE 0 END) AS BIGINT) AS n_bindings FROM x GROUP BY ALL""")
def multi_company(spark, d):
    o = table(spark, d, "orders").where("o_custkey > 0")
    tickers = F.array(F.concat(F.lit("S"), F.col("o_custkey")), F.concat(F.lit("S"), F.floor(F.col("o_custkey") / 2)))
    pos = o.select(F.col("o_orderkey").alias("question_id"), F.posexplode(tickers).alias("position", "ticker")).withColumn("position", F.col("position") + 1)
    q = st.questions(spark, d).drop("ticker").join(pos, "question_id")
    report = op.annual_rows(qop.annual_requests(q), st.facts(spark, d))
    return op.multi_company(report, pos).select("question_id", "n_companies", F.col("hit").cast("int").alias("hit"), "reason", "n_bindings")
