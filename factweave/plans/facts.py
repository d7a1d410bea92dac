"""Queries on facts: values, filters, bindings, programs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.operators import facts as op
from factweave.operators import questions as qop
from factweave.plans import standins as st
from factweave.plans.base import Area
from factweave.sources.tables import table

area = Area()
QUERIES, ORACLES, query = area.queries, area.oracles, area.query


def dbl(c, n=6):
    return F.round(F.col(c).cast("double") if isinstance(c, str) else c, n)


F_SQL = "WITH " + st.FACTS_SQL


@query("fact_values", F_SQL + """
SELECT id, CAST(amount AS DOUBLE) AS amount, CASE WHEN lower(value) = 'nan' THEN 'nonfinite' WHEN amount IS NULL THEN 'invalid_value'
  ELSE 'ok' END AS value_status FROM facts""")
def fact_values(spark, d):
    return op.with_amount(st.facts(spark, d)).select("id", F.col("amount").cast("double").alias("amount"), "value_status")


@query("consolidated_facts", F_SQL + """
SELECT role, fiscal_period, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM facts WHERE segment IS NULL GROUP BY ALL""")
def consolidated_facts(spark, d):
    x = op.consolidated(op.with_amount(st.facts(spark, d)))
    return x.groupBy(F.col("roles")[0].alias("role"), F.col("period.fiscal_period").alias("fiscal_period")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))


@query("annual_facts", F_SQL + """
SELECT id, ticker, concept, fiscal_year, strftime(p_start, '%Y-%m-%d') AS p_start, strftime(p_end, '%Y-%m-%d') AS p_end,
  CAST(p_end - p_start + 1 AS INT) AS days FROM facts
WHERE segment IS NULL AND fiscal_period = 'FY' AND kind = 'duration' AND p_end - p_start + 1 BETWEEN 350 AND 380""")
def annual_facts(spark, d):
    return op.annual(st.facts(spark, d)).select(
        "id", "ticker", "concept", "period.fiscal_year", F.col("period.start").cast("string").alias("p_start"),
        F.col("period.end").cast("string").alias("p_end"), (F.datediff("period.end", "period.start") + 1).alias("days"))


@query("role_concepts", F_SQL + "SELECT id, role, concept, priority FROM annual")
def role_concepts(spark, d):
    return op.with_role_priority(op.annual(st.facts(spark, d))).select("id", "role", "concept", "priority")


@query("usd_gate", F_SQL + """
SELECT id, CASE WHEN unit = 'USD' AND currency = 'USD' THEN 'ok' ELSE 'not in USD' END AS gate FROM annual""")
def usd_gate(spark, d):
    x = op.with_role_priority(op.annual(st.facts(spark, d)))
    ok = F.coalesce((F.col("unit") == "USD") & (F.col("currency") == "USD"), F.lit(False))
    return x.select("id", F.when(ok, "ok").otherwise("not in USD").alias("gate"))


CHOICE_SQL = """,
conf AS (
  SELECT ticker, fiscal_year, role, concept, priority, count(*) AS n_facts,
         count(DISTINCT (p_start, p_end, kind, fiscal_period, unit, currency, amount)) > 1 AS conflict,
         arg_min({'amount': amount, 'unit': unit, 'currency': currency, 'path': path, 'id': id, 'value': value, 'scale': scale,
                  'pk': concat_ws('|', strftime(p_start, '%Y-%m-%d'), strftime(p_end, '%Y-%m-%d'), kind, fiscal_year, fiscal_period)}, ordinal) AS f
  FROM annual GROUP BY ALL),
choice AS (SELECT * FROM conf QUALIFY row_number() OVER (PARTITION BY ticker, fiscal_year, role ORDER BY priority) = 1)
"""


@query("fact_conflicts", F_SQL + CHOICE_SQL + "SELECT ticker, fiscal_year, role, concept, n_facts, CAST(conflict AS INT) AS conflict FROM conf")
def fact_conflicts(spark, d):
    x = op.conflicts(op.with_role_priority(op.with_amount(op.annual(st.facts(spark, d)))))
    return x.select("ticker", "fiscal_year", "role", "concept", "n_facts", F.col("conflict").cast("int").alias("conflict"))


@query("concept_choice", F_SQL + CHOICE_SQL + """
SELECT ticker, fiscal_year, role, concept, CAST(conflict AS INT) AS conflict, CAST(f.amount AS DOUBLE) AS amount FROM choice""")
def concept_choice(spark, d):
    x = op.concept_choice(op.with_role_priority(op.with_amount(op.annual(st.facts(spark, d)))))
    return x.select("ticker", "fiscal_year", "role", "concept", F.col("conflict").cast("int").alias("conflict"),
                    F.col("fact.amount").cast("double").alias("amount"))


INTENT_SQL = """,
intents AS (
  SELECT *, CASE WHEN regexp_matches(q, '\\b(compare|calculate|compute|show|what|how)\\b')
      AND NOT regexp_matches(q, 'segment|services|products|quarter|\\bq[1-4]\\b|dividend|debt|forecast|why|drivers|valuation|may|march')
      AND NOT (regexp_matches(q, '\\bassets\\b'))
    THEN CASE WHEN contains(q, 'cash conversion') THEN 'cash_conversion' WHEN contains(q, 'operating leverage') THEN 'operating_leverage'
      WHEN contains(q, 'gross margin') THEN 'gross_margin' WHEN contains(q, 'operating margin') THEN 'operating_margin'
      WHEN contains(q, 'net margin') THEN 'net_margin' END END AS intent,
    list_sort(list_distinct(list_transform(regexp_extract_all(q, '(?:\\b|fy)(20\\d{2})\\b', 1), lambda y: CAST(y AS INT)))) AS ys
  FROM (SELECT *, lower(question) AS q FROM questions)),
requests AS (
  SELECT question_id, ticker, question, intent, years FROM (
    SELECT *, CASE WHEN len(ys) = 2 AND regexp_matches(q, '(?:fy)?20\\d{2}\\s*(?:-|–|through|to)\\s*(?:fy)?20\\d{2}')
               THEN generate_series(ys[1], ys[2]) ELSE ys END AS years FROM intents)
  WHERE intent IS NOT NULL AND len(years) BETWEEN 1 AND 5 AND (intent <> 'operating_leverage' OR len(years) >= 2))
"""
REQ_SQL = F_SQL + CHOICE_SQL + ", " + st.QUESTIONS_SQL + INTENT_SQL
ROWS_SQL = """,
ir(intent, ra, rb) AS (VALUES ('cash_conversion', 'operating_cash_flow', 'net_income'), ('operating_leverage', 'revenue', 'operating_income'),
  ('gross_margin', 'revenue', 'cost_of_revenue'), ('operating_margin', 'revenue', 'operating_income'), ('net_margin', 'revenue', 'net_income')),
arows AS (
  SELECT r.question_id, r.ticker, r.intent, r.fiscal_year, ra, rb, a.f AS fa, b.f AS fb, a.concept AS ca, b.concept AS cb,
    CASE WHEN a.concept IS NULL THEN 'missing binding: ' || ra WHEN a.conflict THEN 'conflicting facts: ' || ra
      WHEN b.concept IS NULL THEN 'missing binding: ' || rb WHEN b.conflict THEN 'conflicting facts: ' || rb
      WHEN a.f.pk <> b.f.pk THEN 'different reporting periods'
      WHEN a.f.currency <> 'USD' OR b.f.currency <> 'USD' THEN 'not in USD'
      WHEN a.f.amount IS NULL OR b.f.amount IS NULL THEN 'invalid value or scale' END AS reason
  FROM (SELECT question_id, ticker, intent, CAST(unnest(years) AS INT) AS fiscal_year FROM requests) r JOIN ir USING (intent)
  LEFT JOIN choice a ON a.ticker = r.ticker AND a.fiscal_year = r.fiscal_year AND a.role = ra
  LEFT JOIN choice b ON b.ticker = r.ticker AND b.fiscal_year = r.fiscal_year AND b.role = rb),
ratios AS (
  SELECT *, CAST(fa.amount AS DOUBLE) AS av, CAST(fb.amount AS DOUBLE) AS bv,
    CASE WHEN intent = 'cash_conversion' THEN CASE WHEN fb.amount > 0 THEN CAST(fa.amount AS DOUBLE) / CAST(fb.amount AS DOUBLE) END
      WHEN fa.amount > 0 THEN CASE WHEN intent = 'gross_margin' THEN CAST(fa.amount - fb.amount AS DOUBLE) ELSE CAST(fb.amount AS DOUBLE) END
        / CAST(fa.amount AS DOUBLE) * 100 END AS ratio,
    CASE WHEN fa.amount IS NULL OR fb.amount IS NULL THEN 'rejected'
      WHEN intent = 'cash_conversion' AND fb.amount <= 0 THEN 'not meaningful: net income <= 0'
      WHEN intent <> 'cash_conversion' AND fa.amount <= 0 THEN 'undefined: revenue <= 0' ELSE 'ok' END AS ratio_status
  FROM arows),
report AS (
  SELECT *, lag(fiscal_year) OVER w AS prior_year, (ratio - lag(ratio) OVER w) * CASE WHEN intent = 'cash_conversion' THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS delta,
    CAST(fa.amount - lag(fa.amount) OVER w AS DOUBLE) AS d_a, CAST(fb.amount - lag(fb.amount) OVER w AS DOUBLE) AS d_b,
    min(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY question_id, ticker) AS question_hit,
    first_value(reason IGNORE NULLS) OVER (PARTITION BY question_id, ticker ORDER BY fiscal_year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS question_reason
  FROM ratios WINDOW w AS (PARTITION BY question_id, ticker ORDER BY fiscal_year))
"""


def _report(spark, d):
    return op.annual_report(qop.annual_requests(st.questions(spark, d)), st.facts(spark, d))


@query("annual_bind", REQ_SQL + ROWS_SQL + """
SELECT question_id, fiscal_year, ca AS a_concept, cb AS b_concept, CAST(fa.amount AS DOUBLE) AS a_amount, CAST(fb.amount AS DOUBLE) AS b_amount,
  CASE WHEN fa.pk = fb.pk THEN 1 ELSE 0 END AS same_period FROM arows""")
def annual_bind(spark, d):
    x = op.annual_rows(qop.annual_requests(st.questions(spark, d)), st.facts(spark, d))
    return x.select("question_id", "fiscal_year", "a_concept", "b_concept", F.col("a_amount").cast("double").alias("a_amount"),
                    F.col("b_amount").cast("double").alias("b_amount"),
                    F.coalesce((F.col("a_period_key") == F.col("b_period_key")).cast("int"), F.lit(0)).alias("same_period"))


@query("annual_rejects", REQ_SQL + ROWS_SQL + """
SELECT intent, coalesce(reason, 'hit') AS reason, count(*) AS n FROM arows GROUP BY ALL""")
def annual_rejects(spark, d):
    x = op.annual_rows(qop.annual_requests(st.questions(spark, d)), st.facts(spark, d))
    return x.groupBy("intent", F.coalesce("reason", F.lit("hit")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("annual_report", REQ_SQL + ROWS_SQL + """
SELECT question_id, ticker, intent, fiscal_year, CAST(fa.amount AS DOUBLE) AS a_amount, CAST(fb.amount AS DOUBLE) AS b_amount,
  round(ratio, 6) AS ratio, ratio_status, prior_year, round(delta, 4) AS delta,
  CASE WHEN intent = 'operating_leverage' AND d_a <> 0 THEN round(d_b / d_a * 100, 4) END AS incremental, question_hit, question_reason FROM report""")
def annual_report(spark, d):
    return _report(spark, d).select(
        "question_id", "ticker", "intent", "fiscal_year", F.col("a_amount").cast("double").alias("a_amount"),
        F.col("b_amount").cast("double").alias("b_amount"), dbl("ratio"), "ratio_status", "prior_year", dbl("delta", 4),
        dbl("incremental", 4), F.col("question_hit").cast("int").alias("question_hit"), "question_reason",
    ).toDF("question_id", "ticker", "intent", "fiscal_year", "a_amount", "b_amount", "ratio", "ratio_status", "prior_year", "delta",
           "incremental", "question_hit", "question_reason")


@query("margin_delta", REQ_SQL + ROWS_SQL + """
SELECT question_id, prior_year, fiscal_year, round(delta, 4) AS delta, CASE WHEN intent = 'cash_conversion' THEN 'x' ELSE 'bp' END AS delta_unit
FROM report WHERE question_hit = 1 AND delta IS NOT NULL""")
def margin_delta(spark, d):
    x = _report(spark, d).where("question_hit and delta is not null")
    return x.select("question_id", "prior_year", "fiscal_year", dbl("delta", 4).alias("delta"),
                    F.when(F.col("intent") == "cash_conversion", "x").otherwise("bp").alias("delta_unit"))


KEY_SQL = REQ_SQL + ROWS_SQL + """,
bindings AS (SELECT question_id, ticker, intent, fiscal_year, 0 AS side, fa AS f FROM report WHERE question_hit = 1
  UNION ALL SELECT question_id, ticker, intent, fiscal_year, 1, fb FROM report WHERE question_hit = 1)
"""


@query("calc_key", KEY_SQL + """
SELECT question_id, 'annual-v1:' || sha256(ticker || chr(10) || intent || chr(10) || string_agg(concat_ws(';', fiscal_year, side, f.id, f.value, f.scale, f.path), chr(10)
  ORDER BY fiscal_year, side)) AS calc_key, count(*) AS n_bindings FROM bindings GROUP BY question_id, ticker, intent""")
def calc_key(spark, d):
    return op.calculation_key(_report(spark, d)).select("question_id", "calc_key", "n_bindings")


@query("answer_sources", KEY_SQL + """
SELECT question_id, string_agg(path, ';' ORDER BY o) AS sources FROM (
  SELECT question_id, f.path AS path, min(fiscal_year * 2 + side) AS o FROM bindings GROUP BY ALL) GROUP BY question_id""")
def answer_sources(spark, d):
    return op.calculation_key(_report(spark, d)).select("question_id", "sources")


@query("operating_leverage", """
WITH y AS (
  SELECT n_name AS ticker, year(l_shipdate) AS fiscal_year, sum(p) AS revenue, sum(p * (d - t)) AS income
  FROM (SELECT l_suppkey, l_shipdate, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d,
               CAST(l_tax AS DECIMAL(4,2)) AS t FROM lineitem)
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL),
m AS (SELECT *, CASE WHEN revenue > 0 THEN CAST(income AS DOUBLE) / CAST(revenue AS DOUBLE) * 100 END AS margin,
        CAST(revenue - lag(revenue) OVER w AS DOUBLE) AS dr, CAST(income - lag(income) OVER w AS DOUBLE) AS di
      FROM y WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year))
SELECT ticker, CAST(fiscal_year AS INT) AS fiscal_year, CAST(revenue AS DOUBLE) AS revenue, CAST(income AS DOUBLE) AS operating_income, round(margin, 6) AS margin_pct,
  round((margin - lag(margin) OVER w) * 100, 4) AS change_bp, CASE WHEN dr <> 0 THEN round(di / dr * 100, 6) END AS incremental_margin_pct,
  CASE WHEN revenue <= 0 THEN 'undefined: revenue <= 0' ELSE 'ok' END AS margin_status
FROM m WINDOW w AS (PARTITION BY ticker ORDER BY fiscal_year)""")
def operating_leverage(spark, d):
    """Margin, its change and the incremental margin per company and year, straight from the given tables.

    Lines are summed by supplier and year before the join, so only the small sums meet supplier and nation.
    """
    p, disc, tax = (F.col(c).cast(t) for c, t in (("l_extendedprice", "decimal(18,2)"), ("l_discount", "decimal(4,2)"), ("l_tax", "decimal(4,2)")))
    sums = (
        table(spark, d, "lineitem")
        .select("l_suppkey", F.year("l_shipdate").alias("fiscal_year"), p.alias("p"), (p * (disc - tax)).alias("i"))
        .groupBy("l_suppkey", "fiscal_year").agg(F.sum("p").alias("r"), F.sum("i").alias("i"))
    )
    sup = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("ticker"))
    y = (
        sums.join(sup, F.col("l_suppkey") == F.col("s_suppkey")).join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("ticker", "fiscal_year")
        .agg(F.sum("r").cast("decimal(24,4)").alias("a_amount"), F.sum("i").cast("decimal(24,4)").alias("b_amount"))
        .withColumn("intent", F.lit("operating_leverage"))
    )
    w = W.partitionBy("ticker").orderBy("fiscal_year")
    x = op.margin_columns(y)
    dr = (F.col("a_amount") - F.lag("a_amount").over(w)).cast("double")
    di = (F.col("b_amount") - F.lag("b_amount").over(w)).cast("double")
    return x.select(
        "ticker", "fiscal_year", F.col("a_amount").cast("double").alias("revenue"), F.col("b_amount").cast("double").alias("operating_income"),
        F.round("ratio", 6).alias("margin_pct"), F.round((F.col("ratio") - F.lag("ratio").over(w)) * 100, 4).alias("change_bp"),
        F.round(F.when(dr != 0, di / F.nullif(dr, F.lit(0.0)) * 100), 6).alias("incremental_margin_pct"),
        F.col("ratio_status").alias("margin_status"))


@query("cash_bindings", F_SQL + """,
p AS (
  SELECT ticker, p_start, p_end, arg_min(struct_pack(a := amount, u := unit), ordinal) FILTER (role = 'operating_cash_flow') AS c,
    arg_min(struct_pack(a := amount, u := unit), ordinal) FILTER (role = 'net_income') AS i
  FROM facts WHERE segment IS NULL AND kind = 'duration' AND role IN ('operating_cash_flow', 'net_income') GROUP BY ticker, p_start, p_end
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY p_end DESC, p_start DESC) <= 6)
SELECT ticker, strftime(p_start, '%Y-%m-%d') AS p_start, strftime(p_end, '%Y-%m-%d') AS p_end, CAST(c.a AS DOUBLE) AS cfo, CAST(i.a AS DOUBLE) AS income,
  CASE WHEN i.a = 0 THEN 'undefined (zero net income)' ELSE 'ok' END AS ratio_status,
  CASE WHEN i.a <> 0 THEN round(CAST(c.a AS DOUBLE) / CAST(i.a AS DOUBLE), 6) END AS ratio
FROM p WHERE c.a IS NOT NULL AND i.a IS NOT NULL AND c.u = i.u""")
def cash_bindings(spark, d):
    x = op.cash_bindings(st.facts(spark, d))
    return x.select("ticker", F.col("start").cast("string").alias("p_start"), F.col("end").cast("string").alias("p_end"),
                    F.col("cfo").cast("double").alias("cfo"), F.col("income").cast("double").alias("income"), "ratio_status",
                    F.round("ratio", 6).alias("ratio"))


@query("role_pivot", F_SQL + """
SELECT ticker, strftime(p_start, '%Y-%m-%d') AS p_start, strftime(p_end, '%Y-%m-%d') AS p_end,
  CAST((arg_min(struct_pack(a := amount), ordinal) FILTER (role = 'revenue')).a AS DOUBLE) AS revenue,
  CAST((arg_min(struct_pack(a := amount), ordinal) FILTER (role = 'net_income')).a AS DOUBLE) AS net_income,
  CAST((arg_min(struct_pack(a := amount), ordinal) FILTER (role = 'operating_cash_flow')).a AS DOUBLE) AS operating_cash_flow
FROM facts WHERE segment IS NULL GROUP BY ALL""")
def role_pivot(spark, d):
    x = op.consolidated(op.with_amount(st.facts(spark, d))).withColumn("role", F.explode("roles"))
    x = x.groupBy("ticker", F.col("period.start").cast("string").alias("p_start"), F.col("period.end").cast("string").alias("p_end")).pivot(
        "role", ["revenue", "net_income", "operating_cash_flow"]).agg(F.min_by(F.struct("amount"), "ordinal"))
    return x.select("ticker", "p_start", "p_end", *[F.col(f"{r}.amount").cast("double").alias(r) for r in ("revenue", "net_income", "operating_cash_flow")])


@query("fact_ranked", F_SQL + """
SELECT id, CAST(row_number() OVER (PARTITION BY ticker, role ORDER BY strftime(p_end, '%Y-%m-%d') DESC, starts_with(concept, 'us-gaap:') DESC,
  length(concept), ordinal, id) AS INT) AS rank FROM facts WHERE segment IS NULL AND fiscal_period = 'FY'""")
def fact_ranked(spark, d):
    x = op.consolidated(st.facts(spark, d)).where("period.fiscal_period = 'FY'").withColumn("role", F.explode("roles"))
    return op.ranked(x, ["ticker", "role"]).select("id", F.col("rank").cast("int").alias("rank"))



PROGRAM_SQL = F_SQL + ", " + st.SCALARS_SQL + """,
programs AS (
  SELECT question_id, ticker, question, CASE WHEN contains(q, 'operating cash flow') THEN 'operating_cash_flow' WHEN contains(q, 'net income') THEN 'net_income'
      WHEN contains(q, 'revenue') THEN 'revenue' END AS role,
    CASE WHEN contains(q, 'margin') THEN CASE WHEN contains(q, 'gross') THEN 'gross_profit' WHEN contains(q, 'net') THEN 'net_income' ELSE 'operating_income' END END AS margin_role,
    TRY_CAST(nullif(regexp_extract(q, '\\b(20\\d{2})\\b', 1), '') AS INT) AS year,
    CASE WHEN regexp_matches(q, '\\bq[1-4]\\b') THEN 'Q' || regexp_extract(q, '\\bq([1-4])\\b', 1) ELSE 'FY' END AS fiscal_period,
    CASE WHEN NOT regexp_matches(q, '^(what (?:is|was|are|were)|how much|how many|calculate|compute|give me|show me)\\b') OR regexp_matches(q, '\\bwhy\\b') THEN 'refused: needs synthesis'
      WHEN contains(q, 'margin') THEN 'divide_percent' WHEN contains(q, 'growth') THEN 'period_growth_percent' ELSE 'direct_fact' END AS operation
  FROM (SELECT *, lower(question) AS q FROM scalars))
"""


def _programs(spark, d):
    q = st.scalar_questions(spark, d)
    return q.select("*", *[c.alias(n) for n, c in qop.scalar_program(F.col("question")).items()])


@query("fact_candidates", PROGRAM_SQL + """
SELECT question_id, count(*) AS n_candidates FROM programs p JOIN facts f ON f.ticker = p.ticker AND f.role = p.role AND f.segment IS NULL
  AND (p.year IS NULL OR p.year = f.fiscal_year) AND p.fiscal_period = f.fiscal_period
WHERE operation IN ('direct_fact', 'period_growth_percent') GROUP BY ALL""")
def fact_candidates(spark, d):
    x = _programs(spark, d).where(F.col("operation").isin("direct_fact", "period_growth_percent"))
    return op.scalar_candidates(x, st.facts(spark, d), "role").groupBy("question_id").agg(F.count(F.lit(1)).alias("n_candidates"))


CAND_ORDER = "strftime(p_end, '%Y-%m-%d') DESC, starts_with(concept, 'us-gaap:') DESC, length(concept), ordinal"


@query("direct_fact", PROGRAM_SQL + f"""
SELECT p.question_id, p.role, b.concept, CAST(b.amount AS DOUBLE) AS amount, strftime(b.p_end, '%Y-%m-%d') AS p_end,
  CASE WHEN b.concept IS NULL THEN 'no consolidated fact is bound' WHEN b.amount IS NULL THEN 'not exact' ELSE 'ok' END AS status
FROM programs p LEFT JOIN (
  SELECT question_id, f.* FROM programs p JOIN facts f ON f.ticker = p.ticker AND f.role = p.role AND f.segment IS NULL
    AND (p.year IS NULL OR p.year = f.fiscal_year) AND p.fiscal_period = f.fiscal_period
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY {CAND_ORDER}) = 1) b USING (question_id)
WHERE operation = 'direct_fact'""")
def direct_fact(spark, d):
    x = op.direct_fact(_programs(spark, d).where("operation = 'direct_fact'"), st.facts(spark, d))
    return x.select("question_id", "role", "fact.concept", F.col("fact.amount").cast("double").alias("amount"),
                    F.col("fact.period.end").cast("string").alias("p_end"), "status")


@query("simple_margin", PROGRAM_SQL + """,
n AS (SELECT question_id, f.* FROM programs p JOIN facts f ON f.ticker = p.ticker AND f.role = p.margin_role AND f.segment IS NULL
      AND (p.year IS NULL OR p.year = f.fiscal_year) AND p.fiscal_period = f.fiscal_period WHERE operation = 'divide_percent'),
r AS (SELECT question_id, f.* FROM programs p JOIN facts f ON f.ticker = p.ticker AND f.role = 'revenue' AND f.segment IS NULL
      AND (p.year IS NULL OR p.year = f.fiscal_year) AND p.fiscal_period = f.fiscal_period WHERE operation = 'divide_percent'),
pair AS (
  SELECT n.question_id, n.amount AS na, r.amount AS ra, n.concept AS nc, r.concept AS rc FROM n JOIN r ON n.question_id = r.question_id AND n.p_start = r.p_start AND n.p_end = r.p_end
    AND n.fiscal_year = r.fiscal_year AND n.unit = r.unit AND n.currency = r.currency
  QUALIFY row_number() OVER (PARTITION BY n.question_id ORDER BY n.p_end DESC, starts_with(n.concept, 'us-gaap:') DESC, length(n.concept), n.ordinal,
    r.p_end DESC, starts_with(r.concept, 'us-gaap:') DESC, length(r.concept), r.ordinal) = 1),
s AS (
  SELECT p.question_id, p.margin_role, nc, rc, na, ra, CASE WHEN p.question_id NOT IN (SELECT question_id FROM n) OR p.question_id NOT IN (SELECT question_id FROM r)
     THEN 'numerator or revenue binding unavailable' WHEN nc IS NULL THEN 'facts do not share an exact reporting period'
     WHEN na IS NULL OR ra IS NULL OR ra = 0 THEN 'not exact' ELSE 'ok' END AS status
  FROM programs p LEFT JOIN pair USING (question_id) WHERE operation = 'divide_percent')
SELECT question_id, margin_role, nc AS n_concept, rc AS r_concept, status, CASE WHEN status = 'ok' THEN round(CAST(na AS DOUBLE) / CAST(ra AS DOUBLE) * 100, 6) END AS margin FROM s""")
def simple_margin(spark, d):
    x = op.simple_margin(_programs(spark, d).where("operation = 'divide_percent'"), st.facts(spark, d))
    return x.select("question_id", "margin_role", "m.n_concept", "m.r_concept", "status", F.round("margin", 6).alias("margin"))


@query("margin_bind", F_SQL + """
SELECT n.id AS n_id, r.id AS r_id, round(CAST(n.amount AS DOUBLE) / CAST(r.amount AS DOUBLE) * 100, 6) AS margin
FROM facts n JOIN facts r ON n.ticker = r.ticker AND n.p_start = r.p_start AND n.p_end = r.p_end AND n.kind = r.kind AND n.fiscal_year = r.fiscal_year
  AND n.fiscal_period = r.fiscal_period AND n.unit = r.unit AND n.currency = r.currency
WHERE n.role = 'net_income' AND r.role = 'revenue' AND n.segment IS NULL AND r.segment IS NULL
QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY starts_with(r.concept, 'us-gaap:') DESC, length(r.concept), r.ordinal) = 1""")
def margin_bind(spark, d):
    """Net margin of every period: numerator and denominator meet on the whole period, unit and currency."""
    keys = ["ticker", "pk", "unit", "currency"]
    # both roles are read and dealt out once; a part without a value meets nothing
    f = op.consolidated(st.facts(spark, d)).withColumn("role", F.explode("roles")).where(F.col("role").isin("net_income", "revenue")).dropna(subset=["ticker", "unit", "currency"])
    f = op.with_amount(f).select(*keys[:1], op.period_key().alias("pk"), *keys[2:], "role", "id", "amount", "concept", "ordinal")
    key = F.struct((~F.col("concept").startswith("us-gaap:")).cast("int").alias("a"), F.length("concept").alias("b"), F.col("ordinal").alias("c"))
    best = F.min_by(F.struct(F.col("id").alias("r_id"), F.col("amount").alias("ra")), F.when(F.col("role") == "revenue", key)).over(W.partitionBy(*keys))
    x = f.withColumn("r", best).where("role = 'net_income' AND r IS NOT NULL").select(F.col("id").alias("n_id"), F.col("amount").alias("na"), "r")
    return x.select("n_id", "r.r_id", F.round(F.col("na").cast("double") / F.nullif(F.col("r.ra").cast("double"), F.lit(0.0)) * 100, 6).alias("margin"))


@query("period_growth", PROGRAM_SQL + f"""
, cur AS (
  SELECT question_id, p.role AS prole, p.fiscal_period AS pfp, f.* FROM programs p JOIN facts f ON f.ticker = p.ticker AND f.role = p.role AND f.segment IS NULL
    AND (p.year IS NULL OR p.year = f.fiscal_year) AND p.fiscal_period = f.fiscal_period WHERE operation = 'period_growth_percent'
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY {CAND_ORDER}) = 1),
pri AS (
  SELECT c.question_id, f.amount, f.p_end, f.concept FROM cur c JOIN facts f ON f.ticker = c.ticker AND f.role = c.role AND f.segment IS NULL AND f.concept = c.concept
    AND f.fiscal_period = c.fiscal_period AND f.kind = c.kind AND f.p_end < c.p_end
  QUALIFY row_number() OVER (PARTITION BY c.question_id ORDER BY f.p_end DESC, f.ordinal) = 1),
s AS (SELECT p.question_id, c.amount AS ca, strftime(c.p_end, '%Y-%m-%d') AS p_end, strftime(q.p_end, '%Y-%m-%d') AS prior_end, q.amount AS pa,
  CASE WHEN c.id IS NULL THEN 'two comparable periods are required' WHEN q.p_end IS NULL THEN 'no prior comparable period is bound'
    WHEN c.amount IS NULL OR q.amount IS NULL OR q.amount = 0 THEN 'not exact' ELSE 'ok' END AS status
  FROM programs p LEFT JOIN cur c USING (question_id) LEFT JOIN pri q USING (question_id) WHERE operation = 'period_growth_percent')
SELECT question_id, p_end, prior_end, status, CASE WHEN status = 'ok' THEN round((CAST(ca AS DOUBLE) / CAST(pa AS DOUBLE) - 1) * 100, 6) END AS growth FROM s""")
def period_growth(spark, d):
    x = op.period_growth(_programs(spark, d).where("operation = 'period_growth_percent'"), st.facts(spark, d))
    return x.select("question_id", F.col("fact.period.end").cast("string").alias("p_end"), F.col("prior.period.end").cast("string").alias("prior_end"),
                    "status", F.round("growth", 6).alias("growth"))


@query("fact_grid", F_SQL + """
SELECT ticker, count(*) AS n, count(DISTINCT strftime(p_end, '%Y-%m-%d')) AS n_ends, count(*) FILTER (segment IS NOT NULL) AS n_segment,
  count(*) FILTER (lower(trim(value)) NOT IN ('', '-', '—', '–', 'n/a', 'na', 'null', 'none')) AS n_value FROM facts GROUP BY ALL""")
def fact_grid(spark, d):
    """Period fields as columns; per column the number of rows that are not an empty marker."""
    from factweave.functions.fixed import EMPTY_GRID_VALUES as empty
    x = st.facts(spark, d).select("ticker", "value", "dimensions", "period.*")
    return x.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.col("end").cast("string")).alias("n_ends"),
        F.count(F.when(F.size("dimensions") > 0, 1)).alias("n_segment"),
        F.count(F.when(~F.lower(F.trim("value")).isin(empty), 1)).alias("n_value"))


@query("fact_grid_cells", F_SQL + """,
c AS (SELECT ticker, id, unnest([{'p': 1, 'c': 'value', 'v': value}, {'p': 2, 'c': 'scale', 'v': CASE WHEN scale = '1' THEN 'n/a' ELSE scale END}, {'p': 3, 'c': 'segment', 'v': segment}, {'p': 4, 'c': 'period.end', 'v': strftime(p_end, '%Y-%m-%d')}], recursive := true) FROM facts WHERE fiscal_period = 'FY'),
v AS (SELECT DISTINCT ticker, p FROM c WHERE lower(trim(coalesce(v, ''))) NOT IN ('', '-', '—', '–', 'n/a', 'na', 'null', 'none')),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY p) AS position FROM v)
SELECT c.ticker, id, CAST(position AS INT) AS position, c.c AS column, c.v AS value FROM c JOIN n USING (ticker, p)""")
def fact_grid_cells(spark, d):
    """Cells of each company's yearly facts; a column without any value is left out."""
    from factweave.functions.fixed import EMPTY_GRID_VALUES as empty
    x = st.facts(spark, d).where("period.fiscal_period = 'FY'")
    columns = {"value": F.col("value"), "scale": F.when(F.col("scale") == "1", "n/a").otherwise(F.col("scale")), "segment": F.col("dimensions")["segment"], "period.end": F.col("period.end")}
    return op.grid_cells(x, "ticker", "id", columns, empty).withColumnsRenamed({"table": "ticker", "row": "id"})


@query("cash_questions", F_SQL + """,
q AS (SELECT o_orderkey AS question_id, 'S' || o_custkey AS ticker, CASE o_orderstatus WHEN 'F' THEN [year(o_orderdate) + 20, year(o_orderdate) + 19] ELSE [] END AS years FROM orders WHERE o_orderpriority = '3-MEDIUM'),
p AS (
  SELECT question_id, f.ticker, p_start, p_end, arg_min(struct_pack(a := amount, u := unit), ordinal) FILTER (role = 'operating_cash_flow') AS c, arg_min(struct_pack(a := amount, u := unit), ordinal) FILTER (role = 'net_income') AS i
  FROM q JOIN facts f ON f.ticker = q.ticker AND (len(years) = 0 OR list_contains(years, fiscal_year)) WHERE segment IS NULL AND kind = 'duration' AND role IN ('operating_cash_flow', 'net_income') GROUP BY question_id, f.ticker, p_start, p_end
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY p_end DESC, p_start DESC) <= 6)
SELECT question_id, ticker, strftime(p_start, '%Y-%m-%d') AS p_start, strftime(p_end, '%Y-%m-%d') AS p_end, CAST(c.a AS DOUBLE) AS cfo, CAST(i.a AS DOUBLE) AS income,
  CASE WHEN i.a = 0 THEN 'undefined (zero net income)' ELSE 'ok' END AS ratio_status, CASE WHEN i.a <> 0 THEN round(CAST(c.a AS DOUBLE) / CAST(i.a AS DOUBLE), 6) END AS ratio
FROM p WHERE c.a IS NOT NULL AND i.a IS NOT NULL AND c.u = i.u""")
def cash_questions(spark, d):
    """Cash conversion of the years that a question names, else of the latest periods."""
    y = F.year("o_orderdate") + 20
    q = table(spark, d, "orders").where("o_orderpriority = '3-MEDIUM'").select(
        F.col("o_orderkey").alias("question_id"), F.concat(F.lit("S"), "o_custkey").alias("ticker"), F.when(F.col("o_orderstatus") == "F", F.array(y, y - 1)).otherwise(F.expr("cast(array() AS array<int>)")).alias("years"))
    x = op.cash_for_questions(q, st.facts(spark, d))
    return x.select("question_id", "ticker", F.col("start").cast("string").alias("p_start"), F.col("end").cast("string").alias("p_end"), F.col("cfo").cast("double").alias("cfo"), F.col("income").cast("double").alias("income"), "ratio_status", F.round("ratio", 6).alias("ratio"))
