"""Joins of rows that come out of a generator: Spark takes them for small, and must not send them through the driver."""

from factweave.operators import certify, questions, text
from factweave.sources.acquisition import structured_facts


def stored(spark, path, name, sql):
    """Rows in Parquet, so that Spark knows a size."""
    spark.sql(sql).write.parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def sends_nothing(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "Broadcast" not in plan


def test_number_binding_sorts(spark, tmp_path):
    a = stored(spark, tmp_path, "a", "select id as answer_id, 'It was 5.0 or 7.' as text from range(3)")
    c = stored(spark, tmp_path, "c", "select id as answer_id, cast(5 as decimal(9,2)) as value, '1' as decimals from range(2)")
    got = certify.number_binding(a, c)
    assert sends_nothing(got)
    assert sorted(map(tuple, got.collect())) == [(0, 2, 1, False), (1, 2, 1, False), (2, 2, 0, False)]


def test_align_gold_sorts(spark, tmp_path):
    a = stored(spark, tmp_path, "a", "select id as answer_id, id as bundle, 'It was 5000 or 7 or 31.' as text from range(2)")
    g = stored(spark, tmp_path, "g", "select id as answer_id, cast(5 as decimal(9,2)) as value, '0' as decimals from range(2)")
    f = stored(spark, tmp_path, "f", "select id as bundle, 'f' as fact_id, cast(0.7 as decimal(9,2)) as value from range(1)")
    got = certify.align_gold(a, g, f)
    assert sends_nothing(got)
    assert sorted((r.answer_id, r.n, r["class"]) for r in got.collect()) == [(0, 0, "scale"), (0, 1, "wrong operand"), (0, 2, "fabricated"), (1, 0, "scale"), (1, 1, "fabricated"), (1, 2, "fabricated")]


def test_company_mentions_sort(spark, tmp_path):
    q = stored(spark, tmp_path, "q", "select id as question_id, if(id = 0, 'Is Acme or S7 better?', 'Who?') as question, 'S1' as selected from range(2)")
    c = stored(spark, tmp_path, "c", "select 'S' || (id + 7) as ticker, if(id = 0, 'Other', 'Acme Inc') as title from range(2)")
    got = questions.company_mentions(q, c)
    assert sends_nothing(got)
    assert sorted((r.question_id, r.ticker, r.position) for r in got.collect()) == [(0, "S7", 11), (0, "S8", 3), (1, "S1", -1)]


FILING = 'schema_version: "x"\nproperties:\n  title: "T"\n  form: "10-K"\n  filing_date: "2020-01-01"\nfacts:\n  - fact_id: a\n    label: "Net sales"\n    value: "5"\n    period:\n      end: "2020-01-01"\n      fiscal_year: 2020\n'


def asked(spark, path):
    docs = stored(spark, path, "d", f"select 'p' || id as path, '{FILING}' as text from range(2)".replace("\n", "\\n"))
    return docs, stored(spark, path, "r", "select 'q' as question_id, 'p0' as path, 'Which sales?' as question from range(2)")


def test_fact_rank_of_questions_sorts(spark, tmp_path):
    docs, requests = asked(spark, tmp_path)
    got = text.rank_facts(structured_facts(docs), requests)
    assert sends_nothing(got)
    assert [(r.question_id, r.path, r.line, r.position) for r in got.collect()] == [("q", "p0", "- Net sales: 5 (2020-01-01)", 1)]


def test_excerpts_of_questions_sort(spark, tmp_path):
    docs, requests = asked(spark, tmp_path)
    got = text.filing_excerpts(docs, structured_facts(docs), requests)
    assert sends_nothing(got)
    assert [(r.path, r.kind, r.excerpt.splitlines()[-1]) for r in got.collect()] == [("p0", "structured", "- Net sales: 5 (2020-01-01)")]


def test_bootstrap_spreads_clusters_and_draws_without_lambdas(spark):
    c = spark.sql("select cast(id as string) as cluster, id * 10 as total, 2L as n from range(20)")
    got = certify.cluster_bootstrap(c, 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "lambda" not in plan
    low, high = got.select("low", "high").first()
    assert got.first().replicates == 50 and 0 < low < 47.5 < high < 95


def test_fact_rows_are_made_without_lambdas(spark, tmp_path):
    from factweave.plans import standins

    line = "select 1L as l_suppkey, date'1996-05-05' as l_shipdate, 'R' as l_returnflag, 100.0D as l_extendedprice, 0.1D as l_discount, 0.05D as l_tax, 5.0D as l_quantity"
    spark.sql(line).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = standins.facts(spark, str(tmp_path)).select("id", "value")
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in got.where("id like 'S1:2016:FY:all:%'").collect()) == [f"S1:2016:FY:all:{i}" for i in (1, 2, 3, 4, 5, 6, 7, 8)]


LINES = "select 1L as l_suppkey, timestamp'1996-05-05 00:00:00' as l_shipdate, 'R' as l_returnflag, 100.0D as l_extendedprice, 0.1D as l_discount, 0.05D as l_tax, 0.5D as l_quantity"


def test_margin_bind_reads_lines_once(spark, tmp_path):
    from factweave.plans import facts

    spark.sql(LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = facts.margin_bind(spark, str(tmp_path))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    # 100 * (0.1 - 0.05) - 10 * 0.5 = 0 of 100; of the three revenues of the year row 2 comes first
    assert {tuple(r) for r in got.collect()} == {("S1:2016:FY:all:7", "S1:2016:FY:all:2", 0.0), ("S1:2016:Q2:all:7", "S1:2016:Q2:all:2", 0.0)}


def test_cash_questions_parse_only_their_roles(spark):
    from factweave import schemas
    from factweave.functions import fixed
    from factweave.operators import facts as op

    facts = spark.createDataFrame([], schemas.FACTS)
    requests = spark.createDataFrame([], "question_id long, ticker string, years array<int>")
    lines = op.cash_for_questions(requests, facts)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    parsed, roles = ([i for i, x in enumerate(lines) if t in x] for t in (fixed.PLAIN_VALUE, "IN (operating_cash_flow,net_income)"))
    assert parsed and max(roles) > max(parsed)
