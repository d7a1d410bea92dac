"""Queries on filing discovery, selection and manifests; orders stand in for filings."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave import schemas
from factweave.functions import scalars as sc
from factweave.operators import filings as op
from factweave.plans.base import Area
from factweave.sources import acquisition as acq
from factweave.sources import sinks
from factweave.sources.tables import table

area = Area()
QUERIES, ORACLES, query = area.queries, area.oracles, area.query

FORMS = {"1-URGENT": "10-K", "2-HIGH": "10-Q", "3-MEDIUM": "8-K", "4-NOT SPECIFIED": "10-K/A"}


def filings(spark, d, orders=None):
    p = F.col("o_orderpriority")
    form = F.lit("DEF-14A")
    for k, v in FORMS.items():
        form = F.when(p == k, v).otherwise(form)
    date = F.add_months(F.to_date("o_orderdate"), 240)
    text = lambda c, n: F.lpad(c.cast("string"), n, "0")
    orders = table(spark, d, "orders") if orders is None else orders
    return orders.select(
        F.concat(F.lit("filing:"), "o_orderkey").alias("id"), F.concat(F.lit("C"), "o_custkey").alias("ticker"), form.alias("form"),
        (F.year("o_orderdate") + 20).alias("fiscal_year"), date.alias("filing_date"), F.trunc(date, "quarter").alias("report_date"),
        F.concat_ws("-", text(F.col("o_custkey"), 10), F.date_format("o_orderdate", "yy"), text(F.col("o_orderkey") % 1000000, 6)).alias("accession"),
        F.col("o_orderkey").alias("ordinal"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit("doc"), "o_orderkey", F.lit(".htm"))).alias("primary_document"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


FILINGS_SQL = """
filings AS (
  SELECT 'filing:' || o_orderkey AS id, 'C' || o_custkey AS ticker,
    CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '2-HIGH' THEN '10-Q' WHEN '3-MEDIUM' THEN '8-K' WHEN '4-NOT SPECIFIED' THEN '10-K/A' ELSE 'DEF-14A' END AS form,
    CAST(year(o_orderdate) + 20 AS INT) AS fiscal_year, CAST(o_orderdate + INTERVAL 20 YEAR AS DATE) AS filing_date,
    CAST(date_trunc('quarter', o_orderdate + INTERVAL 20 YEAR) AS DATE) AS report_date,
    lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS accession,
    o_orderkey AS ordinal, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'doc' || o_orderkey || '.htm' END AS primary_document, o_orderstatus AS status, o_totalprice AS price
  FROM orders)
"""
W_SQL = "WITH " + FILINGS_SQL
D = "strftime({}, '%Y-%m-%d')".format
YEARS = [2016, 2017, 2018]


def day(c):
    return F.col(c).cast("string").alias(c)


def submissions(spark, d):
    """Columnar submissions of one filing each: the filing, an exhibit without report date, and a short last array."""
    f = filings(spark, d)
    s = lambda c: F.col(c).cast("string")
    recent = F.struct(
        F.array(F.concat("accession", F.lit("a")), F.concat("accession", F.lit("b"))).alias("accessionNumber"), F.array("form", F.lit("10-Q")).alias("form"),
        F.array(s("filing_date"), s("filing_date")).alias("filingDate"), F.array(s("report_date"), F.lit("")).alias("reportDate"),
        F.array("primary_document").alias("primaryDocument"))
    y = F.year("filing_date")
    page = lambda n, a, b: F.struct(F.concat(F.lit(n), "ordinal").alias("name"), a.alias("filingFrom"), b.alias("filingTo"))
    files = F.array(page("old", (y - 3).cast("string"), s("filing_date")), page("next", s("filing_date"), (y + 1).cast("string")),
                    page("odd", F.lit("n/a"), F.lit("n/a")))
    return f.select("accession", "ordinal", F.col("accession").alias("cik"), F.struct(recent.alias("recent"), files.alias("files")).alias("filings"))


@query("submissions_rows", W_SQL + f""",
r AS (SELECT ordinal, accession || 'a' AS accession, form, {D('filing_date')} AS filing_date, {D('report_date')} AS report_date, primary_document FROM filings
  UNION ALL SELECT ordinal, accession || 'b', '10-Q', {D('filing_date')}, {D('filing_date')}, NULL FROM filings)
SELECT accession, form, filing_date, report_date, CAST(left(report_date, 4) AS INT) AS year, primary_document FROM r
WHERE form IN ('10-K', '10-Q') AND CAST(left(report_date, 4) AS INT) IN (2016, 2017, 2018)""")
def submissions_rows(spark, d):
    x = op.submissions_rows(submissions(spark, d), ["10-K", "10-Q"], YEARS)
    return x.select("accession", "form", "filing_date", "report_date", "year", "primary_document")


@query("submission_pages", W_SQL + """
SELECT accession AS cik, 'main' AS page FROM filings
UNION ALL SELECT accession, 'old' || ordinal FROM filings WHERE fiscal_year - 3 <= 2018 AND fiscal_year >= 2016
UNION ALL SELECT accession, 'next' || ordinal FROM filings WHERE fiscal_year <= 2018 AND fiscal_year + 1 >= 2016
UNION ALL SELECT accession, 'odd' || ordinal FROM filings""")
def submission_pages(spark, d):
    return op.submission_pages(submissions(spark, d), YEARS)


@query("ticker_map", """
SELECT 'C' || c_custkey AS key, 'C.' || c_custkey AS sec_ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name || ' Inc' AS title,
  CASE WHEN c_acctbal < 0 THEN 'OTC' ELSE 'NYSE' END AS exchange FROM customer""")
def ticker_map(spark, d):
    """Later row of the same symbol wins; symbols differ only by punctuation."""
    key = F.col("c_custkey").cast("string")
    ex = F.when(F.col("c_acctbal") < 0, "OTC").otherwise("NYSE")
    m = table(spark, d, "customer").select(
        F.array(*map(F.lit, ("cik", "name", "ticker", "exchange"))).alias("fields"),
        F.array(F.array(key, F.col("c_name"), F.concat(F.lit("c"), key), F.lit("Nasdaq")),
                F.array(key, F.concat("c_name", F.lit(" Inc")), F.concat(F.lit("C."), key), ex)).alias("data"))
    return op.ticker_map(m)


@query("constituents", """
SELECT s_suppkey AS page_id, CAST(unnest([0, 1]) AS INT) AS pos, unnest(['S' || s_suppkey, 'BRK-' || s_nationkey]) AS ticker FROM supplier""")
def constituents(spark, d):
    """Supplier list pages and all crawled pages; only tables with a symbol column count."""
    s = table(spark, d, "supplier")
    html = F.concat(
        F.lit("<html><table class='x'><tr><th>Name</th></tr><tr><td>none</td></tr></table><TABLE><tr><th>Security</th><th>Symbol<sup>1</sup></th></tr><tr><td>"), "s_name",
        F.lit("</td><td><a href='/x'> S"), "s_suppkey", F.lit("</a>\n</td></tr><tr><td>short</td></tr><tr><td>B</td><td>BRK."), "s_nationkey",
        F.lit("</td></tr></TABLE><table><tr><th>Symbol</th></tr><tr><td>LATE</td></tr></table></html>"))
    pages = s.select(F.col("s_suppkey").alias("page_id"), html.alias("html")).unionByName(
        table(spark, d, "pages").select((-F.col("page_id") - 1).alias("page_id"), "html"))
    return op.constituents(pages)


@query("flatten_company_facts", """
SELECT o_orderkey AS cik, concept, unit, o_totalprice * m AS val, o_orderstatus AS form, CAST(year(o_orderdate) AS INT) AS fy FROM orders,
  (VALUES ('us-gaap:Revenues', 'USD', 1), ('us-gaap:Revenues', 'USD', 2), ('dei:Shares', 'shares', 3)) v(concept, unit, m)""")
def flatten_company_facts(spark, d):
    o = table(spark, d, "orders")
    entry = lambda m: F.format_string('{"val": %s, "form": "%s", "fy": %d, "accn": "x"}', (F.col("o_totalprice") * m).cast("string"), "o_orderstatus", F.year("o_orderdate"))
    js = F.concat(F.lit('{"cik": '), "o_orderkey", F.lit(', "facts": {"us-gaap": {"Revenues": {"label": "r", "units": {"USD": ['), entry(1), F.lit(", "), entry(2),
                  F.lit(']}}}, "dei": {"Shares": {"units": {"shares": ['), entry(3), F.lit("]}}}}}"))
    raw = o.select(F.from_json(js, schemas.COMPANY_FACTS).alias("j")).select("j.*")
    return acq.flatten_company_facts(raw).select("cik", "concept", "unit", "val", "form", "fy")


NAMES_SQL = """
names AS (SELECT l_orderkey AS filing_id, 'doc' || l_orderkey || '.htm' AS primary_document, l_linenumber AS ordinal,
  CASE WHEN l_linenumber = 1 THEN 'DOC' || l_orderkey || '.HTM' WHEN l_returnflag = 'R' THEN 'R' || l_linenumber || '.htm' WHEN l_linenumber = 2 THEN 'a-ex' || l_linenumber || '.txt'
    WHEN l_linenumber = 3 THEN 'FilingSummary.xml' WHEN l_linenumber = 4 THEN 'pic.jpg' WHEN l_linenumber = 5 THEN 'x-index.html' WHEN l_linenumber = 6 THEN 'body.htm' ELSE 'schema.xsd' END AS name FROM lineitem)
"""


def names(spark, d):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    name = (
        F.when(n == 1, F.concat(F.lit("DOC"), k, F.lit(".HTM"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("R"), n, F.lit(".htm")))
        .when(n == 2, F.concat(F.lit("a-ex"), n, F.lit(".txt"))).when(n == 3, "FilingSummary.xml").when(n == 4, "pic.jpg").when(n == 5, "x-index.html")
        .when(n == 6, "body.htm").otherwise("schema.xsd"))
    return table(spark, d, "lineitem").select(k.alias("filing_id"), F.concat(F.lit("doc"), k, F.lit(".htm")).alias("primary_document"), n.alias("ordinal"), name.alias("name"))


@query("archive_files", "WITH " + NAMES_SQL + """
SELECT filing_id, name, min(ordinal)::BIGINT AS ordinal FROM (
  SELECT filing_id, name, ordinal FROM names WHERE lower(name) = primary_document OR (regexp_matches(lower(name), '\\.(xml|xsd|txt|pdf)$|-index\\.html$') AND NOT regexp_matches(lower(name), '[-_]ex\\d'))
  UNION ALL SELECT filing_id, primary_document, -1 FROM names) GROUP BY ALL""")
def archive_files(spark, d):
    return op.archive_files(names(spark, d))


@query("high_value_sources", "WITH " + NAMES_SQL + """
SELECT right(lower(name), 8) AS ending, count(*) AS n FROM names
WHERE ends_with(lower(name), '.htm') OR ends_with(lower(name), '.txt') OR ends_with(lower(name), 'filingsummary.xml') GROUP BY ALL""")
def high_value_sources(spark, d):
    x = names(spark, d).where(op.high_value_source(F.concat("name", F.lit(".md"))))
    return x.groupBy(F.right(F.lower("name"), F.lit(8)).alias("ending")).agg(F.count(F.lit(1)).alias("n"))


@query("latest_filings", W_SQL + f"""
SELECT ticker, fiscal_year AS year, replace(form, '/A', '') AS base_form, {D('report_date')} AS report_date, accession, form, {D('filing_date')} AS filing_date FROM filings
QUALIFY row_number() OVER (PARTITION BY ticker, fiscal_year, replace(form, '/A', ''), report_date ORDER BY filing_date DESC, ordinal) = 1""")
def latest_filings(spark, d):
    x = op.latest_filings(filings(spark, d).withColumnRenamed("fiscal_year", "year").drop("status", "price"))
    return x.select("ticker", "year", "base_form", day("report_date"), "accession", "form", day("filing_date"))


@query("filings_by_accession", W_SQL + f"""
SELECT acc AS accession, id, form FROM (SELECT *, left(accession, 13) AS acc FROM filings WHERE primary_document <> '')
QUALIFY row_number() OVER (PARTITION BY acc ORDER BY ordinal DESC) = 1""")
def filings_by_accession(spark, d):
    x = filings(spark, d).withColumn("accession", F.left("accession", F.lit(13)))
    return op.by_accession(x).select("accession", "id", "form")


@query("filing_timeline", W_SQL + """
SELECT id, lag(id) OVER w AS prior_filing, lead(id) OVER w AS next_filing FROM filings WINDOW w AS (PARTITION BY ticker ORDER BY filing_date, accession)""")
def filing_timeline(spark, d):
    return op.timeline(filings(spark, d)).select("id", "prior_filing", "next_filing")


@query("retrieval_filings", W_SQL + """,
req AS (SELECT o_orderkey AS question_id, 'C' || o_custkey AS ticker, [year(o_orderdate) + 20] AS years FROM orders WHERE o_orderstatus = 'F'),
x AS (SELECT question_id, f.*, row_number() OVER (PARTITION BY question_id ORDER BY list_contains(years, fiscal_year) DESC, filing_date DESC, ordinal) AS r
  FROM req JOIN filings f USING (ticker) WHERE form IN ('10-K', '10-Q')),
a AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY r) AS ar FROM x WHERE form = '10-K'),
u AS (SELECT question_id, ticker, id, min(o) AS o FROM (SELECT question_id, ticker, id, CASE WHEN r = 1 THEN 0 ELSE r + 10 END AS o FROM x
  UNION ALL SELECT question_id, ticker, id, ar FROM a WHERE ar <= 2) GROUP BY ALL)
SELECT question_id, ticker, id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY o) AS INT) AS rank FROM u QUALIFY rank <= 4""")
def retrieval_filings(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    req = o.select(F.col("o_orderkey").alias("question_id"), F.concat(F.lit("C"), "o_custkey").alias("ticker"), F.array(F.year("o_orderdate") + 20).alias("years"))
    return op.retrieval_filings(req, filings(spark, d), 4)


@query("balanced_sample", W_SQL + """,
t AS (SELECT ticker, fiscal_year AS year, accession AS path, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY accession) AS turn FROM filings)
SELECT ticker, year, path, CAST(row_number() OVER (PARTITION BY ticker ORDER BY turn, year) AS INT) AS pick FROM t QUALIFY pick <= 5""")
def balanced_sample(spark, d):
    x = filings(spark, d).select("ticker", F.col("fiscal_year").alias("year"), F.col("accession").alias("path"))
    return op.balanced_sample(x, 5).select("ticker", "year", "path", "pick")


@query("unresolved_tickers", """
SELECT 'c.' || c_custkey AS ticker FROM customer WHERE 'C' || c_custkey NOT IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def unresolved_tickers(spark, d):
    want = table(spark, d, "customer").select(F.concat(F.lit("c."), "c_custkey").alias("ticker"))
    known = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("C"), "o_custkey").alias("ticker"))
    return op.unresolved(want, known).select("ticker")


PATHS_SQL = """
stored AS (SELECT 'filings/' || ticker || '/' || ticker || '-FY' || fiscal_year || '-' || accession || '.md' AS path, ticker FROM filings WHERE status <> 'P'),
wanted AS (SELECT DISTINCT CASE status WHEN 'F' THEN 'filings/' || ticker || '/' || ticker || '-FY' || fiscal_year || '-' || accession || '.md'
   WHEN 'O' THEN 'filings/' || ticker || '/old-' || accession || '.yml' ELSE 'filings/' || ticker || '/' || ticker || '-FY' || fiscal_year || '-x.md' END AS path, accession, ticker, fiscal_year, status FROM filings)
"""


@query("canonical_paths", W_SQL + "," + PATHS_SQL + """,
m AS (SELECT w.path, status, min(s.path) AS stored FROM wanted w LEFT JOIN stored s ON s.ticker = w.ticker AND
  CASE status WHEN 'P' THEN starts_with(split_part(s.path, '/', 3), w.ticker || '-FY' || w.fiscal_year) ELSE contains(s.path, w.accession) END GROUP BY ALL)
SELECT path, coalesce(stored, path) AS canonical, CAST(CASE WHEN stored IS NULL THEN 3 WHEN status = 'F' THEN 0 WHEN status = 'O' THEN 1 ELSE 2 END AS INT) AS rule FROM m""")
def canonical_paths(spark, d):
    f = filings(spark, d)
    folder = F.concat(F.lit("filings/"), "ticker", F.lit("/"))
    full = F.concat(folder, "ticker", F.lit("-FY"), "fiscal_year", F.lit("-"), "accession", F.lit(".md"))
    stored = f.where("status <> 'P'").select(full.alias("path"))
    want = f.select(F.when(F.col("status") == "F", full).when(F.col("status") == "O", F.concat(folder, F.lit("old-"), "accession", F.lit(".yml")))
                    .otherwise(F.concat(folder, "ticker", F.lit("-FY"), "fiscal_year", F.lit("-x.md"))).alias("path")).distinct()
    return op.canonical_paths(want, stored)


@query("company_sector", """
WITH c AS (SELECT c_custkey, c_name AS title, CASE c_mktsegment WHEN 'BUILDING' THEN 'DUK' WHEN 'AUTOMOBILE' THEN 'GM' WHEN 'MACHINERY' THEN 'CAT' WHEN 'HOUSEHOLD' THEN 'PG' ELSE 'ZZZ' END AS ticker,
  CASE WHEN c_acctbal < 0 THEN 'Dairy Products' ELSE '' END AS industry FROM customer)
SELECT c_custkey, CASE ticker WHEN 'DUK' THEN 'Utilities' WHEN 'GM' THEN 'Consumer Discretionary' WHEN 'CAT' THEN 'Industrials' WHEN 'PG' THEN 'Consumer Staples' ELSE 'Unknown' END AS sector,
  CASE WHEN industry <> '' THEN title || ' primarily operates in dairy products and is classified in the ' || sector || ' sector.'
    WHEN ticker = 'ZZZ' THEN title || ' is a publicly traded company. More detailed company profile data is not yet available.'
    ELSE title || ' ' || CASE ticker WHEN 'DUK' THEN 'generates or distributes electricity and other utility services' WHEN 'GM' THEN 'provides consumer products or services such as retail, travel, restaurants, vehicles, or apparel'
      WHEN 'CAT' THEN 'provides industrial equipment, transportation, aerospace, engineering, or commercial services' ELSE 'provides everyday consumer products such as food, beverages, household goods, or essential retail' END
      || ' and is classified in the ' || sector || ' sector.' END AS overview FROM c""")
def company_sector(spark, d):
    seg = F.col("c_mktsegment")
    t = F.when(seg == "BUILDING", "DUK").when(seg == "AUTOMOBILE", "GM").when(seg == "MACHINERY", "CAT").when(seg == "HOUSEHOLD", "PG").otherwise("ZZZ")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("title"), t.alias("ticker"), F.when(F.col("c_acctbal") < 0, "Dairy Products").otherwise("").alias("industry"))
    return op.company_sector(c).select("c_custkey", "sector", "overview")


@query("company_enrich", """
SELECT 'C' || c_custkey AS ticker, CASE WHEN c_acctbal > 5000 THEN c_name || ' Corp' WHEN c_acctbal > 0 OR c_acctbal < -500 THEN c_name ELSE '' END AS title,
  CASE WHEN c_acctbal > 0 THEN CAST(c_custkey AS VARCHAR) ELSE '0' || c_custkey END AS cik, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS industry FROM customer""")
def company_enrich(spark, d):
    c, b, k = table(spark, d, "customer"), F.col("c_acctbal"), F.concat(F.lit("C"), "c_custkey").alias("ticker")
    comp = c.select(k, F.when((b > 0) | (b < -500), F.col("c_name")).otherwise("").alias("title"), F.concat(F.lit("0"), "c_custkey").alias("cik"))
    sub = c.where(b > 0).select(k, F.when(b > 5000, F.concat("c_name", F.lit(" Corp"))).otherwise("").alias("name"), F.col("c_custkey").cast("string").alias("cik"), F.col("c_mktsegment").alias("industry"))
    return op.company_enrich(comp, sub)


@query("doc_page_stats", """
SELECT doc_id, count(*) AS page_count, CAST(sum(len(regexp_extract_all(line, '[^ ]+'))) AS BIGINT) AS token_count, CAST(sum(len(string_split(line, '. '))) AS BIGINT) AS element_count
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def doc_page_stats(spark, d):
    """Pages of a document are its lines; tokens are words, elements are sentences. Sums combine before the shuffle."""
    x = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), F.sum(F.size(F.regexp_extract_all("line", F.lit("[^ ]+"), F.lit(0)))).alias("token_count"),
                                   F.sum(F.size(F.split("line", r"\. "))).alias("element_count"))


def manifest(spark, d):
    f = filings(spark, d)
    status = F.when(F.col("status") == "F", "downloaded").when(F.col("status") == "O", "skipped_existing").otherwise("failed")
    return sinks.filing_path(f).select("ticker", F.col("fiscal_year").alias("year"), "accession", status.alias("state"), "output", "price")


MANIFEST_SQL = W_SQL + """,
manifest AS (SELECT ticker, fiscal_year AS year, accession, CASE status WHEN 'F' THEN 'downloaded' WHEN 'O' THEN 'skipped_existing' ELSE 'failed' END AS state, price,
  'filings/' || ticker || '/' || ticker || '-FY' || fiscal_year || '-' || replace(form, '/', '-') || '-' || strftime(filing_date, '%Y-%m-%d') || '-' || accession || '.md' AS output FROM filings)
"""


@query("download_manifest", MANIFEST_SQL + "SELECT ticker, year, accession, state, output FROM manifest")
def download_manifest(spark, d):
    return manifest(spark, d).drop("price")


@query("write_filings", MANIFEST_SQL + "SELECT ticker, year, count(*) AS n, min(output) AS first_output FROM manifest WHERE state <> 'skipped_existing' GROUP BY ALL")
def write_filings(spark, d):
    """The rows a write would add: outputs that exist already are skipped by an anti-join."""
    existing = manifest(spark, d).where("state = 'skipped_existing'").select("output")
    x = sinks.new_filings(filings(spark, d), existing)
    return x.groupBy("ticker", F.col("fiscal_year").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("output").alias("first_output"))


@query("manifest_merge", MANIFEST_SQL + """
SELECT ticker, year, accession, 'old' AS origin FROM manifest WHERE state <> 'downloaded' OR price <= 100000
UNION ALL SELECT ticker, year, accession, 'new' FROM manifest WHERE state = 'downloaded' AND price > 100000""")
def manifest_merge(spark, d):
    m = manifest(spark, d)
    new = m.where("state = 'downloaded' and price > 100000").select("ticker", "year", "accession", F.lit("new").alias("origin"))
    return op.manifest_merge(m.select("ticker", "year", "accession", F.lit("old").alias("origin")), new, ["ticker", "accession"])


@query("ingest_status", MANIFEST_SQL + "SELECT coalesce(state, 'all') AS state, coalesce(CAST(year AS VARCHAR), 'all') AS year, count(*) AS n FROM manifest GROUP BY ROLLUP (year, state)")
def ingest_status(spark, d):
    x = manifest(spark, d).rollup("year", "state").agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.coalesce("state", F.lit("all")).alias("state"), F.coalesce(F.col("year").cast("string"), F.lit("all")).alias("year"), "n")


@query("company_progress", MANIFEST_SQL + """
SELECT ticker, CAST(bool_and(state IN ('downloaded', 'skipped_existing')) AND NOT bool_or(state = 'failed') AS INT) AS complete, count(*) FILTER (state = 'failed') AS n_failed FROM manifest GROUP BY ticker""")
def company_progress(spark, d):
    exists = F.col("state").isin("downloaded", "skipped_existing")
    return manifest(spark, d).groupBy("ticker").agg((F.bool_and(exists) & ~F.bool_or(F.col("state") == "failed")).cast("int").alias("complete"), F.count_if(F.col("state") == "failed").alias("n_failed"))


@query("filing_docs", MANIFEST_SQL + f""",
m AS (SELECT m.*, f.form, f.ticker AS t FROM manifest m JOIN filings f USING (accession))
SELECT accession, CASE WHEN state = 'failed' THEN '' ELSE t || ' "FY" ' || form END AS title, CASE WHEN state = 'failed' THEN '' ELSE 'company/' || t || ';sector/x' END AS tags,
  CASE WHEN state = 'failed' THEN '' ELSE 'filed_by>entity:' || t || ';amends>filing:0' END AS edges,
  CASE WHEN state = 'failed' THEN 'no fence ' || accession ELSE '# Head' || chr(10) || 'text' END AS body FROM m""")
def filing_docs(spark, d):
    m = manifest(spark, d).join(filings(spark, d).select("accession", "form"), "accession")
    text = F.when(F.col("state") == "failed", F.concat(F.lit("no fence "), "accession")).otherwise(F.concat(
        F.lit('---\ntitle: "'), "ticker", F.lit(' \\"FY\\" '), "form", F.lit('"\ncik:\ntags:\n  - company/'), "ticker", F.lit("\n  - \"sector/x\"\nedges:\n  - rel: filed_by\n    target: \"entity:"), "ticker",
        F.lit('"\n  - rel: broken\n  - rel: amends\n    target: filing:0\ntitle: second\n---\n\n# Head\ntext')))
    x = acq.front_matter(m.select(F.col("accession").alias("path"), text.alias("text")))
    return x.select(F.col("path").alias("accession"), F.coalesce(F.element_at("header", "title"), F.lit("")).alias("title"), F.array_join("tags", ";").alias("tags"),
                    F.array_join(F.transform("edges", lambda e: F.concat(e["rel"], F.lit(">"), e["target"])), ";").alias("edges"), "body")


@query("filing_yaml_facts", W_SQL + """
SELECT accession, n AS fact_no, CASE n WHEN 0 THEN 'Net sales' ELSE 'Total assets' END AS label, CASE n WHEN 0 THEN '"1,5"' ELSE CAST(ordinal AS VARCHAR) END AS value,
  CASE n WHEN 0 THEN CAST(fiscal_year AS VARCHAR) END AS fiscal_year, CASE n WHEN 0 THEN 0 ELSE 1 END AS has_dimensions
FROM (SELECT *, CAST(unnest([0, 1]) AS INT) AS n FROM filings)""".replace("'\"1,5\"'", "'1,5'"))
def filing_yaml_facts(spark, d):
    f = filings(spark, d)
    text = F.concat(F.lit('schema_version: "filing/1"\nproperties:\n  title: x\nfacts:\n  - fact_id: a\n    label: "Net sales"\n    value: "0"\n    value: "1,5"\n    period:\n      fiscal_year: '),
                    "fiscal_year", F.lit("\n  - fact_id: b\n    label: Total assets\n    dimensions: x\n    value: "), "ordinal", F.lit("\ntext_facts:\n  - fact_id: c\n    label: none\n"))
    x = acq.structured_facts(f.select(F.col("accession").alias("path"), text.alias("text")))
    g = lambda k: F.element_at("fields", k)
    return x.select(F.col("path").alias("accession"), "fact_no", g("label").alias("label"), g("value").alias("value"), g("period.fiscal_year").alias("fiscal_year"),
                    g("dimensions").isNotNull().cast("int").alias("has_dimensions"))


@query("scalar_hash", W_SQL + """
SELECT id, sha256(accession) AS full_hash, left(sha256(id), 12) AS short_hash, trim(regexp_replace(lower(form || ' ' || id || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM filings""")
def scalar_hash(spark, d):
    f = filings(spark, d)
    return f.select("id", sc.full_hash(F.col("accession")).alias("full_hash"), sc.short_hash(F.col("id")).alias("short_hash"), sc.slug(F.concat("form", F.lit(" "), "id", F.lit("!"))).alias("slug"))


@query("scalar_dates", W_SQL + """
SELECT id, CAST(left(strftime(filing_date, '%Y-%m-%d'), 4) AS INT) AS year, strftime(filing_date, '%Y-%m-%d') AS iso, strftime(report_date, '%Y-%m-%d') AS named,
  CAST(fiscal_year AS VARCHAR) AS fy_text, accession, CASE WHEN form = '10-K/A' THEN '10-K' ELSE form END AS form, strftime(filing_date, '%Y%m%d') || 'T000000000000Z' AS stamp FROM filings""")
def scalar_dates(spark, d):
    f = filings(spark, d)
    name = F.concat("ticker", F.lit("-FY"), "fiscal_year", F.lit("-"), F.replace("form", F.lit("/A"), F.lit("")), F.lit("-"), "accession", F.lit(".md"))
    iso = F.concat(F.lit("price on "), F.col("filing_date").cast("string"), F.lit(" please"))
    named = F.concat(F.lit("close of "), F.date_format("report_date", "MMMM d"), F.lit("st, "), F.year("report_date"))
    return f.select("id", sc.year_of(F.col("filing_date").cast("string")).alias("year"), sc.date_in_text(iso).cast("string").alias("iso"), sc.date_in_text(named).cast("string").alias("named"),
                    sc.fiscal_year_in_name(name).alias("fy_text"), sc.accession_in_name(name).alias("accession"), sc.form_in_name(name).alias("form"),
                    sc.run_stamp(F.col("filing_date").cast("timestamp")).alias("stamp"))


@query("facts_scan", W_SQL + """
SELECT upper(replace(ticker, 'C', 'c-')) AS ticker, id || suffix AS id, concept, value, fiscal_year, n AS ordinal FROM filings, (VALUES (0::BIGINT, 'a', 'us-gaap:Revenues'), (1::BIGINT, 'b', 'us-gaap:NetIncomeLoss')) v(n, suffix, concept), LATERAL (SELECT CAST(ordinal + n AS VARCHAR) AS value)""")
def facts_scan(spark, d):
    """One index document per filing with two facts; the ticker becomes an upper-case slug."""
    f = filings(spark, d)
    fact = lambda n, s, c: F.format_string('{"id":"%s' + s + '","concept":"' + c + '","roles":["x"],"value":"%d","scale":"1","unit":"USD","dimensions":{},"period":{"fiscal_year":%d,"kind":"duration"}}', "id", F.col("ordinal") + n, "fiscal_year")
    js = F.concat(F.lit('{"ticker":"'), F.replace("ticker", F.lit("C"), F.lit("c/")), F.lit('","facts":['), fact(0, "a", "us-gaap:Revenues"), F.lit(","), fact(1, "b", "us-gaap:NetIncomeLoss"), F.lit("]}"))
    x = acq.fact_index_rows(f.select(F.from_json(js, schemas.FACT_INDEX).alias("j")).select("j.*"))
    return x.select("ticker", "id", "concept", "value", "period.fiscal_year", "ordinal")
