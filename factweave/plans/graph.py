"""Queries on the corpus graph: customers are company hubs, orders filings, line items facts, parts sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import filings as fop
from factweave.operators import graph as op
from factweave.plans import filings as pf
from factweave.plans.base import Area
from factweave.sources.tables import table

area = Area()
QUERIES, ORACLES, query = area.queries, area.oracles, area.query


def nodes(spark, d):
    cat, lit = F.concat, F.lit
    c, li, p = table(spark, d, "customer"), table(spark, d, "lineitem"), table(spark, d, "part")
    f = pf.filings(spark, d)
    word = F.when(F.col("l_returnflag") == "R", "revenue").when(F.col("l_returnflag") == "A", "cost").otherwise("other")
    fact_title = cat(lit("Item "), "l_linenumber", lit(" "), word)
    return (
        c.select(cat(lit("entity:C"), "c_custkey").alias("id"), lit("finance.entity").alias("type"), F.col("c_name").alias("title"), cat(lit("C"), "c_custkey").alias("ticker"))
        .unionByName(f.select("id", lit("finance.filing").alias("type"), cat("ticker", lit(" FY"), "fiscal_year", lit(" "), "form").alias("title"), "ticker"))
        .unionByName(li.select(fact_id().alias("id"), lit("finance.fact").alias("type"), fact_title.alias("title"), lit(None).cast("string").alias("ticker")))
        .unionByName(p.select(cat(lit("source:"), "p_partkey").alias("id"), lit("finance.source").alias("type"), F.col("p_name").alias("title"), lit(None).cast("string").alias("ticker")))
    )


def fact_id():
    return F.concat_ws("-", F.concat(F.lit("fact:"), "l_orderkey"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))


def edges(spark, d):
    cat, lit = F.concat, F.lit
    f, li, p = pf.filings(spark, d), table(spark, d, "lineitem"), table(spark, d, "part")
    e = lambda s, st, t, r, o: F.struct(s.alias("source"), lit(st).alias("source_type"), t.alias("target"), lit(r).alias("rel"), o.cast("long").alias("ordinal"))
    hub = cat(lit("entity:"), "ticker")
    order_edges = f.select("form", F.explode(F.array(
        e(hub, "finance.entity", F.col("id"), "has_filing", F.col("ordinal")), e(F.col("id"), "finance.filing", hub, "filed_by", lit(0)),
        e(F.col("id"), "finance.filing", cat(lit("filing:"), F.col("ordinal") * 2), "amends", lit(1)))).alias("e")).where("e.rel <> 'amends' or form = '10-K/A'").select("e.*")
    order_id = cat(lit("filing:"), "l_orderkey")
    fact_edges = li.select(F.explode(F.array(
        e(order_id, "finance.filing", fact_id(), "reports", F.col("l_linenumber") + 1), e(fact_id(), "finance.fact", order_id, "reported_in", lit(0)),
        e(fact_id(), "finance.fact", cat(lit("source:"), "l_partkey"), "sourced_from", lit(1)))).alias("e")).select("e.*")
    source_edges = p.select(e(cat(lit("source:"), "p_partkey"), "finance.source", cat(lit("filing:"), "p_partkey"), "belongs_to", lit(0)).alias("e")).select("e.*")
    return order_edges.unionByName(fact_edges).unionByName(source_edges)


GRAPH_SQL = "WITH " + pf.FILINGS_SQL + """,
facts AS (SELECT 'fact:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, * FROM lineitem),
nodes AS (SELECT 'entity:C' || c_custkey AS id, 'finance.entity' AS type, c_name AS title, 'C' || c_custkey AS ticker FROM customer
  UNION ALL SELECT id, 'finance.filing', ticker || ' FY' || fiscal_year || ' ' || form, ticker FROM filings
  UNION ALL SELECT id, 'finance.fact', 'Item ' || l_linenumber || ' ' || CASE l_returnflag WHEN 'R' THEN 'revenue' WHEN 'A' THEN 'cost' ELSE 'other' END, NULL FROM facts
  UNION ALL SELECT 'source:' || p_partkey, 'finance.source', p_name, NULL FROM part),
edges AS (SELECT 'entity:' || ticker AS source, 'finance.entity' AS source_type, id AS target, 'has_filing' AS rel, ordinal FROM filings
  UNION ALL SELECT id, 'finance.filing', 'entity:' || ticker, 'filed_by', 0 FROM filings
  UNION ALL SELECT id, 'finance.filing', 'filing:' || (ordinal * 2), 'amends', 1 FROM filings WHERE form = '10-K/A'
  UNION ALL SELECT 'filing:' || l_orderkey, 'finance.filing', id, 'reports', l_linenumber + 1 FROM facts
  UNION ALL SELECT id, 'finance.fact', 'filing:' || l_orderkey, 'reported_in', 0 FROM facts
  UNION ALL SELECT id, 'finance.fact', 'source:' || l_partkey, 'sourced_from', 1 FROM facts
  UNION ALL SELECT 'source:' || p_partkey, 'finance.source', 'filing:' || p_partkey, 'belongs_to', 0 FROM part)
"""


@query("corpus_counts", GRAPH_SQL + """,
n AS (SELECT type, count(*) AS c FROM nodes GROUP BY ROLLUP (type)), e AS (SELECT source_type AS type, count(*) AS c FROM edges GROUP BY ROLLUP (source_type))
SELECT coalesce(n.type, 'all') AS type, n.c AS n_nodes, coalesce(e.c, 0) AS n_links FROM n LEFT JOIN e ON n.type IS NOT DISTINCT FROM e.type""")
def corpus_counts(spark, d):
    """Node and link totals with their per-type parts: two small aggregates instead of a join of all nodes and edges."""
    n = nodes(spark, d).rollup("type").agg(F.count(F.lit(1)).alias("n_nodes"))
    e = edges(spark, d).rollup(F.col("source_type").alias("type")).agg(F.count(F.lit(1)).alias("n_links"))
    key = lambda df: df.withColumn("type", F.coalesce("type", F.lit("all")))
    return key(n).join(key(e), "type", "left").select("type", "n_nodes", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("compact_edges", GRAPH_SQL + """,
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ordinal, target) AS r FROM edges)
SELECT source, target, rel FROM k WHERE rel IN ('filed_by', 'amends', 'reported_in', 'sourced_from') OR (rel = 'has_filing' AND r <= 40) OR (rel = 'reports' AND r <= 30) OR (rel = 'belongs_to' AND r <= 8)""")
def compact_edges(spark, d):
    return op.compact_edges(edges(spark, d)).select("source", "target", "rel")


@query("valid_edges", GRAPH_SQL + "SELECT rel, count(*) AS n FROM edges WHERE target IN (SELECT id FROM nodes) GROUP BY rel")
def valid_edges(spark, d):
    return op.valid_edges(edges(spark, d), nodes(spark, d)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query("amends_links", GRAPH_SQL + "SELECT source, target FROM edges WHERE rel = 'amends' AND target IN (SELECT id FROM filings)")
def amends_links(spark, d):
    f = pf.filings(spark, d)
    e = f.where("form = '10-K/A'").select(F.col("id").alias("source"), F.concat(F.lit("filing:"), F.col("ordinal") * 2).alias("target"), F.lit("amends").alias("rel"))
    return op.valid_edges(e, f).select("source", "target")


@query("scoped_nodes", GRAPH_SQL + """
SELECT id, type FROM nodes WHERE ticker IN (SELECT 'C' || o_custkey FROM orders WHERE o_totalprice > 490000)""")
def scoped_nodes(spark, d):
    t = table(spark, d, "orders").where("o_totalprice > 490000").select(F.concat(F.lit("c"), "o_custkey").alias("ticker"))
    return op.scoped_nodes(nodes(spark, d), t).select("id", "type")


@query("context_node", GRAPH_SQL + """
SELECT n.id, coalesce(arg_min(e.target, e.ordinal) FILTER (e.target IN (SELECT id FROM nodes)), n.id) AS context FROM nodes n
LEFT JOIN edges e ON e.source = n.id AND e.rel = CASE n.type WHEN 'finance.entity' THEN 'has_filing' WHEN 'finance.source' THEN 'belongs_to' WHEN 'finance.fact' THEN 'reported_in' END
GROUP BY n.id""")
def context_node(spark, d):
    n = nodes(spark, d).dropDuplicates(["id"])  # a repeated line is one node
    return op.context_node(n.select(F.col("id").alias("question_id"), "id", "type"), edges(spark, d), n).select("id", "context")


QUESTION = "Which filing shows revenue and cost?"


@query("gather_evidence", GRAPH_SQL + """,
ctx AS (SELECT c_custkey AS q, 'entity:C' || c_custkey AS sel, coalesce(arg_min(e.target, e.ordinal), 'entity:C' || c_custkey) AS ctx FROM customer LEFT JOIN edges e ON e.source = 'entity:C' || c_custkey AND e.rel = 'has_filing' GROUP BY c_custkey),
base AS (SELECT q, sel AS node, 0 AS o FROM ctx UNION ALL SELECT q, ctx, 1 FROM ctx WHERE ctx <> sel),
fr AS (SELECT q, e.target AS node, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN contains(title, 'revenue') THEN 4 WHEN contains(title, 'cost') THEN 4 ELSE 0 END + 1 DESC, title DESC, o, e.ordinal, e.target) AS r
  FROM base JOIN edges e ON e.source = base.node AND e.rel = 'reports' JOIN nodes n ON n.id = e.target),
chosen AS (SELECT q, node, o FROM base UNION ALL SELECT q, node, r + 1 FROM fr WHERE r <= 4),
sr AS (SELECT q, e.target AS node, row_number() OVER (PARTITION BY q ORDER BY o, e.ordinal, e.target) AS r FROM chosen JOIN edges e ON e.source = chosen.node AND e.rel IN ('sourced_from', 'belongs_to')),
u AS (SELECT q, node, min(o) AS o FROM (SELECT * FROM chosen UNION ALL SELECT q, node, r + 10 FROM sr WHERE r <= 4 AND node IN (SELECT id FROM nodes WHERE type = 'finance.source')) GROUP BY ALL)
SELECT q AS question_id, node, CAST(row_number() OVER (PARTITION BY q ORDER BY o) AS INT) AS position FROM u QUALIFY position <= 8""")
def gather_evidence(spark, d):
    n = nodes(spark, d).withColumn("hay", F.col("title"))
    sel = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), F.lit(QUESTION).alias("question"), F.concat(F.lit("entity:C"), "c_custkey").alias("id"), F.lit("finance.entity").alias("type"))
    return op.gather_evidence(sel, edges(spark, d), n)


CENTERS_SQL = GRAPH_SQL + """,
own AS (SELECT source, target, rel, ordinal FROM edges WHERE rel IN ('has_filing', 'filed_by')),
near AS (SELECT a, b, min(ordinal) AS p FROM (SELECT source AS a, target AS b, ordinal FROM own UNION ALL SELECT target, source, ordinal FROM own) GROUP BY ALL),
c AS (SELECT 'entity:C' || c_custkey AS center FROM customer UNION ALL SELECT id FROM filings WHERE ordinal % 40 = 1),
f0 AS (SELECT center, center AS id, 0 AS hop, 1 AS place FROM c),
r1 AS (SELECT center, id, row_number() OVER (PARTITION BY center ORDER BY w, id) + 1 AS place FROM (SELECT center, b AS id, min((place, p)) AS w FROM f0 JOIN near ON a = id WHERE b <> center GROUP BY center, b)),
f1 AS (SELECT * FROM f0 UNION ALL SELECT center, id, 1, place FROM r1 WHERE place <= 120),
r2 AS (SELECT center, id, row_number() OVER (PARTITION BY center ORDER BY w, id) AS k FROM (
  SELECT f1.center, b AS id, min((place, p)) AS w FROM f1 JOIN near ON a = f1.id LEFT JOIN (SELECT center, id AS d FROM f1) g ON g.center = f1.center AND d = b WHERE hop = 1 AND d IS NULL GROUP BY f1.center, b)),
f2 AS (SELECT * FROM f1 UNION ALL SELECT r2.center, id, 2, k + n FROM r2 JOIN (SELECT center, count(*) AS n FROM f1 GROUP BY ALL) USING (center) WHERE k + n <= 120)
"""


def centers(spark, d):
    """All companies, and each filing with a number 1 beyond a multiple of 40."""
    own = edges(spark, d).where(F.col("rel").isin(*op.fixed.COMPANY_FILING_RELS)).select("source", "target", "rel", F.col("ordinal").alias("position"))
    c = table(spark, d, "customer").select(F.concat(F.lit("entity:C"), "c_custkey").alias("center"))
    return own, c.unionByName(pf.filings(spark, d).where("ordinal % 40 = 1").select(F.col("id").alias("center")))


@query("neighborhood", CENTERS_SQL + "SELECT center, id, CAST(hop AS INT) AS hop, CAST(place AS INT) AS place FROM f2")
def neighborhood(spark, d):
    return op.neighborhoods(*centers(spark, d))


@query("neighborhood_links", CENTERS_SQL + """
SELECT DISTINCT x.center, source, target, rel FROM own JOIN f2 x ON source = x.id JOIN f2 y ON target = y.id AND x.center = y.center""")
def neighborhood_links(spark, d):
    """The company-filing edges among the nodes around each centre."""
    own, c = centers(spark, d)
    return op.neighborhood_links(own, op.neighborhoods(own, c))


@query("form_legend", GRAPH_SQL + """
SELECT CAST(p AS INT) AS position, ['10-K', '10-Q', '8-K', 'OTHER'][p] AS form, count(*) AS n_filings FROM (SELECT CASE upper(form) WHEN '10-K' THEN 1 WHEN '10-Q' THEN 2 WHEN '8-K' THEN 3 ELSE 4 END AS p FROM filings) GROUP BY p""")
def form_legend(spark, d):
    return op.forms_present(pf.filings(spark, d), ["10-K", "10-Q", "8-K"])


@query("node_overlay", GRAPH_SQL + """
SELECT id, CASE WHEN status = 'F' THEN form || '*' ELSE form END AS form, CASE WHEN status = 'F' AND price > 200000 THEN 'new ' || id WHEN status = 'F' THEN 'zz' ELSE 'old' END AS preview FROM filings""")
def node_overlay(spark, d):
    f = pf.filings(spark, d)
    n = f.select("id", "form", F.lit("old").alias("preview"))
    over = f.where("status = 'F'").select("id", F.lit("finance.filing").alias("type"), F.concat("form", F.lit("*")).alias("form"), F.when(F.col("price") > 200000, F.concat(F.lit("new "), "id")).otherwise("").alias("preview"))
    early = over.select("id", F.lit(0).alias("position"), "type", F.lit("zz").alias("form"), F.lit("zz").alias("preview"))
    late = over.select("id", F.lit(2).alias("position"), "type", F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("preview"))  # gives nothing
    over = over.withColumn("position", F.lit(1)).unionByName(early).unionByName(late)
    return op.node_overlay(n, over).select("id", "form", "preview")


CORPUS_SQL = GRAPH_SQL + """,
tl AS (SELECT id, ticker, lag(id) OVER w AS p, lead(id) OVER w AS n FROM filings WINDOW w AS (PARTITION BY ticker ORDER BY filing_date, accession)),
corpus AS (SELECT 'entity:' || ticker AS source, id AS target, 'has_filing' AS rel FROM tl UNION ALL SELECT id, 'entity:' || ticker, 'filed_by' FROM tl
  UNION ALL SELECT id, p, 'prior_filing' FROM tl WHERE p IS NOT NULL UNION ALL SELECT id, n, 'next_filing' FROM tl WHERE n IS NOT NULL
  UNION ALL SELECT source, target, rel FROM edges WHERE rel = 'amends' AND target IN (SELECT id FROM filings))
"""


def corpus(spark, d):
    f = fop.timeline(pf.filings(spark, d))
    a = pf.filings(spark, d).where("form = '10-K/A'").select(F.col("id").alias("source"), F.concat(F.lit("filing:"), F.col("ordinal") * 2).alias("target"), F.lit("amends").alias("rel"))
    return op.corpus_graph(f, a)


@query("corpus_graph", CORPUS_SQL + "SELECT source, target, rel FROM corpus")
def corpus_graph(spark, d):
    return corpus(spark, d)


@query("merge_links", CORPUS_SQL + """
SELECT source, target, rel FROM (SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY source, rel) AS r FROM corpus) WHERE r = 1""")
def merge_links(spark, d):
    return op.undirected_links(corpus(spark, d).withColumn("ordinal", F.lit(0)))


@query("edge_overlay", CORPUS_SQL + """
SELECT source, target, rel FROM corpus WHERE target IN (SELECT id FROM filings) AND source NOT IN (SELECT id FROM filings WHERE status = 'F')
UNION ALL SELECT id, p, 'amends' FROM (SELECT tl.*, status, price FROM tl JOIN filings USING (id)) WHERE status = 'F' AND price > 200000 AND p IS NOT NULL""")
def edge_overlay(spark, d):
    """Finished filings keep one amending edge if they are large, and none otherwise; targets outside the graph go."""
    c, f = corpus(spark, d), fop.timeline(pf.filings(spark, d))
    edge = lambda target: F.array(F.struct(F.col(target).alias("target"), F.lit("amends").alias("rel")))
    over = f.where("status = 'F'").select("id", F.lit(1).alias("position"), F.lit("finance.filing").alias("type"), F.when(F.col("price") > 200000, edge("prior_filing")).alias("edges"))
    over = over.unionByName(over.select("id", F.lit(0).alias("position"), "type", edge("id").alias("edges")))
    return op.edge_overlay(c, over, f)


@query("node_degree", CORPUS_SQL + """,
und AS (SELECT source AS a, target AS b FROM corpus UNION SELECT target, source FROM corpus),
n AS (SELECT id, 'finance.filing' AS type FROM filings UNION ALL SELECT 'entity:C' || c_custkey, 'finance.entity' FROM customer)
SELECT id, type, count(b) AS degree FROM n LEFT JOIN und ON a = id GROUP BY ALL""")
def node_degree(spark, d):
    n = nodes(spark, d).where(F.col("type").isin("finance.filing", "finance.entity"))
    return op.node_degree(n, corpus(spark, d), relations=None)


@query("node_search", GRAPH_SQL + "SELECT id, title FROM nodes WHERE contains(lower(concat_ws(' ', title, ticker)), 'fy2019 10-k') ORDER BY id LIMIT 40")
def node_search(spark, d):
    return op.node_search(nodes(spark, d), " FY2019 10-K ").select("id", "title")


@query("corpus_index", CORPUS_SQL + """
SELECT 'company' AS section, ticker AS key, CAST(count(*) AS VARCHAR) AS value FROM filings GROUP BY ticker
UNION ALL SELECT 'path', id, 'filings/' || ticker || '/' || accession || '.md' FROM filings
UNION ALL SELECT 'count', 'links', CAST(count(*) AS VARCHAR) FROM corpus UNION ALL SELECT 'count', 'nodes', CAST((SELECT count(*) FROM filings) + (SELECT count(DISTINCT ticker) FROM filings) AS VARCHAR)""")
def corpus_index(spark, d):
    f = pf.filings(spark, d)
    comp = f.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    row = lambda s, k, v: (F.lit(s).alias("section"), k.alias("key"), v.cast("string").alias("value"))
    return (
        comp.select(*row("company", F.col("ticker"), F.col("n")))
        .unionByName(f.select(*row("path", F.col("id"), F.concat(F.lit("filings/"), "ticker", F.lit("/"), "accession", F.lit(".md")))))
        .unionByName(corpus(spark, d).agg(F.count(F.lit(1)).alias("n")).select(*row("count", F.lit("links"), F.col("n"))))
        .unionByName(comp.agg((F.sum("n") + F.count(F.lit(1))).alias("n")).select(*row("count", F.lit("nodes"), F.col("n"))))
    )
