"""Page text, links, front matter, readers and sinks."""

import json

from pyspark.sql import functions as F

from factweave.functions import scalars as sc
from factweave.functions import text as tx
from factweave.operators import filings as fop
from factweave.operators import text as top
from factweave.session import work_dir
from factweave.sources import acquisition as acq
from factweave.sources import sinks


def test_page_text_keeps_cells_apart(spark):
    html = "<html><script>var a='</p>'</script><nav>menu</nav><h1>Head</h1><table><tr><td>A&amp;B</td><td>1&nbsp;2</td></tr></table><p>x &eacute;</p></html>"
    assert spark.createDataFrame([(html,)], "h string").select(tx.page_text(F.col("h"))).first()[0] == "Head\n A&B | 1 2 | \n x é"


def test_windows_and_paragraphs(spark):
    text = "alpha\n\nbeta cash\n\ncash income\n\nincome"
    row = spark.createDataFrame([(text, "a" * 5000 + " cash " + "b" * 5000)], "t string, l string").select(
        tx.best_chunks(F.col("t"), F.array(F.lit("cash"), F.lit("income")), 3).alias("c"), tx.text_windows(F.col("l"), F.array(F.lit("cash")), 2000).alias("w")).first()
    assert [x.chunk for x in row.c] == ["cash income", "beta cash", "income"]
    assert len(row.w) == 2000


def test_money_rounds_half_even(spark):
    df = spark.sql("select cast(v as decimal(20,4)) v from values (1234500000), (-2665000), (1500), (2000000000000) as t(v)")
    got = [r[0] for r in df.select(sc.money(F.col("v"), F.lit("USD"), F.lit(None).cast("string"))).collect()]
    assert got == ["$1.23 billion", "-$2.66 million", "$1,500", "$2.00 trillion"]


def test_front_matter_and_structured_facts(spark):
    md = '---\ntitle: "A \\"B\\""\ntags:\n  - company/X\nedges:\n  - rel: amends\n    target: "f:1"\n  - rel: broken\n---\n\nBody'
    r = acq.front_matter(spark.createDataFrame([("p", md), ("q", "no header")], "path string, text string")).orderBy("path").collect()
    assert r[0].header["title"] == 'A "B"' and r[0].tags == ["company/X"] and [tuple(e) for e in r[0].edges] == [("amends", "f:1")] and r[0].body == "Body"
    assert r[1].header == {} and r[1].body == "no header"


def test_readers_and_sinks_round_trip(spark, tmp_path):
    base = work_dir(spark, "test")
    (tmp_path / "BRK-B.csv").write_text("date,open,high,low,close,adj_close,volume,dividend,split_ratio\n2025-10-31,1,1,1,517,515,100,,\nbad,1,1,1,1,1,1,,\n2025-11-03,1,1,1,520,,120,,\n")
    p = acq.read_prices(spark, str(tmp_path / "*.csv")).orderBy("date").collect()
    assert [(r.ticker, str(r.date), r.price) for r in p] == [("BRK.B", "2025-10-31", 515.0), ("BRK.B", "2025-11-03", 520.0)]
    (tmp_path / "msft.json").write_text(json.dumps({"ticker": "msft", "facts": [{"id": "a", "concept": "c", "roles": ["revenue"], "value": "1", "scale": "1", "period": {"fiscal_year": 2024}}]}))
    assert acq.read_fact_index(spark, str(tmp_path / "msft.json")).first().ticker == "MSFT"
    f = spark.sql("select 'T/1' ticker, 2024 fiscal_year, '10-K/A' form, date'2024-02-01' filing_date, 'x-1' accession")
    sinks.write_filings(f, base)
    have = sinks.filing_path(sinks.read_back(spark, base).withColumn("ticker", F.lit("T/1")))
    assert have.first().output == "filings/T-1/T-1-FY2024-10-K-A-2024-02-01-x-1.md" and sinks.new_filings(f, have).count() == 0


def test_price_source_budget_and_constituents(spark):
    e = spark.createDataFrame([("q", i, t, p, "text", x) for i, (t, p, x) in enumerate([
        ("finance.entity", "e", None), ("finance.filing", "a", "x"), ("finance.filing", "a", "x"), ("finance.filing", "b", "x"), ("finance.filing", "c", "x"), ("finance.filing", "d", "x"), ("finance.fact", "f", None)])],
        "question_id string, position int, type string, path string, preview string, excerpt string")
    assert [r.supplied for r in top.evidence_budget(e).orderBy("position").collect()] == [False, True, False, True, True, False, True]
    html = "<table><tr><th>Ticker symbol</th></tr><tr><td>brk.b</td></tr></table>"
    page = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [r.ticker for r in fop.constituents(page, exact=False).collect()] == ["BRK.B"] and fop.constituents(page).count() == 0
