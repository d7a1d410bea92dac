"""Queries on filing tables; every order gives one Markdown document, its priority decides the table's shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions import cells as ce
from factweave.operators import tables as op
from factweave.plans.base import Area
from factweave.sources.tables import table

area = Area()
QUERIES, ORACLES, query = area.queries, area.oracles, area.query

# {p} price with separators, {k} customer number and a half, {q} a two-digit number, {id} order
SHAPES = {
    "1-URGENT": "# Note {id}\n\nCash table\n\n| As of | Cost | Fair Value |\n| --- | --- | --- |\n|  | (In millions) |  |\n| Cash | $ {p} | $ — |\n| Funds | {p} | {k} |\n\nend\n",
    "2-HIGH": "(in millions, except per share data and ratios)\n\n| Line | 2020 | 2019 | Change |  |\n| --- | --- | --- | --- | --- |\n| Total net revenue | $ {p} | $ {k} | ({q} | )% |\n"
              "| Diluted earnings per share | $ 0.78 | $ 2.65 | (71 | ) |\n| Loss | ({k}) | {p} | 5 | % |\n",
    "3-MEDIUM": "Activity (in millions, except number of shares, which are reflected in thousands):\n\n| Period | Shares purchased | Total cost |\n| --- | --- | --- |\n| Total: |  |  |\n| July | {k} | $ {p} |\n| Rate of return % | 5 | 6 |\n",
    "4-NOT SPECIFIED": "Before\n\n| Year | Revenue |\n| --- | --- |\n| 2025 | $ {p} |\n\nAfter\n",
    "5-LOW": "Intro\n| a | b |\n| --- | --- |\n| {k} |\n\n| only |\n| --- |\n| {k} | \ntext",
}
REPAIRED = {
    "1-URGENT": "# Note {id}\n\nCash table\n\n| As of | Cost | Fair Value |\n| --- | --- | --- |\n|  | (In millions) | (In millions) |\n| Cash | $ {p}M | $ — |\n| Funds | $ {p}M | $ {k}M |\n\nend\n",
    "2-HIGH": "(in millions, except per share data and ratios)\n\n| Line | 2020 | 2019 | Change |\n| --- | --- | --- | --- |\n| Total net revenue | $ {p}M | $ {k}M | -{q} % |\n"
              "| Diluted earnings per share | $ 0.78 | $ 2.65 | -71 |\n| Loss | -$ {k}M | $ {p}M | 5 % |\n",
    "3-MEDIUM": "Activity (in millions, except number of shares, which are reflected in thousands):\n\n| Period | Shares purchased | Total cost |\n| --- | --- | --- |\n| Total: |  |  |\n| July | {k}K | $ {p}M |\n| Rate of return % | 5 | 6 |\n",
    "4-NOT SPECIFIED": SHAPES["4-NOT SPECIFIED"],
    "5-LOW": SHAPES["5-LOW"],
}


def docs(spark, d):
    # short rows grow to documents of many lines, and a small file is one task: they are spread before they grow
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").repartition(parts, "o_orderkey")
    slot = {"{p}": F.format_number("o_totalprice", 2), "{k}": F.concat(F.col("o_custkey").cast("string"), F.lit(".5")), "{q}": (F.col("o_custkey") % 90 + 10).cast("string"), "{id}": F.col("o_orderkey").cast("string")}
    body = F.lit(None).cast("string")
    for kind, shape in SHAPES.items():
        text = F.lit(shape)
        for mark, value in slot.items():
            text = F.replace(text, F.lit(mark), value)
        body = F.when(F.col("o_orderpriority") == kind, text).otherwise(body)
    return o.select(F.col("o_orderkey").alias("doc_id"), body.alias("body"))


def _case(shapes: dict[str, str]) -> str:
    quote = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    arms = " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in shapes.items())
    return f"replace(replace(replace(replace(CASE kind {arms} END, '{{p}}', p), '{{k}}', k), '{{q}}', q), '{{id}}', CAST(doc_id AS VARCHAR))"


DOCS_SQL = f"""WITH o AS (SELECT o_orderkey AS doc_id, o_orderpriority AS kind, format('{{:,.2f}}', o_totalprice) AS p, o_custkey || '.5' AS k, CAST(o_custkey % 90 + 10 AS VARCHAR) AS q FROM orders),
docs AS (SELECT doc_id, kind, p, k, q, {_case(SHAPES)} AS body, {_case(REPAIRED)} AS repaired FROM o)
"""
LINES_SQL = DOCS_SQL + """,
lines AS (SELECT doc_id, kind, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, kind, string_split(CASE WHEN ends_with(body, chr(10)) THEN left(body, length(body) - 1) ELSE body END, chr(10)) AS l FROM docs)),
f AS (SELECT *, starts_with(line, '|') AS t, starts_with(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '|') AS pt FROM lines),
b AS (SELECT *, sum(CASE WHEN t AND NOT coalesce(pt, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM f),
blocks AS (SELECT doc_id, kind, block, min(line_no) AS first_line, count(*) AS n_lines FROM b WHERE t GROUP BY ALL)
"""


def parsed(spark, d):
    return op.parse_tables(op.with_context(op.segments(docs(spark, d))))


def structure(spark, d):
    return op.repair_structure(parsed(spark, d))


def sound(repaired):
    """Segments that are sound tables."""
    return op.each_segment(repaired).where("rows is not null")


def scaled(spark, d):
    return op.scale_cells(op.with_policy(structure(spark, d)))


def cells(spark, d):
    return op.each_cell(scaled(spark, d))


@query("table_blocks", LINES_SQL + "SELECT doc_id, CAST(first_line AS INT) AS first_line, CAST(n_lines AS INT) AS n_lines FROM blocks")
def table_blocks(spark, d):
    return op.each_segment(op.segments(docs(spark, d))).where("is_table").select("doc_id", "first_line", F.size("lines").alias("n_lines"))


@query("table_context", LINES_SQL + """
SELECT doc_id, CAST(first_line AS INT) AS first_line, CASE WHEN kind = '1-URGENT' THEN 'Cash table' WHEN kind = '4-NOT SPECIFIED' THEN 'Before' WHEN kind = '5-LOW' THEN CASE WHEN block = 1 THEN 'Intro' ELSE '' END
  WHEN kind = '2-HIGH' THEN '(in millions, except per share data and ratios)' ELSE 'Activity (in millions, except number of shares, which are reflected in thousands):' END AS context FROM blocks""")
def table_context(spark, d):
    return op.each_segment(op.with_context(op.segments(docs(spark, d)))).where("is_table").select("doc_id", "first_line", "context")


@query("table_cells", LINES_SQL + """
SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(generate_subscripts(c, 1) - 1 AS INT) AS col_no, trim(unnest(c)) AS cell FROM (SELECT doc_id, line_no, string_split(substring(trim(line), 2, length(trim(line)) - 2), '|') AS c FROM lines WHERE starts_with(line, '|'))""")
def table_cells(spark, d):
    x = docs(spark, d).select("doc_id", F.posexplode(op.lines_of(F.col("body"))).alias("line_no", "line")).where(F.ltrim("line").startswith("|")).select("doc_id", "line_no", F.posexplode(op.row_cells(F.col("line"))).alias("col_no", "cell"))
    return x.select("doc_id", "line_no", "col_no", "cell")


@query("table_validity", LINES_SQL + """
SELECT doc_id, CAST(first_line AS INT) AS first_line, CASE WHEN kind = '5-LOW' THEN CASE WHEN block = 1 THEN 'inconsistent source row widths' ELSE 'not a complete Markdown table' END ELSE 'ok' END AS state FROM blocks""")
def table_validity(spark, d):
    return op.each_segment(parsed(spark, d)).where("is_table").select("doc_id", "first_line", F.coalesce("reason", F.lit("ok")).alias("state"))


@query("units_propagate", DOCS_SQL + "SELECT doc_id, '|(In millions)|(In millions)' AS units_row FROM docs WHERE kind = '1-URGENT'")
def units_propagate(spark, d):
    x = op.each_segment(parsed(spark, d)).select("doc_id", F.explode("rows").alias("r")).select("doc_id", "r", F.explode(F.array(op.spread_units(F.col("r")))).alias("filled"))
    return x.where("filled <> r").select("doc_id", F.array_join("filled", "|").alias("units_row"))


@query("token_merge", DOCS_SQL + "SELECT doc_id, CAST(CASE kind WHEN '2-HIGH' THEN 3 ELSE 0 END AS INT) AS negatives, CAST(0 AS INT) AS moved FROM docs WHERE kind <> '5-LOW'")
def token_merge(spark, d):
    return sound(structure(spark, d)).select("doc_id", "negatives", "moved")


@query("accounting_negatives", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN '-' || format('{:,.2f}', l_extendedprice) WHEN 'A' THEN '-$' || CAST(l_linenumber AS VARCHAR) ELSE '-' || l_linenumber || ' %' END AS shown FROM lineitem""")
def accounting_negatives(spark, d):
    n = F.col("l_linenumber").cast("string")
    raw = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("( "), F.format_number("l_extendedprice", 2), F.lit(" )"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("$ ("), n, F.lit(")"))).otherwise(F.concat(F.lit("("), n, F.lit(")%")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", ce.accounting_negative(raw).alias("shown"))


@query("first_data_row", DOCS_SQL + "SELECT doc_id, CAST(CASE WHEN kind IN ('1-URGENT', '3-MEDIUM') THEN 3 ELSE 2 END AS INT) AS start FROM docs WHERE kind <> '5-LOW'")
def first_data_row(spark, d):
    return sound(structure(spark, d)).select("doc_id", op.first_data_row(F.col("rows")).alias("start"))


@query("drop_empty_columns", DOCS_SQL + "SELECT doc_id, CAST(CASE kind WHEN '2-HIGH' THEN 1 ELSE 0 END AS INT) AS removed_columns, CASE kind WHEN '1-URGENT' THEN 'As of|Cost|Fair Value' WHEN '2-HIGH' THEN 'Line|2020|2019|Change' WHEN '3-MEDIUM' THEN 'Period|Shares purchased|Total cost' ELSE 'Year|Revenue' END AS header FROM docs WHERE kind <> '5-LOW'")
def drop_empty_columns(spark, d):
    return sound(structure(spark, d)).select("doc_id", "removed_columns", F.array_join(F.col("rows")[0], "|").alias("header"))


@query("column_descriptors", DOCS_SQL + "SELECT doc_id, CASE kind WHEN '1-URGENT' THEN 'As of;Cost (In millions);Fair Value (In millions)' WHEN '2-HIGH' THEN 'Line;2020;2019;Change' WHEN '3-MEDIUM' THEN 'Period Total:;Shares purchased;Total cost' ELSE 'Year;Revenue' END AS descriptors FROM docs WHERE kind <> '5-LOW'")
def column_descriptors(spark, d):
    return sound(op.with_policy(structure(spark, d))).select("doc_id", F.array_join("policy.descriptors", ";").alias("descriptors"))


@query("scale_policy", DOCS_SQL + """
SELECT doc_id, CASE WHEN kind IN ('2-HIGH', '3-MEDIUM') THEN 'M' END AS default_scale, CASE kind WHEN '3-MEDIUM' THEN 'K' END AS share_scale, CASE kind WHEN '2-HIGH' THEN 'per_share,ratio' ELSE '' END AS exceptions, 0 AS currency_default FROM docs WHERE kind <> '5-LOW'""")
def scale_policy(spark, d):
    return sound(op.with_policy(structure(spark, d))).select("doc_id", "policy.default_scale", "policy.share_scale", F.array_join("policy.exceptions", ",").alias("exceptions"), F.col("policy.currency_default").cast("int").alias("currency_default"))


@query("section_context", DOCS_SQL + "SELECT doc_id, CAST(unnest([3, 4]) AS INT) AS row_no, 'Total:' AS section FROM docs WHERE kind = '3-MEDIUM'")
def section_context(spark, d):
    return op.each_row(scaled(spark, d)).where("section <> ''").select("doc_id", "row_no", "section")


@query("currency_columns", DOCS_SQL + "SELECT doc_id, CAST(unnest(CASE kind WHEN '2-HIGH' THEN [1, 2] WHEN '3-MEDIUM' THEN [2] ELSE [1] END) AS INT) AS col_no FROM docs WHERE kind <> '5-LOW'")
def currency_columns(spark, d):
    return cells(spark, d).where("currency_column and row_no = 0").select("doc_id", "col_no")


CHOICE_SQL = DOCS_SQL + """,
c AS (SELECT doc_id, CAST(x.r AS INT) AS row_no, CAST(x.c AS INT) AS col_no, x.s AS scale, x.v AS new_value FROM (SELECT doc_id, unnest(CASE kind
  WHEN '1-URGENT' THEN [{'r': 3, 'c': 1, 's': 'M', 'v': '$ ' || p || 'M'}, {'r': 4, 'c': 1, 's': 'M', 'v': '$ ' || p || 'M'}, {'r': 4, 'c': 2, 's': 'M', 'v': '$ ' || k || 'M'}]
  WHEN '2-HIGH' THEN [{'r': 2, 'c': 1, 's': 'M', 'v': '$ ' || p || 'M'}, {'r': 2, 'c': 2, 's': 'M', 'v': '$ ' || k || 'M'}, {'r': 4, 'c': 1, 's': 'M', 'v': '-$ ' || k || 'M'}, {'r': 4, 'c': 2, 's': 'M', 'v': '$ ' || p || 'M'}]
  WHEN '3-MEDIUM' THEN [{'r': 3, 'c': 1, 's': 'K', 'v': k || 'K'}, {'r': 3, 'c': 2, 's': 'M', 'v': '$ ' || p || 'M'}] END) AS x FROM docs))
"""


@query("scale_choice", CHOICE_SQL + "SELECT doc_id, row_no, col_no, scale FROM c")
def scale_choice(spark, d):
    return cells(spark, d).where("scale is not null").select("doc_id", "row_no", "col_no", "scale")


@query("scaled_cells", CHOICE_SQL + "SELECT doc_id, row_no, col_no, new_value FROM c")
def scaled_cells(spark, d):
    return cells(spark, d).where("new_value <> value").select("doc_id", "row_no", "col_no", "new_value")


@query("table_repair", DOCS_SQL + "SELECT doc_id, repaired AS new_body FROM docs")
def table_repair(spark, d):
    return op.repair_documents(docs(spark, d)).select("doc_id", "new_body")


@query("repair_report", DOCS_SQL + """
SELECT CASE kind WHEN '5-LOW' THEN 'inconsistent source row widths; not a complete Markdown table' ELSE '' END AS skip_reasons, count(*) AS files, count(*) FILTER (kind IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS changed_files, count(*) FILTER (kind IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS changed_tables,
  2 * count(*) FILTER (kind = '5-LOW') AS skipped_tables, count(*) FILTER (kind = '2-HIGH') AS removed_columns, 3 * count(*) FILTER (kind = '2-HIGH') AS negatives, 0::BIGINT AS moved,
  count(*) FILTER (kind = '3-MEDIUM') AS added_k, 3 * count(*) FILTER (kind = '1-URGENT') + 4 * count(*) FILTER (kind = '2-HIGH') + count(*) FILTER (kind = '3-MEDIUM') AS added_m FROM docs GROUP BY ALL""")
def repair_report(spark, d):
    x = op.repair_documents(docs(spark, d))
    total = lambda c: F.sum(c).cast("long").alias(c)
    return x.groupBy("skip_reasons").agg(F.count(F.lit(1)).alias("files"), F.count_if("changed").alias("changed_files"), *[total(c) for c in ("changed_tables", "skipped_tables", "removed_columns", "negatives", "moved", "added_k", "added_m")])


@query("repair_delta", DOCS_SQL + "SELECT doc_id, sha256(body) AS source_sha256, sha256(repaired) AS output_sha256 FROM docs WHERE body <> repaired")
def repair_delta(spark, d):
    return op.repair_documents(docs(spark, d)).where("changed").select("doc_id", "source_sha256", "output_sha256")


@query("table_measures", DOCS_SQL + "SELECT doc_id, 'Funds' AS label, CAST(replace(p, ',', '') AS DOUBLE) AS first_value, CAST(k AS DOUBLE) AS last_value, 0 AS conflict FROM docs WHERE kind = '1-URGENT'")
def table_measures(spark, d):
    x = op.labelled_measures(op.repair_documents(docs(spark, d)), ["Cash", "Funds", "Total net revenue"])
    return x.select("doc_id", "label", F.col("values")[0].cast("double").alias("first_value"), F.element_at("values", -1).cast("double").alias("last_value"), F.col("conflict").cast("int").alias("conflict"))
