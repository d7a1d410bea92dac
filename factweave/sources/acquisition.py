"""Readers for acquired JSON, CSV and Markdown, all with explicit schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave import schemas
from factweave.functions.columns import let


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SUBMISSIONS).json(path, multiLine=True)


def read_company_facts(spark: SparkSession, path: str) -> DataFrame:
    return flatten_company_facts(spark.read.schema(schemas.COMPANY_FACTS).json(path, multiLine=True))


def flatten_company_facts(raw: DataFrame) -> DataFrame:
    """facts[taxonomy][concept].units[unit][] -> one row per entry; form and fiscal fields describe the filing."""
    t = raw.select("cik", F.explode("facts").alias("taxonomy", "concepts"))
    c = t.select("cik", "taxonomy", F.explode("concepts").alias("concept", "body"))
    u = c.select("cik", "taxonomy", "concept", F.explode("body.units").alias("unit", "entries"))
    return u.select("cik", F.concat_ws(":", "taxonomy", "concept").alias("concept"), "unit", F.inline("entries"))


def read_fact_index(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per ticker -> canonical facts; load once and keep as Parquet by ticker (see sinks)."""
    return fact_index_rows(spark.read.schema(schemas.FACT_INDEX).json(path, multiLine=True))


def fact_index_rows(raw: DataFrame) -> DataFrame:
    """(ticker, facts[]) -> one row per fact with its position in the index."""
    x = raw.select("ticker", F.posexplode_outer("facts").alias("ordinal", "f")).where("f is not null")
    return x.select(F.upper(F.regexp_replace("ticker", "[^A-Za-z0-9]+", "-")).alias("ticker"), "f.*", F.col("ordinal").cast("long").alias("ordinal"))


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return price_rows(spark.read.schema(schemas.PRICES).csv(path, header=True).withColumn("file", F.col("_metadata.file_name")))


def price_rows(raw: DataFrame) -> DataFrame:
    """Typed bars; price = adjusted close or close; rows without a readable date or price are left out."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    price = F.coalesce(blank("adj_close"), blank("close")).try_cast("double")
    ticker = F.replace(F.upper(F.regexp_replace("file", r"\.csv$", "")), F.lit("-"), F.lit("."))
    return raw.select(ticker.alias("ticker"), F.try_to_date("date", "yyyy-MM-dd").alias("date"), price.alias("price"),
                      blank("close").try_cast("double").alias("close"), blank("volume").try_cast("long").alias("volume")).where("date is not null and price is not null")


def chart_bars(raw: DataFrame) -> DataFrame:
    """Chart JSON (ticker, chart) -> daily bars by array position; events are looked up by their time stamp."""
    r = raw.select("ticker", F.col("chart.result")[0].alias("r"))
    q, adj = F.col("r.indicators.quote")[0], F.col("r.indicators.adjclose")[0]["adjclose"]
    x = r.select("ticker", "r", F.posexplode("r.timestamp").alias("i", "ts"))
    at = lambda arr: F.get(arr, F.col("i"))
    key = F.col("ts").cast("string")
    split = F.element_at("r.events.splits", key)
    return x.select(
        "ticker", F.to_date(F.timestamp_seconds("ts")).alias("date"),
        *[at(q[c]).alias(c) for c in ("open", "high", "low", "close")], at(adj).alias("adj_close"), at(q["volume"]).alias("volume"),
        F.element_at("r.events.dividends", key)["amount"].alias("dividend"),
        F.when((split["numerator"] != 0) & (split["denominator"] != 0), F.concat_ws(":", split["numerator"].cast("long"), split["denominator"].cast("long"))).alias("split_ratio"),
    )


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    """Observation files named by series -> long rows; '.' and blanks become NULL."""
    raw = spark.read.schema(schemas.MACRO).csv(path, header=True).withColumn("file", F.col("_metadata.file_name"))
    return raw.select(F.regexp_replace("file", r"\.csv$", "").alias("series_id"), F.try_to_date("date", "yyyy-MM-dd").alias("date"),
                      F.col("value").try_cast("double").alias("value"), F.try_to_date("realtime_start", "yyyy-MM-dd").alias("realtime_start"),
                      F.try_to_date("realtime_end", "yyyy-MM-dd").alias("realtime_end"))


def macro_catalog(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    """(series_id, grp): the first group that names a series keeps it."""
    rows = [(s, g, i) for i, (s, g) in enumerate((s, g) for g, ids in groups.items() for s in ids)]
    df = spark.createDataFrame(rows, "series_id string, grp string, ordinal int")
    return df.groupBy("series_id").agg(F.min_by("grp", "ordinal").alias("grp"))


# ---- Markdown with front matter, structured filings ---------------------------------------------------------------


def scalar(c: Column) -> Column:
    t = F.trim(c)
    unq = F.when((F.length(t) >= 2) & t.startswith('"') & t.endswith('"'), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    return F.replace(unq, F.lit('\\"'), F.lit('"'))


def front_matter(docs: DataFrame) -> DataFrame:
    """docs(path, text) -> path, header map, tags, edges, body. Without closing fence all text is body."""
    has = F.col("text").startswith("---\n") & (F.locate("\n---", "text", 4) > 0)
    cut = F.locate("\n---", F.col("text"), 4)
    fm = F.when(has, F.substring("text", F.lit(5), cut - 5)).otherwise("")
    body = F.when(has, F.ltrim(F.regexp_replace(F.substring("text", cut + 4, F.length("text")), r"^\s+", ""))).otherwise(F.col("text"))
    x = docs.select("path", fm.alias("fm"), body.alias("body"))
    lines = F.filter(F.split("fm", "\n"), lambda l: F.regexp_like(l, F.lit(r"^[A-Za-z_][\w.-]*:\s*\S")))
    pairs = F.transform(lines, lambda l: F.struct(F.regexp_extract(l, r"^([^:]+):", 1).alias("key"), scalar(F.regexp_extract(l, r"^[^:]+:\s*(.+)$", 1)).alias("value")))
    # a repeated key keeps its first value
    firsts = F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1))
    block = lambda key: F.regexp_extract("fm", rf"(?m)^{key}:[ \t]*\n((?:(?:[ \t].*|- .*)(?:\n|$))*)", 1)
    items = F.filter(F.transform(F.split(block("tags"), "\n"), lambda l: F.trim(l)), lambda l: l.startswith("- "))
    tags = F.transform(items, lambda l: scalar(F.substring(l, F.lit(3), F.length(l))))
    records = F.filter(F.split(F.concat(F.lit("\n"), block("edges")), r"\n\s*- "), lambda r: F.trim(r) != "")
    field = lambda r, k: F.nullif(scalar(F.regexp_extract(r, rf"(?m)^\s*{k}:[ \t]*(.*)$", 1)), F.lit(""))
    edges = F.filter(F.transform(records, lambda r: F.struct(field(r, "rel").alias("rel"), field(r, "target").alias("target"))), lambda e: e["target"].isNotNull())
    return x.select("path", firsts.alias("header"), tags.alias("tags"), edges.alias("edges"), "body")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return front_matter(raw)


def structured_facts(docs: DataFrame) -> DataFrame:
    """docs(path, text) in the structured filing layout -> (path, fact_no, fields map).

    The part before ``text_facts:`` is cut into records at ``- fact_id:``; fields sit at indent 4, period fields at 6.
    """
    numeric = F.element_at(F.split(F.col("text"), r"(?m)^text_facts:", 2), 1)
    records = F.split(numeric, r"(?m)^  - fact_id:")
    unquote = lambda v: F.regexp_replace(F.trim(v), r'^"+|"+$', "")
    pair = lambda l, prefix: F.struct(F.concat(F.lit(prefix), F.regexp_extract(l, r"^\s*([A-Za-z0-9_.-]+):", 1)).alias("key"), unquote(F.regexp_extract(l, r"^[^:]*:\s*(.*)$", 1)).alias("value"))

    def fields(r):
        def pairs(lines):
            top = F.transform(F.filter(lines, lambda l: F.regexp_like(l, F.lit(r"^\s{4}[A-Za-z0-9_.-]+:"))), lambda l: pair(l, ""))
            per = F.transform(F.filter(lines, lambda l: F.regexp_like(l, F.lit(r"^\s{6}(end|instant|fiscal_year):"))), lambda l: pair(l, "period."))
            return F.concat(top, per)

        def last_wins(all_pairs):
            keys = F.transform(all_pairs, lambda p: p["key"])
            return F.map_from_entries(F.filter(all_pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"])))

        return let(let(F.split(r, "\n"), pairs), last_wins)

    def plain_fields(r):
        """The same for a record without odd blanks and with each key once: its lines need no pattern but one."""
        lines = F.filter(F.split(F.concat(F.lit("\n"), r), "\n    "), lambda l: F.regexp_like(l, F.lit(r"^(?:[A-Za-z0-9_.-]+|  (?:end|instant|fiscal_year)):")))
        key = lambda k: F.when(k.startswith("  "), F.concat(F.lit("period."), F.substring(k, F.lit(3), F.length(k)))).otherwise(k)
        value = lambda l: F.btrim(F.trim(F.substring(l, F.locate(":", l) + 1, F.length(l))), F.lit('"'))
        both = let(lines, lambda ls: F.struct(F.transform(ls, lambda l: key(F.substring_index(l, ":", 1))).alias("keys"), F.transform(ls, lambda l: value(F.substring_index(l, "\n", 1))).alias("values")))
        return let(both, lambda b: F.when(F.size(F.array_distinct(b["keys"])) == F.size(b["keys"]), F.map_from_arrays(b["keys"], b["values"])).otherwise(fields(r)))

    # parsed inside the generator, so that no later expression parses a record again
    after_first = lambda records: F.slice(records, 2, F.greatest(F.size(records) - 1, F.lit(1)))
    plain_records = F.split(F.substring_index(F.concat(F.lit("\n"), "text"), "\ntext_facts:", 1), "\n  - fact_id:")
    odd = reduce(lambda a, b: a | b, [F.contains("text", F.lit(c)) for c in "\t\x0b\f\r\x85\u2028\u2029"])
    parsed = F.when(~odd, F.transform(after_first(plain_records), plain_fields)).otherwise(F.transform(after_first(records), fields))
    return docs.select("path", F.posexplode(parsed).alias("fact_no", "fields"))
