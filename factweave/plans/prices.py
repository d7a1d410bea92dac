"""Queries on prices and macro series; events stand in for trades of a user's instrument."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave import schemas
from factweave.functions import fixed
from factweave.functions import scalars as sc
from factweave.operators import prices as op
from factweave.plans.base import Area
from factweave.sources import acquisition as acq
from factweave.sources.tables import table

area = Area()
QUERIES, ORACLES, query = area.queries, area.oracles, area.query


def bars(spark, d):
    """Daily bars per instrument in one combining aggregate."""
    e = table(spark, d, "events").select(F.concat(F.lit("U"), "user_id").alias("ticker"), F.to_date("ts").alias("date"), "ts", "event_id", "value")
    at = F.struct("ts", "event_id")
    return e.groupBy("ticker", "date").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"),
        F.max_by("value", at).alias("adj_close"), F.count(F.lit(1)).alias("volume"))


BARS_SQL = """
bars AS (SELECT 'U' || user_id AS ticker, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close,
  arg_max(value, (ts, event_id)) AS adj_close, count(*) AS volume FROM events GROUP BY ALL)
"""


@query("price_asof", "WITH " + BARS_SQL + """,
req AS (SELECT event_id, 'U' || user_id AS ticker, CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN CAST(ts AS DATE) - 40 ELSE CAST(ts AS DATE) - 2 END AS target FROM events)
SELECT event_id, strftime(session, '%Y-%m-%d') AS session, close, volume, CASE WHEN session IS NULL THEN 'no local price on or before target' WHEN target IS NULL THEN 'latest stored session' ELSE 'on or before target' END AS status
FROM (SELECT r.*, b.date AS session, close, volume FROM (SELECT *, coalesce(target, DATE '9999-12-31') AS a FROM req) r ASOF LEFT JOIN bars b ON r.ticker = b.ticker AND r.a >= b.date)""")
def price_asof(spark, d):
    day = F.to_date("ts")
    t = F.when(F.col("event_type") == "signup", F.lit(None).cast("date")).when(F.col("event_type") == "error", F.date_sub(day, 40)).otherwise(F.date_sub(day, 2))
    req = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.concat(F.lit("U"), "user_id").alias("ticker"), t.alias("target"))
    x = op.price_asof(req, bars(spark, d))
    return x.select(F.col("request_id").alias("event_id"), F.col("session").cast("string").alias("session"), "close", "volume", "status")


@query("price_return", "WITH " + BARS_SQL + """,
e AS (SELECT ticker, count(*) AS n, max(date) AS end_date, arg_max(close, date) AS end_price FROM bars GROUP BY ticker),
s AS (SELECT ticker, any_value(n) AS n, any_value(end_date) AS end_date, any_value(end_price) AS end_price, min(date) AS start_date, arg_min(close, date) AS start_price, max(close) AS high, min(close) AS low
  FROM bars JOIN e USING (ticker) WHERE date >= end_date - 14 GROUP BY ticker)
SELECT ticker, strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date, start_price, end_price, high, low,
  CASE WHEN n < 2 THEN 'not enough rows' WHEN start_price = 0 THEN 'start price is zero' ELSE 'ok' END AS status,
  CASE WHEN n >= 2 AND start_price <> 0 THEN round((end_price / start_price - 1) * 100, 6) END AS return_pct FROM s""")
def price_return(spark, d):
    x = op.price_return(bars(spark, d).withColumn("price", F.col("adj_close")), 14)
    return x.select("ticker", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"), "start_price", "end_price", "high", "low", "status",
                    F.round("return_pct", 6).alias("return_pct"))


@query("price_scan", "WITH " + BARS_SQL + """
SELECT ticker, strftime(date, '%Y-%m-%d') AS date, CASE WHEN volume > 1 THEN close ELSE low END AS price, volume FROM bars WHERE volume <> 3""")
def price_scan(spark, d):
    """Price text rows: adjusted close or close; rows with an unreadable price or date are left out."""
    b = bars(spark, d)
    raw = b.select(F.concat(F.lower("ticker"), F.lit(".csv")).alias("file"), F.col("date").cast("string").alias("date"), F.when(F.col("volume") == 1, "").otherwise(F.col("close").cast("string")).alias("adj_close"),
                   F.col("low").cast("string").alias("close"), F.col("volume").cast("string").alias("volume"))
    bad = b.where("volume = 3").select(F.concat(F.lower("ticker"), F.lit(".csv")).alias("file"), F.lit("31/31/2024").alias("date"), F.lit("1").alias("adj_close"), F.lit("1").alias("close"), F.lit("1").alias("volume"))
    return acq.price_rows(raw.where("volume <> '3'").unionByName(bad)).select("ticker", F.col("date").cast("string").alias("date"), "price", "volume")


@query("chart_bars", """
SELECT 'E' || event_id AS ticker, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN i = 0 THEN value END AS open, CASE WHEN i = 0 THEN value * 2 ELSE value END AS close, CASE WHEN i = 0 THEN value END AS adj_close, CASE WHEN i = 1 THEN CAST(0.5 AS DOUBLE) END AS dividend,
  CASE WHEN i = 0 THEN '4:1' END AS split_ratio FROM events, (VALUES (0), (1)) v(i)""")
def chart_bars(spark, d):
    """Chart JSON per event: two stamps, a null and a short array, one dividend, one split."""
    sec = F.unix_timestamp(F.to_date("ts").cast("timestamp"))
    v = F.col("value").cast("string")
    js = F.format_string(
        '{"result":[{"timestamp":[%d,%d],"indicators":{"quote":[{"open":[%s,null],"close":[%s,%s],"volume":[1]}],"adjclose":[{"adjclose":[%s]}]},'
        '"events":{"dividends":{"%d":{"amount":0.5}},"splits":{"%d":{"numerator":4,"denominator":1}}}}]}',
        sec, sec + 3600, v, (F.col("value") * 2).cast("string"), v, v, sec + 3600, sec)
    raw = table(spark, d, "events").select(F.concat(F.lit("E"), "event_id").alias("ticker"), F.from_json(js, schemas.CHART.split(" ", 1)[1]).alias("chart"))
    return acq.chart_bars(raw).select("ticker", F.col("date").cast("string").alias("date"), "open", "close", "adj_close", "dividend", "split_ratio")


@query("macro_long", """
SELECT e.event_type AS series_id, coalesce(g.grp, 'file') AS grp, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, CASE WHEN value > 50 THEN NULL ELSE value END AS value FROM
  (SELECT CASE event_type WHEN 'view' THEN 'GDP' WHEN 'click' THEN 'SP500' WHEN 'signup' THEN 'UNRATE' ELSE event_type END AS event_type, ts, value FROM events) e
LEFT JOIN (VALUES ('GDP', 'growth'), ('SP500', 'markets_fx_commodities'), ('UNRATE', 'labor')) g(s, grp) ON g.s = e.event_type""")
def macro_long(spark, d):
    """Observations in long form with the group of their series; '.' is a missing value."""
    t = F.col("event_type")
    series = F.when(t == "view", "GDP").when(t == "click", "SP500").when(t == "signup", "UNRATE").otherwise(t)
    text = F.when(F.col("value") > 50, ".").otherwise(F.col("value").cast("string"))
    obs = table(spark, d, "events").select(series.alias("series_id"), F.to_date("ts").cast("string").alias("date"), text.try_cast("double").alias("value"))
    cat = acq.macro_catalog(spark, fixed.MACRO_SERIES)
    return obs.join(F.broadcast(cat), "series_id", "left").select("series_id", F.coalesce("grp", F.lit("file")).alias("grp"), "date", "value")


@query("scalar_money", """
WITH v AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) * CASE o_orderstatus WHEN 'F' THEN 1000 WHEN 'O' THEN 1 ELSE -100000 END AS v, o_orderstatus <> 'O' AS usd FROM orders),
c AS (SELECT *, CAST(abs(v) * 100 AS BIGINT) AS c, CASE WHEN abs(v) >= 1000000000 THEN 1000000000 ELSE 1000000 END AS u FROM v),
r AS (SELECT *, c // u AS q, c % u AS rest FROM c)
SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN usd THEN '$' ELSE '' END ||
  CASE WHEN abs(v) >= 1000000 THEN format('{:,.2f}', CAST(q + CASE WHEN rest * 2 > u OR (rest * 2 = u AND q % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100) || CASE WHEN u = 1000000 THEN ' million' ELSE ' billion' END
       ELSE regexp_replace(regexp_replace(format('{:,.4f}', CAST(abs(v) AS DOUBLE)), '0+$', ''), '\\.$', '') END AS shown FROM r""")
def scalar_money(spark, d):
    m = F.when(F.col("o_orderstatus") == "F", 1000).when(F.col("o_orderstatus") == "O", 1).otherwise(-100000).cast("decimal(8,0)")
    v = (F.col("o_totalprice").cast("decimal(18,2)") * m).cast("decimal(27,2)")
    unit = F.when(F.col("o_orderstatus") == "O", "shares").otherwise("usd")
    return table(spark, d, "orders").select("o_orderkey", sc.money(v, F.lit(None).cast("string"), unit).alias("shown"))
