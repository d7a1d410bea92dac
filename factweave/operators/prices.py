"""Price bars: as-of sessions and period returns per ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def price_asof(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """requests(request_id, ticker, target date or NULL) x bars(ticker, date, close, adj_close, volume).

    Latest session on or before the target; without a target the latest stored one; without any an explicit row.
    Requests are reduced to distinct (ticker, date) first, so each ticker's window holds at most one row per
    calendar day and kind, however many requests there are.
    """
    bar = F.struct(F.col("date").alias("session"), "close", "adj_close", "volume")
    far = F.lit("9999-12-31").cast("date")
    r = requests.withColumn("_at", F.coalesce("target", far))
    points = r.select("ticker", F.col("_at").alias("date")).distinct().withColumn("bar", F.lit(None).cast(bars.select(bar.alias("b")).schema["b"].dataType))
    line = bars.select("ticker", "date", bar.alias("bar")).unionByName(points)
    carried = F.last("bar", ignorenulls=True).over(W.partitionBy("ticker").orderBy("date", F.col("bar").isNull()).rowsBetween(W.unboundedPreceding, 0))
    found = line.withColumn("found", carried).where("bar is null").select("ticker", F.col("date").alias("_at"), "found")
    x = r.join(found, ["ticker", "_at"], "left")
    status = F.when(F.col("found").isNotNull(), F.when(F.col("target").isNull(), "latest stored session").otherwise("on or before target")).otherwise("no local price on or before target")
    return x.select("request_id", "ticker", "target", "found.*", status.alias("status"))


def price_return(bars: DataFrame, days: int = 365) -> DataFrame:
    """Return, high and low between the first session in the window and the last one.

    Ends and counts are aggregates; the second pass only aggregates rows joined to one row per ticker.
    """
    ends = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("end_date"), F.max_by("price", "date").alias("end_price"))
    x = bars.join(ends, "ticker").where((F.col("date") >= F.date_sub("end_date", days)))
    s = x.groupBy("ticker").agg(
        F.min("date").alias("start_date"), F.min_by("price", "date").alias("start_price"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.first("n").alias("n"), F.first("end_date").alias("end_date"), F.first("end_price").alias("end_price"))
    status = F.when(F.col("n") < 2, "not enough rows").when(F.col("start_price") == 0, "start price is zero").otherwise("ok")
    return s.withColumn("status", status).withColumn("return_pct", F.when(status == "ok", (F.col("end_price") / F.nullif(F.col("start_price"), F.lit(0.0)) - 1) * 100))
