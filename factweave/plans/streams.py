"""Streaming queries over the given tables, run to the end of the data at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.scalars import source_key
from factweave.plans import filings as pf
from factweave.plans import runs as pr
from factweave.plans.base import Area
from factweave.streaming import jobs

area = Area()
QUERIES, ORACLES, query = area.queries, area.oracles, area.query


def _conversations(spark, d):
    return jobs.read_table_stream(spark, d, "conversations")


def _evidence(spark, d):
    x = _conversations(spark, d).where("role = 'assistant'").select(F.concat(F.lit("v"), "conv_id").alias("vault"), "turn", (F.length("text") % 2 == 0).alias("cache_hit"), F.posexplode(F.split("text", "\n")).alias("position", "line"))
    word = F.split("line", " ")[0]
    kind = F.when(F.length("line") % 2 == 0, "finance.fact").otherwise("finance.filing")
    path = F.concat(F.lit("filings/"), F.left(word, F.lit(2)), F.lit(".md"))
    return x.select("vault", "turn", "position", "cache_hit", source_key(kind, path, word).alias("source_key"), F.sha2("line", 256).alias("content_hash"), F.struct("turn", (-F.col("position")).alias("p")).alias("at"))


@query("stream_metrics_upsert", pr.M_SQL + "SELECT question_id, agent, arg_max(total_tokens, source_turn) AS total_tokens, max(source_turn) AS source_turn FROM metrics GROUP BY ALL")
def stream_metrics_upsert(spark, d):
    c = _conversations(spark, d).where("role <> 'system'")
    m = c.select(F.concat_ws(".", "conv_id", F.floor(F.col("turn") / 2).cast("string")).alias("question_id"), F.when(F.col("role") == "user", "web").otherwise("local").alias("agent"),
                 F.length("text").cast("long").alias("total_tokens"), F.col("turn").alias("source_turn"), F.col("turn").alias("position"))
    return jobs.metrics_upsert(m, ["question_id", "agent"]).select("question_id", "agent", "total_tokens", "source_turn")


@query("stream_evidence_usage", pr.E_SQL + """
SELECT vault, source_key, min(turn) AS first_used, max(turn) AS last_used, count(*) AS use_count, CAST(arg_max(cache_hit, (turn, -position)) AS INT) AS cache_hit, arg_max(content_hash, (turn, -position)) AS content_hash FROM (SELECT vault, source_key, turn, arg_max(cache_hit, -position) AS cache_hit, arg_max(content_hash, -position) AS content_hash, min(position) AS position FROM ev1 GROUP BY ALL) GROUP BY ALL""")
def stream_evidence_usage(spark, d):
    x = jobs.evidence_usage(_evidence(spark, d))
    return x.select("vault", "source_key", "first_used", "last_used", "use_count", F.col("cache_hit").cast("int").alias("cache_hit"), "content_hash")


@query("stream_research_reuse")
def stream_research_reuse(spark, d):
    e = jobs.read_table_stream(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") < 5).alias("warned"))
    return jobs.research_reuse(e).select("request_id", "key", F.col("hit").cast("int").alias("hit"))


ORACLES["stream_research_reuse"] = pr.ORACLES["research_reuse"]


@query("stream_source_versions", pr.E_SQL + """,
c AS (SELECT *, CASE WHEN content_hash IS DISTINCT FROM lag(content_hash) OVER (PARTITION BY vault, source_key ORDER BY turn) THEN 1 ELSE 0 END AS changed FROM evidence)
SELECT vault, source_key, turn, CAST(sum(changed) OVER (PARTITION BY vault, source_key ORDER BY turn) AS BIGINT) AS version FROM c""")
def stream_source_versions(spark, d):
    return jobs.source_versions(_evidence(spark, d).drop("at", "cache_hit"))


@query("stream_filings", pf.MANIFEST_SQL + "SELECT ticker, accession, output FROM manifest WHERE state <> 'skipped_existing'")
def stream_filings(spark, d):
    """Outputs of half-done companies exist already; the stream adds the others."""
    from factweave.sources import sinks
    existing = pf.manifest(spark, d).where("state = 'skipped_existing'")
    f = sinks.filing_path(pf.filings(spark, d, jobs.read_table_stream(spark, d, "orders")))
    return jobs.new_filings(f.select("ticker", "accession", "output"), existing)


@query("stream_answers", pr.M_SQL + """,
a AS (SELECT question_id, agent, CASE WHEN total_tokens < 60 THEN 'failed' ELSE 'ok' END AS status, source_turn AS turn, total_tokens AS tokens FROM metrics QUALIFY row_number() OVER (PARTITION BY question_id, agent ORDER BY source_turn DESC) = 1)
SELECT question_id, agent, status, turn, tokens, 'answer' AS event FROM a
UNION ALL SELECT question_id, NULL, CASE WHEN bool_and(status = 'ok') THEN 'ok' ELSE 'failed' END, NULL, NULL, 'final' FROM a GROUP BY question_id HAVING count(*) = 2""")
def stream_answers(spark, d):
    tokens = F.length("text").cast("long")
    c = _conversations(spark, d).where("role <> 'system'").select(
        F.concat_ws(".", "conv_id", F.floor(F.col("turn") / 2).cast("string")).alias("question_id"), F.when(F.col("role") == "user", "web").otherwise("local").alias("agent"),
        "turn", F.when(tokens < 60, "failed").otherwise("ok").alias("status"), tokens.alias("tokens"))
    return jobs.answer_events(c, ["question_id"], ["web", "local"])


@query("stream_price_bars", """
SELECT 'U' || user_id AS ticker, strftime(ts, '%Y-%m-%d') AS date, arg_min(value, (ts, event_id)) AS open, count(*) AS volume FROM events GROUP BY ALL""")
def stream_price_bars(spark, d):
    e = jobs.read_table_stream(spark, d, "events").select(F.concat(F.lit("U"), "user_id").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    return jobs.price_bars(e).select("ticker", F.col("date").cast("string").alias("date"), "open", "volume")
