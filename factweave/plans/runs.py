"""Queries on saved runs; conversations stand in for vaults (user = web agent, assistant = local agent)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave import schemas
from factweave.operators import graph as gop
from factweave.operators import runs as op
from factweave.plans import standins as st
from factweave.plans.base import Area
from factweave.sources.tables import table

area = Area()
QUERIES, ORACLES, query = area.queries, area.oracles, area.query


def metrics(spark, d):
    c = table(spark, d, "conversations").where("role <> 'system'")
    n = F.length("text")
    qid = F.concat_ws(".", "conv_id", F.floor(F.col("turn") / 2).cast("string"))
    return c.select(
        qid.alias("question_id"), F.when(F.col("role") == "user", "web").otherwise("local").alias("agent"), n.alias("total_tokens"), (n * 1.5).alias("elapsed_ms"),
        F.lit("prov").alias("provider"), F.concat(F.lit("model-"), F.col("conv_id") % 3).alias("model"), F.when(n < 60, "failed").otherwise("ok").alias("status"),
        F.concat(F.lit("v"), "conv_id").alias("source_vault"), F.col("turn").alias("source_turn"))


M_SQL = """WITH metrics AS (
  SELECT conv_id || '.' || (turn // 2) AS question_id, CASE role WHEN 'user' THEN 'web' ELSE 'local' END AS agent, length(text) AS total_tokens, length(text) * 1.5::DOUBLE AS elapsed_ms,
    'prov' AS provider, 'model-' || (conv_id % 3) AS model, CASE WHEN length(text) < 60 THEN 'failed' ELSE 'ok' END AS status, 'v' || conv_id AS source_vault, turn AS source_turn
  FROM conversations WHERE role <> 'system'),
scan AS (SELECT *, elapsed_ms / 1000.0::DOUBLE AS elapsed_seconds, provider || '/' || model AS model_key FROM metrics WHERE status = 'ok'),
pairs AS (SELECT * FROM scan WHERE (question_id, model_key) IN (SELECT (question_id, model_key) FROM scan GROUP BY question_id, model_key HAVING count(DISTINCT agent) = 2))
"""
LABELS = {"local": "Evidence pipeline", "web": "Web research"}


def scan(spark, d):
    return op.metrics_scan(metrics(spark, d), LABELS)


def pairs(spark, d):
    return op.complete_pairs(scan(spark, d), ["question_id", "model_key"])


@query("metrics_scan", M_SQL + """
SELECT question_id, source_turn, CASE agent WHEN 'web' THEN 'Web research' ELSE 'Evidence pipeline' END AS agent_label, elapsed_seconds, model_key FROM scan""")
def metrics_scan(spark, d):
    return scan(spark, d).select("question_id", "source_turn", "agent_label", "elapsed_seconds", "model_key")


@query("paired_runs", M_SQL + "SELECT question_id, source_turn, agent, model_key FROM pairs")
def paired_runs(spark, d):
    return pairs(spark, d).select("question_id", "source_turn", "agent", "model_key")


@query("paired_questions", M_SQL + "SELECT question_id FROM scan WHERE agent = 'web' INTERSECT SELECT question_id FROM scan WHERE agent = 'local'")
def paired_questions(spark, d):
    s = scan(spark, d)
    return s.where("agent = 'web'").select("question_id").intersect(s.where("agent = 'local'").select("question_id"))


@query("cost_by_question", M_SQL + "SELECT question_id, agent, round(avg(total_tokens), 6) AS mean_tokens, round(avg(elapsed_seconds), 6) AS mean_seconds, count(*) AS n FROM pairs GROUP BY ALL")
def cost_by_question(spark, d):
    return op.cost(pairs(spark, d), ["question_id", "agent"]).select("question_id", "agent", F.round("mean_tokens", 6).alias("mean_tokens"), F.round("mean_seconds", 6).alias("mean_seconds"), "n")


@query("cost_by_model", M_SQL + "SELECT model_key, agent, round(avg(total_tokens), 6) AS mean_tokens, round(avg(elapsed_seconds), 6) AS mean_seconds, count(*) AS n FROM pairs GROUP BY ALL")
def cost_by_model(spark, d):
    return op.cost(pairs(spark, d), ["model_key", "agent"]).select("model_key", "agent", F.round("mean_tokens", 6).alias("mean_tokens"), F.round("mean_seconds", 6).alias("mean_seconds"), "n")


@query("cost_summary", M_SQL + """
SELECT agent, min(total_tokens) AS min_tokens, max(total_tokens) AS max_tokens, round(avg(total_tokens), 6) AS mean_tokens, min(elapsed_ms) AS min_ms, max(elapsed_ms) AS max_ms, round(avg(elapsed_ms), 6) AS mean_ms, count(*) AS runs FROM pairs GROUP BY agent""")
def cost_summary(spark, d):
    return pairs(spark, d).groupBy("agent").agg(
        F.min("total_tokens").cast("long").alias("min_tokens"), F.max("total_tokens").cast("long").alias("max_tokens"), F.round(F.avg("total_tokens"), 6).alias("mean_tokens"),
        F.min("elapsed_ms").alias("min_ms"), F.max("elapsed_ms").alias("max_ms"), F.round(F.avg("elapsed_ms"), 6).alias("mean_ms"), F.count(F.lit(1)).alias("runs"))


@query("cost_ratios", M_SQL + """
SELECT model_key, round(1 - CAST(sum(total_tokens) FILTER (agent = 'local') AS DOUBLE) / CAST(sum(total_tokens) FILTER (agent = 'web') AS DOUBLE), 6) AS token_reduction,
  round(avg(elapsed_seconds) FILTER (agent = 'web') / avg(elapsed_seconds) FILTER (agent = 'local'), 6) AS latency_ratio FROM pairs GROUP BY model_key""")
def cost_ratios(spark, d):
    return op.cost_ratios(pairs(spark, d), "local", "web").select("model_key", F.round("token_reduction", 6).alias("token_reduction"), F.round("latency_ratio", 6).alias("latency_ratio"))


@query("agent_results_scan", M_SQL + """,
f AS (SELECT *, source_turn // 2 AS turn FROM metrics WHERE model <> 'model-2')
SELECT model, agent, source_vault AS vault, CAST(turn AS INT) AS turn, total_tokens, count(*) OVER (PARTITION BY model, agent, source_vault, turn) AS copies FROM f""")
def agent_results_scan(spark, d):
    m = metrics(spark, d)
    file = F.concat("source_vault", F.lit("/results/turn-"), F.lpad(F.floor(F.col("source_turn") / 2).cast("string"), 3, "0"), F.lit("-"), "agent", F.lit(".json"))
    raw = m.select(file.alias("file"), F.from_json(F.to_json(F.struct("model", F.struct("total_tokens").alias("metrics"))), schemas.RESULT).alias("j")).select("file", F.col("j.model").alias("model"), "j.metrics.total_tokens")
    return op.results_from_files(raw, ["model-0", "model-1"]).select("model", "agent", "vault", "turn", "total_tokens", "copies")


@query("questions_flat", """
SELECT o_orderkey AS set_id, (o_orderkey % 50 + 1) || '.' || n AS short_id, 'Why ' || o_orderpriority || '?' AS prompt FROM orders, (VALUES (1), (12)) v(n)""")
def questions_flat(spark, d):
    o = table(spark, d, "orders")
    no = F.lpad((F.col("o_orderkey") % 50 + 1).cast("string"), 2, "0")
    sub = lambda n: F.format_string('{"id":"question-%s-%02d","label":"l","prompt":"Why %s?"}', no, F.lit(n), "o_orderpriority")
    js = F.concat(F.lit('{"source":"'), "o_orderkey", F.lit('","questions":[{"id":"q","title":"t","subquestions":['), sub(1), F.lit(","), sub(12), F.lit("]}]}"))
    x = op.questions_flat(o.select(F.from_json(js, schemas.QUESTION_SET).alias("j")).select("j.*"))
    return x.select(F.col("source").cast("long").alias("set_id"), "short_id", "prompt")


@query("metrics_upsert", M_SQL + """
SELECT question_id, agent, source_vault, source_turn, CASE WHEN status = 'ok' THEN elapsed_ms + 1 ELSE elapsed_ms END AS elapsed_ms, CAST(CASE WHEN total_tokens < 300 THEN 0 ELSE 1 END AS INT) AS first_batch
FROM metrics WHERE total_tokens < 300 OR status = 'ok'""")
def metrics_upsert(spark, d):
    m = metrics(spark, d).withColumn("position", F.col("source_turn"))
    x = op.metrics_upsert(m.where("total_tokens < 300"), m.where("status = 'ok'").withColumn("elapsed_ms", F.col("elapsed_ms") + 1))
    return x.select("question_id", "agent", "source_vault", "source_turn", "elapsed_ms", "first_batch")


@query("usage_totals", """
WITH c AS (SELECT conv_id, CASE WHEN role = 'user' THEN CASE WHEN length(text) >= 100 THEN length(text) END ELSE 10 END AS p, CASE WHEN role = 'assistant' THEN length(text) ELSE 5 END AS c FROM conversations)
SELECT 'v' || conv_id AS vault, CASE WHEN count(*) = count(p) THEN CAST(sum(p) AS BIGINT) END AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CASE WHEN count(*) = count(p) THEN CAST(sum(p + c) AS BIGINT) END AS total_tokens,
  CAST(bool_and(p IS NOT NULL) AS INT) AS usage_complete FROM c GROUP BY conv_id""")
def usage_totals(spark, d):
    n = F.length("text")
    c = table(spark, d, "conversations").select(
        F.concat(F.lit("v"), "conv_id").alias("vault"), F.when(F.col("role") == "user", F.when(n >= 100, n).otherwise(-1)).otherwise(10).alias("prompt_tokens"),
        F.when(F.col("role") == "assistant", n).otherwise(5).alias("completion_tokens"), F.lit(None).cast("int").alias("total_tokens"))
    return op.usage_totals(c, ["vault"]).withColumn("usage_complete", F.col("usage_complete").cast("int"))


# ---- audit --------------------------------------------------------------------------------------------------------

AUDIT_SQL = "WITH " + st.FACTS_SQL + """,
ref AS (SELECT ticker, fy, CAST(oi AS DOUBLE) / CAST(rev AS DOUBLE) * 100 AS expected FROM grains WHERE is_fy AND rev > 0),
panel AS (SELECT o_orderkey AS check_id, 'model-' || left(o_orderpriority, 1) AS model, CASE WHEN o_custkey % 2 = 0 THEN 'local' ELSE 'web' END AS agent, expected, o_totalprice >= 60000 AS ok, o_totalprice > 480000 AS inconsistent,
    CASE o_orderstatus WHEN 'F' THEN sgn || (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') WHEN 'O' THEN sgn || (cents // 100) || '.' || ((cents % 100) // 10) END AS token
  FROM (SELECT *, CASE WHEN expected < 0 THEN '-' ELSE '' END AS sgn, CAST(floor(abs(expected) * 100) AS BIGINT) AS cents FROM orders JOIN ref ON ref.ticker = 'S' || o_custkey AND ref.fy = year(o_orderdate) + 20)),
audit AS (SELECT *, CASE WHEN NOT ok THEN 'unavailable' WHEN token IS NULL THEN 'omitted' WHEN inconsistent THEN 'inconsistent'
    WHEN abs(CAST(token AS DOUBLE) - expected) <= 0.5::DOUBLE * pow(10.0::DOUBLE, -length(split_part(token, '.', 2))) THEN 'correct' ELSE 'incorrect' END AS status FROM panel)
"""


def panel(spark, d):
    """Reported margins (from orders) next to margins recomputed from the summed lines."""
    g = st.fact_grains(spark, d).where("q is null and seg is null and rev > 0")
    ref = g.select(F.concat(F.lit("S"), "l_suppkey").alias("ticker"), "fy", (F.col("oi").cast("double") / F.nullif(F.col("rev").cast("double"), F.lit(0.0)) * 100).alias("expected"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.concat(F.lit("S"), "o_custkey").alias("ticker"), (F.year("o_orderdate") + 20).alias("fy"))
    x = o.join(ref, ["ticker", "fy"])
    sgn = F.when(F.col("expected") < 0, "-").otherwise("")
    cents = F.floor(F.abs("expected") * 100)
    whole = F.floor(cents / 100).cast("string")
    token = F.when(F.col("o_orderstatus") == "F", F.concat(sgn, whole, F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))).when(
        F.col("o_orderstatus") == "O", F.concat(sgn, whole, F.lit("."), F.floor((cents % 100) / 10).cast("string")))
    return x.select(F.col("o_orderkey").alias("check_id"), F.concat(F.lit("model-"), F.left("o_orderpriority", F.lit(1))).alias("model"), F.when(F.col("o_custkey") % 2 == 0, "local").otherwise("web").alias("agent"),
                    "expected", (F.col("o_totalprice") >= 60000).alias("ok"), (F.col("o_totalprice") > 480000).alias("inconsistent"), token.alias("token"), F.lit(1.0).alias("scale"))


@query("panel_audit", AUDIT_SQL + "SELECT check_id, model, agent, round(expected, 6) AS expected, token, status FROM audit")
def panel_audit(spark, d):
    return op.panel_audit(panel(spark, d)).select("check_id", "model", "agent", F.round("expected", 6).alias("expected"), "token", "status")


@query("audit_tally", AUDIT_SQL + """
SELECT model, agent, count(*) FILTER (status = 'correct') AS correct, count(*) FILTER (status = 'incorrect') AS incorrect, count(*) FILTER (status = 'inconsistent') AS inconsistent,
  count(*) FILTER (status = 'omitted') AS omitted, count(*) FILTER (status = 'unavailable') AS unavailable FROM audit GROUP BY ALL""")
def audit_tally(spark, d):
    return op.audit_tally(op.panel_audit(panel(spark, d)), ["model", "agent"])


@query("coverage_rates", AUDIT_SQL + """
SELECT model, agent, round(count(*) FILTER (status = 'correct') / count(*), 6) AS correct_of_panel,
  round(count(*) FILTER (status = 'correct') / nullif(count(*) FILTER (status IN ('correct', 'incorrect', 'inconsistent')), 0), 6) AS correct_of_reported FROM audit GROUP BY ALL""")
def coverage_rates(spark, d):
    t = op.audit_tally(op.panel_audit(panel(spark, d)), ["model", "agent"])
    reported = F.col("correct") + F.col("incorrect") + F.col("inconsistent")
    return t.select("model", "agent", F.round(F.col("correct") / (reported + F.col("omitted") + F.col("unavailable")), 6).alias("correct_of_panel"),
                    F.round(F.col("correct") / F.nullif(reported, F.lit(0)), 6).alias("correct_of_reported"))


@query("token_presence", AUDIT_SQL + """
SELECT check_id, CAST(regexp_matches(answer, '(^|[^0-9.])' || regexp_escape(token) || '($|[^0-9.])') AS INT) AS present FROM (
  SELECT *, CASE WHEN ok THEN 'The margin was ' || token || '%, after 1' || token ELSE 'It was 1' || token || ' or ' || token || '5' END AS answer FROM panel WHERE token IS NOT NULL)""")
def token_presence(spark, d):
    t = F.col("token")
    answer = F.when(F.col("ok"), F.concat(F.lit("The margin was "), t, F.lit("%, after 1"), t)).otherwise(F.concat(F.lit("It was 1"), t, F.lit(" or "), t, F.lit("5")))
    return panel(spark, d).where("token is not null").select("check_id", op.token_present(answer, t).cast("int").alias("present"))


@query("finding_quotes", """
WITH f AS (SELECT doc_id, text, CASE WHEN lang = 'fr' THEN upper(q) ELSE q END AS quote FROM (SELECT *, string_split(text, '. ')[1] AS q FROM documents))
SELECT doc_id, CAST(contains(text, quote) AS INT) AS verbatim FROM f""")
def finding_quotes(spark, d):
    """Each finding (a first sentence, some of them altered) must stand verbatim in its saved text."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    q = F.split("text", r"\. ")[0]
    findings = docs.select("doc_id", F.when(F.col("lang") == "fr", F.upper(q)).otherwise(q).alias("quote"))
    return findings.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.contains("text", "quote").cast("int").alias("verbatim"))


@query("copy_check", """
WITH s AS (SELECT doc_id, 'doc' || doc_id || '.md' AS name, sha256(text) AS h FROM documents),
c AS (SELECT name, CASE WHEN quality = 0 THEN sha256(text || ' ') ELSE sha256(text) END AS h FROM (SELECT 'doc' || doc_id || '.md' AS name, text, quality, unnest(CASE WHEN toxic = 1 THEN [1, 2] ELSE [1] END) FROM documents JOIN labels USING (doc_id))),
n AS (SELECT name, count(*) AS n, max(h) AS h FROM c GROUP BY name)
SELECT doc_id AS source_id, s.name, s.h AS source_hash, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN s.h <> n.h THEN 'differs' ELSE 'ok' END AS status FROM s LEFT JOIN n USING (name)""")
def copy_check(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    src = docs.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("doc"), "doc_id", F.lit(".md")).alias("name"), F.col("text").alias("content"))
    lab = docs.join(table(spark, d, "labels"), "doc_id")
    path = F.concat(F.lit("documents/"), F.left(F.sha2("text", 256), F.lit(16)), F.lit("/doc"), "doc_id", F.lit(".md"))
    copies = lab.select(F.explode(F.when(F.col("toxic") == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))), F.regexp_extract(path, "([^/]+)$", 1).alias("name"),
                        F.when(F.col("quality") == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("content"))
    return op.copy_check(src, copies)


@query("scrub_results", """
SELECT conv_id, turn, 'answer,metrics{ms},parts[{x}],tags' AS kept, 1 AS n_tags FROM conversations""")
def scrub_results(spark, d):
    c = table(spark, d, "conversations")
    x = c.select("conv_id", "turn", F.struct(
        F.col("text").alias("answer"), F.lit("k").alias("API_Key"), F.struct(F.length("text").alias("ms"), F.lit("h").alias("headers")).alias("metrics"),
        F.array(F.struct(F.lit(1).alias("x"), F.lit("a").alias("authorization"))).alias("parts"), F.create_map(F.lit("Headers"), F.lit("1"), F.lit("ok"), F.col("role")).alias("tags")).alias("result"))
    y = op.scrub(x)
    t = y.schema["result"].dataType
    kept = f"answer,metrics{{{','.join(t['metrics'].dataType.names)}}},parts[{{{','.join(t['parts'].dataType.elementType.names)}}}],tags" if t.names == ["answer", "metrics", "parts", "tags"] else ",".join(t.names)
    return y.select("conv_id", "turn", F.lit(kept).alias("kept"), F.size("result.tags").alias("n_tags"))


# ---- runs and evidence ------------------------------------------------------------------------------------------------


def runs(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    return c.select(F.concat(F.lit("v"), "conv_id").alias("vault"), "turn", F.col("text").alias("answer"), (F.length("text") % 2 == 0).alias("cache_hit"),
                    F.when(F.col("conv_id") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("T"), F.col("conv_id") % 7)).alias("tickers"))


def evidence(spark, d):
    """One evidence row per line of an answer; the line's first word names the source."""
    x = runs(spark, d).select("vault", "turn", "cache_hit", F.posexplode(F.split("answer", "\n")).alias("position", "line"))
    word = F.split("line", " ")[0]
    kind = F.when(F.length("line") % 2 == 0, "finance.fact").otherwise("finance.filing")
    x = x.select("vault", "turn", "cache_hit", (F.col("position") + 1).alias("position"), kind.alias("type"), word.alias("source_id"), F.concat(F.lit("filings/"), F.left(word, F.lit(2)), F.lit(".md")).alias("path"),
                 F.sha2("line", 256).alias("content_hash"), F.when(F.length("line") > 80, F.concat(F.lit("T"), F.length(word))).alias("ticker"))
    from factweave.functions.scalars import source_key
    x = x.withColumn("source_key", source_key(F.col("type"), F.col("path"), F.col("source_id")))
    x = gop.first_occurrence(x, ["vault", "turn", "source_key"], ["position"])
    return x.withColumn("node_id", F.concat(F.lit("snapshot:"), "vault", F.lit(":"), F.left(F.sha2("source_key", 256), F.lit(12))))


E_SQL = """WITH runs AS (SELECT 'v' || conv_id AS vault, turn, text AS answer, length(text) % 2 = 0 AS cache_hit, CASE WHEN conv_id % 2 = 0 THEN '' ELSE 'T' || (conv_id % 7) END AS tickers FROM conversations WHERE role = 'assistant'),
lines AS (SELECT vault, turn, cache_hit, unnest(string_split(answer, chr(10))) AS line, generate_subscripts(string_split(answer, chr(10)), 1) AS position FROM runs),
ev0 AS (SELECT *, CASE WHEN length(line) % 2 = 0 THEN 'finance.fact' ELSE 'finance.filing' END AS type, string_split(line, ' ')[1] AS source_id, 'filings/' || left(string_split(line, ' ')[1], 2) || '.md' AS path, sha256(line) AS content_hash,
  CASE WHEN length(line) > 80 THEN 'T' || length(string_split(line, ' ')[1]) END AS ticker FROM lines),
ev1 AS (SELECT *, CASE WHEN type = 'finance.fact' THEN path || '#' || source_id ELSE path END AS source_key FROM ev0),
evidence AS (SELECT *, 'snapshot:' || vault || ':' || left(sha256(source_key), 12) AS node_id FROM ev1 QUALIFY row_number() OVER (PARTITION BY vault, turn, source_key ORDER BY position) = 1)
"""


@query("evidence_usage", E_SQL + """
SELECT vault, source_key, min(turn) AS first_used, max(turn) AS last_used, count(*) AS use_count, CAST(arg_max(cache_hit, turn) AS INT) AS cache_hit, arg_max(content_hash, turn) AS content_hash FROM evidence GROUP BY ALL""")
def evidence_usage(spark, d):
    return op.evidence_usage(evidence(spark, d)).withColumn("cache_hit", F.col("cache_hit").cast("int"))


@query("cache_hits", E_SQL + "SELECT 'model-' || (length(vault) % 3) AS model, count(*) AS runs, count(*) FILTER (cache_hit) AS cache_hits FROM runs GROUP BY ALL")
def cache_hits(spark, d):
    return runs(spark, d).groupBy(F.concat(F.lit("model-"), F.length("vault") % 3).alias("model")).agg(F.count(F.lit(1)).alias("runs"), F.count_if("cache_hit").alias("cache_hits"))


@query("latest_turn", E_SQL + "SELECT vault, max(turn) AS turn, arg_max(length(answer), turn) AS answer_length FROM runs GROUP BY vault")
def latest_turn(spark, d):
    return gop.last_occurrence(runs(spark, d), ["vault"], ["turn"]).select("vault", "turn", F.length("answer").cast("long").alias("answer_length"))


@query("turn_numbers", E_SQL + "SELECT vault, turn, row_number() OVER (PARTITION BY vault ORDER BY turn) AS turn_number FROM runs")
def turn_numbers(spark, d):
    return op.turn_numbers(runs(spark, d)).select("vault", "turn", "turn_number")


@query("source_versions", E_SQL + """,
c AS (SELECT *, CASE WHEN content_hash IS DISTINCT FROM lag(content_hash) OVER w THEN 1 ELSE 0 END AS changed FROM evidence WINDOW w AS (PARTITION BY vault, source_key ORDER BY turn)),
v AS (SELECT *, sum(changed) OVER (PARTITION BY vault, source_key ORDER BY turn) AS version FROM c)
SELECT vault, source_key, CAST(version AS BIGINT) AS version, content_hash, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS uses FROM v GROUP BY ALL""")
def source_versions(spark, d):
    return op.source_versions(evidence(spark, d))


TURN_SQL = E_SQL + """,
tg AS (SELECT vault, turn, vault AS source, vault || ':' || turn AS target, 'executes' AS rel FROM runs
  UNION ALL SELECT vault, turn, vault || ':' || turn, vault || ':answer:' || lpad(CAST(turn AS VARCHAR), 3, '0'), 'produces' FROM runs
  UNION ALL SELECT vault, turn, vault || ':' || turn, node_id, CASE WHEN cache_hit THEN 'reuses' ELSE 'binds' END FROM evidence)
"""


@query("turn_graph", TURN_SQL + "SELECT vault, turn, source, target, rel FROM tg")
def turn_graph(spark, d):
    return op.turn_graph(runs(spark, d), evidence(spark, d))


@query("vault_graph", TURN_SQL + """
SELECT vault, source, target, rel FROM tg UNION SELECT vault, vault || ':company:' || ticker, node_id, 'has_evidence' FROM evidence WHERE ticker IS NOT NULL""")
def vault_graph(spark, d):
    e = evidence(spark, d)
    return op.vault_graph(op.turn_graph(runs(spark, d), e), e.where("ticker is not null"))


@query("merge_nodes", E_SQL + "SELECT node_id, max(turn) AS turn, arg_max(content_hash, turn) AS content_hash FROM evidence GROUP BY node_id")
def merge_nodes(spark, d):
    return gop.last_occurrence(evidence(spark, d).select("node_id", "turn", "content_hash"), ["node_id"], ["turn"])


@query("union_sources", E_SQL + """
SELECT vault, path, arg_min(branch, (branch, turn, position)) AS branch FROM (SELECT vault, path, turn, position, 0 AS branch FROM evidence WHERE cache_hit UNION ALL SELECT vault, path, turn, position, 1 FROM evidence WHERE NOT cache_hit) GROUP BY ALL""")
def union_sources(spark, d):
    e = evidence(spark, d).select("vault", "path", "turn", "position", "cache_hit")
    u = e.where("cache_hit").withColumn("branch", F.lit(0)).unionByName(e.where("not cache_hit").withColumn("branch", F.lit(1)))
    u = u.withColumn("o1", F.col("branch"))
    return gop.first_occurrence(u, ["vault", "path"], ["o1", "turn", "position"]).select("vault", "path", "branch")


@query("vault_disjoint", E_SQL + "SELECT count(*) AS node_ids, count(*) FILTER (n > 1) AS shared FROM (SELECT node_id, count(DISTINCT vault) AS n FROM evidence GROUP BY node_id)")
def vault_disjoint(spark, d):
    """Node ids of different vaults never meet."""
    per = evidence(spark, d).groupBy("node_id").agg((F.min("vault") != F.max("vault")).alias("many"))
    return per.agg(F.count(F.lit(1)).alias("node_ids"), F.count_if("many").alias("shared"))


@query("graph_remap", E_SQL + """,
n AS (SELECT DISTINCT vault || ':' || turn || ':' || position AS id, vault || '|' || path AS identity, turn * 1000 + position AS ordinal FROM evidence),
f AS (SELECT identity, arg_min(id, ordinal) AS canonical FROM n GROUP BY identity), m AS (SELECT id, canonical FROM n JOIN f USING (identity)),
l AS (SELECT vault || ':' || turn || ':' || position AS source, lead(vault || ':' || turn || ':' || position) OVER (PARTITION BY vault, turn ORDER BY position) AS target FROM evidence)
SELECT DISTINCT a.canonical AS source, b.canonical AS target, 'traverses' AS rel FROM l JOIN m a ON l.source = a.id JOIN m b ON l.target = b.id""")
def graph_remap(spark, d):
    from pyspark.sql import Window as W
    e = evidence(spark, d)
    ident = F.concat_ws(":", "vault", F.col("turn").cast("string"), F.col("position").cast("string"))
    nodes = e.select(ident.alias("id"), F.concat_ws("|", "vault", "path").alias("identity"), (F.col("turn") * 1000 + F.col("position")).alias("ordinal"))
    links = e.select(ident.alias("source"), F.lead(ident).over(W.partitionBy("vault", "turn").orderBy("position")).alias("target"), F.lit("traverses").alias("rel")).where("target is not null")
    return gop.graph_remap(nodes, links)[1]


@query("claim_edges", E_SQL + """,
p AS (SELECT vault || ':' || turn AS a, node_id, row_number() OVER (PARTITION BY vault, turn ORDER BY position) AS n FROM evidence)
SELECT a AS source, a || ':c1' AS target, 'asserts' AS rel FROM p WHERE n = 1 UNION ALL SELECT a, a || ':skill', 'produced_by' FROM p WHERE n = 1
UNION ALL SELECT a || ':c1', node_id, 'derives_from' FROM p WHERE n <= 4 UNION ALL SELECT a || ':skill', node_id, 'used' FROM p WHERE n <= 6""")
def claim_edges(spark, d):
    from pyspark.sql import Window as W
    w = W.partitionBy("vault", "turn").orderBy("position")
    return op.claim_edges(evidence(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 6").withColumn("position", F.col("n")))


@query("trace_chain", E_SQL + """
SELECT coalesce(lag(node_id) OVER w, vault || ':' || turn || ':skill') AS source, node_id AS target, CASE WHEN lag(node_id) OVER w IS NULL THEN 'starts_at' ELSE 'traverses' END AS rel
FROM evidence WINDOW w AS (PARTITION BY vault, turn ORDER BY position)""")
def trace_chain(spark, d):
    return op.trace_chain(evidence(spark, d))


@query("transcripts", """
SELECT 'v' || conv_id AS vault, turn, role AS speaker, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS message_no, text FROM conversations""")
def transcripts(spark, d):
    c = table(spark, d, "conversations")
    return op.transcripts(c.select(F.concat(F.lit("v"), "conv_id").alias("vault"), "turn", F.col("role").alias("speaker"), "text"))


@query("agent_compare", M_SQL + """,
u AS (SELECT question_id, agent, unnest(['Total tokens', 'Elapsed (ms)']) AS metric, unnest([CASE WHEN total_tokens < 100 THEN 'Unavailable' ELSE CAST(total_tokens AS VARCHAR) END, CAST(elapsed_ms AS VARCHAR)]) AS shown FROM metrics)
SELECT question_id, metric, max(shown) FILTER (agent = 'web') AS web, max(shown) FILTER (agent = 'local') AS local FROM u GROUP BY ALL""")
def agent_compare(spark, d):
    m = metrics(spark, d).select("question_id", "agent", F.when(F.col("total_tokens") >= 100, F.col("total_tokens")).alias("Total tokens"), F.col("elapsed_ms").cast("double").alias("Elapsed (ms)"))
    return op.agent_compare(m, ["Total tokens", "Elapsed (ms)"], ["web", "local"])


@query("backfill_runs", E_SQL + """,
t AS (SELECT vault, turn, coalesce(string_agg(DISTINCT ticker, ',' ORDER BY ticker), '') AS found FROM evidence GROUP BY ALL),
x AS (SELECT r.vault, r.turn, coalesce(found, r.tickers, '') AS tickers FROM runs r LEFT JOIN t USING (vault, turn))
SELECT vault, turn, tickers, s_name AS company, 'results/turn-' || CASE WHEN turn < 1000 THEN lpad(CAST(turn AS VARCHAR), 3, '0') ELSE CAST(turn AS VARCHAR) END || '-local-agent.json' AS result_path
FROM x LEFT JOIN supplier ON 'T' || s_suppkey = string_split(tickers, ',')[1]""")
def backfill_runs(spark, d):
    """Runs with stored tickers that their evidence corrects, and runs without."""
    r = runs(spark, d).select("vault", "turn", "tickers", F.lit(None).cast("string").alias("company"))
    comp = table(spark, d, "supplier").select(F.concat(F.lit("T"), "s_suppkey").alias("ticker"), F.col("s_name").alias("title"))
    results = r.select("vault", "turn", F.lit("Local Agent").alias("agent"))
    out = op.backfill_runs(r, evidence(spark, d), comp, results)
    return out.select("vault", "turn", "tickers", "company", F.element_at("result_paths", 1)["path"].alias("result_path"))


@query("backfill_evidence", E_SQL + """
SELECT vault, turn, type, ticker, node_id FROM evidence
UNION ALL SELECT DISTINCT vault, turn, 'finance.entity', ticker, 'entity:' || ticker FROM evidence JOIN supplier ON ticker = 'T' || s_suppkey""")
def backfill_evidence(spark, d):
    comp = table(spark, d, "supplier").select(F.concat(F.lit("T"), "s_suppkey").alias("ticker")).withColumn("node_id", F.concat(F.lit("entity:"), "ticker"))
    return op.backfill_evidence(evidence(spark, d), comp)


@query("research_reuse", """
WITH RECURSIVE e AS (SELECT event_id, event_type AS key, epoch(date_trunc('second', ts))::BIGINT AS sec, ts, CASE WHEN value < 5 THEN 60 ELSE 900 END AS ttl FROM events),
p AS (SELECT key, sec, arg_min(ttl, (ts, event_id)) AS ttl, arg_min(event_id, (ts, event_id)) AS id FROM e GROUP BY ALL),
nx AS MATERIALIZED (SELECT a.key, a.sec, min(b.sec) AS next_sec FROM p a LEFT JOIN p b ON a.key = b.key AND a.sec + a.ttl <= b.sec GROUP BY ALL),
m AS (SELECT key, min(sec) AS sec FROM p GROUP BY key UNION ALL SELECT nx.key, nx.next_sec FROM m JOIN nx ON nx.key = m.key AND nx.sec = m.sec WHERE nx.next_sec IS NOT NULL)
SELECT event_id AS request_id, e.key, CAST(event_id NOT IN (SELECT id FROM p JOIN m USING (key, sec)) AS INT) AS hit FROM e""")
def research_reuse(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("key"), "ts", (F.col("value") < 5).alias("warned"))
    return op.research_reuse(e).withColumn("hit", F.col("hit").cast("int"))


@query("spend_alarm", """
SELECT event_id, CAST(sum(CAST(value AS DECIMAL(12,2))) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS spent,
  CAST(sum(CAST(value AS DECIMAL(12,2))) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) >= 70000 AS INT) AS alarm FROM events""")
def spend_alarm(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.col("value").cast("decimal(12,2)").alias("cost"))
    x = op.spend_alarm(e, F.date_trunc("minute", F.col("ts").cast("timestamp")), ["ts", "event_id"], 100000.0)
    return x.select("event_id", F.col("spent").cast("double").alias("spent"), F.col("alarm").cast("int").alias("alarm"))
