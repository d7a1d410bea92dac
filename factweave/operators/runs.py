"""Saved runs: metrics, usage, pairing, cost, audit, provenance, reuse."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.functions import fixed
from factweave.functions import scalars as sc
from factweave.functions.scalars import slug
from factweave.operators.graph import first_occurrence, last_occurrence
from factweave.operators.ordered import with_neighbors, with_running


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def metrics_scan(raw: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Successful runs with agent label, seconds and model key."""
    require_columns(raw, ["question_id", "agent", "total_tokens", "elapsed_ms", "provider", "model", "status"])
    label = F.create_map(*[F.lit(v) for kv in labels.items() for v in kv])
    return raw.where("status = 'ok'").select("*", F.element_at(label, F.col("agent")).alias("agent_label"), (F.col("elapsed_ms") / 1000.0).alias("elapsed_seconds"),
                                             F.concat_ws("/", "provider", "model").alias("model_key"))


def results_from_files(raw: DataFrame, models: list[str]) -> DataFrame:
    """raw(file, json columns): vault, turn and agent come from the file name; known models only; ``copies`` > 1 marks a clash."""
    x = raw.select("*", F.regexp_extract("file", r"([^/]+)/results/", 1).alias("vault"), F.regexp_extract("file", r"turn-(\d+)-([a-z]+)\.json$", 1).try_cast("int").alias("turn"),
                   F.regexp_extract("file", r"turn-(\d+)-([a-z]+)\.json$", 2).alias("agent")).where(F.col("model").isin(models) & F.col("turn").isNotNull())
    n = x.groupBy("model", "agent", "vault", "turn").agg(F.count(F.lit(1)).alias("copies"))
    return x.join(n, ["model", "agent", "vault", "turn"])


def questions_flat(raw: DataFrame) -> DataFrame:
    """Question set -> one row per subquestion with the short id (question-01-02 -> 1.2)."""
    s = raw.select("source", F.inline("questions")).select("source", "title", F.inline("subquestions"))
    a, b = (F.regexp_extract("id", r"^question-(\d+)-(\d+)$", i).try_cast("int").cast("string") for i in (1, 2))
    return s.withColumn("short_id", F.coalesce(F.concat(a, F.lit("."), b), "id"))


METRIC_KEYS = ["question_id", "agent", "provider", "model", "source_vault", "source_turn"]


def metrics_upsert(existing: DataFrame, new: DataFrame, keys: list[str] = METRIC_KEYS) -> DataFrame:
    """New rows replace rows of the same key; ``position`` keeps the key's first insertion. Needs ``position`` on both sides."""
    u = existing.withColumn("_b", F.lit(0)).unionByName(new.withColumn("_b", F.lit(1)))
    rest = [c for c in u.columns if c not in (*keys, "position", "_b")]
    order = F.struct("_b", "position")
    g = u.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"), F.min(order).alias("o"))
    return g.select(*keys, "r.*", F.col("o._b").alias("first_batch"), F.col("o.position").alias("position"))


def complete_pairs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of those keys for which both agents are present."""
    both = runs.groupBy(*keys).agg((F.min("agent") != F.max("agent")).alias("both")).where("both").select(*keys)
    return runs.join(both, keys, "left_semi")


def cost(runs: DataFrame, by: list[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.avg("total_tokens").alias("mean_tokens"), F.avg("elapsed_seconds").alias("mean_seconds"), F.count(F.lit(1)).alias("n"))


def cost_ratios(pairs: DataFrame, cheap: str, dear: str) -> DataFrame:
    """Token reduction and latency ratio of paired means per model."""
    p = pairs.groupBy("model_key").pivot("agent", [cheap, dear]).agg(F.sum("total_tokens").alias("tokens"), F.avg("elapsed_seconds").alias("seconds"))
    return p.select("model_key", (1 - F.col(f"{cheap}_tokens") / F.col(f"{dear}_tokens")).alias("token_reduction"), (F.col(f"{dear}_seconds") / F.col(f"{cheap}_seconds")).alias("latency_ratio"))


def usage_totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """A sum is unknown as soon as one part is unknown."""
    u = sc.usage_total(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens"))
    x = calls.select(*keys, *[c.alias(n) for n, c in u.items()])
    known = lambda c: F.when(F.count(F.lit(1)) == F.count(c), F.sum(c)).alias(c)
    return x.groupBy(*keys).agg(known("prompt_tokens"), known("completion_tokens"), known("total_tokens"), F.bool_and("usage_complete").alias("usage_complete"))


def panel_audit(panel: DataFrame) -> DataFrame:
    """panel(expected, token, scale, ok, inconsistent): status within half a unit of the last shown digit."""
    reported = F.col("token").try_cast("double") * F.col("scale")
    error = F.abs(reported - F.col("expected"))
    tol = sc.display_tolerance(F.col("token"), F.col("scale"))
    status = (
        F.when(~F.col("ok"), "unavailable").when(F.col("token").isNull(), "omitted").when(F.col("inconsistent"), "inconsistent")
        .when(error <= tol, "correct").otherwise("incorrect")
    )
    return panel.select("*", reported.alias("reported"), error.alias("absolute_error"), tol.alias("tolerance"), status.alias("status"))


STATUSES = ["correct", "incorrect", "inconsistent", "omitted", "unavailable"]


def audit_tally(audit: DataFrame, keys: list[str]) -> DataFrame:
    return audit.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def token_present(answer: Column, token: Column) -> Column:
    """The token occurs and is no part of a longer number."""
    return F.regexp_like(answer, F.concat(F.lit(r"(?<![\d.])\Q"), token, F.lit(r"\E(?![\d.])")))


def copy_check(sources: DataFrame, copies: DataFrame) -> DataFrame:
    """sources(source_id, name, content) and copies(name, content): exactly one copy of the name with equal bytes."""
    c = copies.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max(F.sha2("content", 256)).alias("copy_hash"))
    x = sources.withColumn("source_hash", F.sha2("content", 256)).join(c, "name", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(F.col("source_hash") != F.col("copy_hash"), "differs").otherwise("ok")
    return x.select("source_id", "name", "source_hash", status.alias("status"))


def scrub(df: DataFrame, secrets: list[str] = fixed.SECRET_KEYS) -> DataFrame:
    """Drops secret fields at any depth: fields of structs, keys of string maps, also inside arrays and map values."""

    def nested(t: T.DataType) -> bool:
        return isinstance(t, (T.StructType, T.MapType)) or isinstance(t, T.ArrayType) and nested(t.elementType)

    def clean(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            fields = [clean(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields if f.name.lower() not in secrets]
            return F.when(c.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
        if isinstance(t, T.ArrayType) and nested(t.elementType):
            return F.transform(c, lambda e: clean(e, t.elementType))
        if isinstance(t, T.MapType):
            if isinstance(t.keyType, T.StringType):
                c = F.map_filter(c, lambda k, v: ~F.lower(k).isin(secrets))
            return F.transform_values(c, lambda k, v: clean(v, t.valueType)) if nested(t.valueType) else c
        return c

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields if f.name.lower() not in secrets])


# ---- provenance ---------------------------------------------------------------------------------------------------


def evidence_usage(evidence: DataFrame) -> DataFrame:
    """evidence(vault, source_key, turn, cache_hit, content_hash): registry of each logical source."""
    at = F.col("turn")
    return evidence.groupBy("vault", "source_key").agg(
        F.min("turn").alias("first_used"), F.max("turn").alias("last_used"), F.count(F.lit(1)).alias("use_count"),
        F.max_by("cache_hit", at).alias("cache_hit"), F.max_by("content_hash", at).alias("content_hash"))


def turn_block(turn: str = "turn", size: int = 4096) -> Column:
    """Chunks of turns: a key with a billion turns brings some 250,000 border rows, and no window holds more than a chunk."""
    return F.floor(F.col(turn) / size)


def turn_numbers(runs: DataFrame) -> DataFrame:
    return with_running(runs, ["vault"], turn_block(), ["turn"], F.lit(1), "turn_number")


def turn_versions(evidence: DataFrame) -> DataFrame:
    """evidence(vault, source_key, turn, content_hash) with the version of each turn: a changed content hash opens a new one."""
    keys = ["vault", "source_key"]
    x = with_neighbors(evidence, keys, turn_block(), ["turn"], ["content_hash"])
    x = x.withColumn("changed", (F.col("prior").isNull() | ~F.col("prior.content_hash").eqNullSafe(F.col("content_hash"))).cast("int"))
    return with_running(x.drop("prior", "next"), keys, turn_block(), ["turn"], F.col("changed"), "version")


def source_versions(evidence: DataFrame) -> DataFrame:
    """Versions with their first and last turn; earlier turns keep theirs."""
    x = turn_versions(evidence)
    return x.groupBy("vault", "source_key", "version", "content_hash").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("uses"))


def turn_graph(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """vault executes run, run produces answer, run binds (or on a cache hit reuses) evidence."""
    run = F.concat_ws(":", "vault", F.col("turn").cast("string"))
    answer = F.concat(F.col("vault"), F.lit(":answer:"), F.lpad(F.col("turn").cast("string"), 3, "0"))
    link = lambda s, t, r: F.struct(s.alias("source"), t.alias("target"), r.alias("rel"))
    own = runs.select(F.col("vault"), F.col("turn"), F.explode(F.array(link(F.col("vault"), run, F.lit("executes")), link(run, answer, F.lit("produces")))).alias("l"))
    rel = F.when(F.col("cache_hit"), "reuses").otherwise("binds")
    used = evidence.select("vault", "turn", link(run, F.col("node_id"), rel).alias("l"))
    return own.unionByName(used).select("vault", "turn", "l.*")


def vault_graph(links: DataFrame, members: DataFrame) -> DataFrame:
    """All turns of a vault plus company links. members(vault, ticker, node_id); a company node is named by vault and ticker."""
    company = F.concat(F.col("vault"), F.lit(":company:"), F.col("ticker"))
    own = members.select("vault", company.alias("source"), F.col("node_id").alias("target"), F.lit("has_evidence").alias("rel"))
    return links.select("vault", "source", "target", "rel").unionByName(own).distinct()


def claim_edges(evidence: DataFrame) -> DataFrame:
    """evidence(vault, turn, position, node_id): answer asserts claim, claim derives from the first four, the skill run used the first six."""
    answer = F.concat_ws(":", "vault", F.col("turn").cast("string"))
    claim, skill = F.concat(answer, F.lit(":c1")), F.concat(answer, F.lit(":skill"))
    link = lambda s, t, r: F.struct(s.alias("source"), t.alias("target"), F.lit(r).alias("rel"))
    e = F.filter(F.array(
        F.when(F.col("position") == 1, link(answer, claim, "asserts")), F.when(F.col("position") == 1, link(answer, skill, "produced_by")),
        F.when(F.col("position") <= 4, link(claim, F.col("node_id"), "derives_from")), F.when(F.col("position") <= 6, link(skill, F.col("node_id"), "used"))), lambda x: x.isNotNull())
    return evidence.select(F.explode(e).alias("l")).select("l.*")


def trace_chain(evidence: DataFrame) -> DataFrame:
    """The skill run starts at the first evidence node, each traverses to the next. Groups are single runs."""
    w = W.partitionBy("vault", "turn").orderBy("position")
    skill = F.concat_ws(":", "vault", F.col("turn").cast("string"), F.lit("skill"))
    prev = F.lag("node_id").over(w)
    return evidence.select(F.coalesce(prev, skill).alias("source"), F.col("node_id").alias("target"), F.when(prev.isNull(), "starts_at").otherwise("traverses").alias("rel"))


def transcripts(messages: DataFrame) -> DataFrame:
    """Messages in turn order with their number; kept as rows so a long conversation never becomes one value."""
    return with_running(messages, ["vault"], turn_block(), ["turn", "speaker"], F.lit(1), "message_no")


def agent_compare(results: DataFrame, metrics: list[str], agents: list[str]) -> DataFrame:
    """One row per question and metric, one column per agent; an unknown number shows as unavailable."""
    items = F.array(*[F.struct(F.lit(m).alias("metric"), F.coalesce(F.col(m).cast("string"), F.lit("Unavailable")).alias("shown")) for m in metrics])
    x = results.select("question_id", "agent", F.explode(items).alias("m")).select("question_id", "agent", "m.*")
    return x.groupBy("question_id", "metric").pivot("agent", agents).agg(F.max("shown"))


def backfill_runs(runs: DataFrame, evidence: DataFrame, companies: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """runs(vault, turn, tickers, company): a run with evidence takes the tickers of its evidence, in order, whatever was stored; a
    missing company name comes from the companies. With results(vault, turn, agent) a run without result_paths gets the path of
    each agent's result. A second pass changes nothing.
    """
    t = evidence.groupBy("vault", "turn").agg(F.array_join(F.array_sort(F.collect_set(F.nullif("ticker", F.lit("")))), ",").alias("found"))
    x = runs.join(t, ["vault", "turn"], "left").withColumn("tickers", F.coalesce("found", "tickers", F.lit("")))
    x = x.withColumn("first", F.element_at(F.split("tickers", ","), 1)).join(companies.select(F.col("ticker").alias("first"), F.col("title").alias("_title")), "first", "left")
    x = x.withColumn("company", F.coalesce("company", "_title")).drop("found", "first", "_title")
    if results is None:
        return x
    name = F.concat(F.lit("results/turn-"), F.when(F.col("turn") < 1000, F.lpad(F.col("turn").cast("string"), 3, "0")).otherwise(F.col("turn").cast("string")), F.lit("-"), slug(F.col("agent")), F.lit(".json"))
    paths = results.where("coalesce(agent, '') <> ''").groupBy("vault", "turn").agg(F.array_sort(F.collect_set(F.struct("agent", name.alias("path")))).alias("_paths"))
    x = x.join(paths, ["vault", "turn"], "left")
    if "result_paths" in runs.columns:
        return x.withColumn("result_paths", F.when(F.size("result_paths") > 0, F.col("result_paths")).otherwise(F.col("_paths"))).drop("_paths")
    return x.withColumnRenamed("_paths", "result_paths")


def backfill_evidence(evidence: DataFrame, companies: DataFrame) -> DataFrame:
    """evidence(vault, turn, type, ticker, node_id) and a company node for each ticker of a run that has none, if the company is known."""
    entity = F.max((F.col("type") == "finance.entity").cast("int"))
    missing = evidence.where("coalesce(ticker, '') <> ''").groupBy("vault", "turn", "ticker").agg(F.coalesce(entity, F.lit(0)).alias("_has")).where("_has = 0")
    node = missing.join(companies.select("ticker", "node_id"), "ticker").select("vault", "turn", F.lit("finance.entity").alias("type"), "ticker", "node_id")
    return evidence.select("vault", "turn", "type", "ticker", "node_id").unionByName(node)


# ---- reuse --------------------------------------------------------------------------------------------------------


DAY = 86_400


def _day_exits(points: pd.DataFrame) -> pd.DataFrame:
    """For one key and day: where reuse stands at the day's end, for each point that may be the day's first miss."""
    p = points.sort_values("sec")
    sec, until = p["sec"].to_numpy(), (p["sec"] + p["ttl"]).to_numpy()
    after, out = np.searchsorted(sec, until), until.copy()
    for i in range(len(sec) - 1, -1, -1):
        if after[i] < len(sec):
            out[i] = out[after[i]]
    # stored research lives 900 s at most, so the first miss is one of the points up to then or the one after
    n = int(np.searchsorted(sec, points["day"].iloc[0] * DAY + fixed.REUSE_SECONDS)) + 1
    return pd.DataFrame({"key": [points["key"].iloc[0]], "day": [points["day"].iloc[0]], "firsts": [sec[:n].tolist()], "exits": [out[:n].tolist()]})


def _day_misses(points: pd.DataFrame) -> pd.DataFrame:
    """Misses of one key and day, given until when reuse stands at its start."""
    p, found = points.sort_values("sec"), []
    until = p["entry"].iloc[0]
    for sec, ttl, first in zip(p["sec"], p["ttl"], p["first_id"], strict=True):
        if sec >= until:
            until = sec + ttl
            found.append(first)
    return pd.DataFrame({"request_id": found})


def research_reuse(requests: DataFrame) -> DataFrame:
    """requests(request_id, key, ts, warned) -> hit flag. A miss is stored for 900 s, or 60 s with warnings; a hit renews nothing.

    The clock has whole seconds: requests of one key in one second are one point. A key's history is cut into days, each of
    at most 86,400 points. Each day tells where reuse would stand at its end for every possible start (first pass), one
    small row a day is folded along the key, and each day is replayed from its true start (second pass).
    """
    kind = requests.schema["key"].dataType.simpleString()
    x = requests.withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    ttl = F.when(F.col("warned"), fixed.REUSE_SECONDS_WARNED).otherwise(fixed.REUSE_SECONDS).cast("long")
    order = F.struct("ts", "request_id")
    points = x.groupBy("key", "sec").agg(F.min_by(ttl, order).alias("ttl"), F.min_by("request_id", order).alias("first_id")).withColumn("day", F.floor(F.col("sec") / DAY))
    exits = points.select("key", "day", "sec", "ttl").groupBy("key", "day").applyInPandas(_day_exits, f"key {kind}, day long, firsts array<long>, exits array<long>")
    days = exits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("day", "firsts", "exits"))).alias("days"))
    zero = F.struct(F.lit(-1).cast("long").alias("until"), F.expr("array()").cast("array<struct<day:bigint,entry:bigint>>").alias("starts"))

    def step(s, d):
        reached = F.get(d["exits"], F.size(F.filter(d["firsts"], lambda first: first < s["until"])))
        return F.struct(F.coalesce(reached, s["until"]).alias("until"), F.concat(s["starts"], F.array(F.struct(d["day"].alias("day"), s["until"].alias("entry")))).alias("starts"))

    entries = days.select(F.col("key").alias("_key"), F.inline(F.aggregate("days", zero, step)["starts"])).withColumnRenamed("day", "_day")
    started = points.join(entries, F.col("key").eqNullSafe(F.col("_key")) & (F.col("day") == F.col("_day"))).select("key", "day", "sec", "ttl", "first_id", "entry")
    misses = started.groupBy("key", "day").applyInPandas(_day_misses, f"request_id {requests.schema['request_id'].dataType.simpleString()}").withColumn("miss", F.lit(True))
    return requests.join(misses, "request_id", "left").select("request_id", "key", F.col("miss").isNull().alias("hit"))


def spend_alarm(costs: DataFrame, chunk: Column, order: list[str], budget: float, share: float = 0.7) -> DataFrame:
    """costs(cost DECIMAL): running total over time and whether the share of the budget is used up."""
    x = with_running(costs, [], chunk, order, F.col("cost"), "spent")
    return x.withColumn("alarm", F.col("spent") >= F.lit(budget * share))
