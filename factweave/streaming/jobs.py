"""Structured Streaming jobs. Results land as one folder per micro-batch, so a replayed batch overwrites only itself.

Checkpoints and results go below the cluster's shared checkpoint folder. The latest state of a key is read
back as "last batch wins"; no job keeps or rewrites a whole table on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factweave.operators import runs
from factweave.operators.ordered import with_neighbors, with_running
from factweave.session import work_dir
from factweave.streaming.blocks import keep, kept, newest


def read_table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    path = f"{root}/{name}.parquet"
    # as a pattern, since a stream's plain path must be a folder and the table may be one file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def run_available(stream: DataFrame, name: str, mode: str = "append", prepare: Callable[[DataFrame, int], DataFrame] | None = None, base: str | None = None, parts: tuple[str, ...] = ()) -> DataFrame:
    """Runs the stream over all data at hand; returns the written rows with their ``batch``. With the base of an earlier run it goes on there."""
    spark = stream.sparkSession
    base = base or work_dir(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        out = prepare(batch, batch_id) if prepare else batch
        out.write.mode("overwrite").partitionBy(*parts).parquet(f"{base}/rows/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def current(log: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Latest row of each key in the batch log."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", *(order or []))).alias("r")).select(*keys, "r.*")


def metrics_upsert(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Every turn's metric rows as a log; the newest row of a key counts."""
    return current(run_available(metrics, "metrics"), keys, ["position"])


def evidence_usage(evidence: DataFrame) -> DataFrame:
    """First and last use, number of turns and last state of each source.

    Each batch writes one partial row per source and turn; a turn counts once however often and in how many batches it comes.
    """
    def partial(batch: DataFrame, _: int) -> DataFrame:
        return batch.groupBy("vault", "source_key", "turn").agg(F.max_by(F.struct("cache_hit", "content_hash"), "at").alias("r"), F.max("at").alias("at"))

    turns = run_available(evidence, "evidence", prepare=partial).groupBy("vault", "source_key", "turn").agg(F.max_by("r", "at").alias("r"), F.max("at").alias("at"))
    return turns.groupBy("vault", "source_key").agg(
        F.min("turn").alias("first_used"), F.max("turn").alias("last_used"), F.count(F.lit(1)).alias("use_count"), F.max_by("r", "at").alias("r")).select("vault", "source_key", "first_used", "last_used", "use_count", "r.*")


def research_reuse(requests: DataFrame) -> DataFrame:
    """Requests as a log; hits are found by the batch operator over the log, so they don't depend on how requests arrived."""
    return runs.research_reuse(run_available(requests, "reuse").drop("batch"))


def source_versions(evidence: DataFrame, base: str | None = None) -> DataFrame:
    """Version of each source and turn, whatever order the lines arrive in; the first line of a turn counts.

    Turns are kept in blocks of 4096 with a summary per source: first and last content, changes inside, where a change at a border
    follows from two neighbours. A new line costs its own block; versions are the changes before a block, composed of the
    summaries, and those inside it. A later run with the same base goes on where the last one ended.
    """
    spark = evidence.sparkSession
    base = base or work_dir(spark, "versions")
    keys = ["vault", "source_key"]
    part = F.concat_ws("-", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("string"), runs.turn_block().cast("string"))

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "turn").agg(F.min_by("content_hash", "position").alias("content_hash"), F.min("position").alias("position"))

    def inside(rows: DataFrame) -> DataFrame:
        """Changes up to each turn of a block; the block's first turn has none."""
        w = Window.partitionBy(*keys, "part").orderBy("turn")
        changed = (F.lag(F.struct("content_hash")).over(w).isNotNull() & ~F.lag("content_hash").over(w).eqNullSafe(F.col("content_hash"))).cast("int")
        return rows.withColumn("changed", changed).withColumn("local", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def summary(rows: DataFrame) -> DataFrame:
        first = F.min_by(F.struct("content_hash"), "turn")["content_hash"]
        last = F.max_by(F.struct("content_hash"), "turn")["content_hash"]
        return inside(rows).groupBy(*keys, "part", runs.turn_block().alias("block")).agg(first.alias("first"), last.alias("last"), F.max("local").alias("changes"))

    lines = evidence.select(*keys, "turn", "content_hash", "position")
    run_available(lines, "versions", base=base, prepare=lambda batch, n: keep(batch, n, base, part, merge, summary, not exists(spark, f"{base}/blocks")))
    now = newest(spark, base)
    made = T.StructType([*[lines.schema[k] for k in keys], T.StructField("block", T.LongType()), *[T.StructField(c, lines.schema["content_hash"].dataType) for c in ("first", "last")], T.StructField("changes", T.LongType())])
    block = F.floor(F.col("block") / 4096)
    borders = with_neighbors(kept(spark, base, "summaries", made, now), keys, block, ["block"], ["last"])
    borders = borders.withColumn("opens", (F.col("prior").isNull() | ~F.col("prior.last").eqNullSafe(F.col("first"))).cast("long"))
    borders = with_running(borders.drop("prior", "next"), keys, block, ["block"], F.col("opens") + F.col("changes"), "upto")
    before = borders.select(*keys, "block", (F.col("upto") - F.col("changes")).alias("start"))
    rows = inside(kept(spark, base, "blocks", lines.schema, now).withColumn("part", part)).withColumn("block", runs.turn_block())
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "block")]
    return rows.join(before.withColumnsRenamed({k: f"_{k}" for k in (*keys, "block")}), same).select(*keys, "turn", (F.col("start") + F.col("local")).alias("version"))


#: Hash buckets of the registry of outputs.
BUCKETS = 64


def new_filings(filings: DataFrame, existing: DataFrame, base: str | None = None) -> DataFrame:
    """Filings as they arrive, each output once: not if it exists, came in an earlier batch, or came before in its own batch.

    The registry is what the batches have written, cut into buckets by the hash of the output; a batch reads only the buckets that
    it touches, of batches before it, so a replay gives the same rows. Of one output in a batch the least row stays.
    """
    spark = filings.sparkSession
    base = base or work_dir(spark, "filings")
    bucket = F.pmod(F.xxhash64("output"), F.lit(BUCKETS)).cast("int")
    if not exists(spark, f"{base}/existing"):
        existing.select("output").distinct().withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{base}/existing")
    rest = [c for c in filings.columns if c != "output"]

    def unseen(batch: DataFrame, batch_id: int) -> DataFrame:
        new = batch.groupBy("output").agg(F.min(F.struct(*rest)).alias("r")).select("output", "r.*").withColumn("bucket", bucket)
        touched = F.col("bucket").isin([r[0] for r in new.select("bucket").distinct().collect()])  # BUCKETS at most
        schema = "output string, bucket int"
        seen = spark.read.schema(schema).parquet(f"{base}/existing").where(touched).select("output")
        if exists(spark, f"{base}/rows"):
            seen = seen.union(spark.read.schema(f"{schema}, batch int").parquet(f"{base}/rows").where(touched & (F.col("batch") < batch_id)).select("output"))
        return new.join(seen, "output", "left_anti")

    return run_available(filings, "filings", prepare=unseen, base=base, parts=("bucket",)).select(*filings.columns)


def answer_log(answers: DataFrame, keys: list[str], agents: list[str], base: str | None = None) -> DataFrame:
    """answers(keys, agent, status, ...) -> events as they come: each answer in the batch that brings it, and a final event in the
    batch in which the last agent answers; with the ``batch``.

    The state of a question holds the status of each agent, marks of the answers told and the final status told. An answer that comes
    again is not told again; a later answer of an agent is an event of its own, and a new final event follows only if it changes the outcome.
    """
    rest = [c for c in answers.columns if c not in (*keys, "agent")]
    columns = [*keys, "agent", *rest, "event"]
    types = dict(answers.dtypes) | {"event": "string"}
    whole = {c for c, t in types.items() if t in ("tinyint", "smallint", "int", "bigint")}

    def plain(name: str, value):
        return None if pd.api.types.is_scalar(value) and pd.isna(value) else int(value) if name in whole else value

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, names, statuses, final = state.get if state.exists else ([], [], [], None)
        told, status, events = set(told), dict(zip(names, statuses, strict=True)), []
        new = [{c: plain(c, v) for c, v in r.items()} for frame in frames for r in frame.to_dict("records")]  # one question in one batch
        for r in sorted(new, key=lambda r: [(r[c] is not None, r[c]) for c in rest]):
            if r["_mark"] not in told:
                told.add(r["_mark"])
                status[r["agent"]] = r["status"]
                events.append([*[r[c] for c in columns[:-1]], "answer"])
        if all(a in status for a in agents):
            now = "ok" if all(status[a] == "ok" for a in agents) else "failed"
            if now != final:
                final = now
                events.append([*[new[0][k] for k in keys], None, *[now if c == "status" else None for c in rest], "final"])
        state.update((sorted(told), list(status), list(status.values()), final))
        yield pd.DataFrame(events, columns=columns, dtype=object)

    marked = answers.select(*keys, "agent", *rest, F.xxhash64("agent", *rest).alias("_mark"))
    events = marked.groupBy(*keys).applyInPandasWithState(
        step, ", ".join(f"`{c}` {types[c]}" for c in columns), "told array<bigint>, names array<string>, statuses array<string>, final string", "append", GroupStateTimeout.NoTimeout)
    return run_available(events, "answers", base=base)


def answer_events(answers: DataFrame, keys: list[str], agents: list[str]) -> DataFrame:
    """The events of answer_log as they stand at the end: the last answer of each agent, failed ones too, and the final event.

    No answer waits for its partner or is dropped for its delay.
    """
    rest = [c for c in answers.columns if c not in (*keys, "agent")]
    log = answer_log(answers, keys, agents)
    last = log.groupBy(*keys, "agent", "event").agg(F.max_by(F.struct(*rest), F.struct("batch", *rest)).alias("r"))
    return last.select(*keys, "agent", "r.*", "event")


def price_bars(trades: DataFrame) -> DataFrame:
    """First price and number of trades per ticker and day, from partial bars of each batch; late trades count like others."""
    def partial(batch: DataFrame, _: int) -> DataFrame:
        return batch.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.min(F.struct("ts", "event_id", "value")).alias("first"), F.count(F.lit(1)).alias("volume"))

    bars = run_available(trades, "bars", prepare=partial).groupBy("ticker", "date").agg(F.min("first").alias("first"), F.sum("volume").alias("volume"))
    return bars.select("ticker", "date", F.col("first.value").alias("open"), "volume")
