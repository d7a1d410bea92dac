"""Company and filing graph as two tables: nodes(id, type, title, ticker, ...) and edges(source, target, rel, ordinal)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions import fixed
from factweave.operators.questions import has_any
from factweave.sources.sinks import written


def compact_edges(edges: DataFrame) -> DataFrame:
    """edges with source_type -> retained edges.

    Kinds that are always kept also fill the budget of capped kinds. Until the budget is full every keepable edge
    is kept, so a capped edge stays exactly when it is among the first ``cap`` keepable edges of its node. That
    is a top-k per node, which is pruned before the shuffle; always-kept edges need no window at all.
    """
    kind = F.col("source_type")
    always, cap = F.lit(False), F.lit(None).cast("int")
    named = [t for t in fixed.EDGE_RULES if t != "*"]
    for t, (keep, caps) in fixed.EDGE_RULES.items():
        here = ~kind.isin(named) if t == "*" else kind == t
        if keep:
            always = always | (here & F.col("rel").isin(keep))
        for rel, n in caps.items():
            cap = F.coalesce(cap, F.when(here if rel == "*" else here & (F.col("rel") == rel), F.lit(n)))
    x = edges.withColumn("_always", always).withColumn("_cap", cap)
    most = max(n for _, caps in fixed.EDGE_RULES.values() for n in caps.values())
    w = W.partitionBy("source").orderBy("ordinal", "target")
    top = x.where("_always or _cap is not null").withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most)
    capped = top.where(~F.col("_always") & (F.col("_rank") <= F.col("_cap")))
    return x.where("_always").select(edges.columns).unionByName(capped.select(edges.columns))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("target")), "target", "left_semi")


def scoped_nodes(nodes: DataFrame, tickers: DataFrame) -> DataFrame:
    """Allowlist: edges cannot widen it."""
    return nodes.withColumn("_t", F.upper("ticker")).join(tickers.select(F.upper("ticker").alias("_t")).distinct(), "_t", "left_semi").drop("_t")


def context_node(selected: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """selected(question_id, id, type) -> the first linked node of the kind's relation, else the node itself."""
    rel = F.element_at(F.create_map(*[F.lit(v) for kv in fixed.CONTEXT_RELS.items() for v in kv]), F.col("type"))
    s = selected.withColumn("_rel", rel)
    e = edges.where(F.col("rel").isin(list(fixed.CONTEXT_RELS.values()))).select("source", F.col("rel").alias("_rel"), "target", "ordinal")
    t = nodes.select(F.col("id").alias("target"), F.col("type").alias("t_type"))
    linked = s.join(e, (s["id"] == e["source"]) & (s["_rel"] == e["_rel"])).drop(e["_rel"]).join(t, "target")
    linked = linked.where((F.col("type") != "bundle_view") | (F.col("t_type") == "finance.filing"))
    first = linked.groupBy("question_id", "id").agg(F.min_by("target", F.struct("ordinal", "target")).alias("linked"))
    return selected.join(first, ["question_id", "id"], "left").withColumn("context", F.coalesce("linked", "id")).drop("linked")


def fact_score(question: Column, hay: Column, kind: Column) -> Column:
    q, h = F.lower(question), F.lower(hay)
    words = sum((F.contains(q, F.lit(w)) & F.contains(h, F.lit(w))).cast("int") for w in fixed.FACT_SCORE_WORDS)
    return words * 4 + F.when(kind == "finance.fact", 1).otherwise(0)


def word_mask(text: Column) -> Column:
    """Which of the score words a text holds, one bit each."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(w)).cast("int") * F.lit(1 << i) for i, w in enumerate(fixed.FACT_SCORE_WORDS)), F.lit(0))


def best_linked_facts(asked: DataFrame, edges: DataFrame, nodes: DataFrame, keep: int = 4) -> DataFrame:
    """asked(node, mask), each once: the best ``keep`` linked facts of a node for a question with those score words.

    Facts with the same words and kind score alike for every question, so a node keeps the best few of each such group: what
    questions meet is bounded by the sets of words, not by the links of a node. Ties: larger title, earlier link, smaller id.
    """
    n = nodes.select(F.col("id").alias("target"), (F.col("type") == "finance.fact").cast("int").alias("kind"), "title", word_mask(F.col("hay")).alias("words"))
    order = [F.desc("title"), "ordinal", "target"]
    linked = edges.where(F.col("rel").isin(fixed.LINKED_FACT_RELS)).select(F.col("source").alias("node"), "target", "ordinal").join(n, "target")
    linked = linked.join(asked.select("node").distinct(), "node", "left_semi")
    top = linked.withColumn("_r", F.row_number().over(W.partitionBy("node", "words", "kind").orderBy(*order))).where(F.col("_r") <= keep).drop("_r")
    met = asked.join(top, "node").withColumn("score", F.bit_count(F.col("mask").bitwiseAND(F.col("words"))) * 4 + F.col("kind"))
    return met.withColumn("_r", F.row_number().over(W.partitionBy("node", "mask").orderBy(F.desc("score"), *order))).where(F.col("_r") <= keep).select("node", "mask", "target", "score", "title", "ordinal")


def gather_evidence(selected: DataFrame, edges: DataFrame, nodes: DataFrame, limit: int = 8) -> DataFrame:
    """selected(question_id, question, id, type): node, its context, four best facts, their sources; at most eight.

    Neither facts nor sources of a node meet its questions one by one: questions pick among the best facts for their score words,
    and among the first four sources of a node.
    """
    ctx = context_node(selected, edges, nodes)
    base = ctx.select("question_id", "question", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.col("id").alias("node")), F.struct(F.lit(1).alias("o"), F.col("context").alias("node")))).alias("b"))
    base = base.groupBy("question_id", "question", F.col("b.node").alias("node")).agg(F.min("b.o").alias("o")).withColumn("mask", word_mask(F.col("question")))
    n = nodes.select(F.col("id").alias("target"), "type", "title", "hay")
    facts = base.join(best_linked_facts(base.select("node", "mask").distinct(), edges, nodes), ["node", "mask"])
    own = selected.where("type = 'finance.fact'").join(n.drop("type"), F.col("id") == F.col("target"))
    own = own.select("question_id", "question", "target", fact_score(F.col("question"), F.col("hay"), F.col("type")).alias("score"), "title", F.lit(2).alias("o"), F.lit(0).cast("long").alias("ordinal"))
    cols = ["question_id", "question", "target", "score", "title", "o", "ordinal"]
    w = W.partitionBy("question_id").orderBy(F.desc("score"), F.desc("title"), "o", "ordinal", "target")
    best = facts.select(cols).unionByName(own).withColumn("r", F.row_number().over(w)).where("r <= 4")
    base = base.drop("mask")
    chosen = base.unionByName(best.select("question_id", "question", F.col("target").alias("node"), (F.col("r") + 1).alias("o")))
    chosen = chosen.groupBy("question_id", "question", "node").agg(F.min("o").alias("o"))
    first = edges.where(F.col("rel").isin(fixed.LINKED_SOURCE_RELS)).select("source", "target", "ordinal")
    first = first.withColumn("_r", F.row_number().over(W.partitionBy("source").orderBy("ordinal", "target"))).where("_r <= 4").drop("_r")
    links = first.join(chosen, F.col("source") == F.col("node"))
    ws = W.partitionBy("question_id").orderBy("o", "ordinal", "target")
    cap = F.when(has_any(F.lower("question"), fixed.SOURCE_TERMS), 4).otherwise(2)
    src = links.withColumn("r", F.row_number().over(ws)).where("r <= 4").where(F.col("r") <= cap)
    src = src.join(n.where("type = 'finance.source'").select("target"), "target", "left_semi")
    out = chosen.select("question_id", "node", "o").unionByName(src.select("question_id", F.col("target").alias("node"), (F.col("r") + 10).alias("o")))
    out = out.groupBy("question_id", "node").agg(F.min("o").alias("o"))
    wo = W.partitionBy("question_id").orderBy("o")
    return out.withColumn("position", F.row_number().over(wo)).where(F.col("position") <= limit).select("question_id", "node", "position")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("p")).select("p.*")


def neighborhoods(edges: DataFrame, centers: DataFrame, hops: int = 2, cap: int = 120, relations: list[str] = fixed.COMPANY_FILING_RELS) -> DataFrame:
    """edges(source, target, rel, position), centers(center): (center, id, hop, place) of the nodes within hops, all centres at once.

    Nodes are found hop by hop, in the order of the node they are found from, then of the edge that first links both (ties: by
    id), until a centre has cap nodes, itself included. As a centre never holds more than cap nodes, the first 2 * cap links of a
    node are all that it can need: a hub is cut to them before it meets the frontier, which has cap rows a centre at most.
    """
    own = edges.where(F.col("rel").isin(relations)).select("source", "target", "position")
    ends = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "position")
    both = own.select(F.explode(F.array(ends("source", "target"), ends("target", "source"))).alias("e")).select("e.*").where("a <> b")
    first = both.groupBy("a", "b").agg(F.min("position").alias("position"))
    near = first.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy("position", "b"))).where(F.col("_r") <= 2 * cap).drop("_r")
    near = written(near, "near_links")
    found = written(centers.where("center is not null").select("center").distinct().select("center", F.col("center").alias("id"), F.lit(0).alias("hop"), F.lit(1).alias("place")), "found")
    for hop in range(1, hops + 1):
        frontier = found.where(F.col("hop") == hop - 1).select("center", F.col("id").alias("a"), F.col("place").alias("_from"))
        reached = frontier.join(near, "a").groupBy("center", F.col("b").alias("id")).agg(F.min(F.struct("_from", "position")).alias("_at"))
        reached = reached.join(found.select("center", "id"), ["center", "id"], "left_anti")
        room = found.groupBy("center").agg(F.count(F.lit(1)).cast("int").alias("_n"))
        place = F.row_number().over(W.partitionBy("center").orderBy("_at", "id"))
        new = reached.withColumn("_p", place).where(F.col("_p") < cap).join(room, "center").where(F.col("_p") + F.col("_n") <= cap)
        found = written(found.unionByName(new.select("center", "id", F.lit(hop).alias("hop"), (F.col("_p") + F.col("_n")).alias("place"))), "found")
    return found


def neighborhood_links(edges: DataFrame, found: DataFrame, relations: list[str] = fixed.COMPANY_FILING_RELS) -> DataFrame:
    """(center, source, target, rel): the links between the nodes found(center, id) of each centre.

    Each link is looked up from its end with fewer links, so that a hub's links don't meet all centres that hold the hub.
    """
    own = edges.where(F.col("rel").isin(relations)).select("source", "target", "rel").distinct()
    size = own.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    x = own.join(size.select(F.col("id").alias("source"), F.col("n").alias("_s")), "source").join(size.select(F.col("id").alias("target"), F.col("n").alias("_t")), "target")
    x = x.withColumn("_few", F.when(F.col("_s") <= F.col("_t"), F.col("source")).otherwise(F.col("target")))
    met = x.join(found.select("center", F.col("id").alias("_few")), "_few").withColumn("_other", F.when(F.col("_few") == F.col("source"), F.col("target")).otherwise(F.col("source")))
    return met.join(found.select("center", F.col("id").alias("_other")), ["center", "_other"], "left_semi").select("center", "source", "target", "rel")


def neighborhood(edges: DataFrame, center: str, hops: int = 2, cap: int = 120) -> DataFrame:
    """(id, hop) of the nodes around one centre, in edges(source, target, rel, position)."""
    return neighborhoods(edges, edges.sparkSession.createDataFrame([(center,)], "center string"), hops, cap).select("id", "hop")


def forms_present(filings: DataFrame, known: list[str]) -> DataFrame:
    """The known forms that some filing has, in their order, and OTHER for all else."""
    place = F.array_position(F.array(*[F.lit(k) for k in known]), F.upper("form"))
    return filings.groupBy(F.when(place > 0, place).otherwise(len(known) + 1).cast("int").alias("position")).agg(F.count(F.lit(1)).alias("n_filings")).select(
        "position", F.element_at(F.array(*[F.lit(k) for k in [*known, "OTHER"]]), F.col("position")).alias("form"), "n_filings")


def _overlaid(overlay: DataFrame) -> DataFrame:
    return overlay.where("type = 'finance.filing' and coalesce(id, '') <> ''")


def node_overlay(nodes: DataFrame, overlay: DataFrame) -> DataFrame:
    """overlay(id, position, type, form, preview): given values of filings replace the node's; of several rows the last that gives a field counts for it."""
    last = lambda c, given: F.max_by(c, F.when(given, F.col("position"))).alias(f"_{c}")
    o = _overlaid(overlay).groupBy("id").agg(last("form", F.col("form").isNotNull()), last("preview", F.coalesce(F.col("preview") != "", F.lit(False))))
    x = nodes.join(o, "id", "left")
    return x.withColumn("form", F.coalesce("_form", "form")).withColumn("preview", F.coalesce("_preview", "preview")).drop("_form", "_preview")


def edge_overlay(edges: DataFrame, overlay: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges(source, target, rel), overlay(id, position, type, edges array of (target, rel)): the last overlay row of a node replaces
    all its edges, with none if it lists none; rows for unknown nodes don't count, and targets must be nodes."""
    known = nodes.select(F.col("id"))
    last = _overlaid(overlay).groupBy("id").agg(F.max_by(F.coalesce("edges", F.array().cast(overlay.schema["edges"].dataType)), F.col("position")).alias("e")).join(known, "id", "left_semi")
    kept = edges.select("source", "target", "rel").join(last.select(F.col("id").alias("source")), "source", "left_anti")
    new = last.select(F.col("id").alias("source"), F.explode("e").alias("e")).select("source", F.col("e.target").alias("target"), F.col("e.rel").alias("rel"))
    return valid_edges(kept.unionByName(new), nodes).select("source", "target", "rel")


def corpus_graph(filings: DataFrame, amends: DataFrame) -> DataFrame:
    """filings(id, ticker, prior_filing, next_filing) and amending edges -> all edges of the corpus graph."""
    hub = F.concat(F.lit("entity:"), "ticker")
    e = F.array(
        F.struct(hub.alias("source"), F.col("id").alias("target"), F.lit("has_filing").alias("rel")),
        F.struct(F.col("id").alias("source"), hub.alias("target"), F.lit("filed_by").alias("rel")),
        F.struct(F.col("id").alias("source"), F.col("prior_filing").alias("target"), F.lit("prior_filing").alias("rel")),
        F.struct(F.col("id").alias("source"), F.col("next_filing").alias("target"), F.lit("next_filing").alias("rel")),
    )
    return filings.select(F.explode(e).alias("e")).select("e.*").where("target is not null").unionByName(
        valid_edges(amends.where("rel = 'amends'"), filings).select("source", "target", "rel"))


def first_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the given order: a combining minimum, no sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def last_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def undirected_links(edges: DataFrame) -> DataFrame:
    """Each unordered pair once, the first one kept."""
    x = edges.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target"))
    return first_occurrence(x, ["lo", "hi"], ["ordinal", "source", "rel"]).select("source", "target", "rel")


def node_degree(nodes: DataFrame, edges: DataFrame, relations: list[str] | None = fixed.COMPANY_FILING_RELS) -> DataFrame:
    """Different neighbours of each node by company-filing links between the given nodes; without relations by all links to any node."""
    both = undirected(edges)
    if relations is not None:
        both = undirected(edges.where(F.col("rel").isin(relations))).join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    d = both.groupBy(F.col("a").alias("id")).agg(F.count_distinct("b").alias("degree"))
    return nodes.select("id", "type").join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def node_search(nodes: DataFrame, text: str, limit: int = 40) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "title", "ticker"))
    return nodes.where(F.contains(hay, F.lit(text.strip().lower()))).orderBy("id").limit(limit)


def graph_remap(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, identity, ordinal): nodes of one source become its first id; links follow and lose repeats.

    The first id per identity is an aggregate joined back, so a source with very many nodes needs no group in one task.
    """
    first = nodes.groupBy("identity").agg(F.min_by("id", "ordinal").alias("canonical"))
    remap = nodes.join(first, "identity").select("id", "canonical")
    a = remap.select(F.col("id").alias("source"), F.col("canonical").alias("s"))
    b = remap.select(F.col("id").alias("target"), F.col("canonical").alias("t"))
    out = links.join(a, "source").join(b, "target").select(F.col("s").alias("source"), F.col("t").alias("target"), "rel").distinct()
    return first.select(F.col("canonical").alias("id"), "identity"), out
