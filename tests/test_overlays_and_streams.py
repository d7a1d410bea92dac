"""Overlays, degrees, history repair, nested scrubbing, and streams that go on where they stopped."""


import random

from factweave.functions import fixed
from factweave.operators import graph, runs
from factweave.streaming import jobs


def test_last_given_field_wins(spark):
    nodes = spark.createDataFrame([("a", "10-K", "old"), ("b", "10-Q", "old"), ("c", "8-K", "old")], "id string, form string, preview string")
    f = "finance.filing"
    over = [("a", 0, f, "10-K/A", "good preview"), ("a", 1, f, None, None), ("b", 0, f, "x", ""), ("b", 1, f, None, "p"), ("b", 2, f, "y", ""), ("c", 0, "finance.fact", "z", "z"), ("", 0, f, "z", "z"), (None, 0, f, "z", "z")]
    got = graph.node_overlay(nodes, spark.createDataFrame(over, "id string, position int, type string, form string, preview string"))
    assert sorted(tuple(r) for r in got.select("id", "form", "preview").collect()) == [("a", "10-K/A", "good preview"), ("b", "y", "p"), ("c", "8-K", "old")]


def test_overlay_replaces_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b", "x"), ("a", "c", "x"), ("b", "c", "x"), ("c", "gone", "x"), ("c", "a", "x")], "source string, target string, rel string")
    f = "finance.filing"
    over = [("a", 0, f, [("b", "early")]), ("a", 1, f, [("c", "late"), ("gone", "late")]), ("b", 0, f, None), ("gone", 0, f, [("a", "y")]), ("c", 0, "finance.fact", [("b", "y")])]
    got = graph.edge_overlay(edges, spark.createDataFrame(over, "id string, position int, type string, edges array<struct<target:string,rel:string>>"), nodes)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "c", "late"), ("c", "a", "x")]


def test_degree_counts_company_filing_links(spark):
    nodes = spark.createDataFrame([("e", "finance.entity"), ("f", "finance.filing"), ("g", "finance.filing"), ("lone", "finance.filing")], "id string, type string")
    edges = spark.createDataFrame([("e", "f", "has_filing"), ("f", "e", "filed_by"), ("e", "g", "has_filing"), ("f", "g", "next_filing"), ("g", "f", "amends"), ("e", "unknown", "has_filing"), ("unknown", "g", "has_filing")], "source string, target string, rel string")
    assert {r.id: r.degree for r in graph.node_degree(nodes, edges).collect()} == {"e": 2, "f": 1, "g": 1, "lone": 0}


def test_degree_query_counts_all_links(spark, tmp_path):
    """Two filings of one company, next to each other in time, and one of another company: timeline links count besides company links."""
    from factweave.plans.registry import queries

    spark.sql("select * from values (1L, 'C1'), (2L, 'C2') t(c_custkey, c_name)").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("select * from values (1L, 'p') t(p_partkey, p_name)").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select * from values (10L, 1L, 1L, 1, 'N') t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag)").write.parquet(f"{tmp_path}/lineitem.parquet")
    o = "(10L, 1L, 'F', 1000.0D, date'1995-01-01', '5-LOW'), (11L, 1L, 'F', 1000.0D, date'1995-02-01', '5-LOW'), (13L, 2L, 'F', 1000.0D, date'1995-03-01', '5-LOW')"
    spark.sql(f"select * from values {o} t(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority)").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.id: r.degree for r in queries()["node_degree"](spark, str(tmp_path)).collect()}
    assert got == {"entity:C1": 2, "entity:C2": 1, "filing:10": 2, "filing:11": 2, "filing:13": 1}


def test_tickers_of_the_evidence_replace_stored_ones(spark):
    r = spark.createDataFrame([("v", 1, "OLD", None), ("v", 2, "KEEP", "Kept Inc."), ("v", 3, "OLD", None), ("w", 1200, None, None)], "vault string, turn int, tickers string, company string")
    e = spark.createDataFrame([("v", 1, "finance.fact", "MSFT", "n1"), ("v", 1, "finance.fact", "AAPL", "n2"), ("v", 1, "finance.entity", "MSFT", "n3"), ("v", 3, "finance.source", None, "n4"), ("v", 1, "finance.fact", "NEW", "n5")], "vault string, turn int, type string, ticker string, node_id string")
    c = spark.createDataFrame([("AAPL", "Apple Inc.", "entity:AAPL"), ("MSFT", "Microsoft", "entity:MSFT"), ("KEEP", "Other", "entity:KEEP")], "ticker string, title string, node_id string")
    res = spark.createDataFrame([("v", 1, "Local One"), ("v", 1, "web"), ("w", 1200, "!"), ("w", 1200, None)], "vault string, turn int, agent string")
    once = runs.backfill_runs(r, e, c, res)
    told = lambda df: {(x.vault, x.turn): (x.tickers, x.company, [tuple(p) for p in x.result_paths or []]) for x in df.collect()}
    assert told(once) == {
        ("v", 1): ("AAPL,MSFT,NEW", "Apple Inc.", [("Local One", "results/turn-001-local-one.json"), ("web", "results/turn-001-web.json")]),
        ("v", 2): ("KEEP", "Kept Inc.", []), ("v", 3): ("", None, []), ("w", 1200): ("", None, [("!", "results/turn-1200-answer.json")])}
    assert told(runs.backfill_runs(once, e, c, res)) == told(once)
    more = runs.backfill_evidence(e, c)
    assert sorted((x.ticker, x.node_id) for x in more.where("type = 'finance.entity'").collect()) == [("AAPL", "entity:AAPL"), ("MSFT", "n3")]
    assert runs.backfill_evidence(more, c).count() == more.count() == 6


def test_scrub_inside_map_values(spark):
    df = spark.sql("""select map('Authorization', named_struct('api_key', 1, 'k', 2), 'ok', named_struct('api_key', 3, 'k', 4)) as m, map('a', map('HEADERS', 'x', 'b', 'y')) as mm,
        array(map('api_key', 1, 'z', 2)) as am, map('l', array(named_struct('headers', 1, 'n', 2))) as ml, map(1, named_struct('api_key', 1, 'k', 5)) as im""")
    r = runs.scrub(df).first().asDict(recursive=True)
    assert r == {"m": {"ok": {"k": 4}}, "mm": {"a": {"b": "y"}}, "am": [{"z": 2}], "ml": {"l": [{"n": 2}]}, "im": {1: {"k": 5}}}


def _add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_each_output_is_written_once(spark, tmp_path):
    schema, base = "ticker string, accession string, output string", str(tmp_path / "base")
    have = spark.createDataFrame([("x", "0", "old.md")], schema)
    rows = [("a", "1", "a.md"), ("a", "2", "a.md"), ("x", "0", "old.md"), ("b", "1", "b.md")]
    s = _add(spark, tmp_path / "in", rows, schema)
    assert sorted(map(tuple, jobs.new_filings(s, have, base).collect())) == [("a", "1", "a.md"), ("b", "1", "b.md")]
    _add(spark, tmp_path / "in", [("a", "0", "a.md"), ("c", "1", "c.md")], schema)
    s = _add(spark, tmp_path / "in", [("c", "0", "c.md"), ("b", "9", "b.md")], schema)
    out = jobs.new_filings(s, have, base).collect()
    assert sorted(r.output for r in out) == ["a.md", "b.md", "c.md"] and ("a", "1", "a.md") in map(tuple, out)


def test_events_come_with_their_answers(spark, tmp_path):
    schema, base = "q string, agent string, status string, n long", str(tmp_path / "base")
    told = lambda log: [tuple(r) for r in log.select("batch", "q", "agent", "status", "n", "event").orderBy("batch", "q", "event", "agent").collect()]
    s = _add(spark, tmp_path / "in", [("q1", "web", "ok", 1), ("q2", "web", "failed", None)], schema)
    first = told(jobs.answer_log(s, ["q"], ["web", "local"], base))
    assert [x[1:] for x in first] == [("q1", "web", "ok", 1, "answer"), ("q2", "web", "failed", None, "answer")]
    s = _add(spark, tmp_path / "in", [("q1", "local", "ok", 2), ("q1", "web", "ok", 1)], schema)  # an answer that comes again
    second = told(jobs.answer_log(s, ["q"], ["web", "local"], base))
    assert second[:2] == first and [x[1:] for x in second[2:]] == [("q1", "local", "ok", 2, "answer"), ("q1", None, "ok", None, "final")]
    s = _add(spark, tmp_path / "in", [("q2", "local", "ok", 3), ("q1", "local", "failed", 4)], schema)
    third = told(jobs.answer_log(s, ["q"], ["web", "local"], base))
    assert third[:4] == second and [x[1:] for x in third[4:]] == [
        ("q1", "local", "failed", 4, "answer"), ("q1", None, "failed", None, "final"), ("q2", "local", "ok", 3, "answer"), ("q2", None, "failed", None, "final")]
    assert told(jobs.answer_log(s, ["q"], ["web", "local"], base)) == third  # nothing new, nothing told twice


def plain_neighborhood(links, center, hops, cap):
    """Breadth first in the order of links, as sets that keep their order."""
    near = {}
    for s, t in links:
        near.setdefault(s, {})[t] = near.setdefault(t, {})[s] = None
    ids, frontier = {center: 0}, [center]
    for hop in range(1, hops + 1):
        found = []
        for x in frontier:
            for y in near.get(x, {}):
                if y not in ids and len(ids) < cap:
                    ids[y] = hop
                    found.append(y)
        frontier = found
    return list(ids.items())


def test_neighborhoods_of_all_centres(spark):
    rng = random.Random(4)
    links = [(f"e{rng.randrange(12) if rng.random() < 0.6 else 0}", f"f{rng.randrange(150)}") for _ in range(420)]
    rows = [(s, t, "has_filing", i) for i, (s, t) in enumerate(links)] + [("e1", f"x{i}", "amends", i) for i in range(9)]
    edges = spark.createDataFrame(rows, "source string, target string, rel string, position int").repartition(5)
    names = sorted({n for r in rows for n in r[:2]}) + ["nowhere"]
    centers = spark.createDataFrame([(n,) for n in [*names, None, "e1"]], "center string")
    for hops, cap in ((2, 25), (3, 120), (1, 1)):
        found = graph.neighborhoods(edges, centers, hops, cap)
        got = {}
        for r in found.orderBy("center", "place").collect():
            got.setdefault(r.center, []).append((r.id, r.hop))
        want = {n: plain_neighborhood(links, n, hops, cap) for n in names}
        assert got == want
        pairs = {(r.center, r.source, r.target) for r in graph.neighborhood_links(edges, found).collect()}
        assert pairs == {(n, s, t) for n in names for s, t in links if s in dict(want[n]) and t in dict(want[n])}


def test_evidence_of_many_questions_at_a_hub(spark):
    rng = random.Random(9)
    words = fixed.FACT_SCORE_WORDS
    some = lambda n: " ".join(rng.sample(words, n))
    facts = {f"f{i}": (rng.choice(["finance.fact", "finance.metric"]), f"title {rng.randrange(60)}", some(rng.randrange(4))) for i in range(400)}
    nodes = [("hub", "finance.filing", "hub", "")] + [(k, *v) for k, v in facts.items()]
    links = [("hub", k, rng.choice(fixed.LINKED_FACT_RELS), i) for i, k in enumerate(facts)] + [("hub", "f0", "other", 1)]
    asked = {q: f"what about {some(rng.randrange(6))}?" for q in range(300)}
    hay = {k: v[2] for k, v in facts.items()}
    edges = spark.createDataFrame(links, "source string, target string, rel string, ordinal long")
    n = spark.createDataFrame(nodes, "id string, type string, title string, hay string")
    got = graph.gather_evidence(spark.createDataFrame([(q, t, "hub", "finance.filing") for q, t in asked.items()], "question_id long, question string, id string, type string"), edges, n)
    told = {}
    for r in got.orderBy("question_id", "position").collect():
        told.setdefault(r.question_id, []).append(r.node)
    score = lambda q, k: 4 * sum(w in asked[q] and w in hay[k] for w in words) + (facts[k][0] == "finance.fact")
    place = {t: o for _, t, r, o in links if r != "other"}
    for q in asked:
        order = sorted(facts, key=lambda k: place[k])
        order.sort(key=lambda k: (score(q, k), facts[k][1]), reverse=True)  # stable: earlier links first on ties
        assert told[q] == ["hub", *order[:4]]


def test_versions_kept_in_blocks(spark, tmp_path):
    rng, base, schema = random.Random(6), str(tmp_path / "base"), "vault string, source_key string, turn int, position int, content_hash string"
    rows = [(v, s, t, p, rng.choice(["a", "a", "b", None])) for v, s in (("v", "s"), ("v", "t"), (None, "s")) for t in range(0, 13_000, 7) for p in range(rng.choice([1, 2]))]
    rng.shuffle(rows)

    def want(lines):
        first = {}
        for v, s, t, p, h in lines:
            first[v, s, t] = min(first.get((v, s, t), (p, h)), (p, h), key=lambda x: x[0])
        out, last = {}, {}
        for v, s, t in sorted(first, key=lambda k: (str(k[:2]), k[2])):
            n, h = last.get((v, s), (0, object()))
            n += h != first[v, s, t][1]
            last[v, s] = out[v, s, t] = (n, first[v, s, t][1])
        return {k: n for k, (n, _) in out.items()}

    told = lambda df: {(r.vault, r.source_key, r.turn): r.version for r in df.collect()}
    for part in (rows[:2000], rows[2000:-3]):
        s = _add(spark, tmp_path / "in", part, schema)
    assert told(jobs.source_versions(s, base)) == want(rows[:-3])
    gens = {p.name for p in (tmp_path / "base" / "blocks").glob("gen=*")}
    new = [*rows[-3:-2], ("v", "s", rows[-3][2], 9, "late")] if rows[-3][:2] == ("v", "s") else [("v", "s", 5001, 0, "new")]
    s = _add(spark, tmp_path / "in", new, schema)
    assert told(jobs.source_versions(s, base)) == want(rows[:-3] + new)
    (added,) = {p for p in (tmp_path / "base" / "blocks").glob("gen=*") if p.name not in gens}
    assert len(list(added.glob("part=*"))) == 1 and len(list((tmp_path / "base" / "summaries" / added.name).glob("part=*"))) == 1
    assert told(jobs.source_versions(s, base)) == want(rows[:-3] + new)  # a run without new rows changes nothing
