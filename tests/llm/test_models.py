"""Learned operators, the pipeline and the registered queries."""

import glob
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from factweave.llm import bpe, queries
from factweave.llm.language_id import identify, language_id, learn as learn_languages, mixture
from factweave.llm.quality_rules import ITERATIONS, START, START_WEIGHT, measures, posteriors, quality_rules, with_votes
from factweave.llm.site_quality import site_posteriors, site_quality
from factweave.llm.toxicity import fit, toxicity, without_toxic
from tests.llm.brute import base_counts, components

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the shared tables")


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def prose(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = "xy"[i % 2]
        text = prose(rng, "abcdef" if lang == "x" else "mnopqé", rng.randint(60, 150))
        if i % 8 == 0:
            text += " nastyword " + prose(rng, "abc", 3) + " nastier"
        if i % 30 == 1:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, lang, f"s{i % 3}", 0, 0.0))
    rows += [(500, None, "x", None, 0, 0.0), (501, "", None, "s1", 0, 0.0), (502, "123 !!", "y", "s1", 0, 0.0), (None, rows[0][1], None, "s2", 0, 0.0), rows[5]]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 0 if i % 30 == 1 else 1, int(i % 8 == 0)) for i in range(240) if i % 10] + [(None, 1, 1), (3, None, None), (7, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_languages(spark, docs):
    got = {r.doc_id: r for r in language_id(docs).collect()}
    for d in range(240):
        assert got[d].lang_pred == "xy"[d % 2] and 0.9 < got[d].score <= 1 and got[d].held_out == (crc(d) % 4 == 2)
    assert all((got[d].lang_pred, got[d].score) == ("und", 0.0) for d in (500, 501, 502)) and got[None].lang_pred == "x"
    rng = random.Random(9)
    both = spark.createDataFrame([(1, prose(rng, "abcdef", 120) + " " + prose(rng, "mnopqé", 60), 1)], "doc_id long, text string, languages int")
    mixed = identify(both, learn_languages(docs)).first()
    assert [x.lang for x in mixed.languages] == ["x", "y"] and 0.55 < mixed.score < 0.8
    assert language_id(docs.limit(0)).count() == 0 and {r.lang_pred for r in language_id(docs.withColumn("lang", docs.lang.substr(9, 0)).drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang")).collect()} == {"und"}


def test_one_language_needs_no_second():
    m = np.array([[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]])
    assert [i for i, _ in mixture(m, np.array([0] * 50 + [1] * 40 + [2] * 10))] == [0]


def test_toxicity(spark, docs, labels):
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    toxic = [d for d in range(240) if d % 8 == 0]
    assert all(got[d].predicted == (d % 8 == 0) for d in range(240)) and all(got[d].held_out == (crc(d) % 5 == 0) for d in toxic)
    assert got[500].predicted == got[501].predicted == 0 and got[None].predicted == 1
    left = without_toxic(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d in got if not got[d].predicted}
    assert toxicity(docs.limit(0), labels).count() == 0 and {r.predicted for r in toxicity(docs, labels.limit(0)).collect()} == {0}


def test_correction_keeps_positives_among_the_unlabelled():
    # half of the unlabelled carry the positive feature: a plain classifier would call them negative
    p = np.array([1] * 50 + [0] * 200)
    columns = np.array([0] * 50 + [0] * 100 + [1] * 100)
    w, b = fit(p, np.arange(250), columns, 2, 0.5, 0)
    assert w[0] + b > 1 and w[1] + b < -1


def test_base_counts(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    more = {900: "a b c a b c a b", 901: "x\nx\n\n \nx y", 902: "a a a a", 903: "#*$%&|<> é", 904: "a b"}
    rows = [*text.items(), *more.items()]
    d = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    for r in quality_rules(d).collect():
        want = base_counts(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.base_failed or not r.kept)
        if isinstance(r.doc_id, int) and r.doc_id < 240:
            assert r.kept == (r.doc_id % 30 != 1)
    assert quality_rules(d.limit(0)).count() == 0


def test_posteriors_equal_plain_estimation(docs):
    voted = with_votes(measures(docs)).cache()
    counts = Counter(tuple(r.votes) for r in voted.collect())
    n, rules = sum(counts.values()), len(next(iter(counts)))
    pi, good, bad = START["pi"], [START["good"]] * rules, [START["bad"]] * rules

    def q(v):
        odds = math.log(pi / (1 - pi))
        for j, x in enumerate(v):
            odds += math.log(good[j] / (1 - bad[j])) if x == 1 else math.log((1 - good[j]) / bad[j]) if x == 0 else 0
        return 1 / (1 + math.exp(-odds))

    k = START_WEIGHT * n
    for _ in range(ITERATIONS):
        post = {v: q(v) for v in counts}
        rate = lambda j, vote, w, at: (sum(c * w(v) for v, c in counts.items() if v[j] == vote) + k * at) / (sum(c * w(v) for v, c in counts.items() if v[j] >= 0) + k)
        good, bad = [rate(j, 1, lambda v: post[v], START["good"]) for j in range(rules)], [rate(j, 0, lambda v: 1 - post[v], START["bad"]) for j in range(rules)]
        pi = (sum(c * post[v] for v, c in counts.items()) + k * START["pi"]) / (n + k)
    for r in posteriors(voted).collect():
        assert abs(r.posterior - q(tuple(r.votes))) < 1e-9


def test_sites(spark, docs, labels):
    d = docs.selectExpr("doc_id", "text", "source AS host", "lang AS path", "0 AS posterior")
    got = {r.doc_id: r for r in site_quality(d, labels).collect()}
    assert all(got[i].kept == (i % 30 != 1) for i in range(240)) and all(0 <= r.posterior <= 1 for r in got.values())
    assert got[500].own == 0 and abs(got[500].posterior - got[500].path_mean) < 1e-9
    assert site_quality(d.limit(0), labels).count() == 0 and {r.posterior for r in site_quality(d, labels.limit(0)).collect()} == {0.5}


def test_sparse_sites_shrink(spark):
    rng = random.Random(1)
    rows = [(f"h{h}", "/", int(rng.random() < (0.9 if h % 2 else 0.2))) for h in range(40) for _ in range(50)] + [("few", "/", 1), (None, None, 0)]
    got = {r.host: r for r in site_posteriors(spark.createDataFrame(rows, "host string, path string, y int")).collect()}
    assert got["h1"].host_mean > 0.75 and got["h0"].host_mean < 0.35 and 0.5 < got["few"].host_mean < 0.9 and got[None].host_mean < 0.5


@needs_tables
def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    out, stage = {}, docs
    for name, f in corpus_pipeline.STAGES:
        stage = out[name] = f(spark, stage, ROOT)
        if name != "tokens":
            assert stage.columns == docs.columns
    rows = {n: {r.doc_id: r for r in df.collect()} for n, df in out.items()}
    predicted = {r.doc_id: r.predicted for r in queries.op3_toxicity(spark, ROOT).collect()}
    assert set(rows["toxicity"]) == {d for d, p in predicted.items() if not p}
    groups = components([(d, r.text) for d, r in rows["toxicity"].items()])
    assert set(rows["near_copies"]) == {c for _, _, c in groups}
    items = [r.text.split() for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    wins = lambda w: {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
    leaks = lambda t: any(len(wins(x) & wins(t.split())) >= min(6, len(wins(x)) / 2) for x in items if wins(x))
    assert set(rows["decontamination"]) == {d for d, r in rows["near_copies"].items() if not leaks(r.text)}
    assert set(rows["pii"]) == set(rows["decontamination"]) == set(rows["tokens"])
    v = bpe.Vocabulary(queries.public_tokenizers.path("word_bpe_49k.json"))
    assert all(list(rows["tokens"][d].ids) == v.encode(r.text) for d, r in rows["pii"].items())
    ran = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, ROOT).collect()}
    assert ran == {d: list(r.ids) for d, r in rows["tokens"].items()}


@needs_tables
@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op4_substring_dedup", "op5_quality_rules", "op6_chat_formatting"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, ROOT)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns) and sorted(map(tuple, df.select(*cols).collect())) == sorted(cur.fetchall())


def test_all_are_registered():
    names = [*entry.queries()]
    assert [any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [True] * 10 and "pipeline" in names
