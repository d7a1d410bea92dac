"""Queries over the embeddings, and of periodic runs in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.periodic_runs import periodic_runs
from factweave.llm.queries import table
from factweave.llm.vector_dedup import near_vectors
from factweave.llm.whitening import whitening
from factweave.plans.base import Area

AREA = Area()
QUERIES, ORACLES = AREA.queries, AREA.oracles


@AREA.query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whitening(table(spark, root, "embeddings"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; of each tenth document (by checksum of its id) the words from one place on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tenth = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    at = tenth.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    at = at.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    again = F.expr("concat(slice(w, 1, a), transform(sequence(a, n - 1), i -> w[a + (i - a) % p]))")
    return at.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@AREA.query("op12_periodic_runs", r"""
WITH raw AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda k: 0::BIGINT), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM documents),
place AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM raw),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM place),
win AS (SELECT doc_id, n, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS k FROM (SELECT *, unnest(range(n - 15)) AS i FROM d)),
period AS (SELECT DISTINCT x.doc_id, y.i - x.i AS q FROM win x JOIN win y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
same AS (SELECT doc_id, q, i FROM (SELECT period.doc_id, q, w, unnest(range(n - q)) AS i FROM period JOIN d USING (doc_id)) WHERE w[i + 1] = w[i + q + 1]),
stretch AS (SELECT doc_id, q, min(i) AS s, max(i) + 1 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS o FROM same) GROUP BY doc_id, q, o),
run AS (SELECT doc_id, s, e, min(q) AS q FROM stretch WHERE e - s >= greatest(24, 3 * q) GROUP BY doc_id, s, e),
best AS (SELECT doc_id, s, e - s AS l, q, row_number() OVER (PARTITION BY doc_id ORDER BY (e - s)::DECIMAL(18, 0) / q DESC, s, q) AS r FROM run),
told AS (SELECT doc_id, count(*) AS c, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY doc_id),
hit AS (SELECT DISTINCT doc_id, unnest(range(s + q, e)) AS i FROM run),
cut AS (SELECT doc_id, list(i) AS gone FROM hit GROUP BY doc_id)
SELECT d.doc_id, coalesce(c, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
  sha256(coalesce(t, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN cut.gone IS NULL THEN w ELSE list_transform(list_filter(range(n), lambda i: NOT list_contains(cut.gone, i)), lambda i: w[i + 1]) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN best ON d.doc_id = best.doc_id AND r = 1 LEFT JOIN told ON d.doc_id = told.doc_id LEFT JOIN cut ON d.doc_id = cut.doc_id
""")
def op12_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    out = periodic_runs(planted_periods(table(spark, root, "documents")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.col("greatest")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * greatest.length div greatest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


@AREA.query("op13_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e,
  coalesce(label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
pair AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.ok AND b.ok
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, pair.b FROM reach JOIN pair ON reach.y = pair.a),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT a, count(*) AS n FROM pair GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON vec_id = x LEFT JOIN degree ON vec_id = a
""")
def op13_embedding_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return near_vectors(table(spark, root, "embeddings"))
