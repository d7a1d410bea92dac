"""The quality rules as DuckDB SQL: counts, votes and the estimation as a recursive query over the vote patterns."""

from __future__ import annotations

from factweave.llm.quality_rules import CAPITALS, ITERATIONS, RULES, START, START_WEIGHT, SYMBOLS


def quality_rules_sql() -> str:
    weight, rules = f"({START_WEIGHT} * total)", f"range(1, {len(RULES) + 1})"
    votes = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END" for bad, good in RULES.values())
    count = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))::BIGINT"
    each = "range(1, len(ps) + 1)"
    odds = (f"ln(s.pi / (1 - s.pi)) + list_sum(list_transform({rules}, lambda j: CASE p.v[j] WHEN 1 THEN ln(s.good[j] / (1 - s.bad[j])) "
            "WHEN 0 THEN ln((1 - s.good[j]) / s.bad[j]) ELSE 0.0::DOUBLE END))")
    posterior = f"list_transform(ps, lambda p: 1 / (1 + exp(-({odds}))))"
    total = lambda test, share: f"list_sum(list_transform({each}, lambda i: CASE WHEN ps[i].v[j] {test} THEN ps[i].n * {share} ELSE 0.0::DOUBLE END))"
    rate = lambda vote, share, start: f"list_transform({rules}, lambda j: ({total(f'= {vote}', share)} + {weight} * {start}) / ({total('>= 0', share)} + {weight}))"
    begin = lambda name: f"list_transform({rules}, lambda j: {START[name]}::DOUBLE) AS {name}"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM h, range(0, 3) u(k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, {count(SYMBOLS)} AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, {count('.!?')} AS n_stops, {count('0123456789')} AS n_digits, {count(CAPITALS)} AS n_capitals,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{votes}] AS v FROM m),
p AS (SELECT list({{'v': v, 'n': n}} ORDER BY v) AS ps, sum(n)::DOUBLE AS total FROM (SELECT v, count(*)::DOUBLE AS n FROM v GROUP BY v)),
s AS (SELECT 0 AS step, {START['pi']}::DOUBLE AS pi, {begin('good')}, {begin('bad')}
  UNION ALL SELECT step + 1, (list_sum(list_transform({each}, lambda i: ps[i].n * q[i])) + {weight} * {START['pi']}) / (total + {weight}), {rate(1, 'q[i]', START['good'])}, {rate(0, '(1 - q[i])', START['bad'])}
    FROM (SELECT s.*, ps, total, {posterior} AS q FROM s, p WHERE step < {ITERATIONS})),
z AS (SELECT unnest(list_zip(list_transform(ps, lambda p: p.v), {posterior})) AS x FROM s, p WHERE step = {ITERATIONS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND x[2] >= 0.5 AS kept, round(x[2], 6) AS posterior FROM v JOIN z ON v.v = x[1]
"""
