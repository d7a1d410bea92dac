"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them; DataFrame expressions only.

Each rule says good (1), bad (0) or nothing (-1). The votes of a document are one of at most 3^9 patterns; their counts
over the whole corpus are all that the estimation needs. It finds the share of good documents and, for each rule, how often it
is right about good and about bad ones when it votes; a start (``START``) that weighs as much as
a twentieth of the corpus tells the two classes apart. A document's posterior then replaces the rule that all rules must pass. Two hard rules stay before
it (``base_failed``): under 50 words, or more than half of the words in repeated three-word windows.

Defined results: a null or empty text has no words and fails; equal rows get equal verdicts; a row with a null doc_id is
judged like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.functions.columns import pin
from factweave.llm.storage import save

SYMBOLS = "#*$%&|<>"
CAPITALS = "".join(chr(c) for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])
#: Where the estimation starts: the share of good documents, and how often a rule is right about good and bad ones.
START, START_WEIGHT, ITERATIONS = {"pi": 0.85, "good": 0.99, "bad": 0.3}, 0.05, 25

#: name -> SQL of (bad, good); a rule abstains where neither holds.
RULES = {
    "length": ("n_words < 50", "n_words BETWEEN 100 AND 50000"),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 12 * n_words", "word_chars BETWEEN 4 * n_words AND 8 * n_words"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    "symbol_share": ("15 * n_symbols > word_chars", "200 * n_symbols <= word_chars"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines"),
    "repeats": ("100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    "sentences": ("200 * n_stops < n_words", "n_stops BETWEEN n_words / 40 AND n_words / 3"),
    "capitals": ("3 * n_capitals > word_chars", "6 * n_capitals <= word_chars"),
    "digits": ("5 * n_digits > word_chars", "50 * n_digits <= word_chars"),
}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read."""
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    gone = lambda chars: f"length(text) - length(translate(text, '{chars}', ''))"
    x = pin(
        x.withColumn("bare", F.expr(r"translate(text, ' \t\n\u000B\u000C\r', '')")), words=F.expr(r"filter(split(text, '[ \\t\\n\\x0B\\f\\r]+'), w -> w <> '')"),
        lines=F.expr(r"filter(split(text, '\n'), l -> l rlike '[^ \\t\\n\\x0B\\f\\r]')"))
    x = x.select(
        "doc_id", "words", F.expr("cast(size(words) AS bigint)").alias("n_words"), F.length("bare").cast("long").alias("word_chars"),
        F.expr(f"cast({gone(SYMBOLS)} AS bigint)").alias("n_symbols"), F.expr("cast(size(lines) AS bigint)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) AS bigint)").alias("n_dup_lines"), F.expr(f"cast({gone('.!?')} AS bigint)").alias("n_stops"),
        F.expr(f"cast({gone('0123456789')} AS bigint)").alias("n_digits"), F.expr(f"cast({gone(CAPITALS)} AS bigint)").alias("n_capitals"))
    x = pin(x, windows=F.expr("if(size(words) < 3, cast(array() AS array<bigint>), transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])))")).drop("words")
    # only texts with an equal pair of windows need their places: sorted by hash, then by place, equal ones stand side by side
    placed = "sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))"
    twice = "sort_array(filter(transform(z, (x, k) -> if(get(z, k - 1).h <=> x.h OR get(z, k + 1).h <=> x.h, x.i, NULL)), i -> i IS NOT NULL))"
    covered = f"aggregate({twice}, named_struct('n', 0L, 'end', 0), (s, i) -> named_struct('n', s.n + i + 3 - greatest(i, s.end), 'end', i + 3), s -> s.n)"
    repeats = f"CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE element_at(transform(array({placed}), z -> {covered}), 1) END"
    return x.withColumn("n_repeat_words", F.expr(repeats)).drop("windows")


def with_votes(counts: DataFrame) -> DataFrame:
    """Adds base_failed and votes, an array of one vote a rule."""
    votes = [f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END" for bad, good in RULES.values()]
    failed = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    return counts.withColumn("base_failed", F.expr(failed)).withColumn("votes", F.expr(f"array({', '.join(votes)})"))


def posteriors(voted: DataFrame, rules: int = len(RULES), iterations: int = ITERATIONS) -> DataFrame:
    """(votes, posterior): the probability of a good document for each pattern of votes; at most 3^rules rows."""
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), "n"))).alias("ps"), F.sum("n").alias("total"))
    each = f"sequence(0, {rules - 1})"
    odds = lambda s, v: (f"ln({s}.pi / (1 - {s}.pi)) + aggregate({each}, 0D, (t, j) -> t + CASE {v}[j] WHEN 1 THEN ln({s}.good[j] / (1 - {s}.bad[j])) "
                         f"WHEN 0 THEN ln((1 - {s}.good[j]) / {s}.bad[j]) ELSE 0D END)")
    q = lambda s, v: f"1 / (1 + exp(-({odds(s, v)})))"
    total = lambda what: f"aggregate(z, 0D, (t, x) -> t + {what})"
    keep = f"({START_WEIGHT} * total)"
    rate = lambda vote, share, at: f"transform({each}, j -> ({total(f'if(x.v[j] = {vote}, x.n * {share}, 0D)')} + {keep} * {at}) / ({total(f'if(x.v[j] >= 0, x.n * {share}, 0D)')} + {keep}))"
    better = (f"element_at(transform(array(transform(ps, p -> named_struct('v', p.v, 'n', p.n, 'q', {q('s', 'p.v')}))), z -> named_struct("
              f"'pi', ({total('x.n * x.q')} + {keep} * {START['pi']}) / (total + {keep}), 'good', {rate(1, 'x.q', START['good'])}, 'bad', {rate(0, '(1 - x.q)', START['bad'])})), 1)")
    start = f"named_struct('pi', cast({START['pi']} AS double), 'good', array_repeat(cast({START['good']} AS double), {rules}), 'bad', array_repeat(cast({START['bad']} AS double), {rules}))"
    model = one.select("ps", F.expr(f"aggregate(sequence(1, {iterations}), {start}, (s, i) -> {better})").alias("m"))
    return model.select(F.explode(F.expr(f"transform(ps, p -> named_struct('votes', p.v, 'posterior', {q('m', 'p.v')}))")).alias("r")).select("r.*")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, posterior (of good quality), kept."""
    voted = save(with_votes(measures(docs)), "votes")
    known = F.broadcast(posteriors(voted))  # 3^9 rows at most
    out = voted.join(known, "votes", "left")
    kept = ~F.col("base_failed") & (F.col("posterior") >= 0.5)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "posterior")
