"""Question wording to programs: ordered column expressions, plus the mention join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions import fixed
from factweave.functions.columns import let, pin, shuffled


def has_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def rx(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def question_skill(q: Column) -> dict[str, Column]:
    """name, label, chain and reason of the first matching class; a term may sit inside a longer word."""
    q = F.lower(q)
    out = {}
    for field, default in (("skill", fixed.DEFAULT_CLASS[0]), ("label", fixed.DEFAULT_CLASS[1]),
                           ("chain", " > ".join(fixed.DEFAULT_CLASS[2])), ("reason", fixed.DEFAULT_CLASS[3])):
        c = F.lit(default)
        for name, label, terms, chain, reason in reversed(fixed.QUESTION_CLASSES):
            value = {"skill": name, "label": label, "chain": " > ".join(chain), "reason": reason}[field]
            c = F.when(has_any(q, terms), value).otherwise(c)
        out[field] = c
    return out


def question_flags(q: Column) -> dict[str, Column]:
    low = F.lower(q)
    return {
        "is_comparison": has_any(low, fixed.COMPARISON_TERMS),
        "is_price_growth": has_any(low, fixed.PRICE_GROWTH_TERMS) & has_any(low, fixed.PRICE_TERMS),
        "is_investment": has_any(low, fixed.INVESTMENT_TERMS),
        "is_market": rx(low, fixed.MARKET_PATTERN),
    }


def years_mentioned(q: Column) -> Column:
    """Sorted distinct years 20xx."""
    found = F.regexp_extract_all(F.lower(q), F.lit(fixed.YEAR_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def annual_years(q: Column) -> Column:
    """Requested years; two years with a range word are filled; none or more than five give NULL."""
    def fill(y):
        ranged = (F.size(y) == 2) & rx(F.lower(q), fixed.YEAR_RANGE_PATTERN)
        return F.when(ranged, F.sequence(y[0], F.element_at(y, -1))).otherwise(y)

    filled = let(years_mentioned(q), fill)
    return let(filled, lambda y: F.when(F.size(y).between(1, fixed.MAX_YEARS), y))


def annual_intent(q: Column) -> Column:
    """One of five intents, or NULL where the wording asks for anything else."""

    def named(low):
        other = F.lit(None).cast("string")
        for name, phrases in reversed(fixed.ANNUAL_INTENT_PHRASES):
            other = F.when(has_any(low, phrases), name).otherwise(other)
        return F.when(F.contains(low, F.lit("cash conversion")) | rx(low, fixed.CASH_CONVERSION_WORDING), "cash_conversion").otherwise(other)

    def checked(low):
        def allowed(intent):
            extra = F.lit(False)
            for name, permitted in fixed.INTENT_PERMITTED.items():
                extra = F.when(intent == name, has_any(low, [m for m in fixed.ANNUAL_METRICS if m not in permitted])).otherwise(extra)
            return F.when(intent.isNotNull() & rx(low, fixed.ANNUAL_VERBS) & ~rx(low, fixed.ANNUAL_EXCLUDED) & ~extra, intent)

        return let(named(low), allowed)

    return let(F.regexp_replace(F.lower(q), fixed.EQUITY_WORDING, "analyst"), checked)


def annual_requests(questions: DataFrame) -> DataFrame:
    """(question_id, ticker, question) -> (…, intent, years) of the questions that an annual program can answer."""
    q = F.col("question")
    answerable = lambda i: let(annual_years(q), lambda y: F.when(
        i.isNotNull() & y.isNotNull() & ((i != "operating_leverage") | (F.size(y) >= 2)), F.struct(i.alias("intent"), y.alias("years"))))
    # one expression for intent and years, so wording is read once per question
    x = pin(questions, program=let(annual_intent(q), answerable)).where("program is not null")
    return x.select(*questions.columns, "program.intent", "program.years")


def scalar_program(q: Column) -> dict[str, Column]:
    """role, margin role, year, fiscal period and operation of a single-number question."""
    low = F.lower(q)
    refused = (
        (F.size(years_mentioned(q)) > 1) | ~rx(F.trim(low), fixed.SCALAR_OPENING) | rx(low, fixed.SCALAR_COMPOSITE)
        | has_any(low, ["free cash", "cash conversion"])
    )
    role = F.lit(None).cast("string")
    for name, terms in reversed(fixed.SCALAR_ROLE_TERMS):
        role = F.when(has_any(low, terms), name).otherwise(role)
    margin = F.when(F.contains(low, F.lit("margin")), F.when(F.contains(low, F.lit("gross")), "gross_profit")
                    .when(F.contains(low, F.lit("net")), "net_income").otherwise("operating_income"))
    year = F.nullif(F.regexp_extract(low, r"\b(20\d{2})\b", 1), F.lit("")).try_cast("int")
    quarter = F.nullif(F.regexp_extract(low, r"\bq([1-4])\b", 1), F.lit(""))
    period = F.when(quarter.isNotNull(), F.concat(F.lit("Q"), quarter)).when(~has_any(low, fixed.QUARTER_TERMS), "FY")
    operation = (
        F.when(refused, "refused: needs synthesis")
        .when(role.isNull() & margin.isNull(), "refused: no financial role")
        .when(margin.isNotNull(), "divide_percent")
        .when(has_any(low, fixed.GROWTH_TERMS), "period_growth_percent")
        .otherwise("direct_fact")
    )
    return {"role": role, "margin_role": margin, "year": year, "fiscal_period": period, "operation": operation}


# ---- company mentions --------------------------------------------------------------------------------------------


def company_aliases(title: Column, ticker: Column) -> Column:
    """Ticker, name without legal suffixes, first word; empty ones dropped, order kept."""
    name = F.regexp_replace(F.lower(title), r"[^a-z0-9& ]+", " ")
    name = F.trim(F.regexp_replace(F.regexp_replace(name, fixed.LEGAL_SUFFIXES, " "), r"\s+", " "))
    first = F.split(name, " ")[0]
    keep_first = (F.length(first) > 2) & ~first.isin(fixed.ALIAS_STOP_WORDS)
    items = F.array(F.lower(ticker), name, F.when(keep_first, first), F.when(F.upper(ticker) == "NVDA", "nvidia"))
    return F.array_distinct(F.filter(items, lambda a: a.isNotNull() & (a != "")))


def _gram_key(text: Column, n: int = 3) -> Column:
    """First n words of an alias: the equi-join key, whatever the alias' length."""
    words = F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def mention_text(q: Column) -> Column:
    """Class shares written with a hyphen become dotted; other punctuation becomes a blank."""
    dotted = F.regexp_replace(q, r"\b([A-Za-z]+)-([A-Za-z])\b", "$1.$2")
    return F.regexp_replace(F.lower(dotted), r"[^a-z0-9&. ]+", " ")


def company_mentions(questions: DataFrame, companies: DataFrame, limit: int = fixed.MAX_MENTIONS) -> DataFrame:
    """questions(question_id, question, selected) x companies(ticker, title) -> (question_id, ticker, position, rank).

    Word n-grams of the text meet alias keys in an equi-join, and only those pairs are checked for a
    word-bounded match, so no text-by-alias product arises. Aliases shared by companies are left out.
    """
    spark = questions.sparkSession
    a = companies.select(F.upper("ticker").alias("ticker"), F.explode(company_aliases(F.col("title"), F.col("ticker"))).alias("alias"))
    unique = a.groupBy("alias").agg(F.min("ticker").alias("ticker"), F.max("ticker").alias("other"))
    unique = unique.where("ticker = other").select("alias", "ticker", F.lit(False).alias("common"))
    names = spark.createDataFrame([(n, t, True) for n, t in fixed.COMMON_NAMES.items()], "alias string, ticker string, common boolean")
    symbols = spark.createDataFrame([(t.lower(), t, True) for t in sorted(set(fixed.COMMON_NAMES.values()))], "alias string, ticker string, common boolean")
    aliases = unique.unionByName(names).unionByName(symbols).distinct().withColumn("gram", _gram_key(F.col("alias")))

    q = questions.withColumn("q", mention_text(F.col("question")))
    words = F.filter(F.split(F.regexp_replace("q", "[^a-z0-9]+", " "), " "), lambda w: w != "")
    q = q.withColumn("words", words)
    at = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)))
    starting = lambda n: F.transform(at, lambda i: F.array_join(F.slice("words", i, n), " "))
    grams = F.array_distinct(F.flatten(F.array(starting(1), starting(2), starting(3))))
    # narrow rows meet the aliases; the text comes back for the few that do
    pairs = q.select("question_id", F.explode(grams).alias("gram")).join(shuffled(aliases), "gram").select("question_id", "alias", "ticker", "common").distinct()
    pairs = pairs.join(shuffled(q.select("question_id", "question", "q")), "question_id")
    quoted = F.concat(F.lit(r"\Q"), F.col("alias"), F.lit(r"\E"))
    pos = F.regexp_instr("q", F.concat(F.lit("(?<![a-z0-9])"), quoted, F.lit("(?![a-z0-9])")))
    symbol = F.regexp_like("question", F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.col("ticker"), F.lit(r"\E(?![A-Za-z0-9])")))
    pairs = pairs.withColumn("position", pos - 1).where("position >= 0")
    word_like = (F.upper("alias") == F.col("ticker")) & F.col("ticker").isin(fixed.WORD_TICKERS)
    pairs = pairs.where(~word_like | symbol)
    hits = pairs.groupBy("question_id", "ticker").agg(F.min("position").alias("position"))
    # at most one row per question remains without a hit: the selected company
    none = questions.join(shuffled(hits.select("question_id").distinct()), "question_id", "left_anti")
    none = none.where(F.col("selected").isNotNull()).select("question_id", F.upper("selected").alias("ticker"), F.lit(-1).alias("position"))
    w = W.partitionBy("question_id").orderBy("position", "ticker")
    ranked = hits.unionByName(none).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= limit)
