"""Column expressions for lexical ranking, web text and links."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.functions import fixed
from factweave.functions.columns import let
from factweave.operators.questions import has_any


def question_terms(q: Column) -> Column:
    """Terms of four letters and more, expanded for cash, segment and investment wording; distinct, in order, at most 18."""

    def build(low):
        words = F.filter(F.regexp_extract_all(low, F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(fixed.TERM_STOP_WORDS))
        none = F.expr("array()").cast("array<string>")
        cash = F.when(F.regexp_like(low, F.lit("cash|profitab|cash.flow")), F.array(*map(F.lit, fixed.CASH_TERMS))).otherwise(none)
        seg = F.when(F.regexp_like(low, F.lit("segment|growth|durab")), F.array(*map(F.lit, fixed.SEGMENT_TERMS))).otherwise(none)
        inv = F.when(has_any(low, fixed.INVESTMENT_TERMS), F.array(*map(F.lit, fixed.INVESTMENT_EXTRA_TERMS))).otherwise(none)
        return F.slice(F.array_distinct(F.concat(seg, cash, words, inv)), 1, fixed.MAX_TERMS)

    return let(F.lower(q), build)


def term_hits(text: Column, terms: Column) -> Column:
    """How many of the terms occur in the text."""
    return let(F.lower(text), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))))


def best_chunks(text: Column, terms: Column, k: int = 3, splitter: str = r"\n\s*\n") -> Column:
    """The k paragraphs with most term hits (earlier first on ties, none without a hit), inside the row: no shuffle."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    chunks = F.filter(F.transform(F.split(text, splitter), strip), lambda c: c != "")
    scored = F.transform(chunks, lambda c, i: F.struct((-term_hits(c, terms)).alias("neg"), i.alias("position"), c.alias("chunk")))
    return F.slice(F.array_sort(F.filter(scored, lambda s: s["neg"] < 0)), 1, k)


def text_windows(text: Column, terms: Column, limit: int, width: int = 1800, step: int = 1500) -> Column:
    """Overlapping windows with most hits, put back in text order and cut to the limit; short texts stay whole."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    scored = F.transform(starts, lambda s: let(F.substring(text, s, F.lit(width)), lambda w: F.struct((-term_hits(w, terms)).alias("neg"), s.alias("start"), w.alias("w"))))
    best = F.slice(F.array_sort(scored), 1, limit // step + 2)
    ordered = F.transform(F.array_sort(F.transform(best, lambda b: F.struct(b["start"].alias("start"), b["w"].alias("w")))), lambda b: b["w"])
    return F.when(F.length(text) <= limit, text).otherwise(F.left(F.array_join(ordered, "\n\n"), F.lit(limit)))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    """All named and numeric entities; the table of names is Python's own."""
    return s.map(lambda v: html.unescape(v) if v is not None and "&" in v else v)


def page_text(c: Column) -> Column:
    """Readable text of a page; cells end in ' | ', rows and blocks in a line break."""
    t = F.regexp_replace(c, r"(?is)<(script|style|nav|header|footer)\b[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)</(?:td|th)\s*>", " | ")
    t = F.regexp_replace(t, r"(?i)</(?:tr|p|div|h[1-6])\s*>", "\n")
    t = unescape(F.regexp_replace(t, r"<[^>]+>", " "))
    t = F.regexp_replace(t, r"(?U)[^\S\n]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\n\s*\n", "\n"), r"(?U)^\s+|\s+$", "")


def decoded_link(url: Column) -> Column:
    """Target of a search engine's tracking link, or the link itself; NULL where it is no http(s) address."""
    ru = F.nullif(F.regexp_extract(url, r"/RU=(.*?)/RK=", 1), F.lit(""))
    b64 = F.nullif(F.regexp_extract(url, r"[?&]u=a1([A-Za-z0-9_-]+)", 1), F.lit(""))
    std = F.translate(b64, "-_", "+/")
    padded = F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), F.lit("="))
    plain = F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")
    ddg = F.nullif(F.regexp_extract(url, r"/l/\?(?:[^#]*&)?uddg=([^&#]+)", 1), F.lit(""))
    target = (
        F.when(F.regexp_like(url, F.lit(r"^https?://r\.search\.yahoo\.com/")), F.try_url_decode(ru))
        .when(b64.isNotNull() & F.regexp_like(plain, F.lit("^https?://")), plain)
        .when(ddg.isNotNull(), F.try_url_decode(ddg))
        .when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    )
    return F.when(F.regexp_like(target, F.lit("(?i)^https?://")), target)


def is_public_url(url: Column) -> Column:
    """http(s) with a host, no user part, port absent, 80 or 443."""
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    ok = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull() & F.try_parse_url(url, F.lit("USERINFO")).isNull()
    return F.coalesce(ok & port.isin("", "80", "443"), F.lit(False))
