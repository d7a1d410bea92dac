"""Column expressions on text, money, dates and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factweave.functions import fixed


def _trim_chars(c: Column, chars: str) -> Column:
    return F.regexp_replace(c, f"^[{chars}]+|[{chars}]+$", "")


def slug(c: Column, default: str = "answer") -> Column:
    return F.coalesce(F.nullif(_trim_chars(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "-"), F.lit("")), F.lit(default))


def full_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def short_hash(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(12))


def ticker_strict(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def ticker_loose(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9.-]", "")


def ticker_dashed(c: Column) -> Column:
    return F.replace(ticker_loose(c), F.lit("."), F.lit("-"))


def safe_name(c: Column) -> Column:
    """Letters and digits of any script stay."""
    name = _trim_chars(F.regexp_replace(F.trim(c), r"(?U)[^\w.-]+", "_"), "_")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))


def safe_name_dash(c: Column) -> Column:
    name = _trim_chars(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "-"), "._-")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))


def year_of(c: Column) -> Column:
    return F.left(c, F.lit(4)).try_cast("int")


def date_in_text(c: Column) -> Column:
    """ISO date, else 'Month D[suffix], YYYY'; NULL if neither reads as a date."""
    iso = F.nullif(F.regexp_extract(c, fixed.ISO_DATE, 1), F.lit(""))
    day = F.regexp_extract(c, fixed.NAMED_DATE, 1)
    year = F.regexp_extract(c, fixed.NAMED_DATE, 2)
    named = F.when(day != "", F.try_to_date(F.concat(F.initcap(day), F.lit(" "), year), "MMMM d yyyy"))
    return F.when(iso.isNotNull(), F.try_to_date(iso, "yyyy-MM-dd")).otherwise(named)


def fiscal_year_in_name(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, fixed.FISCAL_YEAR_NAME, 1), F.lit("")), F.lit("unknown"))


def run_stamp(ts: Column) -> Column:
    """UTC time as YYYYmmddTHHMMSSffffffZ."""
    return F.date_format(ts, "yyyyMMdd'T'HHmmssSSSSSS'Z'")


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def accession_in_name(c: Column) -> Column:
    return F.regexp_extract(c, fixed.ACCESSION_NAME, 1)


def form_in_name(c: Column) -> Column:
    return F.upper(F.regexp_extract(c, fixed.FORM_NAME, 1))


def year_in_name(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)-FY(20\d{2})-", 1), F.lit("")).try_cast("int")


def money(value: Column, currency: Column, unit: Column) -> Column:
    """value DECIMAL -> '-$1.25 billion'; below a million four decimals without trailing zeros. Half-even rounding."""
    a = F.abs(value)
    sign = F.when(value < 0, "-").otherwise("")
    prefix = F.when(F.coalesce(currency == "USD", F.lit(False)) | F.coalesce(F.upper(unit) == "USD", F.lit(False)), "$").otherwise("")
    big = F.coalesce(*[
        F.when(a >= F.lit(d).cast("decimal(14,0)"), F.concat(F.format_number(F.bround((a / F.lit(d).cast("decimal(14,0)")).cast("decimal(38,12)"), 2), 2), F.lit(f" {n}")))
        for d, n in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"))
    ])
    small = F.regexp_replace(F.regexp_replace(F.format_number(F.bround(a.cast("decimal(30,8)"), 4), 4), "0+$", ""), r"\.$", "")
    return F.concat(sign, prefix, F.coalesce(big, small))


def percent_text(ratio: Column, digits: int = 2) -> Column:
    """Half-even display of a DECIMAL ratio in percent."""
    return F.concat(F.format_number(F.bround(ratio, digits), digits), F.lit("%"))


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))


def preview(c: Column, limit: int = 420) -> Column:
    """Plain start of a note: no code fences, heading marks, wiki links or ticks."""
    t = c
    for pattern, kept in fixed.PREVIEW_MARKS:
        t = F.regexp_replace(t, pattern, kept)
    return F.regexp_replace(F.left(t, F.lit(limit)), r"\s+$", "")


def trimmed(c: Column, limit: int) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.left(t, F.lit(limit)), r"\s+$", ""), F.lit("\n\n[truncated]")))


def source_key(kind: Column, path: Column, ident: Column) -> Column:
    """Facts of one filing are different sources; anything else is its path."""
    p, i = F.coalesce(path, F.lit("")), F.coalesce(ident, F.lit(""))
    return F.when(kind == "finance.fact", F.concat(p, F.lit("#"), i)).otherwise(F.coalesce(F.nullif(p, F.lit("")), i))


def typed_scalar(c: Column) -> dict[str, Column]:
    """Kind and value of a YAML-like scalar."""
    t = F.trim(F.coalesce(c, F.lit("")))
    number = F.when(F.regexp_like(t, F.lit(r"^-?\d+(\.\d+)?$")), t.try_cast("double"))
    quoted = F.regexp_like(t, F.lit(r'^(".*"|\'.*\')$')) & (F.length(t) >= 2)
    kind = (
        F.when(t == "", "empty").when(t == "null", "null").when(t.isin("true", "false"), "boolean").when(number.isNotNull(), "number")
        .when(quoted, "string").when(t == "[]", "array").when(t == "{}", "object").otherwise("string")
    )
    return {"kind": kind, "number": number, "text": F.when(quoted, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)}


def display_tolerance(token: Column, scale: Column) -> Column:
    """Half a unit of the last shown digit, times the multiplier."""
    digits = F.length(F.regexp_extract(token, r"\.(\d+)$", 1))
    return F.pow(F.lit(10.0), -digits.cast("double")) * 0.5 * scale


def usage_total(prompt: Column, completion: Column, total: Column) -> dict[str, Column]:
    """Unknown stays unknown: a negative or missing count is no zero."""
    ok = lambda c: F.when(c >= 0, c)
    p, q, t = ok(prompt), ok(completion), ok(total)
    t = F.coalesce(t, p + q)
    return {"prompt_tokens": p, "completion_tokens": q, "total_tokens": t,
            "usage_complete": p.isNotNull() & q.isNotNull() & t.isNotNull()}
