"""Cell patterns behind their cheap tests: the same results as the patterns alone, and no pattern twice in one expression."""

from pyspark.sql import functions as F

from factweave.functions import cells as ce
from factweave.functions import fixed

TEXTS = [
    None, "", " ", " x ", "​﻿ 5 ", " ⁠a\tb ", "a  b", "x<br/>y", "**bold** `c`", "_　z", "\x1cq\x1c", "\n5 \n", "2024", " 2024M", "2024 (1)", "+2024", "$ 2024", "20245", "1,999", "1999*", "€5K", "- $ 7 [a]",
    "$5.25T (b)", "5 $", "(5)", "$ (5)", "( 5 ) %", "5)", "IN MILLIONS", "Amounts in thousands", "billions of dollars", "( $ Trillions )", "(000's)", "(000s)", "millionaires", "in millionſ", "number of shares, which are reflected in thousands",
    "thousands of Shares; shares in millions", "shares", "in millions, EXCEPT per share data and ratios", "excepted", "awards granted", "Shares Kept", "100 %", "PerCent", "basis  points", "EPS", "per common share", "Expected term", "İn thousands",
]


def old_clean(c):
    return F.regexp_replace(F.translate(c, fixed.INVISIBLE, ""), r"(?U)^\s+|\s+$", "")


def old_plain(c):
    t = F.regexp_replace(old_clean(c), r"<br/?>", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[*_`]", ""), r"(?U)\s+", " "), r"^ | $", "")


def old_year(c):
    v = old_clean(c)
    return ce.like(v, fixed.CELL_VALUE) & (F.trim(ce.part(v, 1)) == "") & ce.like(ce.part(v, 2), r"^(?:19|20)\d{2}$")


def old_scale(c):
    t = old_plain(c)
    return F.coalesce(F.when(ce.like(t, fixed.ZERO_THOUSANDS), "K"), *[ce.scale_letter(F.regexp_extract(t, p, 1)) for p in fixed.SCALE_PATTERNS])


def old_exceptions(c):
    t = F.array_join(F.regexp_extract_all(old_plain(c), F.lit(fixed.EXCEPT_CLAUSE), F.lit(1)), " ")
    return F.filter(F.array(*[F.when(ce.like(t, p), n) for n, p in fixed.EXCEPTION_TERMS.items()]), lambda x: x.isNotNull())


def test_cheap_tests_change_nothing(spark):
    t = F.col("t")
    pairs = {
        "strip": (ce.strip(t), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")), "clean": (ce.clean(t), old_clean(t)), "plain": (ce.plain(t), old_plain(t)), "year": (ce.is_year(t), old_year(t)),
        "currency": (ce.has_currency(t), ce.like(old_clean(t), fixed.CELL_VALUE) & ce.like(ce.part(old_clean(t), 1), "[$€£]")), "scale": (ce.scale_in(t), old_scale(t)), "exceptions": (ce.exceptions_in(t), old_exceptions(t)),
        **{k: (ce.worded(t, F.lower(t), k), ce.like(t, getattr(fixed, k))) for k in fixed.WORDS_OF if k != "SCALE_WORDS"},
    }
    for r in spark.createDataFrame([(x,) for x in TEXTS], "t string").select("t", *[F.struct(a.alias("now"), b.alias("was")).alias(n) for n, (a, b) in pairs.items()]).collect():
        for n in pairs:
            assert r[n].now == r[n].was, (n, r.t)
    found = spark.createDataFrame([(x,) for x in TEXTS], "t string").select("t", ce.share_scale_in(t).alias("s")).where("s is not null").collect()
    assert {r.t: r.s for r in found} == {"number of shares, which are reflected in thousands": "K", "thousands of Shares; shares in millions": "M"}


def test_each_scale_pattern_is_searched_once(spark):
    plan = spark.range(1).select(ce.scale_in(F.col("id").cast("string")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract(") == len(fixed.SCALE_PATTERNS)
