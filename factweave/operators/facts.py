"""Exact fact binding and period arithmetic over the canonical fact table.

Every operator takes and returns DataFrames. A missing or unsafe input never drops a requested row: it
gets a status and a reason. Ratios come with a status because "not meaningful" is not the same as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions import fixed
from factweave.functions.columns import let, pin
from factweave.operators.ordered import with_running

NON_FINITE = ["nan", "inf", "-inf", "+inf", "infinity", "-infinity", "+infinity", "snan"]


#: Places of an amount: 28 digits before the point and 9 after it, so that sums and differences of two stay exact too.
AMOUNT_DIGITS, AMOUNT_PLACES = 28, 9
AMOUNT = f"decimal({AMOUNT_DIGITS + AMOUNT_PLACES},{AMOUNT_PLACES})"


def _number(text: Column) -> Column:
    """Digits (without leading zeros) and power of ten of a number's text; NULL if it is no finite number."""
    part = lambda i: F.regexp_extract(text, fixed.NUMBER_TEXT, i)
    digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+", "")
    power = F.coalesce(F.nullif(part(4), F.lit("")).try_cast("int"), F.lit(0)) - F.length(part(3))
    good = F.regexp_like(text, F.lit(fixed.NUMBER_TEXT)) & (F.length(F.concat(part(2), part(3))) > 0)
    return F.when(good, F.struct((part(1) == "-").alias("minus"), digits.alias("digits"), power.alias("power")))


def _exact_product(a: Column, b: Column) -> Column:
    """Product of two numbers as text; NULL if it has more places than an amount."""
    digits = F.try_multiply(a["digits"].try_cast("decimal(38,0)"), b["digits"].try_cast("decimal(38,0)")).cast("string")
    zero, power = (a["digits"] == "") | (b["digits"] == ""), a["power"] + b["power"]
    whole = F.when(power >= 0, F.concat(digits, F.repeat(F.lit("0"), F.least(power, F.lit(40)))))
    wide = F.lpad(digits, F.greatest(F.length(digits), F.lit(1) - F.greatest(power, F.lit(-99))), "0")
    cut = F.length(wide) + power
    fraction = F.regexp_replace(F.substr(wide, cut + 1), "0+$", "")
    shown = F.coalesce(whole, F.concat(F.substr(wide, F.lit(1), cut), F.lit("."), fraction))
    fits = (F.length(F.regexp_replace(F.split_part(shown, F.lit("."), F.lit(1)), "^0+", "")) <= AMOUNT_DIGITS) & ((power >= 0) | (F.length(fraction) <= AMOUNT_PLACES)) & power.between(-90, 40)
    return F.when(zero, "0").when(fits, F.concat(F.when(a["minus"] != b["minus"], "-").otherwise(""), shown))


def with_amount(facts: DataFrame) -> DataFrame:
    """Adds amount = value x scale, never rounded, and value_status: ok, nonfinite, invalid_value (no number) or not_exact (too many digits)."""
    text, scale = F.lower(F.trim("value")), F.trim(F.coalesce("scale", F.lit("1")))
    plain_scale = F.regexp_like(scale, F.lit(fixed.PLAIN_SCALE))
    x = pin(facts, _t=text, _p=F.coalesce(F.regexp_like(text, F.lit(fixed.PLAIN_VALUE)) & plain_scale, F.lit(False)), _s=scale)

    def any_form(n):
        """Numbers of any form, taken apart by patterns; in a lambda, so that the step for plain ones stays small."""
        return let(F.struct(_number(n["t"]).alias("v"), _number(n["s"]).alias("s")), lambda p: F.struct(
            _exact_product(p["v"], p["s"]).try_cast(AMOUNT).alias("amount"), (p["v"].isNotNull() & p["s"].isNotNull()).alias("number")))

    # not finite and no scale of zero, whose product with anything is zero
    none = F.coalesce(F.col("_t").isin(NON_FINITE) & F.regexp_like("_s", F.lit(fixed.PLAIN_SCALE)) & (F.col("_s").try_cast("decimal(7,3)") != 0), F.lit(False))
    other = F.when(~F.col("_p") & ~none, F.array(F.struct(F.col("_t").alias("t"), F.col("_s").alias("s"))))
    x = pin(x, _o=F.get(F.transform(other, any_form), F.lit(0)))
    product = F.col("_t").try_cast("decimal(25,6)") * F.col("_s").try_cast("decimal(7,3)")
    x = x.withColumn("amount", F.when(F.col("_p"), product.cast(AMOUNT)).otherwise(F.col("_o.amount")))
    status = F.when(F.col("_p"), "ok").when(F.col("_t").isin(NON_FINITE), "nonfinite").when(~F.col("_o.number"), "invalid_value").when(F.col("_o.amount").isNull(), "not_exact").otherwise("ok")
    return x.withColumn("value_status", status).drop("_t", "_p", "_s", "_o")


def consolidated(facts: DataFrame) -> DataFrame:
    return facts.where(F.coalesce(F.size("dimensions"), F.lit(0)) <= 0)


def period_key(p: str = "period") -> Column:
    """All five parts of a period as one comparable text; NULL parts stay distinguishable."""
    parts = [F.coalesce(F.col(f"{p}.{c}").cast("string"), F.lit("?")) for c in ("start", "end", "kind", "fiscal_year", "fiscal_period")]
    return F.concat_ws("|", *parts)


def is_annual_duration(p: str = "period") -> Column:
    days = F.datediff(F.col(f"{p}.end"), F.col(f"{p}.start")) + 1
    return (F.col(f"{p}.fiscal_period") == "FY") & (F.col(f"{p}.kind") == "duration") & days.between(*fixed.ANNUAL_DAYS)


def annual(facts: DataFrame) -> DataFrame:
    return consolidated(facts).where(is_annual_duration())


def role_concepts(spark: SparkSession) -> DataFrame:
    """(role, concept, priority): a fixed table of a dozen rows."""
    rows = [(r, f"us-gaap:{c}", i) for r, cs in fixed.ROLE_CONCEPTS.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "role string, concept string, priority int")


def with_role_priority(facts: DataFrame) -> DataFrame:
    """One row per (fact, role) whose concept is on the role's list; the fixed list is small enough to broadcast."""
    lookup = role_concepts(facts.sparkSession)
    return facts.withColumn("role", F.explode("roles")).join(F.broadcast(lookup), ["role", "concept"])


def fact_identity() -> Column:
    return F.concat_ws("|", period_key(), F.coalesce("unit", F.lit("?")), F.coalesce("currency", F.lit("?")),
                       F.coalesce(F.col("amount").cast("string"), F.col("value"), F.lit("?")))


def conflicts(candidates: DataFrame) -> DataFrame:
    """Per (ticker, year, role, concept): number of facts and whether they disagree.

    min <> max of the identity says "more than one" with one map-side combined aggregate and no distinct.
    """
    return (
        candidates.withColumn("identity", fact_identity())
        .groupBy("ticker", F.col("period.fiscal_year").alias("fiscal_year"), "role", "concept", "priority")
        .agg(
            F.count(F.lit(1)).alias("n_facts"),
            (F.min("identity") != F.max("identity")).alias("conflict"),
            F.min_by(F.struct("amount", "value_status", "unit", "currency", "path", "id", "period", "value", "scale",
                              period_key().alias("period_key")), "ordinal").alias("fact"),
        )
    )


def concept_choice(candidates: DataFrame) -> DataFrame:
    """The preferred concept of each (ticker, year, role); its facts' first row and conflict flag."""
    c = conflicts(candidates)
    best = F.min_by(F.struct("concept", "priority", "n_facts", "conflict", "fact"), "priority").alias("b")
    return c.groupBy("ticker", "fiscal_year", "role").agg(best).select("ticker", "fiscal_year", "role", "b.*")


def annual_panel(facts: DataFrame) -> DataFrame:
    """One row per (ticker, fiscal_year) with a struct column per role: the input of all annual programs."""
    found = conflicts(with_role_priority(with_amount(annual(facts))))
    cell = F.struct("concept", "conflict", F.col("fact.amount").alias("amount"), F.col("fact.value_status").alias("value_status"),
                    F.col("fact.unit").alias("unit"), F.col("fact.currency").alias("currency"), F.col("fact.path").alias("path"),
                    F.col("fact.id").alias("id"), F.col("fact.period_key").alias("period_key"),
                    F.col("fact.value").alias("value"), F.col("fact.scale").alias("scale"))
    # min_by skips rows without an ordering value, so each role's column sees only its own concepts
    return found.select("ticker", "fiscal_year", "role", "priority", cell.alias("cell")).groupBy("ticker", "fiscal_year").agg(
        *[F.min_by("cell", F.when(F.col("role") == r, F.col("priority"))).alias(r) for r in fixed.ROLE_CONCEPTS]
    )


def _pick(intent: Column, side: int) -> Column:
    """The struct column of an intent's first or second role."""
    c = F.lit(None)
    for name, roles in fixed.INTENT_ROLES.items():
        c = F.when(intent == name, F.col(roles[side])).otherwise(c)
    return c


def annual_rows(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """requests(question_id, ticker, intent, years) -> one row per requested year with status and reason.

    Left join from the request side, so an absent binding is a row with a reason. The first failing rule wins.
    """
    req = requests.select("question_id", "ticker", "intent", F.explode("years").alias("fiscal_year"))
    x = req.join(annual_panel(facts), ["ticker", "fiscal_year"], "left")
    i = F.col("intent")
    role = lambda side: F.element_at(
        F.create_map(*[v for k, r in fixed.INTENT_ROLES.items() for v in (F.lit(k), F.lit(r[side]))]), i
    )
    x = x.select("question_id", "ticker", "intent", "fiscal_year", role(0).alias("a_role"), role(1).alias("b_role"),
                 _pick(i, 0).alias("a"), _pick(i, 1).alias("b"))
    fields = ("concept", "conflict", "amount", "value_status", "unit", "currency", "path", "period_key", "id", "value", "scale")
    x = x.select("question_id", "ticker", "intent", "fiscal_year", "a_role", "b_role",
                 *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("a", "b") for f in fields])
    usd = lambda c: (F.col(f"{c}_unit") == "USD") & (F.col(f"{c}_currency") == "USD")
    reason = (
        F.when(F.col("a_concept").isNull(), F.concat(F.lit("missing binding: "), F.col("a_role")))
        .when(F.col("a_conflict"), F.concat(F.lit("conflicting facts: "), F.col("a_role")))
        .when(F.col("b_concept").isNull(), F.concat(F.lit("missing binding: "), F.col("b_role")))
        .when(F.col("b_conflict"), F.concat(F.lit("conflicting facts: "), F.col("b_role")))
        .when(F.col("a_period_key") != F.col("b_period_key"), "different reporting periods")
        .when(~(F.coalesce(usd("a"), F.lit(False)) & F.coalesce(usd("b"), F.lit(False))), "not in USD")
        .when((F.col("a_value_status") == "invalid_value") | (F.col("b_value_status") == "invalid_value"), "invalid value or scale")
        .when((F.col("a_value_status") == "not_exact") | (F.col("b_value_status") == "not_exact"), "value not exact")
        .when((F.col("a_value_status") == "nonfinite") | (F.col("b_value_status") == "nonfinite"), "nonfinite measurement")
    )
    return x.withColumn("reason", reason).withColumn("hit", F.col("reason").isNull())


def margin_columns(x: DataFrame, a: str = "a_amount", b: str = "b_amount") -> DataFrame:
    """ratio (double) and ratio_status of an intent's two amounts."""
    av, bv, cash = F.col(a).cast("double"), F.col(b).cast("double"), F.col("intent") == "cash_conversion"
    # the difference is taken on exact decimals, the division on doubles
    num = F.when(F.col("intent") == "gross_margin", (F.col(a) - F.col(b)).cast("double")).otherwise(bv)
    ratio = F.when(cash & (F.col(b) > 0), av / F.nullif(bv, F.lit(0.0))).when(~cash & (F.col(a) > 0), num / F.nullif(av, F.lit(0.0)) * 100)
    status = (
        F.when(F.col(a).isNull() | F.col(b).isNull(), "rejected")
        .when(cash & (F.col(b) <= 0), "not meaningful: net income <= 0")
        .when(~cash & (F.col(a) <= 0), "undefined: revenue <= 0")
        .otherwise("ok")
    )
    return x.withColumn("ratio", ratio).withColumn("ratio_status", status)


def annual_report(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Per question and year: inputs, ratio, change against the prior requested year, incremental margin.

    At most five years per question, so the window groups are bounded.
    """
    x = margin_columns(annual_rows(requests, facts))
    w = W.partitionBy("question_id", "ticker").orderBy("fiscal_year")
    whole = W.partitionBy("question_id", "ticker")
    x = (
        x.withColumn("prior_year", F.lag("fiscal_year").over(w))
        .withColumn("prior_ratio", F.lag("ratio").over(w))
        .withColumn("d_a", (F.col("a_amount") - F.lag("a_amount").over(w)).cast("double"))
        .withColumn("d_b", (F.col("b_amount") - F.lag("b_amount").over(w)).cast("double"))
        .withColumn("question_hit", F.min(F.col("hit").cast("int")).over(whole) == 1)
        .withColumn("question_reason", F.first("reason", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    lever = F.col("intent") == "operating_leverage"
    delta = (F.col("ratio") - F.col("prior_ratio")) * F.when(F.col("intent") == "cash_conversion", 1.0).otherwise(100.0)
    return x.withColumn("delta", delta).withColumn(
        "incremental", F.when(lever & (F.col("d_a") != 0), F.col("d_b") / F.nullif(F.col("d_a"), F.lit(0.0)) * 100)
    )


def multi_company(report: DataFrame, positions: DataFrame) -> DataFrame:
    """All companies of a question must hit; otherwise the first failing company's reason (at most four companies)."""
    per = report.groupBy("question_id", "ticker").agg(
        F.min(F.col("hit").cast("int")).alias("hit"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("fiscal_year"))).alias("reason"),
        F.count(F.lit(1)).alias("n_years"),
    )
    x = positions.join(per, ["question_id", "ticker"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    fail = F.when(F.col("hit") == 0, F.concat(F.col("ticker"), F.lit(": "), F.coalesce("reason", F.lit("unsupported question"))))
    return x.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_companies"),
        (F.min("hit") == 1).alias("hit"),
        F.min_by(fail, F.when(F.col("hit") == 0, F.col("position"))).alias("reason"),
        F.sum(F.when(F.col("hit") == 1, F.col("n_years") * 2).otherwise(0)).alias("n_bindings"),
    )


def cash_bindings(facts: DataFrame, keep: int = 6) -> DataFrame:
    """Cash flow with income of exactly the same period; the latest periods are cut before incomplete ones are skipped.

    Negative income is divided here, zero income is undefined.
    """
    roles = ["operating_cash_flow", "net_income"]
    x = consolidated(with_amount(facts)).where("period.kind = 'duration'").withColumn("role", F.explode("roles"))
    first = F.struct("amount", "unit", "currency", "path", "id")
    p = (
        x.where(F.col("role").isin(roles))
        .groupBy("ticker", F.col("period.start").alias("start"), F.col("period.end").alias("end"))
        .agg(*[F.min_by(F.when(F.col("role") == r, first), F.when(F.col("role") == r, F.col("ordinal"))).alias(r) for r in roles])
    )
    w = W.partitionBy("ticker").orderBy(F.desc("end"), F.desc("start"))
    p = p.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= keep)
    cfo, inc = F.col("operating_cash_flow"), F.col("net_income")
    p = p.where(cfo.amount.isNotNull() & inc.amount.isNotNull() & cfo.unit.eqNullSafe(inc.unit))
    return p.select(
        "ticker", "start", "end", "recency",
        cfo.amount.alias("cfo"), inc.amount.alias("income"),
        F.when(inc.amount == 0, "undefined (zero net income)").otherwise("ok").alias("ratio_status"),
        F.when(inc.amount != 0, cfo.amount.cast("double") / F.nullif(inc.amount.cast("double"), F.lit(0.0))).alias("ratio"),
    )


def cash_for_questions(requests: DataFrame, facts: DataFrame, keep: int = 6) -> DataFrame:
    """requests(question_id, ticker, years): cash flow and income of the latest periods of the question's years, of all years if it names none.

    Periods are reduced to the latest of each company and of each company's year before questions meet them.
    """
    roles = ["operating_cash_flow", "net_income"]
    x = consolidated(facts).where("period.kind = 'duration'").withColumn("role", F.explode("roles")).where(F.col("role").isin(roles))
    x = with_amount(x)  # of the facts that are asked for
    first = lambda r: F.min_by(F.struct("amount", "unit"), F.when(F.col("role") == r, F.col("ordinal"))).alias(r)
    p = x.groupBy(F.col("ticker").alias("p_ticker"), F.col("period.start").alias("start"), F.col("period.end").alias("end"), F.col("period.fiscal_year").alias("p_year")).agg(*[first(r) for r in roles])
    latest = lambda df, keys: df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("end"), F.desc("start")))).where(F.col("_r") <= keep).drop("_r")
    named = requests.where(F.size("years") > 0).select("question_id", "ticker", F.explode(F.array_distinct("years")).alias("year"))
    dated = named.join(latest(p, ["p_ticker", "p_year"]), (F.col("ticker") == F.col("p_ticker")) & (F.col("year") == F.col("p_year"))).drop("year")
    # a year's first facts of a period stand for the period: without years they are reduced over all fiscal years first
    whole = x.groupBy(F.col("ticker").alias("p_ticker"), F.col("period.start").alias("start"), F.col("period.end").alias("end")).agg(F.min("period.fiscal_year").alias("p_year"), *[first(r) for r in roles])
    plain = requests.where(F.coalesce(F.size("years"), F.lit(0)) <= 0).select("question_id", "ticker").join(latest(whole, ["p_ticker"]), F.col("ticker") == F.col("p_ticker"))
    top = latest(dated.unionByName(plain), ["question_id", "ticker"])
    bound = top.where("operating_cash_flow.amount IS NOT NULL AND net_income.amount IS NOT NULL AND operating_cash_flow.unit = net_income.unit")
    cfo, income = F.col("operating_cash_flow.amount"), F.col("net_income.amount")
    return bound.select("question_id", "ticker", "start", "end", cfo.alias("cfo"), income.alias("income"), F.when(income == 0, "undefined (zero net income)").otherwise("ok").alias("ratio_status"),
                        (cfo.cast("double") / F.nullif(income.cast("double"), F.lit(0.0))).alias("ratio"))


def grid_cells(rows: DataFrame, table: str, row: str, columns: dict[str, Column], empty: list[str]) -> DataFrame:
    """(table, row, position, column, value): the cells of each table without the columns that have no value in any row; order is kept."""
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("column"), c.cast("string").alias("value")) for i, (n, c) in enumerate(columns.items())])
    x = rows.select(F.col(table).alias("table"), F.col(row).alias("row"), F.inline(cells))
    seen = x.where(~F.coalesce(F.lower(F.trim("value")), F.lit("")).isin(empty)).groupBy("table", "place").agg(F.lit(1).alias("_one"))
    visible = seen.withColumn("position", F.row_number().over(W.partitionBy("table").orderBy("place"))).drop("_one")  # as many as there are columns
    return x.join(visible, ["table", "place"]).select("table", "row", "position", "column", "value")


# ---- single-number programs -------------------------------------------------------------------------------------


def ranked(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rank in candidate order: latest end, us-gaap first, shorter concept, input order, id. A key's facts are counted in years."""
    order = {"_end": _latest("period.end"), "_other": (~F.col("concept").startswith("us-gaap:")).cast("int"), "_length": F.length("concept"), "_ordinal": F.col("ordinal"), "_id": F.col("id")}
    x = facts.withColumns(order)
    chunk = F.coalesce(-F.year("period.end"), F.lit(2**31 - 1))
    return with_running(x, keys, chunk, list(order), F.lit(1), "rank").drop(*order)


def _latest(end: str) -> Column:
    """Ascending order that puts the latest end first and a missing one last."""
    return F.coalesce(-F.unix_date(end), F.lit(2**31 - 1))


ANY = "*"


def _slots() -> Column:
    """The four (year, fiscal period) keys under which a fact can be asked for; * stands for a part that is not given."""
    year, period = F.concat(F.lit("="), F.col("period.fiscal_year").cast("string")), F.concat(F.lit("="), F.col("period.fiscal_period"))
    both = [F.struct(y.alias("slot_year"), p.alias("slot_period")) for y in (F.lit(ANY), year) for p in (F.lit(ANY), period)]
    return F.filter(F.array(*both), lambda s: s["slot_year"].isNotNull() & s["slot_period"].isNotNull())


def _slotted(facts: DataFrame) -> DataFrame:
    """Consolidated facts with amount, one row per role and slot: questions meet them on all parts that they give."""
    f = consolidated(with_amount(facts)).withColumn("fact_role", F.explode("roles")).withColumnRenamed("ticker", "fact_ticker")
    return f.select("*", F.inline(_slots()))


def _asked(requests: DataFrame, role: str) -> DataFrame:
    """Adds the join keys of requests(ticker, <role>, year, fiscal_period)."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(ANY))
    return requests.select("*", F.col("ticker").alias("fact_ticker"), F.col(role).alias("fact_role"), key("year").alias("slot_year"), key("fiscal_period").alias("slot_period"))


SLOT = ["fact_ticker", "fact_role", "slot_year", "slot_period"]


def scalar_candidates(requests: DataFrame, facts: DataFrame, role: str) -> DataFrame:
    """requests(question_id, ticker, <role>, year, fiscal_period) joined to the consolidated facts that fit all given parts."""
    return _asked(requests, role).join(_slotted(facts), SLOT).drop(*SLOT)


def _fact_order() -> Column:
    return F.struct(_latest("period.end").alias("a"), (~F.col("concept").startswith("us-gaap:")).cast("int").alias("b"), F.length("concept").alias("c"), F.col("ordinal").alias("d"))


FACT = ["concept", "amount", "unit", "currency", "path", "id", "period", "value_status"]


def _fact() -> Column:
    return F.struct(*FACT, period_key().alias("period_key"))


def best_by_slot(facts: DataFrame) -> DataFrame:
    """The first fact of each slot: chosen once per slot before any question comes, so a busy company is no product."""
    return _slotted(facts).groupBy(*SLOT).agg(F.min_by(_fact(), _fact_order()).alias("fact"), F.count(F.lit(1)).alias("n_candidates"))


def direct_fact(requests: DataFrame, facts: DataFrame) -> DataFrame:
    x = _asked(requests, "role").join(best_by_slot(facts), SLOT, "left").drop(*SLOT)
    return x.withColumn(
        "status",
        F.when(F.col("fact").isNull(), "no consolidated fact is bound").when(F.col("fact.value_status") != "ok", "not exact").otherwise("ok"),
    )


def simple_margin(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Numerator and revenue with the same full period, unit and currency; the first pair in (numerator, revenue) order.

    Facts of one company, period, unit and currency meet in one group, and each of its roles keeps its first revenue; pairs
    are then reduced to the first one of each slot. Questions join these on all parts that they give.
    """
    f = consolidated(with_amount(facts)).withColumn("fact_role", F.explode("roles")).withColumnRenamed("ticker", "fact_ticker")
    f = f.select("fact_ticker", "fact_role", "concept", "amount", "unit", "currency", "period", "ordinal", period_key().alias("pk"), _fact_order().alias("k"))
    revenue = F.when(F.col("fact_role") == "revenue", F.struct("amount", "concept", "k"))
    group = ["fact_ticker", "pk", "unit", "currency"]
    # a period's facts of one company, unit and currency: as many as a filing has
    g = f.groupBy(*group).agg(
        F.first("period").alias("period"), F.min_by(F.struct("amount", "concept", "k"), F.when(F.col("fact_role") == "revenue", F.col("k"))).alias("r"), F.max(revenue.isNotNull()).alias("has_r"),
        F.collect_list(F.struct("fact_role", "amount", "concept", "k")).alias("facts"))
    g = g.withColumn("r", F.when(F.col("has_r"), F.col("r")))
    x = g.select("fact_ticker", "period", "pk", "r", F.explode("facts").alias("n")).select("fact_ticker", "period", "pk", "r", "n", F.col("n.fact_role").alias("fact_role"))
    pair = F.when(F.col("r").isNotNull(), F.struct(
        F.col("n.amount").alias("n_amount"), F.col("r.amount").alias("r_amount"), F.col("n.concept").alias("n_concept"), F.col("r.concept").alias("r_concept"), F.col("period").alias("n_period"), "pk"))
    order = F.when(F.col("r").isNotNull(), F.struct(F.col("n.k").alias("n"), F.col("r.k").alias("r")))
    slots = x.select("fact_ticker", "fact_role", pair.alias("pair"), order.alias("order"), F.inline(_slots())).groupBy(*SLOT).agg(F.min_by("pair", "order").alias("m"), F.lit(True).alias("have"))
    rev = slots.where("fact_role = 'revenue'").select("fact_ticker", "slot_year", "slot_period", F.col("have").alias("have_rev"))
    x = _asked(requests, "margin_role").join(slots, SLOT, "left").join(rev, ["fact_ticker", "slot_year", "slot_period"], "left").drop(*SLOT)
    status = (
        F.when(F.col("have").isNull() | F.col("have_rev").isNull(), "numerator or revenue binding unavailable")
        .when(F.col("m").isNull(), "facts do not share an exact reporting period")
        .when(F.col("m.n_amount").isNull() | F.col("m.r_amount").isNull() | (F.col("m.r_amount") == 0), "not exact")
        .otherwise("ok")
    )
    ratio = F.when(status == "ok", F.col("m.n_amount").cast("double") / F.nullif(F.col("m.r_amount").cast("double"), F.lit(0.0)) * 100)
    return x.withColumn("status", status).withColumn("margin", ratio)


def period_growth(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Current fact against the nearest earlier period of the same concept, fiscal period and kind."""
    asked = _asked(requests, "role")
    # roles and given parts that questions ask by, a few rows: no other fact is dealt out, and under no other key
    kinds = F.broadcast(asked.select("fact_role", (F.col("slot_year") != ANY).alias("_by_year"), (F.col("slot_period") != ANY).alias("_by_period")).distinct())
    f = consolidated(with_amount(facts)).withColumn("fact_role", F.explode("roles")).withColumnRenamed("ticker", "fact_ticker")
    slots = f.join(kinds, "fact_role").withColumns({
        "slot_year": F.when(F.col("_by_year"), F.concat(F.lit("="), F.col("period.fiscal_year").cast("string"))).otherwise(ANY),
        "slot_period": F.when(F.col("_by_period"), F.concat(F.lit("="), F.col("period.fiscal_period"))).otherwise(ANY)})
    best = slots.groupBy(*SLOT).agg(F.min_by(F.struct(*FACT), _fact_order()).alias("fact"))
    base = asked.join(best, SLOT, "left").drop("slot_year", "slot_period")
    # one fact per end of a series (company, role, concept, fiscal period, kind), then the end before it; a missing end is the last one and meets
    # nothing, without a filter of its own, so that Spark deals out the rows under the facts once for both
    series = {"s_concept": "concept", "s_period": "period.fiscal_period", "s_kind": "period.kind"}
    ends = f.join(kinds, "fact_role", "left_semi").groupBy("fact_ticker", "fact_role", *[F.col(c).alias(n) for n, c in series.items()], F.col("period.end").alias("s_end")).agg(F.min_by(F.struct(*FACT), _fact_order()).alias("here"))
    before = F.lag("here").over(W.partitionBy("fact_ticker", "fact_role", *series).orderBy(F.asc_nulls_last("s_end")))
    steps = ends.select("fact_ticker", "fact_role", *series, "s_end", before.alias("prior")).withColumnsRenamed({"fact_ticker": "s_ticker", "fact_role": "s_role"})
    same = (F.col("fact_ticker") == F.col("s_ticker")) & (F.col("fact_role") == F.col("s_role")) & (F.col("fact.concept") == F.col("s_concept")) & (F.col("fact.period.end") == F.col("s_end"))
    same = same & F.col("fact.period.fiscal_period").eqNullSafe(F.col("s_period")) & F.col("fact.period.kind").eqNullSafe(F.col("s_kind"))
    x = base.join(steps, same, "left").drop("s_ticker", "s_role", *series, "s_end", "fact_ticker", "fact_role")
    # the key of a period is long and read off the period: it is added last
    for c in ("fact", "prior"):
        x = x.withColumn(c, F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{n}").alias(n) for n in FACT], period_key(f"{c}.period").alias("period_key"))))
    status = (
        F.when(F.col("fact").isNull(), "two comparable periods are required")
        .when(F.col("prior").isNull(), "no prior comparable period is bound")
        .when(F.col("fact.amount").isNull() | F.col("prior.amount").isNull() | (F.col("prior.amount") == 0), "not exact")
        .otherwise("ok")
    )
    ratio = F.col("fact.amount").cast("double") / F.nullif(F.col("prior.amount").cast("double"), F.lit(0.0))
    return x.withColumn("status", status).withColumn("growth", F.when(status == "ok", (ratio - 1) * 100))


def calculation_key(report: DataFrame) -> DataFrame:
    """Fingerprint of program and bindings per question; at most ten bindings, so the list is bounded."""
    both = F.array(
        F.struct(F.col("fiscal_year"), F.lit(0).alias("side"), F.col("a_id").alias("id"), F.col("a_value").alias("value"), F.col("a_scale").alias("scale"), F.col("a_path").alias("path")),
        F.struct(F.col("fiscal_year"), F.lit(1).alias("side"), F.col("b_id").alias("id"), F.col("b_value").alias("value"), F.col("b_scale").alias("scale"), F.col("b_path").alias("path")),
    )
    rows = report.where("question_hit").select("question_id", "ticker", "intent", F.explode(both).alias("f"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: F.concat_ws(
        ";", f["fiscal_year"].cast("string"), f["side"].cast("string"), f["id"], f["value"], f["scale"], f["path"])), "\n")
    return rows.groupBy("question_id", "ticker", "intent").agg(
        F.concat(F.lit("annual-v1:"), F.sha2(F.concat_ws("\n", F.first("ticker"), F.first("intent"), text), 256)).alias("calc_key"),
        F.count(F.lit(1)).alias("n_bindings"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["path"])), ";").alias("sources"),
    )
