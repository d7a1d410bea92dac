"""Filing discovery and selection: page pruning, de-duplication, timelines, ranking, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions import fixed
from factweave.operators.ordered import with_neighbors

ACCESSION = r"\d{10}-\d{2}-\d{6}"


def submissions_rows(submissions: DataFrame, forms: list[str], years: list[int]) -> DataFrame:
    """Parallel arrays of one company's submissions -> one row per filing of the wanted forms and years."""
    r = "filings.recent"
    zipped = F.arrays_zip(*[F.col(f"{r}.{c}").alias(c) for c in ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument")])
    x = submissions.select("cik", F.posexplode(zipped).alias("pos", "f")).select("cik", "pos", "f.*")
    report = F.coalesce(F.nullif("reportDate", F.lit("")), "filingDate")
    x = x.withColumn("report_date", report).withColumn("year", F.left("report_date", F.lit(4)).try_cast("int"))
    x = x.where(F.col("form").isin(forms) & F.col("year").isin(years))
    return x.select("cik", "pos", "year", "form", F.col("filingDate").alias("filing_date"), "report_date",
                    F.col("accessionNumber").alias("accession"), F.col("primaryDocument").alias("primary_document"))


def submission_pages(submissions: DataFrame, years: list[int]) -> DataFrame:
    """Main page plus the history pages whose year range meets the wanted years; an unreadable range is kept."""
    f = submissions.select("cik", F.explode("filings.files").alias("h")).select("cik", "h.*")
    lo, hi = F.left("filingFrom", F.lit(4)).try_cast("int"), F.left("filingTo", F.lit(4)).try_cast("int")
    meets = reduce(lambda a, b: a | b, [(lo <= y) & (hi >= y) for y in years])
    hist = f.where((lo.isNull() | hi.isNull() | meets) & (F.coalesce("name", F.lit("")) != "")).select("cik", F.col("name").alias("page"))
    return submissions.select("cik", F.lit("main").alias("page")).unionByName(hist)


def ticker_map(matrix: DataFrame) -> DataFrame:
    """matrix(fields array<string>, data array<array<string>>) -> companies; a later duplicate key wins."""
    x = matrix.select("fields", F.posexplode("data").alias("ordinal", "row"))
    at = lambda name: F.element_at("row", F.array_position("fields", F.lit(name)).cast("int"))
    x = x.select("ordinal", F.upper(at("ticker")).alias("sec_ticker"), F.lpad(at("cik"), 10, "0").alias("cik"), at("name").alias("title"), at("exchange").alias("exchange"))
    x = x.withColumn("key", normal_ticker(F.col("sec_ticker")))
    return x.groupBy("key").agg(F.max_by(F.struct("sec_ticker", "cik", "title", "exchange"), "ordinal").alias("c")).select("key", "c.*")


def normal_ticker(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def constituents(pages: DataFrame, exact: bool = True) -> DataFrame:
    """pages(page_id, html) -> symbols of the first table whose header names a symbol column."""
    flat = F.regexp_replace("html", r"(?is)<(sup|style|script)\b.*?</\1>", "")
    tables = F.regexp_extract_all(flat, F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1))
    t = pages.select("page_id", F.posexplode(tables).alias("table_no", "t"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\s+", " "))
    cells = lambda tr: F.transform(F.regexp_extract_all(tr, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), F.lit(1)), clean)
    rows = F.filter(F.transform(F.regexp_extract_all("t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1)), cells), lambda r: F.size(r) > 0)
    t = t.withColumn("rows", rows).where(F.size("rows") > 0).withColumn("header", F.col("rows")[0])
    hit = (lambda h: h == "Symbol") if exact else (lambda h: F.lower(h).contains("symbol") | F.lower(h).contains("ticker"))
    index = F.array_position(F.transform("header", lambda h: hit(h)), F.lit(True)).cast("int")
    sym = lambda r: F.when(F.size(r) >= F.col("ix"), F.element_at(r, F.col("ix")))
    norm = (lambda s: F.replace(s, F.lit("."), F.lit("-"))) if exact else (lambda s: F.regexp_replace(F.upper(s), "[^A-Z0-9.-]", ""))
    t = t.withColumn("ix", index).where("ix > 0")
    t = t.withColumn("symbols", F.filter(F.transform(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1))), lambda r: norm(sym(r))), lambda s: s.isNotNull() & (s != "")))
    first = t.where(F.size("symbols") > 0).groupBy("page_id").agg(F.min_by("symbols", "table_no").alias("symbols"))
    return first.select("page_id", F.posexplode("symbols").alias("pos", "ticker"))


def archive_files(files: DataFrame, exhibits: bool = False, rendered: bool = False) -> DataFrame:
    """files(filing_id, name, primary_document, ordinal) -> the files to keep, primary first, each name once."""
    low, prim = F.lower("name"), F.lower("primary_document")
    keep = (
        F.when(low == prim, True)
        .when(F.regexp_like(low, F.lit(r"^r\d+\.htm$")), F.lit(rendered))
        .when(low.contains("exhibit") | F.regexp_like(low, F.lit(r"[-_]ex\d")), F.lit(exhibits))
        .when(F.regexp_like(low, F.lit(r"\.(xml|xsd|txt|pdf)$")), True)
        .when(F.regexp_like(low, F.lit(r"(-index|-index-headers)\.html$")), True)
        .otherwise(False)
    )
    listed = files.where(F.regexp_like(low, F.lit(r"\.(htm|html|txt|xml|xsd|pdf)$")) & keep).select("filing_id", "name", "ordinal")
    primary = files.where(F.coalesce("primary_document", F.lit("")) != "").select("filing_id", F.col("primary_document").alias("name"), F.lit(-1).cast("long").alias("ordinal"))
    return primary.unionByName(listed.withColumn("ordinal", F.col("ordinal").cast("long"))).groupBy("filing_id", "name").agg(F.min("ordinal").alias("ordinal"))


def high_value_source(name: Column) -> Column:
    return F.regexp_like(F.lower(name), F.lit(r"(\.htm\.md|_htm\.xml\.md|\.txt\.md|filingsummary\.xml\.md)$"))


def latest_filings(filings: DataFrame) -> DataFrame:
    """Per (ticker, year, form without amendment mark, report date) the latest filing date; the first one on ties."""
    key = F.struct(F.col("filing_date"), (-F.col("ordinal")).alias("o"))
    cols = [c for c in filings.columns if c not in ("ticker", "year", "report_date")]
    g = filings.groupBy("ticker", "year", F.replace("form", F.lit("/A"), F.lit("")).alias("base_form"), "report_date")
    return g.agg(F.max_by(F.struct(*cols), key).alias("f")).select("ticker", "year", "base_form", "report_date", "f.*")


def by_accession(filings: DataFrame) -> DataFrame:
    """Each accession once, the last row wins; filings without a primary document are left out."""
    x = filings.where(F.coalesce("primary_document", F.lit("")) != "")
    cols = [c for c in filings.columns if c != "accession"]
    return x.groupBy("accession").agg(F.max_by(F.struct(*cols), "ordinal").alias("f")).select("accession", "f.*")


def timeline(filings: DataFrame) -> DataFrame:
    """Prior and next filing of the same company by (filing date, accession), in month chunks."""
    chunk = F.date_format("filing_date", "yyyy-MM")
    x = with_neighbors(filings, ["ticker"], chunk, ["filing_date", "accession"], ["id"])
    return x.withColumn("prior_filing", F.col("prior.id")).withColumn("next_filing", F.col("next.id")).drop("prior", "next")


def retrieval_filings(requests: DataFrame, filings: DataFrame, limit: int, several: int | None = None) -> DataFrame:
    """requests(question_id, ticker, years) x filings -> at most ``limit`` annual and quarterly filings per question and company.

    Wanted year first, then recency; the newest one and two annual reports lead. A question that names several companies gets
    ``several`` filings for each. Filings are reduced to the newest of each company and of each company's year first, as no question
    can take more; so a busy company brings a few rows to each of its questions.
    """
    f = filings.where(F.upper("form").isin("10-K", "10-Q")).select("id", F.col("ticker").alias("ft"), "form", "fiscal_year", "filing_date", "ordinal")
    newest = lambda df, keys, k: df.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("filing_date"), "ordinal"))).where(F.col("r") <= k).drop("r")
    wanted = F.coalesce(F.array_contains("years", F.col("fiscal_year")).cast("int"), F.lit(0))
    order = [F.desc(wanted), F.desc("filing_date"), F.col("ordinal")]
    by_year = requests.select("*", F.explode(F.array_distinct("years")).alias("_year"))

    def ranked(pool, k):
        some = requests.join(newest(pool, ["ft"], k), F.col("ticker") == F.col("ft"))
        dated = by_year.join(newest(pool, ["ft", "fiscal_year"], k), (F.col("ticker") == F.col("ft")) & (F.col("_year") == F.col("fiscal_year"))).drop("_year")
        x = some.unionByName(dated).dropDuplicates(["question_id", "ticker", "id"])
        return x.withColumn("r", F.row_number().over(W.partitionBy("question_id", "ticker").orderBy(*order))).where(F.col("r") <= k)

    top, annual = ranked(f, limit + 3), ranked(f.where("form = '10-K'"), 2)
    branches = (
        top.select("question_id", "ticker", "id", F.when(F.col("r") == 1, 0).otherwise(F.col("r") + 10).alias("o"))
        .unionByName(annual.select("question_id", "ticker", "id", F.col("r").alias("o")))
    )
    once = branches.groupBy("question_id", "ticker", "id").agg(F.min("o").alias("o"))
    w = W.partitionBy("question_id", "ticker").orderBy("o")
    out = once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("o")
    if several is None:
        return out
    named = requests.groupBy("question_id").agg((F.min("ticker") != F.max("ticker")).alias("_several"))
    return out.join(named, "question_id").where(~F.col("_several") | (F.col("rank") <= several)).drop("_several")


def balanced_sample(files: DataFrame, limit: int) -> DataFrame:
    """files(ticker, year, path): round robin over years in path order, ``limit`` files per company.

    Only a year's first ``limit`` files can be chosen, so both windows are top-k.
    """
    x = files.withColumn("turn", F.row_number().over(W.partitionBy("ticker", "year").orderBy("path"))).where(F.col("turn") <= limit)
    return x.withColumn("pick", F.row_number().over(W.partitionBy("ticker").orderBy("turn", "year"))).where(F.col("pick") <= limit)


def unresolved(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Wanted tickers without a company of the same normalised symbol."""
    w, k = wanted.withColumn("key", normal_ticker(F.col("ticker"))), known.select(normal_ticker(F.col("ticker")).alias("key"))
    return w.join(k, "key", "left_anti")


def canonical_paths(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted(path) -> stored path: exact, else same folder and accession, else same folder and stem prefix.

    The prefix rule means "starts with"; each stored name offers all its dash-cut prefixes as equi-join keys.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    stem = lambda c: F.regexp_replace(name(c), r"\.[^.]*$", "")
    e = existing.select(F.col("path").alias("stored"), folder("path").alias("folder"), name("path").alias("name"))
    w = wanted.select("path", folder("path").alias("folder"), F.nullif(F.regexp_extract(name(F.col("path")), f"({ACCESSION})", 1), F.lit("")).alias("acc"),
                      F.regexp_replace(stem("path"), r"-[^-]*$", "").alias("prefix"))
    exact = w.join(e.select("stored"), F.col("path") == F.col("stored")).select("path", F.lit(0).alias("o"), "stored")
    acc = e.withColumn("acc", F.regexp_extract("name", f"({ACCESSION})", 1)).where("acc <> ''")
    by_acc = w.join(acc.select("folder", "acc", "stored"), ["folder", "acc"]).select("path", F.lit(1).alias("o"), "stored")
    parts = F.split("name", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "-"))
    pre = e.select("folder", "stored", F.explode(F.array_distinct(F.concat(prefixes, F.array(stem("name"))))).alias("prefix"))
    by_prefix = w.join(pre, ["folder", "prefix"]).select("path", F.lit(2).alias("o"), "stored")
    best = exact.unionByName(by_acc).unionByName(by_prefix).groupBy("path").agg(F.min(F.struct("o", "stored")).alias("b"))
    return wanted.join(best, "path", "left").select("path", F.coalesce("b.stored", "path").alias("canonical"), F.coalesce("b.o", F.lit(3)).alias("rule"))


def sector_lookup(spark) -> DataFrame:
    rows = [(t, s, fixed.SECTOR_ACTIVITY[s]) for s, ts in fixed.SECTOR_TICKERS.items() for t in ts]
    return spark.createDataFrame(rows, "ticker string, sector string, activity string")


def company_sector(companies: DataFrame) -> DataFrame:
    """companies(ticker, title, industry): sector and one-line overview; the sector map is a fixed list of about a hundred."""
    look = sector_lookup(companies.sparkSession)
    x = companies.join(F.broadcast(look), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    text = (
        F.when(F.coalesce("industry", F.lit("")) != "", F.concat("title", F.lit(" primarily operates in "), F.lower("industry"), F.lit(" and is classified in the "), "sector", F.lit(" sector.")))
        .when(F.col("activity").isNotNull(), F.concat("title", F.lit(" "), "activity", F.lit(" and is classified in the "), "sector", F.lit(" sector.")))
        .otherwise(F.concat("title", F.lit(" is a publicly traded company. More detailed company profile data is not yet available.")))
    )
    return x.withColumn("overview", text)


def company_enrich(companies: DataFrame, submissions: DataFrame) -> DataFrame:
    """Name and CIK from the submissions where given, else from the company file; industry from the submissions."""
    s = submissions.select("ticker", F.col("name").alias("s_name"), F.col("cik").alias("s_cik"), "industry")
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")), F.lit(""))
    x = companies.join(s, "ticker", "left")
    return x.select("ticker", pick("s_name", "title").alias("title"), pick("s_cik", "cik").alias("cik"), F.coalesce("industry", F.lit("")).alias("industry"))


def manifest_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows that were not produced again, and all new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
