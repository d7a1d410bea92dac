"""Repair of pipe tables in filings and explicit measurement scales, inside the row of each document.

A document stays one row: its segments are an array of structs, and every step maps that array in plain Python
(``functions/sheets.py``), so nothing is shuffled, sorted or joined. Steps that follow each other are one pass: Spark hands what
one has found to the next as it is. ``each_segment``, ``each_row`` and ``each_cell`` unfold what a step has found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.functions import cells as ce
from factweave.functions import fixed, sheets
from factweave.functions.columns import let, pin

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lines_of(body: Column) -> Column:
    """Lines of a text; a final line break opens no line."""
    return F.split(F.regexp_replace(body, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK)


CELL = "struct<value:string,scale:string,new_value:string>"
COLUMN = "struct<text:string,plain_text:string,scale:string,change:boolean,currency:boolean>"
FOUND = "is_table:boolean,first_line:int,lines:array<string>"
COUNTED = "removed_columns:int,negatives:int,moved:int"
PARSED = f"{FOUND},context:string,rows:array<array<string>>,width:int,reason:string"
REPAIRED = f"{FOUND},context:string,reason:string,rows:array<array<string>>,{COUNTED}"
POLICY = f"{REPAIRED},policy:struct<start:int,default_scale:string,share_scale:string,exceptions:array<string>,currency_default:boolean,descriptors:array<string>>"
SCALED = f"{POLICY},columns:array<{COLUMN}>,table:array<struct<cells:array<{CELL}>,label:string,opens:boolean,section:string>>"
REWRITTEN = f"{FOUND},reason:string,{COUNTED},new_lines:array<string>,changed:boolean,added_k:int,added_m:int,added_b:int,added_t:int"


def _many(fields: str) -> str:
    return f"array<struct<{fields}>>"


def _step(step, d: DataFrame, fields: str) -> DataFrame:
    """segs with what the step finds."""
    return d.withColumn("segs", F.udf(step, _many(fields), useArrow=True)("segs"))


def segments(docs: DataFrame) -> DataFrame:
    """docs(doc_id, body) -> doc_id, body, segs: alternating text and table segments (is_table, first_line, lines). A null body has null segs."""
    cut = F.udf(sheets.segments, _many(FOUND), useArrow=True)
    return docs.select("doc_id", "body", cut(F.make_valid_utf8("body")).alias("segs"))


def each_segment(d: DataFrame) -> DataFrame:
    """One row per segment: doc_id, seg_no (from 1) and the fields found so far."""
    whole = F.when(F.col("segs").isNotNull(), F.col("segs"))  # a filter that Spark infers from a plain column would find the segments twice
    return d.select("doc_id", F.posexplode(whole).alias("_at", "s")).select("doc_id", (F.col("_at") + 1).alias("seg_no"), "s.*")


def with_context(d: DataFrame) -> DataFrame:
    """Adds the context of each table: the last text block above it."""
    return _step(sheets.with_context, d, f"{FOUND},context:string")


def row_cells(line: Column) -> Column:
    """Cells of a complete pipe row, else NULL."""
    def cut(v):
        inner = F.substring(v, F.lit(2), F.length(v) - 2)
        return F.when(v.startswith("|") & v.endswith("|"), F.transform(F.split(inner, r"(?<!\\)\|"), ce.strip))
    return let(ce.strip(line), cut)


def parse_tables(d: DataFrame) -> DataFrame:
    """Adds rows and width of sound tables, and the reason why a table is left alone. Text segments get neither."""
    return _step(sheets.parsed, d, PARSED)


def spread_units(row: Column) -> Column:
    """A row that holds only one units declaration is filled with it from the second cell on."""
    def fill(cells):
        full = F.filter(cells, lambda c: c != "")
        lone = (F.size(full) > 0) & F.forall(full, lambda c: ce.like(ce.plain(c), fixed.UNITS_CELL))
        one = F.size(F.array_distinct(F.transform(full, lambda c: F.lower(ce.plain(c))))) == 1
        return F.when(lone & one, F.transform(cells, lambda c, i: F.when((i > 0) & (c == ""), full[0]).otherwise(c))).otherwise(cells)
    return let(F.transform(row, ce.clean), fill)


def first_data_row(rows: Column) -> Column:
    """Position (from 0) of the first row with a measurement that is no year; the number of rows if there is none."""
    found = F.array_position(F.transform(rows, lambda r, i: (i >= 2) & F.exists(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda c: ce.is_value(c) & ~ce.is_year(c))), True)
    return F.when(found > 0, found.cast("int") - 1).otherwise(F.size(rows))


def repair_structure(d: DataFrame) -> DataFrame:
    """Sound tables in their repaired structure; other segments have NULL rows."""
    return _step(sheets.repaired, d, REPAIRED)


def with_policy(d: DataFrame) -> DataFrame:
    """Adds the field policy to sound tables: table-wide scale, share scale, exceptions, currency habit, one descriptor per column, first data row."""
    return _step(sheets.with_policy, d, POLICY)


def scale_cells(d: DataFrame) -> DataFrame:
    """Adds table (rows with label, section and scaled cells) and columns to each sound table."""
    return _step(sheets.scaled_tables, d, SCALED)


def _unfolded(d: DataFrame, result, of: str, fields: dict[str, str], also: dict[str, str]) -> DataFrame:
    """A row for each element of the fields, which are lists of the same length, with the other fields beside them."""
    found = F.udf(result, "struct<" + ",".join([*[f"{n}:array<{t}>" for n, t in fields.items()], *[f"{n}:{t}" for n, t in also.items()]]) + ">", useArrow=True)(of)
    x = d.select("doc_id", found.alias("_found"))
    return x.select("doc_id", *[f"_found.{n}" for n in also], F.inline(F.arrays_zip(*[F.col(f"_found.{n}") for n in fields])))


def each_row(d: DataFrame) -> DataFrame:
    """One row per table row: doc_id, seg_no, row_no, cells, label, opens, section, columns."""
    text = "array<string>"
    fields = {"seg_no": "int", "row_no": "int", "value": text, "scale": text, "new_value": text, "label": "string", "opens": "boolean", "section": "string", "_at": "int"}
    x = _unfolded(d, sheets.rows_of, "segs", fields, {"_columns": f"array<array<{COLUMN}>>"})
    return x.select("doc_id", "seg_no", "row_no", F.arrays_zip("value", "scale", "new_value").alias("cells"), "label", "opens", "section", F.get("_columns", F.col("_at")).alias("columns"))


def each_cell(d: DataFrame) -> DataFrame:
    """One row per cell: doc_id, seg_no, row_no, col_no, value, scale, new_value, currency_column."""
    fields = {"seg_no": "int", "row_no": "int", "col_no": "int", "value": "string", "scale": "string", "new_value": "string", "currency_column": "boolean"}
    return _unfolded(d, sheets.cells_of, "segs", fields, {})


COUNTS = ["removed_columns", "negatives", "moved", "added_k", "added_m", "added_b", "added_t"]


def repair_tables(docs: DataFrame) -> DataFrame:
    """docs(doc_id, body) -> doc_id, body, segs with old and new lines and the repair counts of each segment."""
    return _step(sheets.rewritten, scale_cells(with_policy(repair_structure(parse_tables(with_context(segments(docs)))))), REWRITTEN)


def repair_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, body) -> repaired text, hashes before and after, report columns. A null body stays null and unchanged."""
    report = ["changed_tables", "skipped_tables", *COUNTS]
    found = F.udf(sheets.summed_up, f"struct<text:string,{','.join(f'{c}:bigint' for c in report)},skip_reasons:string>", useArrow=True)
    x = pin(repair_tables(docs).select("doc_id", "body", found("segs").alias("_r")), _r=F.col("_r"))  # a filter on the results would find them twice
    x = x.select("doc_id", "body", F.concat("_r.text", F.when(F.col("body").endswith("\n"), "\n").otherwise("")).alias("new_body"), *[f"_r.{c}" for c in report], "_r.skip_reasons")
    x = x.withColumn("source_sha256", F.sha2("body", 256)).withColumn("output_sha256", F.sha2("new_body", 256))
    return x.withColumn("changed", ~F.col("source_sha256").eqNullSafe(F.col("output_sha256"))).drop("body")


def labelled_measures(repaired: DataFrame, labels: list[str]) -> DataFrame:
    """Rows with an exact label whose other cells are all '$ n,nnnM'; repeats of a label in a document must agree."""
    x = _unfolded(repaired, lambda text: sheets.labelled_rows(text, labels), "new_body", {"line_no": "int", "label": "string", "cells": "array<string>"}, {})
    x = x.where(F.forall("cells", lambda c: ce.like(c, r"^\$ [\d,]+(?:\.\d+)?M$")))
    nums = F.transform("cells", lambda c: F.regexp_replace(c, "[$ ,M]", "").try_cast("decimal(20,2)"))
    x = x.select("doc_id", "line_no", "label", nums.alias("values"))
    return x.groupBy("doc_id", "label").agg(F.min_by("values", "line_no").alias("values"), (F.min("values") != F.max("values")).alias("conflict"), F.count(F.lit(1)).alias("n_rows"))
