"""Rendering of block rows to Markdown: a scalar step for each block, then an ordered aggregation under a budget.

Blocks have doc_id, block_index and kind, and by kind: text (text, markdown, code), inlines (array of struct text, target:
paragraph, heading, list_item), level, ordinal (list_item: null for bullets), page_number (page_break), grid and header_rows
(table), cells (array of struct row, column, row_span, column_span, text), row_count and header_rows (spanned_table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.functions import pytext as T

KINDS = ("text", "markdown", "code", "paragraph", "heading", "list_item", "page_break", "hard_break", "table", "spanned_table")
INLINES = "array<struct<text:string,target:string>>"
CELLS = "array<struct<row:int,column:int,row_span:int,column_span:int,text:string>>"
SCHEMA = {"doc_id": "long", "block_index": "int", "kind": "string", "text": "string", "inlines": INLINES, "level": "int", "ordinal": "int", "page_number": "int", "grid": "array<array<string>>", "header_rows": "int", "row_count": "int", "cells": CELLS}


def with_schema(blocks: DataFrame) -> DataFrame:
    """`blocks` with every column of SCHEMA, null where it lacks one."""
    return blocks.select(*((F.col(c) if c in blocks.columns else F.lit(None)).cast(t).alias(c) for c, t in SCHEMA.items()))


def inline_text(inlines: Column) -> Column:
    return T.drop_trailing_newlines(F.array_join(F.transform(inlines, lambda x: T.link(x["text"], x["target"])), ""))


def pipe_table(grid: Column) -> Column:
    row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    shown = F.transform(grid, lambda cells: row(F.transform(cells, T.pipe_cell)))
    rule = row(F.transform(F.get(grid, F.lit(0)), lambda _: F.lit("---")))
    return F.array_join(F.concat(F.slice(shown, 1, 1), F.array(rule), F.slice(shown, 2, F.greatest(F.size(shown) - 1, F.lit(0)))), "\n")


def _table(rows: Column, n: Column) -> Column:
    """Rows in the frame of an HTML table, the first `n` of them as its head."""
    head = F.when(n > 0, F.concat(F.lit("<thead>\n"), F.array_join(F.slice(rows, 1, n), "\n"), F.lit("\n</thead>\n"))).otherwise("")
    body = F.array_join(F.concat(F.slice(rows, n + 1, F.greatest(F.size(rows) - n, F.lit(0))), F.array(F.lit("</tbody>\n</table>"))), "\n")
    return F.concat(F.lit("<table>\n"), head, F.lit("<tbody>\n"), body)


def _cell(tag: Column, attributes: Column, text: Column) -> Column:
    return F.concat(F.lit("<"), tag, attributes, F.lit(">"), T.html_cell(text), F.lit("</"), tag, F.lit(">"))


def html_table(grid: Column, header_rows: Column) -> Column:
    n = F.coalesce(header_rows, F.lit(0))
    tag = lambda i: F.when(i < n, "th").otherwise("td")
    rows = F.transform(grid, lambda cells, i: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: _cell(tag(i), F.lit(""), c)), ""), F.lit("</tr>")))
    return _table(rows, n)


def spanned_table(cells: Column, row_count: Column, header_rows: Column) -> Column:
    n, ordered = F.coalesce(header_rows, F.lit(0)), F.array_sort(cells)  # by row, then column
    tag = lambda c: F.when(c["row"] < n, "th").otherwise("td")
    span = lambda name, value: F.when(value != 1, F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))).otherwise("")
    shown = lambda c: _cell(tag(c), F.concat(span("rowspan", c["row_span"]), span("colspan", c["column_span"])), c["text"])
    rows = F.transform(F.sequence(F.lit(0), row_count - 1), lambda i: F.concat(F.lit("<tr>"), F.array_join(F.transform(F.filter(ordered, lambda c: c["row"] == i), shown), ""), F.lit("</tr>")))
    return _table(rows, n)


def list_item(content: Column, level: Column, ordinal: Column) -> Column:
    marker = F.when(ordinal.isNull(), F.lit("- ")).otherwise(F.concat(ordinal.cast("string"), F.lit(". ")))
    indent = F.repeat(F.lit("  "), F.coalesce(level, F.lit(0)))
    further = F.concat(F.lit("\n"), indent, F.repeat(F.lit(" "), F.length(marker)))
    return F.when(content == "", F.rtrim(F.concat(indent, marker))).otherwise(F.concat(indent, marker, F.replace(content, F.lit("\n"), further)))


def heading(content: Column, level: Column) -> Column:
    hashes = F.repeat(F.lit("#"), F.least(F.greatest(level, F.lit(1)), F.lit(6)))
    return F.regexp_replace(F.concat(hashes, F.lit(" "), content), f"[{T.SPACE}]+$", "")


def value() -> Column:
    """What one block renders to; `shown` holds its inlines, rendered once for all kinds."""
    c = F.col
    return (
        F.when(c("kind") == "text", T.escape(T.drop_trailing_newlines(c("text"))))
        .when(c("kind") == "markdown", T.drop_trailing_newlines(c("text")))
        .when(c("kind") == "code", T.fenced(c("text")))
        .when(c("kind") == "paragraph", c("shown"))
        .when(c("kind") == "heading", heading(c("shown"), c("level")))
        .when(c("kind") == "list_item", list_item(c("shown"), c("level"), c("ordinal")))
        .when(c("kind") == "page_break", F.concat(F.lit("<!-- page: "), c("page_number").cast("string"), F.lit(" -->")))
        .when(c("kind") == "hard_break", F.lit("<!-- page-break -->"))
        .when((c("kind") == "table") & (c("header_rows") == 1), pipe_table(c("grid")))
        .when(c("kind") == "table", html_table(c("grid"), c("header_rows")))
        .when(c("kind") == "spanned_table", spanned_table(c("cells"), c("row_count"), c("header_rows")))
    )


def usable() -> Column:
    """Whether a block has content; structural breaks have none."""
    c, some = F.col, lambda x: ~T.is_blank(x)
    held = (
        F.when(c("kind").isin("text", "markdown", "code"), some(c("text")))
        .when(c("kind").isin("paragraph", "heading", "list_item"), F.exists("inlines", lambda x: some(x["text"])))
        .when(c("kind") == "table", F.exists(F.flatten("grid"), some))
        .when(c("kind") == "spanned_table", F.exists("cells", lambda x: some(x["text"])))
    )
    return F.coalesce(held, F.lit(False))


def unsafe_links() -> Column:
    """Warnings about targets that were not rendered; array of struct code, message."""
    bad = F.filter("inlines", lambda x: x["target"].isNotNull() & ~T.safe_target(x["target"]))
    return F.coalesce(F.transform(bad, lambda x: F.struct(F.lit("unsafe_link_target").alias("code"), F.concat(F.lit("rendered plain text for unsupported link target: "), x["target"]).alias("message"))), F.array().cast("array<struct<code:string,message:string>>"))


def rendered(blocks: DataFrame) -> DataFrame:
    """doc_id, block_index, is_item, value, usable, warnings."""
    rows = with_schema(blocks).withColumn("shown", inline_text(F.col("inlines")))
    return rows.select("doc_id", "block_index", (F.col("kind") == "list_item").alias("is_item"), value().alias("value"), usable().alias("usable"), unsafe_links().alias("warnings"))


def assemble(rows: DataFrame, budget: int) -> DataFrame:
    """doc_id, markdown, n_blocks, warnings, error_code: rendered blocks in order, as far as they fit.

    Blocks are joined by a blank line, items of one list by a newline; a final newline counts. A running sum decides what fits:
    it never falls, so what follows the first block too many is out as well. One shuffle, by doc_id.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("block_index")
    rows = rows.withColumn("in_list", F.col("is_item") & F.coalesce(F.lag("is_item").over(by_doc), F.lit(False)))
    shown = F.col("value").isNotNull() & (F.col("value") != "")
    before = F.coalesce(F.sum(shown.cast("int")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("gap", F.when(~shown | (before == 0), "").when(F.col("in_list"), "\n").otherwise("\n\n")).withColumn("shown", shown)
    size = F.when(F.col("shown"), F.length("value") + F.length("gap")).otherwise(0)
    rows = rows.withColumn("fits", F.sum(size).over(by_doc.rowsBetween(Window.unboundedPreceding, 0)) + 1 <= budget)
    kept = F.col("shown") & F.col("fits")
    out = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(kept, F.struct("block_index", "gap", "value")))).alias("parts"),
        F.array_sort(F.collect_list(F.when(kept & (F.size("warnings") > 0), F.struct("block_index", "warnings")))).alias("warned"),
        F.min(F.when(F.col("shown") & ~F.col("fits"), F.col("block_index"))).alias("stop"),
        F.bool_or("usable").alias("any_usable"),
        F.coalesce(F.bool_or(kept & F.col("usable")), F.lit(False)).alias("kept_usable"),
    )
    error = F.when(~F.col("any_usable"), "no_usable_content").when(F.col("stop").isNotNull() & ~F.col("kept_usable"), "limit_exceeded")
    cut = F.when(F.col("stop").isNotNull(), F.array(F.struct(F.lit("output_truncated").alias("code"), F.concat(F.lit("output stopped before block "), F.col("stop").cast("string")).alias("message")))).otherwise(F.array().cast("array<struct<code:string,message:string>>"))
    return out.select(
        "doc_id",
        F.when(error.isNull(), F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["gap"], p["value"])), ""), F.lit("\n"))).alias("markdown"),
        F.when(error.isNull(), F.size("parts")).otherwise(0).alias("n_blocks"),
        F.when(error.isNull(), F.concat(F.flatten(F.transform("warned", lambda w: w["warnings"])), cut)).alias("warnings"),
        error.alias("error_code"),
    )


def render(blocks: DataFrame, budget: int = 400_000) -> DataFrame:
    return assemble(rendered(blocks), budget)
