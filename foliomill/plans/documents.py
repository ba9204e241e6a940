"""From sources to Markdown: detection, extraction by type, rendering; errors are data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliomill.errors import RETRYABLE
from foliomill.functions import pytext as T
from foliomill.operators import images as pictures
from foliomill.operators import detect, geometry, quality, records, regions, render, text, values, vision
from foliomill.plans.lineage import few
from foliomill.plans.lineage import written as written_once
from foliomill.sources import layout, office, package, pdf, sheets
from foliomill.sources.files import FILE_BATCH

RAW = "doc_id long, block_index int, kind string, text string, inlines array<struct<text:string,target:string>>, level int, ordinal int, page_number int, grid array<array<string>>, header_rows int, row_count int, cells array<struct<row:int,column:int,row_span:int,column_span:int,text:string>>, image binary, warning string, error_code string, sheet_index int, sheet string, state string, row int, col int, value string, fmt string, date1904 boolean, box array<double>, font string, size double, failed boolean, has_text boolean, reliable boolean, image_share double, regions int, union_share double, rank int, anchor string, blocks array<struct<kind:string,level:int,inlines:array<struct<text:string,target:string>>,grid:array<array<string>>,header_rows:int>>"
COLUMNS = [c.split()[0] for c in RAW.split(", ")]


def with_members(sources: DataFrame) -> DataFrame:
    """`sources` with the member names of those that are ZIP containers; others never reach Python."""
    zipped = detect.signature(F.col("content")) == "zip"

    @F.pandas_udf("array<string>")
    def names(content: pd.Series) -> pd.Series:
        return content.map(lambda c: package.members(bytes(c)) if c is not None else None)

    return sources.withColumn("members", names(F.when(zipped, F.col("content"))))


def office_rows(reader) -> Iterator[dict]:
    for b in reader.blocks():
        if b["kind"] == "image":
            b = {"kind": "image", "text": b.get("text"), "image": reader.p.read(b["part"])}
        yield b
    yield from ({"kind": "warning", "warning": f"{c}: {m}"} for c, m in reader.warnings)


def xlsx_rows(content: bytes) -> Iterator[dict]:
    book = sheets.Workbook(content)
    for c in book.cells():
        part = c.pop("part", None)
        yield {**c, "kind": c["kind"] or "sheet", "text": c.pop("alt", None), "date1904": book.date1904, "image": book.p.read(part) if part else None}
    yield from ({"kind": "warning", "warning": f"{c}: {m}"} for c, m in book.warnings)


#: Places between two raw rows, for what is read in an image.
STEP = 1000
#: A renderer gives a page (from 1) of a PDF as an image; there is none here, so it is injected.
Renderer = Callable[[bytes, int], bytes]


def pdf_rows(content: bytes, renderer: Renderer | None = None) -> Iterator[dict]:
    """Lines, tables and facts of every page; with a renderer also the image of each page that may need one, and of its regions."""
    for page in pdf.Pdf(content).page_facts():
        number = page["page_number"]
        blocks, about = layout.page_blocks(page)
        yield {"kind": "page_break", "page_number": number}
        yield {"kind": "page", "page_number": number, **about}
        image = None
        if renderer and (about["failed"] or about["regions"] or about["has_text"] and not about["reliable"]):
            try:
                image = renderer(content, number)
                yield {"kind": "page_image", "page_number": number, "box": [0.0, 0.0, 1.0, 1.0], "image": image}
            except Exception:
                yield {"kind": "warning", "warning": f"visual_processing_failed: PDF page {number}: the page was not rendered"}
        for b in blocks:
            b["box"] = list(b["box"])
            if b["kind"] == "table":
                b |= {"grid": [[c or "" for c in row] for row in b["grid"]], "header_rows": 0}
            elif b["kind"] == "region":
                part = pictures.cropped(image, tuple(b["box"])) if image else None
                if part is None:
                    continue
                b |= {"kind": "region_image", "image": part}
            yield {**b, "page_number": number}


#: What reads each type of document: bytes -> raw rows (dicts with some of COLUMNS). `register` adds or replaces one.
READERS: dict[str, Callable[[bytes], Iterator[dict]]] = {"docx": lambda c: office_rows(office.Docx(c)), "pptx": lambda c: office_rows(office.Pptx(c)), "xlsx": xlsx_rows, "pdf": pdf_rows}


def register(kind: str, reader: Callable[[bytes], Iterator[dict]]) -> None:
    if not isinstance(kind, str) or not kind or not callable(reader):
        raise TypeError("a reader is a function for a named type")
    READERS[kind] = reader


def extracted(sources: DataFrame, timeout: float | None = None, renderer: Renderer | None = None) -> DataFrame:
    """Raw rows of packages and PDFs: blocks, images, cells, warnings, or one row with an error."""
    readers = dict(READERS)
    if renderer and readers["pdf"] is pdf_rows:
        readers["pdf"] = partial(pdf_rows, renderer=renderer)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:  # bounded in bytes by Spark
            for first in range(0, len(frame), FILE_BATCH):
                some, out = frame.iloc[first : first + FILE_BATCH], []
                for doc_id, kind, content in zip(some["doc_id"], some["document_type"], some["content"]):
                    rows: list[dict] = []
                    try:
                        with package.deadline(timeout):
                            rows += readers[kind](bytes(content))
                    except package.Rejected as e:
                        rows = [{"kind": "error", "error_code": e.code}]
                    except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError):
                        rows = [{"kind": "error", "error_code": "corrupt_document"}]
                    out += [{**dict.fromkeys(COLUMNS), **r, "doc_id": doc_id, "block_index": i * STEP} for i, r in enumerate(rows, 1)]
                yield pd.DataFrame(out, columns=COLUMNS)

    return sources.select("doc_id", "document_type", "content").mapInPandas(run, RAW)


#: Places of blocks within a sheet, and within a slot of it.
SHEET, SLOT = 10_000_000, 100


def cell_texts(raw: DataFrame) -> DataFrame:
    """doc_id, sheet_index, row, col, text of cells: numbers and dates by their formats. Distinct formats are compiled once, where
    they lie, and joined; only few ones are broadcast."""
    c = F.col
    filled = raw.where("kind IN ('string', 'number', 'bool')").select("doc_id", "sheet_index", "row", "col", "kind", "value", "fmt", "date1904")
    numbers = filled.where("kind = 'number'").drop("kind")
    specs, dates = values.tables_of(numbers)
    specs, dates = few(written_once(specs)), few(written_once(dates))
    exact = numbers.withColumn("serial", c("value").try_cast("double")).withColumn("value", c("serial").cast("decimal(28,8)"))
    shown = values.format_numbers(exact, specs).drop("value").withColumnRenamed("serial", "value")
    shown = values.format_dates(shown, dates).withColumn("text", F.coalesce("date_text", "text"))
    cols = ["doc_id", "sheet_index", "row", "col"]
    texts = shown.select(*cols, "text").unionByName(filled.where("kind <> 'number'").select(*cols, c("value").alias("text")))
    return texts.where(~T.is_blank(c("text")))


def format_warnings(raw: DataFrame) -> DataFrame:
    """doc_id, block_index, warning: numbers whose format is not written here; their saved value is shown."""
    formats = raw.where("kind = 'number'").select("doc_id", "block_index", "sheet", "row", "col", "fmt").where("fmt IS NOT NULL AND lower(fmt) <> 'general'")

    @F.pandas_udf("boolean")
    def unknown(fmt: pd.Series) -> pd.Series:
        seen = {f: not values.supported(f) for f in fmt.unique()}
        return fmt.map(seen)

    at = F.concat("sheet", F.lit("!"), records.column_letters(F.col("col")), F.col("row").cast("string"))
    return formats.where(unknown("fmt")).select("doc_id", "block_index", F.concat(F.lit("xlsx_unsupported_number_format: "), at, F.lit(": the saved value is shown")).alias("warning"))


def sheet_blocks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of workbooks: a heading for each sheet, then its tables and objects in order of their places; and the images, with
    the place of each (doc_id, block_index, text, image)."""
    c = F.col
    key = F.concat_ws(":", "doc_id", "sheet_index").alias("sheet_key")
    state = F.when(c("state") == "hidden", "Hidden").when(c("state") == "veryHidden", "Very Hidden").otherwise("Visible")
    title = F.array(F.struct(F.concat("sheet", F.lit(" ("), state, F.lit(")")).alias("text"), F.lit(None).cast("string").alias("target")))
    heads = raw.where("kind = 'sheet'").select("doc_id", (c("sheet_index") * SHEET).alias("block_index"), F.lit("heading").alias("kind"), title.alias("inlines"), F.lit(1).alias("level"))
    texts = cell_texts(raw).withColumn("kind", F.lit("text"))
    areas = raw.where("kind IN ('merge', 'area')").select("doc_id", "sheet_index", "kind", "box", "header_rows")
    tables = regions.tables(texts.unionByName(areas, allowMissingColumns=True).withColumn("sheet_key", key), "sheet_key")
    place = F.split("sheet_key", ":")
    tables = tables.select(place[0].cast("long").alias("doc_id"), place[1].cast("int").alias("sheet_index"), "row", "col", F.lit(0).alias("kind_rank"), F.lit(0).alias("ordinal"), "kind", "grid", "cells", "row_count", "header_rows")
    objects = raw.where("kind = 'object'").select("doc_id", "sheet_index", "row", "col", c("rank").alias("kind_rank"), c("block_index").alias("ordinal"), "kind", "anchor", "blocks", "text", "image")
    slots = records.ordinals(tables.unionByName(objects, allowMissingColumns=True), "doc_id", "sheet_index").withColumn("block_index", c("sheet_index") * SHEET + c("object_index") * SLOT)
    shown = slots.where("kind <> 'object'").select("doc_id", "block_index", "kind", "grid", "cells", "row_count", "header_rows")
    held = slots.where("kind = 'object'")
    marks = held.select("doc_id", "block_index", F.lit("markdown").alias("kind"), F.format_string("<!-- xlsx-object: sheet=%d range=%s object=%d -->", "sheet_index", "anchor", "object_index").alias("text"))
    said = held.select("doc_id", "block_index", F.posexplode("blocks").alias("at", "b")).select("doc_id", (c("block_index") + 1 + c("at")).alias("block_index"), "b.*")
    images = held.where("image IS NOT NULL").select("doc_id", (c("block_index") + SLOT - 1).alias("block_index"), "text", "image")
    out = heads
    for part in (shown, marks, said):
        out = out.unionByName(part, allowMissingColumns=True)
    return out, images


#: How far lines of one paragraph may be apart (page units), and how much their sizes may differ.
LINE_GAP, LINE_LEFT, LINE_RIGHT, LINE_SIZE = (-0.005, 0.04), 0.04, 0.35, 0.5


def pdf_blocks(raw: DataFrame) -> DataFrame:
    """Lines of PDFs as code, headings by size against the body, list items, and paragraphs of lines that belong together.
    Running headers, footers and page numbers are left out."""
    c = F.col
    lines = raw.where("kind = 'line'").select("doc_id", "page_number", "block_index", "text", "size", "font", *(c("box")[i].alias(n) for i, n in enumerate(("left", "top", "right", "bottom"))))
    edge = F.when(c("bottom") <= quality.TOP_MAX, "top").when(c("top") >= quality.BOTTOM_MIN, "bottom")
    edges = lines.select(c("doc_id").alias("doc"), c("page_number").alias("page"), "block_index", edge.alias("edge"), "text").where("edge IS NOT NULL")
    pages = raw.where("kind = 'page'").select(c("doc_id").alias("doc"), c("page_number").alias("page"))
    dropped = quality.edge_lines(edges, pages).where("suppressed").select(c("doc").alias("doc_id"), "block_index")
    lines = lines.join(dropped, ["doc_id", "block_index"], "left_anti")
    body = quality.body_size(lines.withColumn("weight", F.length(F.trim("text"))), "doc_id")
    rows = lines.join(body, "doc_id").withColumn("text", T.strip(c("text"))).withColumn("m", quality.list_marker(c("text"))).withColumn("h", quality.heading_level(c("size"), c("body"), c("text"), c("font")))
    code = quality.monospace(c("font")) & quality.code_like(c("text"))
    rows = rows.withColumn("kind", F.when(code, "code").when(c("h").isNotNull(), "heading").when(c("m").isNotNull(), "list_item").otherwise("paragraph"))
    by = Window.partitionBy("doc_id").orderBy("block_index")
    before = lambda x: F.lag(x).over(by)
    next_ = (before("block_index") == c("block_index") - STEP) & (before("kind") == c("kind"))
    near = (c("top") - before("bottom")).between(*LINE_GAP) & (F.abs(c("left") - before("left")) <= LINE_LEFT) & (F.abs(c("right") - before("right")) <= LINE_RIGHT) & (F.abs(c("size") - before("size")) <= LINE_SIZE)
    rows = quality.islands(rows, ["doc_id"], "block_index", next_ & ((c("kind") == "code") | (c("kind") == "paragraph") & near))
    whole = rows.groupBy("doc_id", "island").agg(
        F.min("block_index").alias("block_index"), F.first("kind").alias("kind"), F.max("h").alias("h"), F.first("m", True).alias("m"),
        F.transform(F.array_sort(F.collect_list(F.struct("block_index", "text"))), lambda x: x["text"]).alias("lines"),
    )
    shown = F.when(c("kind") == "list_item", c("m.content")).otherwise(quality.join_lines(c("lines")))
    inlines = F.when(c("kind") != "code", F.array(F.struct(shown.alias("text"), F.lit(None).cast("string").alias("target"))))
    return whole.select("doc_id", "block_index", "kind", F.when(c("kind") == "code", F.array_join("lines", "\n")).alias("text"), inlines.alias("inlines"), F.when(c("kind") == "heading", c("h")).when(c("kind") == "list_item", 0).alias("level"), F.when(c("kind") == "list_item", c("m.ordinal").cast("int")).alias("ordinal"))


def page_images(raw: DataFrame) -> DataFrame:
    """doc_id, block_index, page_number, box, route, image: what the model is to see of PDFs: whole pages or regions, by the route."""
    held = raw.where("kind IN ('page_image', 'region_image')").select("doc_id", "block_index", "page_number", "box", "kind", "image")
    both = held.join(routed(raw).select("doc_id", "page_number", "route"), ["doc_id", "page_number"])
    return both.where("route = 'full_vision' AND kind = 'page_image' OR route = 'hybrid' AND kind = 'region_image'").drop("kind")


def without_seen(raw: DataFrame, seen: DataFrame) -> DataFrame:
    """`raw` without the native lines and tables of pages that were read as a whole, and without those of which the centre lies in
    a region that was read. seen: page_images that have elements."""
    box = lambda: F.struct(*(F.col("box")[i].alias(n) for i, n in enumerate(("left", "top", "right", "bottom"))))
    native = raw.where("kind IN ('line', 'table') AND page_number IS NOT NULL").select("doc_id", "page_number", "block_index", box().alias("box"))
    areas = seen.select("doc_id", "page_number", box().alias("box"))
    left = geometry.unowned(native, areas, ["doc_id", "page_number"]).select("doc_id", "block_index")
    gone = native.select("doc_id", "block_index").join(left, ["doc_id", "block_index"], "left_anti")
    return raw.join(gone, ["doc_id", "block_index"], "left_anti")


def worthwhile(images: DataFrame) -> DataFrame:
    """`images` (text: the alternative text, image) without icons that say nothing; a standalone image is never one."""

    @F.pandas_udf("boolean")
    def says(text: pd.Series, image: pd.Series) -> pd.Series:
        def one(alt, content) -> bool:
            try:
                ready = pictures.prepare(bytes(content))
            except package.Rejected:
                return True
            return not pictures.decorative(ready.header.width, ready.header.height, ready.facts, None, alt or "")

        return pd.Series([one(a, c) for a, c in zip(text, image)])

    return images.where(F.col("alone") | says("text", "image")).drop("alone")


def routed(raw: DataFrame) -> DataFrame:
    """doc_id, block_index, page_number, route, reason of every page of a PDF."""
    c = F.col
    r = geometry.route(c("failed"), c("has_text"), c("reliable"), c("image_share"), c("regions"), c("union_share"))
    return raw.where("kind = 'page'").select("doc_id", "block_index", "page_number", r.alias("r")).select("doc_id", "block_index", "page_number", "r.*")


def parse(sources: DataFrame, client: vision.Client | None = None, budget: int = text.OUTPUT_CHARS, timeout: float | None = 900.0, renderer: Renderer | None = None) -> DataFrame:
    """doc_id, name, document_type, markdown, n_blocks, warnings, error_code, retryable for every source (name, content, error_code).

    Text is rendered by column functions alone; packages and PDFs are read once in Python and written by the same renderer.
    Images are asked for once by digest and told at every place they stand; without a client they are left out with a warning.
    With a renderer, pages and regions of PDFs that native text does not cover are read from their images, and what was read there
    takes the place of the native text; where reading fails the native text stays.
    """
    found = detect.detect(with_members(sources.withColumnRenamed("error_code", "source_error")))
    found = found.withColumn("error_code", F.coalesce("source_error", "error_code")).drop("members", "source_error")
    good = found.where("error_code IS NULL")
    texts = good.where("document_type = 'text'").select("doc_id", F.col("content").cast("string").alias("text"))
    written = text.blocks(texts)
    verbatim = good.where("document_type = 'markdown'").select("doc_id", F.lit(1).alias("block_index"), F.lit("markdown").alias("kind"), T.newlines(F.col("content").cast("string")).alias("text"))
    raw = written_once(extracted(good.where(F.col("document_type").isin(*READERS)), timeout, renderer if client else None))  # read by every branch below
    kinds = {r.kind for r in raw.select("kind").distinct().collect()}  # a few names; branches without rows are left out of the plan
    parts: list[DataFrame] = []
    warned = raw.where("kind = 'warning'").select("doc_id", "block_index", "warning")
    images = raw.where("kind = 'image'").unionByName(good.where("document_type = 'image'").select("doc_id", F.lit(1).alias("block_index"), F.lit("image").alias("kind"), F.col("content").alias("image")), allowMissingColumns=True)
    images = images.select("doc_id", "block_index", "text", "image")
    visual = images.select("doc_id")
    if "sheet" in kinds:
        shown, on_sheets = sheet_blocks(raw)
        parts.append(shown)
        images = images.unionByName(on_sheets)
        warned = warned.unionByName(format_warnings(raw))
    if "page" in kinds:
        pages = routed(raw)
        at_page = F.concat(F.lit(": PDF page "), F.col("page_number").cast("string"), F.lit(": "), F.replace("reason", F.lit("_"), F.lit(" ")))
        warned = warned.unionByName(pages.where("route = 'blank'").select("doc_id", "block_index", F.concat(F.lit("blank_page"), at_page).alias("warning")))
        if not (client and renderer):
            warned = warned.unionByName(pages.where("route IN ('hybrid', 'full_vision')").select("doc_id", "block_index", F.concat(F.lit("vision_unavailable_native_only"), at_page).alias("warning")))
        visual = visual.unionByName(pages.where("route = 'full_vision'").select("doc_id"))
    if client is not None:
        kinds_of = good.select("doc_id", F.col("document_type").isin("image", "pdf").alias("alone"))
        if "page_image" in kinds:
            images = images.unionByName(page_images(raw).select("doc_id", "block_index", F.lit(None).cast("string").alias("text"), "image"))
        images = worthwhile(images.withColumn("digest", F.sha2("image", 256)).join(kinds_of, "doc_id"))
        told = vision.outcomes(images.select("digest", F.col("image").alias("content")), client)
        seen = written_once(records.replay(images.drop("image", "text"), told, "digest"))  # each image is asked for once
        if "page_image" in kinds:
            answered = page_images(raw).drop("image").join(seen.where("elements IS NOT NULL").select("doc_id", "block_index"), ["doc_id", "block_index"])
            raw = without_seen(raw, answered)
        elements = seen.where("elements IS NOT NULL").select("doc_id", "block_index", F.posexplode("elements").alias("at", "e")).withColumn("block_index", F.col("block_index") + F.least(F.col("at"), F.lit(STEP - 2)) + 1)
        parts.append(elements.select("doc_id", "block_index", F.when(F.col("e.type") == "table", "table").otherwise("text").alias("kind"), F.col("e.text").alias("text"), F.col("e.grid").alias("grid"), F.col("e.header_rows").alias("header_rows")).where("kind = 'table' OR trim(text) <> ''"))
        failed = F.when(F.col("elements").isNull(), F.concat(F.lit("vision_image_failed: "), "error")).otherwise(F.concat(F.lit("vision_image_tile_failed: "), "error"))
        warned = warned.unionByName(seen.where("error IS NOT NULL").select("doc_id", "block_index", failed.alias("warning")))
        warned = warned.unionByName(seen.where("error IS NULL AND size(elements) = 0").select("doc_id", "block_index", F.lit("vision_image_empty: nothing was read in an image").alias("warning")))
    else:
        warned = warned.unionByName(images.select("doc_id", "block_index", F.lit("vision_unavailable_native_only: an image was left out").alias("warning")))
    if kinds:
        parts.append(raw.where(F.col("kind").isin(*render.KINDS)).select(*[c for c in render.SCHEMA if c in COLUMNS]))
    if "page" in kinds:
        parts.append(pdf_blocks(raw))
    union = lambda some: reduce(DataFrame.unionByName, map(render.with_schema, some))
    blocks = union([written, verbatim])
    if parts:  # written, for the renderer would be planned and compiled anew for each of them
        blocks = blocks.unionByName(written_once(union(parts)))
    rendered = render.render(blocks, budget).withColumnRenamed("error_code", "render_error")
    code = F.substring_index("warning", ": ", 1)
    listed = warned.select("doc_id", code.alias("code"), F.struct("block_index", "warning").alias("seq"), F.expr("substring(warning, length(substring_index(warning, ': ', 1)) + 3)").alias("message"))
    told_all = records.bounded(listed).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("code") == "office_warnings_truncated", "code", "rank", "message"))), lambda w: F.concat(w["code"], F.lit(": "), w["message"])).alias("told"))
    broken = raw.where("kind = 'error'").select("doc_id", F.col("error_code").alias("extract_error"))
    needs = visual.distinct().withColumn("visual", F.lit(True))
    out = found.select("doc_id", "name", "document_type", "error_code").join(rendered, "doc_id", "left").join(told_all, "doc_id", "left").join(broken, "doc_id", "left").join(needs, "doc_id", "left")
    nothing = F.when(F.col("visual"), "vision_required").otherwise("no_usable_content")
    error = F.coalesce("error_code", "extract_error", F.when(F.col("render_error") == "no_usable_content", nothing).otherwise(F.col("render_error")), F.when(F.col("markdown").isNull(), nothing))
    warnings = F.concat(F.coalesce("told", F.array().cast("array<string>")), F.coalesce(F.transform("warnings", lambda w: F.concat(w["code"], F.lit(": "), w["message"])), F.array().cast("array<string>")))
    return out.select("doc_id", "name", "document_type", F.when(error.isNull(), F.col("markdown")).alias("markdown"), F.when(error.isNull(), F.col("n_blocks")).otherwise(0).alias("n_blocks"), F.when(error.isNull(), warnings).alias("warnings"), error.alias("error_code"), F.coalesce(error.isin(*RETRYABLE), F.lit(False)).alias("retryable"))
