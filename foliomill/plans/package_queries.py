"""Queries that write packages from tables and read them back, and those over answers of models and streams."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.operators import geometry, vision
from foliomill.plans import documents
from foliomill.plans.core_queries import BOX, vector_boxes
from foliomill.plans.lineage import place
from foliomill.plans.text_queries import table
from foliomill.sources.package import WORKBOOK
from foliomill.streaming import ingest

QUERIES, ORACLE_SQL = {}, {}
RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def package(main: str, parts: dict[str, str]) -> bytes:
    """A minimal package with the main part and others."""
    out = io.BytesIO()
    rels = lambda pairs: "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{RELATION}{t}" Target="{to}"/>' for i, t, to in pairs) + "</Relationships>"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types><Override PartName="/{main}" ContentType="{WORKBOOK}"/></Types>')
        z.writestr("_rels/.rels", rels([("r1", "officeDocument", main)]))
        for name, data in parts.items():
            z.writestr(name, rels(data) if isinstance(data, list) else data)
    return out.getvalue()


def docx(title: str, lines: list[str]) -> bytes:
    body = f'<p><pPr><outlineLvl val="0"/></pPr><r><t>{escape(title)}</t></r></p>' + "".join(f"<p><r><t>{escape(x)}</t></r></p>" for x in lines)
    return package("word/document.xml", {"word/document.xml": f"<document><body>{body}</body></document>"})


def pptx(title: str, lines: list[str]) -> bytes:
    shapes = f'<sp><ph type="title"/><txBody><p><r><t>{escape(title)}</t></r></p></txBody></sp><sp><txBody>' + "".join(f"<p><pPr><buChar/></pPr><r><t>{escape(x)}</t></r></p>" for x in lines) + "</txBody></sp>"
    return package("ppt/presentation.xml", {"ppt/presentation.xml": '<presentation><sldIdLst><sldId id="s1"/></sldIdLst></presentation>', "ppt/_rels/presentation.xml.rels": [("s1", "slide", "slides/slide1.xml")], "ppt/slides/slide1.xml": f"<sld><cSld><spTree>{shapes}</spTree></cSld></sld>"})


def xlsx(title: str, lines: list[str]) -> bytes:
    rows = "".join(f'<row><c r="A{i}"><v>{i * 1000.5}</v></c><c r="B{i}" t="inlineStr"><is><t>{escape(x)}</t></is></c></row>' for i, x in enumerate(lines, 1))
    return package("xl/workbook.xml", {
        "xl/workbook.xml": f'<workbook><sheets><sheet name="{escape(title)}" id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": [("r1", "worksheet", "worksheets/sheet1.xml")],
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="4"/></cellXfs></styleSheet>', "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>",
    })


def pdf(title: str, lines: list[str]) -> bytes:
    """Four pages of different layout, with a running header and page numbers: a heading and a paragraph of lines, a list, a ruled
    table, and two columns of paragraphs."""
    quoted = lambda x: x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    put = lambda x, y, text, size=12: f"BT /F1 {size} Tf {x} {y} Td ({quoted(text)}) Tj ET"
    half = (len(lines) + 1) // 2
    bodies = [
        [put(72, 700, title, 24), *(put(72, 650 - 14 * i, x) for i, x in enumerate(lines))],
        [put(72, 700 - 14 * i, f"- {x}") for i, x in enumerate(lines)],
        [c for i, x in enumerate(lines) for y in [700 - 24 * i] for c in (f"72 {y} 60 24 re S 132 {y} 300 24 re S", put(78, y + 8, str(i + 1)), put(138, y + 8, x))],
        [put(72 if i < half else 340, 700 - 60 * (i % half), x) for i, x in enumerate(lines)],
    ]
    pages = [" ".join([put(72, 770, f"{title} report"), *body, put(300, 30, f"Page {n}")]) for n, body in enumerate(bodies, 1)]
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    objects = ["<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}>>"]
    for i, shown in enumerate(pages):
        objects += [f"<</Type/Page/Parent 2 0 R/Contents {4 + 2 * i} 0 R>>", f"<</Length {len(shown)}>>\nstream\n{shown}\nendstream"]
    return ("%PDF-1.4\n" + "".join(f"{i} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects, 1))).encode("latin-1")


def roundtrip(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[str, list[str]], bytes]) -> DataFrame:
    """A document for each region with its nations, written and read back."""
    names = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    grouped = names.groupBy("r_regionkey", "r_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("lines"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["r_regionkey"], "name": [f"{k}.{kind}" for k in f["r_regionkey"]], "content": [build(t, [*x]) for t, x in zip(f["r_name"], f["lines"])], "error_code": [None] * len(f)})

    sources = grouped.mapInPandas(write, "doc_id long, name string, content binary, error_code string")
    return documents.parse(sources).select("doc_id", "markdown", "n_blocks", "error_code")


def roundtrip_sql(head: str, line: str, joint: str, tail: str, blocks: str) -> str:
    return f"""
WITH n AS (SELECT r_regionkey, r_name, n_nationkey, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_regionkey::BIGINT AS doc_id, {head} || chr(10) || chr(10) || string_agg({line}, {joint} ORDER BY n_nationkey) || {tail} || chr(10) AS markdown, {blocks} AS n_blocks, NULL::VARCHAR AS error_code FROM n GROUP BY r_regionkey, r_name
"""


TWO, ESCAPED = "chr(10) || chr(10)", "replace(n_name, '_', '\\_')"


@query(roundtrip_sql("'# ' || r_name", ESCAPED, TWO, "''", "count(*)::INT + 1"))
def docx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark, sf_dir, "docx", docx)


@query(roundtrip_sql(f"'<!-- page: 1 -->' || {TWO} || '# ' || r_name", "'- ' || " + ESCAPED, "chr(10)", "''", "count(*)::INT + 2"))
def pptx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark, sf_dir, "pptx", pptx)


@query(roundtrip_sql("'# ' || r_name || ' (Visible)' || chr(10) || chr(10) || '<table>' || chr(10) || '<tbody>'", "'<tr><td>' || format('{:,}', i * 10005 // 10) || CASE WHEN i % 2 = 0 THEN '.00' ELSE '.50' END || '</td><td>' || n_name || '</td></tr>'", "chr(10)", "chr(10) || '</tbody>' || chr(10) || '</table>'", "2").replace("'<tbody>' || chr(10) || chr(10)", "'<tbody>' || chr(10)"))
def xlsx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark, sf_dir, "xlsx", xlsx)


PAGE = lambda n: f"chr(10) || chr(10) || '<!-- page: {n} -->' || chr(10) || chr(10)"


@query(f"""
WITH n AS (SELECT r_regionkey, r_name, n_name AS raw, {ESCAPED} AS n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_regionkey::BIGINT AS doc_id, '<!-- page: 1 -->' || {TWO} || '# ' || r_name || {TWO} || string_agg(n_name, ' ' ORDER BY i) || {PAGE(2)} || string_agg('- ' || n_name, chr(10) ORDER BY i) || {PAGE(3)}
  || '<table>' || chr(10) || '<tbody>' || chr(10) || string_agg('<tr><td>' || i || '</td><td>' || raw || '</td></tr>', chr(10) ORDER BY i) || chr(10) || '</tbody>' || chr(10) || '</table>' || {PAGE(4)} || string_agg(n_name, {TWO} ORDER BY i) || chr(10) AS markdown,
  count(*)::INT * 2 + 7 AS n_blocks, NULL::VARCHAR AS error_code FROM n GROUP BY r_regionkey, r_name
""")
def pdf_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(spark, sf_dir, "pdf", pdf)


PROPS = "'{\"elements\": [{\"type\": \"text\", \"source_index\": 1, \"text\": \"' || event_type || '\"}, {\"type\": \"text\", \"source_index\": 0, \"text\": \"' || user_id || '\"}]}'"


@query("SELECT event_id, 2 AS n, CAST(user_id AS VARCHAR) AS first, event_type AS second FROM events")
def vision_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "events").select("event_id", F.expr(PROPS.replace("user_id", "CAST(user_id AS STRING)")).alias("answer"))
    found = answers.select("event_id", vision.answer_elements(F.col("answer")).alias("e"))
    return found.select("event_id", F.size("e").alias("n"), F.col("e")[0]["text"].alias("first"), F.col("e")[1]["text"].alias("second"))


@query(
    f"""
WITH RECURSIVE v AS (SELECT vec_id, label, {BOX}), o AS (SELECT label, vec_id, {{'l': l, 't': t, 'r': r, 'b': b, 'a': (r - l) * (b - t)}} AS x, row_number() OVER (PARTITION BY label ORDER BY (r - l) * (b - t) DESC, t, l, vec_id) AS n FROM v WHERE (r - l) * (b - t) > 0),
s AS (SELECT label, vec_id, n, true AS keep, [x] AS kept FROM o WHERE n = 1
  UNION ALL SELECT label, vec_id, n, ok, CASE WHEN ok THEN list_append(kept, x) ELSE kept END FROM (SELECT o.label, o.vec_id, o.n, o.x, s.kept, len(list_filter(s.kept, lambda k: greatest(least(k.r, o.x.r) - greatest(k.l, o.x.l), 0) * greatest(least(k.b, o.x.b) - greatest(k.t, o.x.t), 0) >= 0.8 * (k.a + o.x.a - greatest(least(k.r, o.x.r) - greatest(k.l, o.x.l), 0) * greatest(least(k.b, o.x.b) - greatest(k.t, o.x.t), 0)))) = 0 AS ok FROM s JOIN o ON o.label = s.label AND o.n = s.n + 1))
SELECT label, vec_id FROM s WHERE keep
"""
)
def table_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that stay when larger ones take those they overlap: an order-dependent choice within a page."""
    boxes = vector_boxes(spark, sf_dir).where(geometry.area(F.col("box")) > 0).select("label", "vec_id", geometry.area(F.col("box")).alias("area"), "box.*")
    return chosen(boxes, "label")


def chosen(boxes: DataFrame, page: str, overlap: float = 0.8) -> DataFrame:
    """page, vec_id of the boxes kept, greedily by area: one with `overlap` (IoU) with a kept one goes. A page's tables are few by its limits."""

    def keep(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["area", "top", "left", "vec_id"], ascending=[False, True, True, True])
        b, out = f[["left", "top", "right", "bottom", "area"]].to_numpy(), []
        for i in range(len(b)):
            k = b[out]
            w = (k[:, 2].clip(max=b[i, 2]) - k[:, 0].clip(min=b[i, 0])).clip(min=0)
            h = (k[:, 3].clip(max=b[i, 3]) - k[:, 1].clip(min=b[i, 1])).clip(min=0)
            if not (w * h >= overlap * (k[:, 4] + b[i, 4] - w * h)).any():
                out.append(i)
        return f.iloc[out][[page, "vec_id"]]

    return boxes.groupBy(page).applyInPandas(keep, f"{page} {boxes.schema[page].dataType.simpleString()}, vec_id long")


@query("SELECT DISTINCT sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts read as a stream, deduplicated by their digest, taken up until nothing is left, and told from the sink."""
    folder = place(spark)
    table(spark, sf_dir, "documents").where("text IS NOT NULL").select("text", F.current_timestamp().alias("modified")).write.parquet(f"{folder}/in")
    stream = ingest.fresh(spark.readStream.schema("text string, modified timestamp").parquet(f"{folder}/in")).select("digest")
    ingest.to_parquet(stream, f"{folder}/out", f"{folder}/cp").awaitTermination()
    return spark.read.schema("digest string").parquet(f"{folder}/out")


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 3")
def largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest documents of each source: the choice of a title among candidates, as a ranked window with a group limit."""
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").withColumn("rank", rank).where("rank <= 3").select("doc_id", "rank")
