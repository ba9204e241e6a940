import io
import json
import zipfile
import zlib

import pytest

from foliomill.operators import vision
from foliomill.plans import documents
from foliomill.sources import files, layout, office, package, pdf, sheets

R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
P = "http://schemas.openxmlformats.org/package/2006/relationships"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def relations(*rels):
    return f'<Relationships xmlns="{P}">' + "".join(f'<Relationship Id="{i}" Type="{R}/{t}" Target="{to}"{" TargetMode=" + chr(34) + "External" + chr(34) if "://" in to else ""}/>' for i, t, to in rels) + "</Relationships>"


def base(main, **more):
    return {"[Content_Types].xml": f"<Types><Override PartName='/{main}' ContentType='{package.WORKBOOK}'/></Types>", "_rels/.rels": relations(("r1", "officeDocument", main)), **more}


PNG = b"\x89PNG\r\n\x1a\n" + b"picture"
W = "xmlns:w='w' xmlns:r='r' xmlns:a='a' xmlns:wp='wp'"
DOCX = zipped(base("word/document.xml", **{
    "word/document.xml": f"""<w:document {W}><w:body>
      <w:p><w:pPr><w:pStyle w:val='H1'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
      <w:p><w:r><w:t>See </w:t></w:r><w:hyperlink r:id='r5'><w:r><w:t>here</w:t></w:r></w:hyperlink><w:r><w:t>.</w:t></w:r></w:p>
      <w:p><w:pPr><w:numPr><w:ilvl w:val='0'/><w:numId w:val='1'/></w:numPr></w:pPr><w:r><w:t>one</w:t></w:r></w:p>
      <w:p><w:pPr><w:numPr><w:ilvl w:val='0'/><w:numId w:val='1'/></w:numPr></w:pPr><w:r><w:t>two</w:t></w:r></w:p>
      <w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b|c</w:t></w:r></w:p></w:tc></w:tr>
        <w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
      <w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='2'/></w:tcPr><w:p><w:r><w:t>wide</w:t></w:r></w:p></w:tc></w:tr>
        <w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
      <w:p><w:r><w:drawing><wp:docPr descr='a chart'/><a:blip r:embed='r6'/></w:drawing></w:r></w:p>
    </w:body></w:document>""",
    "word/_rels/document.xml.rels": relations(("r5", "hyperlink", "https://x.org/a(b)"), ("r6", "image", "media/i.png")),
    "word/styles.xml": f"<w:styles {W}><w:style w:styleId='H1'><w:name w:val='heading 1'/></w:style></w:styles>",
    "word/numbering.xml": f"<w:numbering {W}><w:abstractNum w:abstractNumId='7'><w:lvl w:ilvl='0'><w:start w:val='3'/><w:numFmt w:val='decimal'/></w:lvl></w:abstractNum><w:num w:numId='1'><w:abstractNumId w:val='7'/></w:num></w:numbering>",
    "word/media/i.png": PNG,
}))
A = "xmlns:p='p' xmlns:a='a' xmlns:r='r'"
PPTX = zipped(base("ppt/presentation.xml", **{
    "ppt/presentation.xml": f"<p:presentation {A}><p:sldIdLst><p:sldId r:id='s1'/><p:sldId r:id='s2'/></p:sldIdLst></p:presentation>",
    "ppt/_rels/presentation.xml.rels": relations(("s1", "slide", "slides/slide1.xml"), ("s2", "slide", "slides/slide2.xml")),
    "ppt/slides/slide1.xml": f"""<p:sld {A}><p:cSld><p:spTree>
      <p:sp><p:nvSpPr><p:nvPr><p:ph type='title'/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Deck</a:t></a:r></a:p></p:txBody></p:sp>
      <p:grpSp><p:sp><p:txBody><a:p><a:pPr><a:buChar char='-'/></a:pPr><a:r><a:t>point</a:t></a:r></a:p><a:p><a:pPr lvl='1'><a:buAutoNum startAt='4'/></a:pPr><a:r><a:t>four</a:t></a:r></a:p></p:txBody></p:sp></p:grpSp>
      <p:graphicFrame><a:tbl><a:tblPr firstRow='1'/><a:tr><a:tc><a:txBody><a:p><a:r><a:t>h</a:t></a:r></a:p></a:txBody></a:tc></a:tr><a:tr><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>
    </p:spTree></p:cSld></p:sld>""",
    "ppt/slides/slide2.xml": f"<p:sld {A}><p:cSld><p:spTree/></p:cSld></p:sld>",
}))
XLSX = zipped(base("xl/workbook.xml", **{
    "xl/workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='Ledger' r:id='r1'/><sheet name='Old' state='hidden' r:id='r2'/></sheets></workbook>",
    "xl/_rels/workbook.xml.rels": relations(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "worksheet", "worksheets/sheet2.xml")),
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>to</t></r><r><t>tal</t></r></si></sst>",
    "xl/styles.xml": "<styleSheet><numFmts><numFmt numFmtId='164' formatCode='$#,##0.00'/><numFmt numFmtId='165' formatCode='yyyy-mm-dd'/><numFmt numFmtId='166' formatCode='[h]:mm:ss'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='164'/><xf numFmtId='165'/><xf numFmtId='166'/></cellXfs></styleSheet>",
    "xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='B1' s='1'><v>1234.5</v></c></row><row><c r='A2' t='s'><v>1</v></c><c r='B2' s='2'><v>45292</v></c></row><row><c r='D9' s='3'><v>1.5</v></c><c r='E9' t='b'><v>1</v></c></row><row><c r='D10'><f>SUM(A1)</f></c></row></sheetData></worksheet>",
    "xl/worksheets/sheet2.xml": "<worksheet><sheetData/></worksheet>",
}))


def pdf_of(*contents):
    objs = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(contents))) + b"]/Count %d>>" % len(contents)]
    for i, c in enumerate(contents):
        data = zlib.compress(c)
        objs += [b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (4 + 2 * i), b"<</Filter/FlateDecode/Length %d>>\nstream\n%s\nendstream" % (len(data), data)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objs, 1))


PDF = pdf_of(b"BT /F1 24 Tf 72 700 Td (Report) Tj /F1 12 Tf 0 -40 Td (Plain \\(first\\) line) Tj 0 -20 Td [(sec) -300 (ond)] TJ 0 -20 Td (- item) Tj ET", b"BT /F1 12 Tf 72 700 Td <50616765> Tj ET")


@pytest.fixture(scope="module")
def results(spark):
    items = [("a.txt", b"# one\r\n\r\ntwo *x*\n"), ("b.md", b"# kept\r\n"), ("c.docx", DOCX), ("d.pptx", PPTX), ("e.xlsx", XLSX), ("f.pdf", PDF), ("g.html", b"<p>"), ("h.txt", b"\xff\xfe"), ("i.pdf", b"plain"), ("j.txt", b" \n\n "),
             ("k.png", PNG), ("l.docx", b"PK\x03\x04 broken"), (None, b"bare text"), ("https://x.org/m.txt", b"no"), ("n.docx", zipped({"word/document.xml": "<a/>"})), ("o.docx", XLSX), ("p.xlsx", zipped({"a": "b"}))]
    return {r.name or "bare": r for r in documents.parse(files.from_memory(spark, items)).collect()}


def test_text_and_markdown(results):
    assert results["a.txt"].markdown == "\\# one\n\ntwo \\*x\\*\n"
    assert results["b.md"].markdown == "# kept\n"
    assert results["bare"].markdown == "bare text\n"


def test_errors_are_data(results):
    want = {"g.html": "unsupported_document", "h.txt": "corrupt_document", "i.pdf": "document_type_mismatch", "j.txt": "no_usable_content", "k.png": "vision_required", "l.docx": "corrupt_document", "https://x.org/m.txt": "invalid_source", "n.docx": "corrupt_document", "o.docx": "document_type_mismatch", "p.xlsx": "corrupt_document"}
    assert {n: results[n].error_code for n in want} == want
    assert all(results[n].markdown is None and not results[n].retryable for n in want)


def test_docx(results):
    assert results["c.docx"].markdown == (
        "# Title\n\nSee [here](https://x.org/a\\(b\\)).\n\n3. one\n4. two\n\n| a | b\\|c |\n| --- | --- |\n| 1 | 2 |\n\n"
        '<table>\n<tbody>\n<tr><td colspan="2">wide</td></tr>\n<tr><td>x</td><td>y</td></tr>\n</tbody>\n</table>\n'
    )
    assert results["c.docx"].warnings == ["vision_unavailable_native_only: an image was left out"]


def test_pptx(results):
    assert results["d.pptx"].markdown == "<!-- page: 1 -->\n\n# Deck\n\n- point\n  4. four\n\n| h |\n| --- |\n| v |\n\n<!-- page: 2 -->\n"
    assert results["d.pptx"].warnings == ["pptx_blank_slide: slide 2 is blank"]


def test_xlsx(results):
    head = "# Ledger (Visible)\n\n<table>\n<tbody>\n<tr><td>name</td><td>$1,234.50</td></tr>\n<tr><td>total</td><td>2024-01-01</td></tr>\n</tbody>\n</table>\n\n"
    assert results["e.xlsx"].markdown == head + "<table>\n<tbody>\n<tr><td>36:00:00</td><td>TRUE</td></tr>\n<tr><td>=SUM(A1)</td><td></td></tr>\n</tbody>\n</table>\n\n# Old (Hidden)\n"
    assert results["e.xlsx"].warnings == ["xlsx_formula_cache_missing: Ledger!D10: no saved value"]


def test_pdf(results):
    assert results["f.pdf"].markdown == "<!-- page: 1 -->\n\n# Report\n\nPlain (first) line sec ond\n\n- item\n\n<!-- page: 2 -->\n\nPage\n"


def test_vision_answers_are_told_at_every_place(spark):
    def client(image, prompt):
        if b"bad" in image:
            return "no json"
        return json.dumps({"elements": [{"type": "table", "grid": [["k", None]], "header_rows": 0, "source_index": 1}, {"type": "text", "text": "seen", "source_index": 0}]})

    items = [("k.png", PNG), ("again.png", PNG), ("bad.png", PNG + b"bad")]
    out = {r.name: r for r in documents.parse(files.from_memory(spark, items), client).collect()}
    assert out["k.png"].markdown == out["again.png"].markdown and "seen" in out["k.png"].markdown and "<td>k</td><td></td>" in out["k.png"].markdown
    assert out["bad.png"].error_code == "vision_required"


def test_a_client_is_asked_again_and_repaired():
    calls = []

    def client(image, prompt):
        calls.append(prompt)
        if len(calls) == 1:
            raise vision.Transient
        return "rubbish" if len(calls) == 2 else '{"text": "ok"}'

    assert vision.ask(client, b"", "p") == ([{"type": "text", "text": "ok", "grid": None, "header_rows": None, "source_index": 0, "bbox": None}], None)
    assert len(calls) == 3 and "rubbish" in calls[2]
    assert vision.ask(lambda *_: (_ for _ in ()).throw(vision.Transient()), b"", "p") == (None, "model_unavailable")
    assert vision.parsed('{"elements": [{"type": "text", "text": "x", "source_index": true}]}') is None
    assert vision.without_overlap("a\nb\nc", "b\n c\nd") == "d" and vision.without_overlap("a", "b") == "b"


@pytest.mark.parametrize("name,ok", [("a/b.xml", True), ("../x", False), ("/x", False), ("C:x", False), ("a//b", False), ("a\\b", False), ("a/./b", False)])
def test_member_names(name, ok):
    assert package.safe(name) is ok


def test_packages_are_guarded():
    with pytest.raises(package.Rejected, match="document types"):
        package.tree(b"<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>")
    with pytest.raises(package.Rejected, match="no target"):
        office.Docx(zipped(base("word/document.xml", **{"word/document.xml": "<d/>", "word/_rels/document.xml.rels": relations(("a", "image", "media/none.png"))})))
    with pytest.raises(package.Rejected, match="too large"):
        office.Docx(zipped(base("word/document.xml", **{"word/document.xml": " " * 5_000_000})))
    with pytest.raises(package.Rejected, match="not valid"):
        sheets.position("A0")
    assert sheets.area("B2:$C$4") == (2, 2, 4, 3)
    with pytest.raises(package.Rejected, match="too many pages"):
        pdf.Pdf(PDF, most=1)


def test_files_names_and_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x y.txt").write_bytes(b"hello")
    (tmp_path / "in" / "z.md").write_bytes(b"*kept*")
    out = documents.parse(files.read(spark, str(tmp_path / "in")))
    files.write_markdown(out, str(tmp_path / "out"))
    got = {r.output_name: r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert got == {"x y.md": "hello", "z.md": "*kept*"}
    twice = files.output_names(spark.createDataFrame([("a.txt",), ("a.md",), ("con.txt",), ("b.txt",)], "name string")).collect()
    assert {r.name: r.name_error for r in twice} == {"a.txt": "names collide", "a.md": "names collide", "con.txt": "name is not portable", "b.txt": None}


def test_stream(spark, tmp_path):
    from foliomill.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"- one\n\ntwo")
    for k in range(2):
        ingest.to_parquet(ingest.markdown(ingest.texts(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        (tmp_path / "in" / "b.txt").write_bytes(b"later")
    assert sorted(r.markdown for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["\\- one\n\ntwo\n", "later\n"]


BOOK = zipped(base("xl/workbook.xml", **{
    "xl/workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='Data' r:id='r1'/></sheets></workbook>",
    "xl/_rels/workbook.xml.rels": relations(("r1", "worksheet", "worksheets/sheet1.xml")),
    "xl/styles.xml": "<styleSheet><numFmts><numFmt numFmtId='164' formatCode='h:mm:ss.00 AM/PM'/><numFmt numFmtId='165' formatCode='0.0E+0'/></numFmts><dxfs><dxf><numFmt numFmtId='166' formatCode='0%'/></dxf></dxfs><cellXfs><xf numFmtId='0'/><xf numFmtId='164'/><xf numFmtId='165'/></cellXfs></styleSheet>",
    "xl/worksheets/sheet1.xml": """<worksheet xmlns:r='r'><dimension ref='A1:H20'/><sheetData>
      <row><c r='A1' t='inlineStr'><is><t>wide</t></is></c><c r='C1'><v>7</v></c></row><row><c r='A2'><v>1</v></c><c r='B2'><v>2</v></c><c r='C2'><v>3</v></c></row>
      <row><c r='E4' t='inlineStr'><is><t>head</t></is></c></row><row><c r='E5' s='1'><v>0.5000001</v></c></row><row><c r='E6' s='2'><v>12.5</v></c></row>
      <row><c r='A10' t='inlineStr'><is><t>site</t></is></c></row></sheetData>
      <conditionalFormatting sqref='C1:C2'><cfRule dxfId='0'/></conditionalFormatting><mergeCells><mergeCell ref='A1:B1'/></mergeCells>
      <hyperlinks><hyperlink ref='A10' r:id='h1'/><hyperlink ref='B10' r:id='h2' display='run'/><hyperlink ref='C10' location='Data!A1'/></hyperlinks>
      <headerFooter><oddHeader>&amp;LLeft &amp;"Arial,Bold"&amp;12bold&amp;RPage &amp;P &amp;G</oddHeader></headerFooter></worksheet>""",
    "xl/worksheets/_rels/sheet1.xml.rels": relations(("h1", "hyperlink", "https://x.org/a"), ("h2", "hyperlink", "file://c/x"), ("t1", "table", "../tables/t1.xml"), ("c1", "comments", "../comments1.xml"), ("p1", "threadedComment", "../threadedComments/tc1.xml"), ("d1", "drawing", "../drawings/d1.xml"), ("x1", "slicer", "../slicer1.xml")),
    "xl/tables/t1.xml": "<table ref='E4:E6' headerRowCount='1'/>", "xl/slicer1.xml": "<slicer/>",
    "xl/comments1.xml": "<comments><authors><author>Ann</author></authors><commentList><comment ref='A2' authorId='0'><text><t>check</t></text></comment></commentList></comments>",
    "xl/threadedComments/tc1.xml": "<t><threadedComment ref='B2' personId='p'><text>why</text></threadedComment></t>", "xl/persons/person.xml": "<personList><person id='p' displayName='Bo'/></personList>",
    "xl/drawings/d1.xml": """<xdr:wsDr xmlns:xdr='x' xmlns:a='a' xmlns:c='c' xmlns:r='r'><xdr:oneCellAnchor><xdr:from><xdr:col>6</xdr:col><xdr:row>0</xdr:row></xdr:from><xdr:sp><xdr:nvSpPr><xdr:cNvPr name='Note'/></xdr:nvSpPr><xdr:txBody><a:p><a:r><a:t>boxed</a:t></a:r></a:p></xdr:txBody></xdr:sp></xdr:oneCellAnchor>
      <xdr:twoCellAnchor><xdr:from><xdr:col>6</xdr:col><xdr:row>9</xdr:row></xdr:from><xdr:to><xdr:col>7</xdr:col><xdr:row>19</xdr:row></xdr:to><xdr:graphicFrame><c:chart r:id='c1'/></xdr:graphicFrame></xdr:twoCellAnchor></xdr:wsDr>""",
    "xl/drawings/_rels/d1.xml.rels": relations(("c1", "chart", "../charts/chart1.xml")),
    "xl/charts/chart1.xml": """<c:chartSpace xmlns:c='c' xmlns:a='a'><c:chart><c:title><a:t>Sales</a:t></c:title><c:plotArea><c:barChart><c:ser><c:tx><c:v>S1</c:v></c:tx>
      <c:cat><c:strRef><c:f>Data!$A$2:$B$2</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>Data!$A$2</c:f><c:numCache><c:ptCount val='2'/><c:pt idx='1'><c:v>9</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>""",
}))


def test_objects_of_a_sheet(spark):
    out = documents.parse(files.from_memory(spark, [("book.xlsx", BOOK)])).collect()[0]
    assert out.error_code is None
    md = out.markdown
    assert md.startswith("# Data (Visible)\n\n")
    assert '<td colspan="2">wide</td><td>7</td>' in md and "<td>1</td><td>2</td><td>3</td>" in md
    assert "| head |\n| --- |\n| 12:00:00.01 PM |\n| 12.5 |" in md
    for part in ("range=A10 object=", "[site](https://x.org/a)", "run (file://c/x)", "](#Data!A1)", "Comment by Ann: check", "Threaded comment by Bo: why", "Text box (Name: Note)\n\nboxed", "Header left: Left bold", "Header right: Page &P", "## Sales\n\nChart type: bar\n\nSeries names: S1"):
        assert part in md or part.replace("&P", "&amp;P") in md, part
    assert "<td>Series</td><td>S1</td><td>Category</td><td>1</td><td>Value</td><td></td>" in md and "<td>2</td><td>Value</td><td>9</td>" in md
    assert md.index("wide") < md.index("Comment by Ann") < md.index("head |") < md.index("[site]") < md.index("## Sales")
    codes = [w.split(":")[0] for w in out.warnings]
    assert sorted(set(codes)) == ["xlsx_external_reference", "xlsx_unsupported_number_format", "xlsx_unsupported_object"] and len(codes) == 6


@pytest.mark.parametrize("change,code", [
    ({"xl/worksheets/sheet1.xml": "<worksheet><sheetData><row><c r='A1'/><c r='A1'/></row></sheetData></worksheet>"}, "corrupt_document"),
    ({"xl/worksheets/sheet1.xml": "<worksheet><sheetData/><mergeCells><mergeCell ref='A1:Z2000'/></mergeCells></worksheet>"}, "limit_exceeded"),
    ({"xl/worksheets/sheet1.xml": "<worksheet><sheetData/>" + "<scenario/>" * 1001 + "</worksheet>"}, "limit_exceeded"),
    ({"xl/styles.xml": "<styleSheet><dxfs>" + "<dxf/>" * 10_001 + "</dxfs></styleSheet>"}, "limit_exceeded"),
    ({"xl/worksheets/sheet1.xml": "<worksheet><dimension ref='A1:XFD1048576'/><sheetData/></worksheet>"}, "limit_exceeded"),
    ({"xl/worksheets/sheet1.xml": "<worksheet>" + "<x/>" * 200_001 + "</worksheet>"}, "limit_exceeded"),
    ({"[Content_Types].xml": "<Types/>"}, "corrupt_document"),
])
def test_workbooks_are_counted_before_they_are_read(change, code):
    parts = base("xl/workbook.xml", **{"xl/workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='A' r:id='r1'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": relations(("r1", "worksheet", "worksheets/sheet1.xml")), "xl/worksheets/sheet1.xml": "<worksheet><sheetData/></worksheet>"}) | change
    with pytest.raises(package.Rejected) as e:
        list(sheets.Workbook(zipped(parts)).cells())
    assert e.value.code == code


def test_many_warnings_are_bounded(spark):
    cells = "".join(f"<row><c r='A{i}'><f>B{i}</f></c></row>" for i in range(1, 41))
    book = zipped(base("xl/workbook.xml", **{"xl/workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='A' r:id='r1'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": relations(("r1", "worksheet", "worksheets/sheet1.xml")), "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>"}))
    out = documents.parse(files.from_memory(spark, [("w.xlsx", book)])).collect()[0]
    assert len(out.warnings) == 21 and "20 additional" in out.warnings[-1]


def page(*words, rules=(), shapes=(), images=()):
    """Words as (text, left, top), each .02 high and .01 wide for a letter."""
    return {"page_number": 1, "failed": False, "rules": list(rules), "shapes": list(shapes), "images": list(images), "words": [{"text": t, "box": (x, y, x + 0.01 * len(t), y + 0.02), "size": 10.0, "font": "Sans"} for t, x, y in words]}


def test_layout_of_pages():
    texts = lambda p: [b.get("text") or b["grid"] for b in layout.page_blocks(p)[0]]
    two = page(*((f"l{i}", 0.1, 0.1 + 0.1 * i) for i in range(3)), *((f"r{i}", 0.6, 0.1 + 0.1 * i) for i in range(3)))
    assert texts(two) == ["l0", "l1", "l2", "r0", "r1", "r2"]
    wide = page(("top", 0.1, 0.05), ("x" * 75, 0.1, 0.3), ("a", 0.1, 0.4), ("b", 0.6, 0.4))
    assert texts(wide)[:2] == ["top", "x" * 75]
    numbers = page(*((t, x, 0.1 + 0.05 * i) for i, row in enumerate([("x1", "5"), ("ab", "12"), ("cd", "3.5"), ("ef", "7%")]) for t, x in zip(row, (0.1, 0.5))))
    assert texts(numbers) == [[["x1", "5"], ["ab", "12"], ["cd", "3.5"], ["ef", "7%"]]]
    joined = page(("Hello", 0.1, 0.1), (",", 0.16, 0.1), ("world", 0.18, 0.1), ("漢", 0.1, 0.3), ("字", 0.12, 0.3))
    assert texts(joined) == ["Hello, world", "漢字"]
    about = lambda p: layout.page_blocks(p)[1]
    assert about(page(images=[(0, 0, 1, 1)]))["image_share"] == 1 and not about(page())["has_text"]
    assert about(page(("word", 0.1, 0.1), images=[(0.5, 0.5, 0.9, 0.9), (0.5, 0.905, 0.9, 0.99), (0.1, 0.5, 0.2, 0.6)]))["regions"] == 1
    assert not about(page(("(cid:5)" * 20, 0.1, 0.1)))["reliable"]
    drawing = page(("word", 0.1, 0.1), shapes=[(0.5 + 0.005 * i, 0.5, 0.51 + 0.005 * i, 0.6) for i in range(40)])
    assert about(drawing)["regions"] == 1
    overlap = page(("aaaaaaaaaaaaaaaa", 0.1, 0.1), ("bbbbbbbbbbbbbbbb", 0.1, 0.112))
    assert layout.ambiguous([b["box"] for b in layout.page_blocks(overlap)[0]])
    assert abs(layout.union_area([(0, 0, 0.5, 0.5), (0.25, 0.25, 0.75, 0.75)]) - 0.4375) < 1e-12
    same = [{"box": (0.1, 0.1, 0.5, 0.5), "grid": [["a", "b"], ["c", "d"]]}, {"box": (0.1, 0.1, 0.5, 0.51), "grid": [["a", "b"], ["c", "d"], ["", ""]]}, {"box": (0.6, 0.1, 0.9, 0.5), "grid": [["x", "y"], ["z", "w"]]}]
    assert [len(t["grid"]) for t in layout.canonical(same)] == [3, 2]


def test_fonts_and_encodings():
    cmap = b"beginbfchar <01> <0041> <02> <00660069> endbfchar beginbfrange <10> <12> <0061> <20> <21> [<0078> <0079>] endbfrange"
    assert pdf.Font.mapped(cmap) == {1: "A", 2: "fi", 16: "a", 17: "b", 18: "c", 32: "x", 33: "y"}
    assert [pdf.glyph(g) for g in ("A", "uni00E9", "eacute", "five", "fi", "comma", "nothing.x")] == ["A", "é", "é", "5", "fi", ",", "\ufffd"]
    assert pdf.read(b"<</A[1 -2.5(x\\(y\\))]/B 3 0 R /C<4142>>>")[0] == {"A": [1, -2.5, b"x(y)"], "B": 3, "C": b"AB"}
    shown = b"BT /F1 10 Tf 1 0 0 1 50 700 Tm <010210> Tj ET"
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate([
        b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1/MediaBox[0 0 600 800]>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>",
        b"<</Length 1>>\nstream\n" + shown + b"\nendstream", b"<</Type/Font/Subtype/TrueType/BaseFont/ABCDEF+Courier/FirstChar 1/Widths[500 600]/ToUnicode 6 0 R>>", b"<</Length 1>>\nstream\n" + cmap + b"\nendstream",
    ], 1))
    word = next(pdf.Pdf(b"%PDF-1.4\n" + body).page_facts())["words"][0]
    assert word["text"] == "Afia" and word["font"] == "Courier" and abs(word["box"][0] - 50 / 600) < 1e-9 and abs(word["box"][2] - 66 / 600) < 1e-9
    with pytest.raises(package.Rejected, match="inflate"):
        bomb = pdf.Pdf(pdf_of(b" " * 1_000_000))
        bomb.left = 1000
        list(bomb.page_facts())


def test_pages_are_read_from_images_where_needed(spark):
    text = b"BT /F1 12 Tf 72 700 Td (Native line) Tj 0 -550 Td (Kept below) Tj ET"
    picture = b" q 400 0 0 300 100 500 cm BI /W 1 /H 1 ID x EI Q"  # over the first line
    full = b"q 612 0 0 792 0 0 cm BI /W 1 /H 1 ID x EI Q"
    content = pdf_of(text + picture, full, text)

    def renderer(data, page):
        from foliomill.operators.images import png
        import numpy as np

        rgb = np.full((80, 60, 3), 255, np.uint8)
        rgb[10:40, 10:50] = 5 * page
        return png(rgb)

    def client(image, prompt):
        return json.dumps({"elements": [{"type": "text", "text": "first seen", "source_index": 0}, {"type": "text", "text": "second seen", "source_index": 1}]})

    out = documents.parse(files.from_memory(spark, [("p.pdf", content)]), client, renderer=renderer).collect()[0]
    pages = out.markdown.split("<!-- page: ")[1:]
    assert pages[0].startswith("1 -->\n\nfirst seen\n\nsecond seen\n\nKept below") and "Native line" not in pages[0]
    assert pages[1].startswith("2 -->\n\nfirst seen\n\nsecond seen") and pages[2].startswith("3 -->\n\nNative line\n\nKept below")
    alone = documents.parse(files.from_memory(spark, [("p.pdf", content)])).collect()[0]
    assert "Native line" in alone.markdown.split("<!-- page: ")[1] and [w.split(":")[0] for w in alone.warnings] == ["vision_unavailable_native_only"] * 2
    broken = documents.parse(files.from_memory(spark, [("p.pdf", content)]), lambda *_: "no json", renderer=renderer).collect()[0]
    assert "Native line" in broken.markdown.split("<!-- page: ")[1] and any(w.startswith("vision_image_failed") for w in broken.warnings)
