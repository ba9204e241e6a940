import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.functions import pytext as T
from foliomill.operators import detect, geometry, quality, records, regions, render, text, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [
    ("a*b_[c]`<d>\\", "a\\*b\\_\\[c\\]\\`\\<d\\>\\\\"), ("# x\n## y\n    # z", "\\# x\n\\## y\n    # z"), ("- a\n-b\n+ c", "\\- a\n-b\n\\+ c"),
    ("1. a\n12) b\n3.c", "1\\. a\n12\\) b\n3.c"), ("> q", "\\> q"), ("   #x\x85-\u2003y", "   \\#x\x85-\u2003y"), ("-", "-"), ("", ""),
])
def test_escape(spark, raw, want):
    assert one(spark, T.escape(F.lit(raw))) == want.replace("> q", "> q")


def test_fences_lines_and_strip(spark):
    assert one(spark, T.fenced(F.lit("a ```` b"))) == "`````\na ```` b\n`````"
    assert one(spark, T.lines(F.lit("a\r\nb\x0bc\u2028d\n"))) == ["a", "b", "c", "d"]
    assert one(spark, T.strip(F.lit("\u3000\x1c a b \u2009\n"))) == "a b"


def blocks(spark, rows):
    names = ["block_index", "kind", "text", "inlines", "level", "ordinal", "page_number", "grid", "header_rows"]
    data = [(1, i, *[r.get(n) for n in names[1:]]) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(data, "doc_id long, block_index int, kind string, text string, inlines array<struct<text:string,target:string>>, level int, ordinal int, page_number int, grid array<array<string>>, header_rows int")


def test_budgets_and_lists(spark):
    rows = [{"kind": "text", "text": "abc"}, {"kind": "text", "text": "def"}, {"kind": "text", "text": "ghi"}]
    r = render.render(blocks(spark, rows), 12).first()
    assert r.markdown == "abc\n\ndef\n" and r.warnings[0].message == "output stopped before block 3"
    assert render.render(blocks(spark, rows), 3).first().error_code == "limit_exceeded"
    assert render.render(blocks(spark, [{"kind": "page_break", "page_number": 1}]), 99).first().error_code == "no_usable_content"
    item = lambda t, **k: {"kind": "list_item", "inlines": [(t, None)], **k}
    rows = [item("a\nb", level=0, ordinal=9), item("c", level=1), {"kind": "text", "text": "\n"}, item("d", level=0), {"kind": "heading", "inlines": [("h", "javascript:x")], "level": 7}]
    r = render.render(blocks(spark, rows), 999).first()
    assert r.markdown == "9. a\n   b\n  - c\n\n- d\n\n###### h\n" and [w.code for w in r.warnings] == ["unsafe_link_target"]


def test_html_header_rows(spark):
    r = render.render(blocks(spark, [{"kind": "table", "grid": [["a'"], ["b"], ["<c>\n"]], "header_rows": 2}]), 999).first()
    assert r.markdown == "<table>\n<thead>\n<tr><th>a&#x27;</th></tr>\n<tr><th>b</th></tr>\n</thead>\n<tbody>\n<tr><td>&lt;c&gt;<br></td></tr>\n</tbody>\n</table>\n"


def test_texts_that_give_nothing(spark):
    out = text.to_markdown(spark.createDataFrame([(1, None), (2, " \n\n\t"), (3, "a\n \nb\n")], "doc_id long, text string")).collect()
    assert [(r.markdown, r.error_code) for r in out] == [(None, "no_usable_content")] * 2 + [("a\n\nb\n", None)]
    assert text.to_markdown(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string"), 3).first().error_code == "limit_exceeded"


@pytest.mark.parametrize("value,fmt,want,bad", [
    ("1234.5", "$#,##0.00", "$1,234.50", False), ("-1234.5", "$#,##0.00;($#,##0.00)", "($1,234.50)", False), ("0", '_("€"* #,##0.00_);_("€"* (#,##0.00);_("€"* "-"??_)', "€-", False), ("1234567", "#,##0,", "1,235", False),
    ("0.125", "0.0%", "12.5%", False), ("2.5", "0", "3", False), ("1.50", "0.##", "1.5", False), ("1234.5", "General", "1234.5", False), ("1234.5", "0.00E+00", "1234.5", True), ("1234.5", "# ?/?", "1234.5", True), ("1234.5", "[Red]0", "1234.5", True),
    ("1234.5", '0 "kg"', "1234.5", True), ("-3", "0.00", "-3.00", False), ("5", "0 [$€-407]", "5€", False),
])
def test_number_formats(spark, value, fmt, want, bad):
    cells = spark.createDataFrame([(Decimal(value), fmt)], "value decimal(18,4), fmt string")
    r = values.format_numbers(cells, values.specs(spark, [fmt])).first()
    assert (r.text, r.unsupported) == (want, bad)


def test_dates_and_elapsed(spark):
    assert str(one(spark, F.date_format(values.from_serial(F.lit(45292.5)), "yyyy-MM-dd HH:mm"))) == "2024-01-01 12:00"
    assert str(one(spark, F.date_format(values.from_serial(F.lit(1.0)), "yyyy-MM-dd"))) == "1900-01-01"
    assert str(one(spark, F.date_format(values.from_serial(F.lit(0.0), True), "yyyy-MM-dd"))) == "1904-01-01"
    assert one(spark, values.elapsed(F.lit(1.5 * 86400), "[h]:mm:ss")) == "36:00:00" and one(spark, values.elapsed(F.lit(-61.0), "[m]:ss")) == "-1:01"
    assert one(spark, values.clock(F.lit(0), F.lit(5), F.lit(9), "h:mm:ss AM/PM")) == "12:05:09 AM"


def plain_join(lines):
    out = lines[0]
    for right in lines[1:]:
        m = re.match(r"([a-z]+)\b", right)
        if m and (out.endswith("\u00ad") or re.search("[A-Za-z]{2}-$", out) and m[1].endswith(quality.SUFFIXES)):
            out = out[:-1] + right
        elif out.endswith("-"):
            out += right
        elif out and right and out[-1] not in " \n" and right[0] not in ",.;:!?)]}，。；：！？":
            out += " " + right
        else:
            out += right
    return out


def test_lines_join_like_a_loop(spark):
    cases = [["process-", "ing of"], ["well-", "known"], ["a", ", b"], ["soft\u00ad", "ly so"], ["x ", "y"], ["end-", "Ing"], ["one"], ["A-", "able"], ["na-", "tion", "ally-", "ed."]]
    got = [r.x for r in spark.createDataFrame([(c,) for c in cases], "c array<string>").select(quality.join_lines(F.col("c")).alias("x")).collect()]
    assert got == [plain_join(c) for c in cases]


def test_components_equal_flood_fill():
    r = np.random.default_rng(3)
    for _ in range(20):
        cells = sorted({(int(a), int(b)) for a, b in r.integers(0, 12, (60, 2))})
        label = regions.labelled(np.array([c[0] for c in cells]), np.array([c[1] for c in cells]))
        rest, groups = set(cells), []
        while rest:
            stack, group = [rest.pop()], set()
            while stack:
                a, b = stack.pop()
                group.add((a, b))
                for n in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                    if n in rest:
                        rest.remove(n)
                        stack.append(n)
            groups.append(group)
        assert {frozenset(c for c, x in zip(cells, label) if x == v) for v in set(label)} == {frozenset(g) for g in groups}


def test_quality_of_text(spark):
    rows = [(1, "\ufffd" * 3 + "a" * 97), (2, "varied text " * 20), (3, "x" * 50), (4, "─" * 90 + "abcdefghij" * 3), (5, "(cid:12) ok"), (6, None), (7, "")]
    got = {r.doc_id: r for r in quality.measured(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("ok", quality.reliable()).collect()}
    assert [got[i].ok for i in (1, 2, 3, 4, 5, 7)] == [False, True, False, True, False, True]
    assert got[5].n_chars == 10 and got[5].bad_ratio == 0.8


def test_boxes_and_routes(spark):
    box = lambda l, t, r, b: F.struct(F.lit(l).alias("left"), F.lit(t).alias("top"), F.lit(r).alias("right"), F.lit(b).alias("bottom"))  # noqa: E731, E741
    assert abs(one(spark, geometry.iou(box(0.0, 0.0, 2.0, 2.0), box(1.0, 1.0, 3.0, 3.0))) - 1 / 7) < 1e-12
    b = spark.createDataFrame([(1, (0.0, 0.0, 2.0, 2.0)), (1, (1.0, 1.0, 3.0, 3.0)), (1, (0.0, 0.0, 1.0, 1.0)), (2, (0.0, 0.0, 1.0, 0.5))], "g int, box struct<left:double,top:double,right:double,bottom:double>")
    assert {r.g: r.area for r in geometry.union_area(b, "g").collect()} == {1: 7.0, 2: 0.5}
    t, f = F.lit(True), F.lit(False)
    route = lambda *a: one(spark, geometry.route(*a)).reason
    assert route(f, t, t, F.lit(0.85), F.lit(0), F.lit(0.0)) == "full_page_image"
    assert route(f, t, t, F.lit(0.1), F.lit(4), F.lit(0.59)) == "localized_visual_regions"
    assert route(f, t, t, F.lit(0.1), F.lit(5), F.lit(0.1)) == "visual_regions_cover_page"
    assert route(f, f, t, F.lit(0.0), F.lit(0), F.lit(0.0)) == "no_text_or_visual_objects"


def test_detection_and_names(spark):
    rows = [("a.PDF", b"%PDF-1.7"), ("a.webp", b"RIFF\0\0\0\0WEBPx"), ("a.txt", b"%PDF-"), ("x", b"\xff"), ("a.docx", b"PK\x03\x04")]
    members = [None, None, None, None, ["xl/workbook.xml", "word/document.xml"]]
    df = spark.createDataFrame([(*r, m) for r, m in zip(rows, members)], "name string, content binary, members array<string>")
    assert [(r.document_type, r.error_code) for r in detect.detect(df).collect()] == [("pdf", None), ("image", None), (None, "document_type_mismatch"), (None, "unsupported_document"), ("docx", None)]


def test_letters_and_redaction(spark):
    for n, want in ((1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (18278, "ZZZ")):
        assert one(spark, records.column_letters(F.lit(n))) == want and one(spark, records.column_number(F.lit(want))) == n
    assert one(spark, records.redact(F.lit("api_key=abc at /home/x and a/b"))) == "api_key=[REDACTED] at [REDACTED] and a/b"
