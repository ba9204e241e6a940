"""What a workbook may hold: elements are counted, part by part, before anything is built of them."""

from __future__ import annotations

from collections import Counter
from xml.parsers import expat

from foliomill.sources.package import Package, Rejected

#: The most of each thing that a workbook may hold.
LIMITS = {
    "sheets": 128, "declared_cells": 2_000_000, "serialized_cells": 200_000, "merges": 10_000, "merge_footprint": 50_000, "shared_strings": 100_000, "shared_string_chars": 1_000_000,
    "tables": 1_024, "table_footprint": 200_000, "table_columns": 10_000, "links_and_comments": 20_000, "link_footprint": 50_000, "drawing_objects": 256, "chart_points": 200_000,
    "style_records": 50_000, "number_formats": 10_000, "fonts": 10_000, "fills": 10_000, "borders": 10_000, "cell_style_xfs": 10_000, "cell_xfs": 10_000, "named_styles": 1_000, "dxfs": 10_000, "table_styles": 1_000,
    "conditional_rules": 20_000, "conditional_ranges": 10_000, "validations": 10_000, "defined_names": 10_000, "pivot_caches": 128, "pivot_tables": 128, "pivot_records": 50_000, "pivot_items": 200_000,
    "custom_properties": 1_000, "row_dimensions": 50_000, "column_dimensions": 10_000, "page_breaks": 10_000, "scenarios": 1_000, "sheet_views": 256, "filter_items": 10_000, "workbook_views": 256,
    "external_references": 128, "comment_authors": 10_000, "xml_elements": 1_000_000,
}
ELEMENTS_OF_A_PART, WIRE, WORKBOOK = 200_000, 8 << 20, 96 << 20
#: What each thing counts in the two budgets, in bytes.
WIRE_COST = {"sheets": 1_024, "serialized_cells": 256, "drawing_objects": 2_048, "chart_points": 512, "links_and_comments": 1_024}
WORKBOOK_COST = {
    "sheets": 16_384, "serialized_cells": 512, "shared_strings": 128, "style_records": 1_024, "table_columns": 512, "conditional_rules": 1_024, "conditional_ranges": 512, "validations": 1_024, "defined_names": 512,
    "pivot_caches": 16_384, "pivot_tables": 16_384, "pivot_records": 512, "pivot_items": 256, "custom_properties": 1_024, "row_dimensions": 512, "column_dimensions": 512, "page_breaks": 256, "scenarios": 2_048,
    "sheet_views": 2_048, "filter_items": 512, "workbook_views": 2_048, "external_references": 2_048, "comment_authors": 256, "drawing_objects": 32_768, "chart_points": 512, "xml_elements": 128,
}
#: Which elements are counted, by the folder or name of their part: element (below a parent, if one is named) -> counter.
COUNTED = {
    "xl/workbook.xml": {"sheet": "sheets", "definedName": "defined_names", "workbookView": "workbook_views", "externalReference": "external_references", "pivotCache": "pivot_caches"},
    "xl/sharedStrings.xml": {"si": "shared_strings"},
    "xl/styles.xml": {"numFmts/numFmt": "number_formats", "fonts/font": "fonts", "fills/fill": "fills", "borders/border": "borders", "cellStyleXfs/xf": "cell_style_xfs", "cellXfs/xf": "cell_xfs", "cellStyles/cellStyle": "named_styles", "dxfs/dxf": "dxfs", "tableStyles/tableStyle": "table_styles"},
    "docProps/custom.xml": {"property": "custom_properties"},
    "xl/connections.xml": {"connection": "external_references"},
    "xl/worksheets/": {
        "c": "serialized_cells", "mergeCell": "merges", "hyperlink": "links_and_comments", "cfRule": "conditional_rules", "dataValidation": "validations", "row": "row_dimensions", "col": "column_dimensions",
        "brk": "page_breaks", "scenario": "scenarios", "sheetView": "sheet_views", "filter": "filter_items", "customFilter": "filter_items", "dateGroupItem": "filter_items",
    },
    "xl/tables/": {"table": "tables", "tableColumn": "table_columns"},
    "xl/comments": {"comment": "links_and_comments", "author": "comment_authors"},
    "xl/threadedComments/": {"threadedComment": "links_and_comments"},
    "xl/persons/": {"person": "comment_authors"},
    "xl/charts/": {"pt": "chart_points"},
    "xl/drawings/": {"oneCellAnchor": "drawing_objects", "twoCellAnchor": "drawing_objects", "absoluteAnchor": "drawing_objects"},
    "xl/pivotTables/": {"pivotTableDefinition": "pivot_tables"},
    "xl/pivotCache/": {"r": "pivot_records", "s": "pivot_items", "n": "pivot_items", "d": "pivot_items", "b": "pivot_items", "e": "pivot_items"},
}
STYLES = ("number_formats", "fonts", "fills", "borders", "cell_style_xfs", "cell_xfs", "named_styles", "dxfs", "table_styles")


def over(counter: str) -> Rejected:
    return Rejected("limit_exceeded", f"the workbook has too many: {counter.replace('_', ' ')}")


def part_counts(xml: bytes, kinds: dict[str, str]) -> Counter:
    """Counters of one part, which is read but not kept. Stops at the first limit that is passed."""
    out: Counter = Counter()
    above = [""]

    def start(name, _):
        tag = name.rsplit("}", 1)[-1]
        out["xml_elements"] += 1
        if out["xml_elements"] > ELEMENTS_OF_A_PART:
            raise over("xml_elements of a part")
        counter = kinds.get(f"{above[-1]}/{tag}") or kinds.get(tag)
        if counter:
            out[counter] += 1
            if out[counter] > LIMITS[counter]:
                raise over(counter)
        above.append(tag)

    def refuse(*_):
        raise Rejected("corrupt_document", "document types are not allowed in a package")

    p = expat.ParserCreate(namespace_separator="}")
    p.StartElementHandler, p.EndElementHandler, p.StartDoctypeDeclHandler = start, lambda _: above.pop(), refuse
    try:
        p.Parse(xml, True)
    except expat.ExpatError as e:
        raise Rejected("corrupt_document", "a part is not well-formed") from e
    return out


def usage(package: Package) -> Counter:
    """All counters of a workbook, within the limits and the two budgets."""
    out: Counter = Counter()
    for name in sorted(n for n in package.names if n.endswith((".xml", ".vml"))):
        kinds = next((k for at, k in COUNTED.items() if name == at or name.startswith(at) and not at.endswith(".xml")), {})
        if name.endswith(".vml"):
            continue
        out += part_counts(package.read(name), kinds)
        for counter, n in out.items():
            if n > LIMITS.get(counter, n):
                raise over(counter)
    out["style_records"] = sum(out[c] for c in STYLES)
    for what, cost, most in (("wire", WIRE_COST, WIRE), ("workbook", WORKBOOK_COST, WORKBOOK)):
        if sum(out[c] * weight for c, weight in cost.items()) > most:
            raise over(f"bytes in its projected {what}")
    if out["style_records"] > LIMITS["style_records"]:
        raise over("style_records")
    return out
