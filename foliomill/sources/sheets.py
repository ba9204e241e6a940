"""XLSX workbooks as rows: cells with typed saved values, formulas and number formats, merges, tables, and objects of sheets."""

from __future__ import annotations

import re

from foliomill.sources import preflight
from foliomill.sources.package import Package, Rejected, every, find
from foliomill.sources.sheet_objects import CHART, REFERENCE, Chart, SheetObjects, paragraph, workbook_references

#: Sheets, cells and characters that a workbook may have.
SHEETS, SERIALIZED, NON_EMPTY, CHARS, GRID = 128, 200_000, 50_000, 1_000_000, 200_000
#: The last row and column of a sheet.
LAST_ROW, LAST_COLUMN = 1_048_576, 16_384
#: The number formats that a style may name without defining them.
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)", 40: "#,##0.00_);[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@"}
A1 = re.compile(r"\$?([A-Z]{1,3})\$?([1-9]\d*)$")


def position(ref: str) -> tuple[int, int]:
    """(row, column), both from 1, of an A1 reference."""
    m = A1.match(ref)
    if not m:
        raise Rejected("corrupt_document", "a cell reference is not valid")
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    if int(m[2]) > LAST_ROW or column > LAST_COLUMN:
        raise Rejected("corrupt_document", "a cell reference is beyond the sheet")
    return int(m[2]), column


def area(ref: str) -> tuple[int, int, int, int]:
    """(top, left, bottom, right) of an A1 range."""
    a, _, b = ref.partition(":")
    (top, left), (bottom, right) = position(a), position(b or a)
    return min(top, bottom), min(left, right), max(top, bottom), max(left, right)


def size(b: tuple[int, int, int, int]) -> int:
    return (b[2] - b[0] + 1) * (b[3] - b[1] + 1)


class Workbook:
    """Sheets in order, with state and cells."""

    def __init__(self, content: bytes):
        self.p = Package(content, "xlsx")
        self.usage = preflight.usage(self.p)
        main, relations = self.p.xml("xl/workbook.xml"), self.p.relations("xl/workbook.xml")
        self.date1904 = (find(main, "workbookPr") or ["", {}])[1].get("date1904") in ("1", "true")
        self.sheets = [(s[1].get("name", ""), s[1].get("state", "visible"), relations.get(s[1].get("id"), ("",))[0]) for s in every(main, "sheet")]
        names = [n.casefold() for n, _, _ in self.sheets]
        if len(names) != len(set(names)):
            raise Rejected("corrupt_document", "sheet names repeat")
        if len(names) > SHEETS:
            raise Rejected("limit_exceeded", "too many sheets")
        shared = self.p.xml("xl/sharedStrings.xml")
        self.strings = ["".join(t[3] for t in every(si, "t")) for si in shared[2] if si[0] == "si"] if shared else []
        styles = self.p.xml("xl/styles.xml")
        own = {int(n[1]["numFmtId"]): n[1].get("formatCode", "General") for n in every(styles, "numFmt")} if styles else {}
        self.formats = [own.get(i, BUILT_IN.get(i, "General")) for x in (find(styles, "cellXfs") or ["", {}, []])[2] for i in [int(x[1].get("numFmtId", 0))]] if styles else []
        self.warnings: list[tuple[str, str]] = []

    def value(self, cell: list) -> tuple[str | None, str | None]:
        """(kind, cached value as text) of a cell: string, bool, error or number."""
        t, v = cell[1].get("t", "n"), find(cell, "v")
        if t == "inlineStr":
            return "string", "".join(x[3] for x in every(cell, "t"))
        if v is None or v[3] == "" and t != "str":
            return None, None
        if t == "s":
            if not v[3].isdigit() or int(v[3]) >= len(self.strings):
                raise Rejected("corrupt_document", "a shared string is missing")
            return "string", self.strings[int(v[3])]
        if t == "b":
            return "bool", "TRUE" if v[3] == "1" else "FALSE"
        if t in ("e", "str"):
            return "string", v[3]
        try:
            float(v[3])
        except ValueError as e:
            raise Rejected("corrupt_document", "a number is not valid") from e
        return "number", v[3]

    def formula(self, f: list, at: str) -> str:
        """A formula without a saved value, as it is written; of special kinds what they span and take."""
        kind = f[1].get("t")
        if kind == "dataTable":
            self.warnings.append(("xlsx_data_table_formula", f"{at}: a data table was not computed"))
            inputs = " ".join(f"{k}={f[1][k]}" for k in sorted(f[1]) if k not in ("t", "ref"))
            return f"=TABLE({f[1].get('ref', '')}{' ' + inputs if inputs else ''})"
        if kind == "array":
            return "{=" + f[3] + "}" + (f" [{f[1]['ref']}]" if ":" in f[1].get("ref", "") else "")
        return "=" + f[3]

    def blanked(self, root: list) -> list[tuple[int, int, int, int]]:
        """Ranges in which a conditional format changes how numbers are written."""
        styles = self.p.xml("xl/styles.xml")
        changing = {i for i, d in enumerate((find(styles, "dxfs") or ["", {}, []])[2]) if find(d, "numFmt")} if styles else set()
        return [area(r) for c in every(root, "conditionalFormatting") if any(x[1].get("dxfId", "").isdigit() and int(x[1]["dxfId"]) in changing for x in c[2] if x[0] == "cfRule") for r in c[1].get("sqref", "").split()]

    def cells(self):
        """Dicts of sheet_index, sheet, state, kind and by kind: cells (row, col, value, fmt), merge and area (box; header_rows for
        an area), object (row, col, rank, blocks). A sheet gives one of kind None first."""
        serialized = filled = chars = grid = linked = 0
        self.found: dict[str, dict[tuple[int, int], str]] = {}
        objects: list[dict] = []
        for index, (name, state, part) in enumerate(self.sheets, 1):
            at = {"sheet_index": index, "sheet": name, "state": state}
            yield {**at, "row": None, "col": None, "kind": None, "value": None, "fmt": None}
            root = self.p.xml(part) if "/worksheets/" in part else None
            if not root:
                continue
            seen: set[tuple[int, int]] = set()
            held = self.found.setdefault(name.casefold(), {})
            changed = self.blanked(root)
            declared = (find(root, "dimension") or ["", {}])[1].get("ref")
            bounds = area(declared) if declared else None
            if bounds and size(bounds) > preflight.LIMITS["declared_cells"]:
                raise preflight.over("declared_cells")
            for c in every(find(root, "sheetData") or ["", {}, []], "c"):
                serialized += 1
                row, col = position(c[1].get("r", ""))
                if (row, col) in seen:
                    raise Rejected("corrupt_document", "a cell repeats")
                seen.add((row, col))
                kind, value = self.value(c)
                formula = find(c, "f")
                if formula is not None:
                    if value is None:
                        kind, value = "string", self.formula(formula, f"{name}!{c[1]['r']}")
                        self.warnings.append(("xlsx_formula_cache_missing", f"{name}!{c[1]['r']}: no saved value"))
                    if re.search(r"\[[^\]]+\]", formula[3]):
                        self.warnings.append(("xlsx_external_reference", f"{name}!{c[1]['r']}: another workbook is referenced"))
                filled, chars = filled + bool(value), chars + len(value or "")
                if serialized > SERIALIZED or filled > NON_EMPTY or chars > CHARS:
                    raise Rejected("limit_exceeded", "too many cells or characters")
                if value:
                    style = int(c[1].get("s", 0))
                    if self.formats and style >= len(self.formats):
                        raise Rejected("corrupt_document", "a style is missing")
                    fmt = self.formats[style] if self.formats else "General"
                    if kind == "number" and any(a <= row <= c_ and b <= col <= d for a, b, c_, d in changed):
                        fmt = "General"
                        self.warnings.append(("xlsx_unsupported_number_format", f"{name}!{c[1]['r']}: a conditional format was not applied"))
                    held[row, col] = value
                    yield {**at, "row": row, "col": col, "kind": kind, "value": value, "fmt": fmt}
            merges = [area(m[1].get("ref", "")) for m in every(root, "mergeCell")]
            about = SheetObjects(self.p, part, root, position)
            tables = [(area(t[1].get("ref", "")), int(t[1].get("headerRowCount", 1) != "0")) for target in about.related("table") for t in [self.p.xml(target)]]
            grid += sum(map(size, merges)) + sum(size(b) for b, _ in tables)
            if sum(map(size, merges)) > preflight.LIMITS["merge_footprint"] or grid > GRID:
                raise Rejected("limit_exceeded", "merges or tables span too many cells")
            for box in merges:
                yield {**at, "kind": "merge", "box": list(map(float, box))}
            for box, header in tables:
                yield {**at, "kind": "area", "box": list(map(float, box)), "header_rows": header}
            some = list(about.all())
            linked += sum(size(area(o["anchor"])) for o in some if "target" in o)
            if linked > preflight.LIMITS["link_footprint"]:
                raise preflight.over("link_footprint")
            objects += [{**at, **o} for o in some]
            self.warnings += [(code, f"{name}!{anchor}: {what}") for code, anchor, what in about.warnings]
        if self.sheets:
            first = {"sheet_index": 1, "sheet": self.sheets[0][0], "state": self.sheets[0][1], "row": 1, "col": 1, "anchor": "A1", "rank": REFERENCE}
            for target in workbook_references(self.p):
                objects.append({**first, "blocks": [paragraph(f"External reference: {target}")]})
                self.warnings.append(("xlsx_external_reference", f"{self.sheets[0][0]}!A1: a reference outside the workbook was not followed"))
        charts: dict[str, list[dict]] = {}
        for o in objects:
            if "target" in o:
                label = o["label"] or self.found.get(o["sheet"].casefold(), {}).get((o["row"], o["col"]), "") or o["target"]
                shown = {"text": label, "target": o["target"]} if o["safe"] else {"text": label if label == o["target"] else f"{label} ({o['target']})", "target": None}
                o["blocks"] = [{"kind": "paragraph", "inlines": [shown]}]
            elif o["rank"] == CHART:
                if o["chart"] not in charts:
                    charts[o["chart"]] = Chart(self.p.xml(o["chart"]), self.range_texts).blocks()
                o["blocks"] = charts[o["chart"]]
            yield {k: v for k, v in o.items() if k in ("sheet_index", "sheet", "state", "row", "col", "anchor", "rank", "blocks", "part", "alt")} | {"kind": "object"}

    def range_texts(self, formula: str) -> list[str] | None:
        """The saved texts of a simple range of one sheet; None for any other formula."""
        m = re.fullmatch(r"(?:'((?:[^']|'')+)'|([^'!\[\]]+))!(\$?[A-Z]{1,3}\$?\d+(?::\$?[A-Z]{1,3}\$?\d+)?)", formula)
        held = self.found.get((m[1] or m[2]).replace("''", "'").casefold()) if m else None
        if held is None:
            return None
        top, left, bottom, right = area(m[3])
        if (bottom - top + 1) * (right - left + 1) > preflight.LIMITS["chart_points"]:
            return None
        return [held.get((r, c), "") for r in range(top, bottom + 1) for c in range(left, right + 1)]
