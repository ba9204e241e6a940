"""What stands on a sheet beside its cells: links, comments, text boxes, headers and footers, charts, images, references.

Objects are dicts of row, col, anchor (as written), rank (their order at one anchor), blocks (block dicts with kind), and for links
label, target and safe, of which the block is made once the cell's text is known; images have their part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

from foliomill.sources.package import Package, Rejected, every, find

#: The order of objects at one anchor.
LINK, COMMENT, TEXT_BOX, HEADER_FOOTER, REFERENCE, CHART, IMAGE = 10, 20, 30, 40, 50, 60, 70
#: Characters that a location may hold unquoted; elements that are headers and footers, and their sides.
PLAIN = "!$&'()*+,-./:;=@_~?"
HEADERS = {"oddHeader": "Header", "oddFooter": "Footer", "evenHeader": "Even header", "evenFooter": "Even footer", "firstHeader": "First header", "firstFooter": "First footer"}
SIDES = {"L": "left", "C": "center", "R": "right"}
#: Charts that are read, by element; points of a range that is read from cells.
CHARTS = {"lineChart": "line", "line3DChart": "line", "barChart": "bar", "bar3DChart": "bar", "pieChart": "pie", "pie3DChart": "pie", "doughnutChart": "doughnut", "scatterChart": "scatter"}
POINTS = 200_000
KNOWN = ("hyperlink", "comments", "threadedComment", "drawing", "vmlDrawing", "table", "printerSettings", "pivotTable", "queryTable", "customProperty")


def plain(text: str) -> list[dict]:
    return [{"text": text, "target": None}]


def paragraph(text: str) -> dict:
    return {"kind": "paragraph", "inlines": plain(text)}


def letters(col: int) -> str:
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


def safe(target: str) -> bool:
    if target.startswith("#"):
        return not re.search(r"\s", target)
    return bool(re.match(r"(?i)(?:https?://[^\s/]|mailto:[^\s])", target)) and not re.search(r"[\s\x00-\x1f\x7f-\x9f]", target)


def sections(raw: str) -> tuple[dict[str, str], set[str]]:
    """The texts of the three sides of a header or footer, and the sides that hold a picture. Formatting codes say nothing."""
    texts, pictures, side = dict.fromkeys("LCR", ""), set(), "C"
    for m in re.finditer(r'&(?P<side>[LCR])|&(?P<font>"[^"]*"?)|&K(?P<colour>[0-9A-Fa-f]{6}|\d{2}[+-]\d{3})|&\[(?P<field>[^\]]*)\]|&(?P<size>\d{1,3})|&(?P<code>.)|(?P<text>[^&]+|&)', raw, re.DOTALL):
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "side":
            side = value
        elif kind == "text":
            texts[side] += value
        elif kind == "field" and value == "Picture" or kind == "code" and value == "G":
            pictures.add(side)
        elif kind == "field":
            texts[side] += f"&[{value}]"
        elif kind == "code" and value == "&":
            texts[side] += "&"
        elif kind == "code" and value not in "BIUESXYOH":
            texts[side] += f"&{value}"
    return {k: v.strip() for k, v in texts.items()}, pictures


class SheetObjects:
    """The objects of one worksheet part; warnings are (code, anchor, what)."""

    def __init__(self, package: Package, part: str, root: list, position):
        self.p, self.part, self.root, self.position = package, part, root, position
        self.relations = package.relations(part)
        self.warnings: list[tuple[str, str, str]] = []

    def related(self, kind: str) -> list[str]:
        return [target for target, type_, external in self.relations.values() if type_.rsplit("/", 1)[-1] == kind and not external]

    def at(self, anchor: str) -> dict:
        row, col = self.position(anchor.split(":")[0])
        return {"row": row, "col": col, "anchor": anchor}

    def all(self) -> Iterator[dict]:
        for make in (self.links, self.comments, self.threads, self.drawings, self.headers, self.unsupported):
            yield from make()

    def links(self) -> Iterator[dict]:
        for link in every(self.root, "hyperlink"):
            target, location = "", link[1].get("location", "")
            if link[1].get("id") is not None:
                if link[1]["id"] not in self.relations:
                    raise Rejected("corrupt_document", "a link has no target")
                target = self.relations[link[1]["id"]][0]
            if location:
                target = f"{target}#{quote(location, safe=PLAIN)}" if target else location if location.startswith("[") else f"#{quote(location, safe=PLAIN)}"
            if not target or not link[1].get("ref"):
                raise Rejected("corrupt_document", "a link has no target or place")
            ok = safe(target)
            if not ok:
                self.warnings.append(("xlsx_external_reference", link[1]["ref"], "the target of a link was kept as plain text"))
            yield {**self.at(link[1]["ref"]), "rank": LINK, "label": link[1].get("display"), "target": target, "safe": ok, "blocks": []}

    def comments(self) -> Iterator[dict]:
        for part in self.related("comments"):
            root = self.p.xml(part)
            authors = [a[3] for a in every(root, "author")]
            for c in every(root, "comment"):
                text, who = "".join(t[3] for t in every(c, "t")), c[1].get("authorId", "")
                if who and (not who.isdigit() or int(who) >= len(authors)):
                    raise Rejected("corrupt_document", "a comment has no author")
                name = authors[int(who)] if who else ""
                if text.strip():
                    yield {**self.at(c[1].get("ref", "")), "rank": COMMENT, "blocks": [paragraph((f"Comment by {name}: " if name else "Comment: ") + text)]}

    def threads(self) -> Iterator[dict]:
        people = {p[1].get("id"): p[1].get("displayName", "") for n in self.p.names if n.startswith("xl/persons/") and n.endswith(".xml") for p in every(self.p.xml(n), "person")}
        for part in self.related("threadedComment"):
            for c in every(self.p.xml(part), "threadedComment"):
                if c[1].get("personId") not in people:
                    raise Rejected("corrupt_document", "a comment has no person")
                yield {**self.at(c[1].get("ref", "")), "rank": COMMENT, "blocks": [paragraph(f"Threaded comment by {people[c[1]['personId']]}: " + "".join(t[3] for t in every(c, "text")))]}

    def headers(self) -> Iterator[dict]:
        for element, label in HEADERS.items():
            for found in every(self.root, element):
                texts, pictures = sections(found[3])
                for side, name in SIDES.items():
                    if texts[side]:
                        yield {**self.at("A1"), "rank": HEADER_FOOTER, "blocks": [paragraph(f"{label} {name}: {texts[side]}")]}
                    if side in pictures:
                        self.warnings.append(("xlsx_unsupported_object", "A1", "a picture in a header or footer was left out"))

    def unsupported(self) -> Iterator[dict]:
        for target, type_, external in self.relations.values():
            kind = type_.rsplit("/", 1)[-1]
            if kind not in KNOWN:
                self.warnings.append(("xlsx_unsupported_object", "A1", f"{kind} was left out"))
        if any(True for e in every(self.root, "extLst")):
            self.warnings.append(("xlsx_unsupported_object", "A1", "an extension was left out"))
        return iter(())

    def drawings(self) -> Iterator[dict]:
        for part in self.related("drawing"):
            relations = self.p.relations(part)
            for anchor in [a for kind in ("twoCellAnchor", "oneCellAnchor", "absoluteAnchor") for a in every(self.p.xml(part), kind)]:
                start, end = find(anchor, "from"), find(anchor, "to")
                cell = lambda n: f"{letters(int(find(n, 'col')[3]) + 1)}{int(find(n, 'row')[3]) + 1}"
                try:
                    name = (cell(start) if start else "A1") + (f":{cell(end)}" if start and end and cell(end) != cell(start) else "")
                except (TypeError, ValueError) as e:
                    raise Rejected("corrupt_document", "the anchor of a drawing is not valid") from e
                at = self.at(name)
                for shape in every(anchor, "sp"):
                    texts = ["".join(t[3] for t in every(p, "t")) for p in every(shape, "p")]
                    about = next(iter(every(shape, "cNvPr")), ["", {}])[1]
                    label = "; ".join(f"{k}: {v}" for k, v in (("Name", about.get("name")), ("Alt text", about.get("descr"))) if v)
                    if any(t.strip() for t in texts):
                        yield {**at, "rank": TEXT_BOX, "blocks": [paragraph(t) for t in [f"Text box ({label})" if label else "Text box", *texts] if t.strip()]}
                for ref in every(anchor, "chart"):
                    target = relations.get(ref[1].get("id"), ("",))[0]
                    if target in self.p.names:
                        yield {**at, "rank": CHART, "chart": target, "blocks": []}
                    else:
                        self.warnings.append(("xlsx_unsupported_object", name, "a chart cannot be read"))
                for picture in every(anchor, "blip"):
                    target = relations.get(picture[1].get("embed"), ("", "", True))
                    if not target[2] and target[0] in self.p.names:
                        about = next(iter(every(anchor, "cNvPr")), ["", {}])[1]
                        yield {**at, "rank": IMAGE, "part": target[0], "alt": about.get("descr", ""), "blocks": []}
                    elif target[0]:
                        self.warnings.append(("xlsx_external_reference", name, "an image outside the workbook was left out"))


def workbook_references(package: Package) -> Iterator[str]:
    """Targets outside the workbook: linked workbooks and connections."""
    for name in sorted(n for n in package.names if n.startswith("xl/externalLinks/") and n.endswith(".xml")):
        yield from (target for target, _, external in package.relations(name).values() if external)
    root = package.xml("xl/connections.xml")
    for c in every(root, "connection") if root else ():
        if held := c[1].get("sourceFile") or c[1].get("odcFile") or next((d[1].get("connection") for d in every(c, "dbPr") if d[1].get("connection")), None):
            yield held


def text_in(node: list | None) -> str:
    return "".join(t[3] for t in every(node, "t")).strip() if node else ""


class Chart:
    """The facts of a chart as blocks; values come from its cache, else from cells of simple ranges."""

    def __init__(self, root: list, cells):
        self.cells = cells  # (sheet name, top, left, bottom, right) -> texts, or None
        self.unresolved: list[str] = []
        self.formulas: list[str] = []
        area = next(iter(every(root, "plotArea")), ["", {}, [], "", ""])
        charts = [c for c in area[2] if c[0] in CHARTS]
        self.kind = CHARTS[charts[0][0]] if charts else "unknown"
        title = next((c for c in every(root, "chart") if find(c, "title")), None)
        self.title = text_in(find(title, "title")) if title else ""
        axes = [a for a in area[2] if a[0] in ("catAx", "valAx", "dateAx", "serAx")]
        self.axis_titles = [t for a in axes if (t := text_in(find(a, "title")))]
        self.axis_labels = [p[1]["val"] for a in axes if (p := find(a, "tickLblPos")) and p[1].get("val")]
        shown = ("showVal", "showCatName", "showSerName", "showPercent", "showLegendKey", "showBubbleSize")
        self.data_labels = [*dict.fromkeys(n[0] for d in every(area, "dLbls") for n in d[2] if n[0] in shown and n[1].get("val") in ("1", "true"))]
        self.series = [self.one(s) for c in charts for s in c[2] if s[0] == "ser"]

    def values(self, node: list | None) -> list[str]:
        """The cached points, with gaps as empty texts and levels joined by ` / `; else the cells of the reference."""
        if not node:
            return []
        formula = next((f[3].strip() for f in every(node, "f") if f[3].strip()), None)
        if formula:
            self.formulas.append(formula)

        def level(cache: list) -> list[str]:
            points = {int(p[1].get("idx", 0)): (find(p, "v") or ["", {}, [], ""])[3] for p in cache[2] if p[0] == "pt"}
            n = int((find(cache, "ptCount") or ["", {}])[1].get("val", len(points)))
            if n > POINTS or any(i >= max(n, 1) for i in points):
                raise Rejected("limit_exceeded" if n > POINTS else "corrupt_document", "the points of a chart are not valid")
            return [points.get(i, "") for i in range(n)]

        for cache in (c for kind in ("strCache", "numCache", "strLit", "numLit") for c in every(node, kind)):
            if found := level(cache):
                return found
        for cache in every(node, "multiLvlStrCache"):
            n = (find(cache, "ptCount") or ["", {}])[1].get("val")
            levels = [level([*lvl[:2], [*lvl[2], ["ptCount", {"val": n}, [], "", ""]] if n else lvl[2], *lvl[3:]]) for lvl in cache[2] if lvl[0] == "lvl"]
            if levels:
                return [" / ".join(x for x in reversed(parts) if x) for parts in zip(*levels)]
        if formula:
            if (found := self.cells(formula)) is not None:
                return found
            self.unresolved.append(formula)
        return []

    def one(self, s: list) -> dict:
        tx = find(s, "tx")
        name = " ".join(self.values(tx)) or (find(tx, "v") or ["", {}, [], ""])[3] if tx else ""
        part = lambda k: self.values(find(s, k))
        return {"name": name, "a": part("xVal") if self.kind == "scatter" else part("cat"), "b": part("yVal") if self.kind == "scatter" else part("val")}

    def blocks(self) -> list[dict]:
        said = [("Axis titles", self.axis_titles), ("Axis label positions", self.axis_labels), ("Data labels", self.data_labels), ("Series names", [*dict.fromkeys(s["name"] for s in self.series)]), ("Local/formula references", [*dict.fromkeys(self.formulas)]), ("References preserved without evaluation", [*dict.fromkeys(self.unresolved)])]
        out = [{"kind": "heading", "level": 2, "inlines": plain(self.title or f"{self.kind.title()} chart")}, paragraph(f"Chart type: {self.kind}")]
        out += [paragraph(f"{what}: {'; '.join(values)}") for what, values in said if values]
        first, second = ("X", "Y") if self.kind == "scatter" else ("Category", "Value")
        at = lambda values, i: values[i] if i < len(values) else ""
        rows = [["Series", s["name"], first, at(s["a"], i), second, at(s["b"], i)] for s in self.series for i in range(max(len(s["a"]), len(s["b"])))]
        if rows:
            return [*out, {"kind": "table", "grid": rows, "header_rows": 0}]
        return [*out, paragraph("Chart series have no saved cache or resolvable local values." if self.series else "Chart has no readable series.")]
