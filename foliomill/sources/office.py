"""DOCX and PPTX packages as block rows (see operators.render for their columns)."""

from __future__ import annotations

import re
from collections import defaultdict

from foliomill.sources.package import Package, Rejected, every, find

#: Fixed value: slides that a presentation may have.
SLIDES = 300
HEADING = re.compile(r"(?:heading|标题)\s*(\d+)$", re.IGNORECASE)
TARGET = re.compile(r"[\s\x00-\x1f\x7f-\x9f]")


def block(kind: str, **values) -> dict:
    return {"kind": kind, **values}


def put(inlines: list[dict], text: str, target: str | None) -> None:
    """Adds text; neighbours with one target grow together, targets that are not valid become plain text."""
    if target is not None and (not target or TARGET.search(target)):
        target = None
    if not text:
        return
    if inlines and inlines[-1]["target"] == target:
        inlines[-1]["text"] += text
    else:
        inlines.append({"text": text, "target": target})


class Docx:
    """Body paragraphs and tables of a document in order."""

    def __init__(self, content: bytes):
        self.p = Package(content, "docx")
        self.relations = self.p.relations("word/document.xml")
        self.styles, self.warnings = {}, []
        for s in every(self.p.xml("word/styles.xml") or ["", {}, [], "", ""], "style"):
            outline = find(s, "pPr", "outlineLvl")
            self.styles[s[1].get("styleId")] = ((find(s, "name") or ["", {}])[1].get("val", ""), (find(s, "basedOn") or ["", {}])[1].get("val"), outline[1].get("val") if outline else None, find(s, "pPr", "numPr"))
        self.levels, self.nums = {}, {}
        numbering = self.p.xml("word/numbering.xml")
        for a in (find_all(numbering, "abstractNum") if numbering else ()):
            for lvl in find_all(a, "lvl"):
                self.levels[a[1].get("abstractNumId"), int(lvl[1].get("ilvl", 0))] = ((find(lvl, "numFmt") or ["", {}])[1].get("val", "decimal"), int((find(lvl, "start") or ["", {}])[1].get("val", 1)))
        for n in (find_all(numbering, "num") if numbering else ()):
            over = {int(o[1].get("ilvl", 0)): int(s[1].get("val", 1)) for o in find_all(n, "lvlOverride") if (s := find(o, "startOverride"))}
            self.nums[n[1].get("numId")] = ((find(n, "abstractNumId") or ["", {}])[1].get("val"), over)
        self.counters: dict[tuple[str, int], int] = {}

    def chain(self, style: str | None):
        seen = set()
        while style in self.styles and style not in seen:
            seen.add(style)
            yield self.styles[style]
            style = self.styles[style][1]

    def heading(self, p: list) -> int | None:
        direct = find(p, "pPr", "outlineLvl")
        style = (find(p, "pPr", "pStyle") or ["", {}])[1].get("val")
        if direct:
            return min(int(direct[1].get("val", 0)) + 1, 6)
        for _, _, outline, _ in self.chain(style):
            if outline is not None:
                return min(int(outline) + 1, 6)
        for name, *_ in self.chain(style):
            if m := HEADING.match(name):
                return min(max(int(m[1]), 1), 6)
        return None

    def numbered(self, p: list) -> tuple[int, int | None] | None:
        """(level, ordinal or None for a bullet) of a list paragraph; direct numbering goes before the style's."""
        style = (find(p, "pPr", "pStyle") or ["", {}])[1].get("val")
        num = find(p, "pPr", "numPr") or next((n for *_, n in self.chain(style) if n), None)
        if not num:
            return None
        ident = (find(num, "numId") or ["", {}])[1].get("val")
        level = int((find(num, "ilvl") or ["", {}])[1].get("val", 0))
        if ident in (None, "0") or ident not in self.nums:
            return None
        abstract, over = self.nums[ident]
        fmt, start = self.levels.get((abstract, level), ("none", 1))
        if fmt == "none":
            return None
        if fmt == "bullet":
            return level, None
        key = (ident, level)
        self.counters[key] = self.counters.get(key, over.get(level, start) - 1) + 1
        return level, self.counters[key]

    def paragraph(self, p: list) -> list[dict]:
        """Blocks of a paragraph; images and page breaks part it."""
        out: list[dict] = []
        inlines: list[dict] = []
        level, item = self.heading(p), self.numbered(p)

        def close() -> None:
            nonlocal inlines
            if "".join(i["text"] for i in inlines).strip():
                if item:
                    out.append(block("list_item", inlines=inlines, level=item[0], ordinal=item[1]))
                elif level:
                    out.append(block("heading", inlines=inlines, level=level))
                else:
                    out.append(block("paragraph", inlines=inlines))
            inlines = []

        def walk(node: list, target: str | None) -> None:
            for c in node[2]:
                if c[0] == "t":
                    put(inlines, c[3], target)
                elif c[0] == "tab":
                    put(inlines, "\t", target)
                elif c[0] == "noBreakHyphen":
                    put(inlines, "‑", target)
                elif c[0] == "cr" or c[0] == "br" and c[1].get("type") in (None, "textWrapping"):
                    put(inlines, "\n", target)
                elif c[0] == "br" and c[1].get("type") == "page":
                    close()
                    out.append(block("hard_break"))
                elif c[0] == "hyperlink":
                    to, anchor = (self.relations.get(c[1].get("id")) or ("",))[0], c[1].get("anchor")
                    walk(c, to + (f"#{anchor}" if anchor else "") or None)
                elif c[0] == "drawing":
                    for blip in every(c, "blip"):
                        if rel := self.relations.get(blip[1].get("embed")):
                            close()
                            props = (every(c, "docPr") or [["", {}]])[0][1]
                            out.append(block("image", text=props.get("descr") or props.get("title") or props.get("name"), part=rel[0]))
                elif c[0] in ("r", "smartTag", "sdt", "sdtContent", "ins", "fldSimple"):
                    walk(c, target)

        walk(p, None)
        close()
        if (kind := find(p, "pPr", "sectPr", "type")) and kind[1].get("val") in ("nextPage", "oddPage", "evenPage") or find(p, "pPr", "sectPr") and not kind:
            out.append(block("hard_break"))
        return out

    def cell_text(self, cell: list) -> str:
        parts = []
        for c in cell[2]:
            if c[0] == "p":
                parts.append("".join(i["text"] for b in self.paragraph(c) for i in b.get("inlines", ())))
            elif c[0] == "tbl":
                self.nested = True
                parts += [" | ".join(self.cell_text(x) for x in find_all(r, "tc")) for r in find_all(c, "tr")]
        return "\n".join(parts).strip("\n")

    def table(self, tbl: list) -> dict:
        """A table; spans of columns and of rows (vMerge) make it a spanned one. Leading header rows count."""
        self.nested = False
        rows, cells, open_, header, leading = find_all(tbl, "tr"), [], {}, 0, True
        for r, row in enumerate(rows):
            column = 0
            leading = leading and find(row, "trPr", "tblHeader") is not None
            header += leading
            for tc in find_all(row, "tc"):
                span = int((find(tc, "tcPr", "gridSpan") or ["", {}])[1].get("val", 1))
                merge = find(tc, "tcPr", "vMerge")
                if merge and merge[1].get("val", "continue") == "continue" and column in open_:
                    open_[column]["row_span"] += 1
                else:
                    cell = {"row": r, "column": column, "row_span": 1, "column_span": span, "text": self.cell_text(tc)}
                    cells.append(cell)
                    open_.pop(column, None)
                    if merge:
                        open_[column] = cell
                column += span
        width = max((c["column"] + c["column_span"] for c in cells), default=1)
        if self.nested:
            self.warnings.append(("docx_nested_table_flattened", "a nested table was flattened"))
        if all(c["row_span"] == c["column_span"] == 1 for c in cells):
            grid = [[""] * width for _ in rows]
            for c in cells:
                grid[c["row"]][c["column"]] = c["text"]
            return block("table", grid=grid, header_rows=header)
        taken = {(c["row"] + i, c["column"] + j) for c in cells for i in range(c["row_span"]) for j in range(c["column_span"])}
        cells += [{"row": r, "column": k, "row_span": 1, "column_span": 1, "text": ""} for r in range(len(rows)) for k in range(width) if (r, k) not in taken]
        return block("spanned_table", cells=sorted(cells, key=lambda c: (c["row"], c["column"])), row_count=len(rows), header_rows=header)

    def blocks(self) -> list[dict]:
        out: list[dict] = []
        for c in (find(self.p.xml("word/document.xml"), "body") or ["", {}, []])[2]:
            if c[0] == "p":
                out += self.paragraph(c)
            elif c[0] == "tbl" and find_all(c, "tr"):
                out.append(self.table(c))
        return out


def find_all(node: list, name: str) -> list[list]:
    return [c for c in node[2] if c[0] == name]


class Pptx:
    """Slides in order, their shapes in z-order, groups opened."""

    def __init__(self, content: bytes, slides: int = SLIDES):
        self.p = Package(content, "pptx")
        self.warnings: list[tuple[str, str]] = []
        main, self.relations = self.p.xml("ppt/presentation.xml"), self.p.relations("ppt/presentation.xml")
        ids = every(main, "sldId")
        if len(ids) > slides:
            raise Rejected("limit_exceeded", "too many slides")
        self.slides = [self.relations[i[1].get("id")][0] for i in ids if i[1].get("id") in self.relations] or [t for t, k, _ in self.relations.values() if k.endswith("/slide")]

    def inlines(self, p: list, relations: dict) -> list[dict]:
        out: list[dict] = []
        for r in p[2]:
            if r[0] in ("r", "fld"):
                link = find(r, "rPr", "hlinkClick")
                target = relations.get(link[1].get("id"), (None,))[0] if link else None
                put(out, (find(r, "t") or ["", {}, [], ""])[3].replace("\x0b", "\n").replace("_x000B_", "\n"), target)
            elif r[0] == "br":
                put(out, "\n", None)
        return out

    def shape(self, sp: list, relations: dict, heading: int | None) -> list[dict]:
        out, counters = [], defaultdict(int)
        for p in find_all(find(sp, "txBody") or ["", {}, []], "p"):
            inlines = self.inlines(p, relations)
            if not "".join(i["text"] for i in inlines).strip():
                continue
            props = find(p, "pPr") or ["", {}, []]
            level, auto = int(props[1].get("lvl", 0)), find(props, "buAutoNum")
            if heading and not out:
                out.append(block("heading", inlines=inlines, level=heading))
            elif auto:
                start = int(auto[1].get("startAt", 1))
                counters[level] = start if start > 1 and counters[level] < start else counters[level] + 1
                out.append(block("list_item", inlines=inlines, level=level, ordinal=counters[level]))
            elif find(props, "buChar"):
                out.append(block("list_item", inlines=inlines, level=level, ordinal=None))
            else:
                out.append(block("paragraph", inlines=inlines))
        return out

    def table(self, frame: list) -> dict:
        tbl = every(frame, "tbl")[0]
        rows = find_all(tbl, "tr")
        text = lambda tc: "\n".join("".join(t[3] for t in every(p, "t")) for p in every(tc, "p"))
        cells = [{"row": r, "column": c, "row_span": int(tc[1].get("rowSpan", 1)), "column_span": int(tc[1].get("gridSpan", 1)), "text": text(tc)} for r, row in enumerate(rows) for c, tc in enumerate(find_all(row, "tc")) if not (tc[1].get("hMerge") or tc[1].get("vMerge"))]
        header = int((find(tbl, "tblPr") or ["", {}])[1].get("firstRow") in ("1", "true"))
        if all(c["row_span"] == c["column_span"] == 1 for c in cells):
            return block("table", grid=[[c["text"] for c in cells if c["row"] == r] for r in range(len(rows))], header_rows=header)
        return block("spanned_table", cells=cells, row_count=len(rows), header_rows=header)

    def chart(self, part: str) -> list[dict]:
        root = self.p.xml(part)
        title = "".join(t[3] for t in every(find(root, "chart", "title") or ["", {}, []], "t"))
        points = lambda node: [(find(p, "v") or ["", {}, [], ""])[3] for p in every(node, "pt")] if node else []
        series = every(root, "ser")
        if not series:
            self.warnings.append(("pptx_chart_data_unavailable", "a chart has no data"))
            return []
        labels = points(find(series[0], "cat"))
        grid = [["Series / Category", *labels]]
        for s in series:
            values = points(find(s, "val"))[: len(labels)]
            grid.append([" ".join(points(find(s, "tx"))) or f"Series {len(grid)}", *values, *[""] * (len(labels) - len(values))])
        return ([block("heading", inlines=[{"text": title, "target": None}], level=2)] if title else []) + [block("table", grid=grid, header_rows=1)]

    def size_of(self, sp: list) -> int:
        return max((int(r[1]["sz"]) for r in every(sp, "rPr") if "sz" in r[1]), default=0)

    def headings(self, shapes: list[list]) -> dict[int, int]:
        """Shape number -> heading level: title placeholders, else the largest short text, else the only one."""
        out, candidates = {}, []
        for i, sp in enumerate(shapes):
            if sp[0] != "sp":
                continue
            kind = next((p[1].get("type") for p in every(sp, "ph")), None)
            text = re.sub(r"\s", "", "".join(t[3] for t in every(sp, "t")))
            if kind in ("title", "ctrTitle", "subTitle") and text:
                out[i] = 2 if kind == "subTitle" else 1
            elif text and len(text) <= 160 and not re.fullmatch(r"[\d.,%]+", text):
                candidates.append((self.size_of(sp), -i))
        if not out and candidates and (max(candidates)[0] or len(candidates) == 1):
            out[-max(candidates)[1]] = 1
        return out

    def flat(self, node: list) -> list[list]:
        return [x for c in node[2] for x in (self.flat(c) if c[0] == "grpSp" else [c] if c[0] in ("sp", "pic", "graphicFrame", "cxnSp") else [])]

    def blocks(self) -> list[dict]:
        out: list[dict] = []
        blank = []
        for number, part in enumerate(self.slides, 1):
            relations, shapes = self.p.relations(part), self.flat(find(self.p.xml(part), "cSld", "spTree") or ["", {}, []])
            out.append(block("page_break", page_number=number))
            heads, before = self.headings(shapes), len(out)
            for i, sp in enumerate(shapes):
                if sp[0] == "sp":
                    out += self.shape(sp, relations, heads.get(i))
                elif sp[0] == "pic":
                    rel = next((relations.get(b[1].get("embed")) for b in every(sp, "blip")), None)
                    if rel:
                        out.append(block("image", text=(every(sp, "cNvPr") or [["", {}]])[0][1].get("descr"), part=rel[0]))
                    else:
                        self.warnings.append(("pptx_image_unavailable", f"slide {number}: an image is missing"))
                elif every(sp, "tbl"):
                    out.append(self.table(sp))
                elif every(sp, "chart"):
                    out += self.chart(relations[every(sp, "chart")[0][1]["id"]][0])
                elif sp[0] == "graphicFrame":
                    self.warnings.append(("pptx_unsupported_shape", f"slide {number}: a shape is not supported"))
            if len(out) == before:
                blank.append(number)
        if len(blank) < len(self.slides):
            self.warnings += [("pptx_blank_slide", f"slide {n} is blank") for n in blank]
        return out
