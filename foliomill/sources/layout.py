"""What stands on a page: lines, tables, visual regions and the order in which they are read, from words and boxes in page units.

A page is one unit of work, bounded by the reader's limits; all functions take plain lists.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from foliomill.operators.quality import BAD_MAX, REPEATED_FROM, REPEATED_MAX, facts

Box = tuple[float, float, float, float]  # left, top, right, bottom

#: Lines (centre distance and gap in heights of a word, lines kept open), columns (gap, common height, wide block).
SAME_LINE, SPLIT_GAP, OPEN_LINES = 0.55, 2.5, 64
COLUMN_GAP, COLUMN_OVERLAP, WIDE_BLOCK = 0.12, 0.20, 0.70
#: Tables: cells filled, cells unknown, text captured, sameness by box and by text; tables without rules: words,
#: rows, columns, distance of anchors, numeric cells.
FILLED_MIN, UNKNOWN_MAX, CAPTURED_MIN, SAME_BOX, SAME_TEXT = 0.30, 0.40, 0.80, 0.80, 0.80
LOOSE_WORDS, LOOSE_ROWS, LOOSE_COLUMNS, ANCHOR, NUMERIC_MIN = 500, 3, (2, 8), 0.025, 0.40
#: Regions: share of a page that an image must have, padding, gap to be merged, candidates, objects of a drawing.
IMAGE_MIN, PADDING, MERGE_GAP, CANDIDATES, DRAWING = 0.05, 0.015, 0.02, 1024, 30
#: Pairs compared for the reading order, and the share of the smaller box from which on two are ambiguous.
COMPARISONS, AMBIGUOUS = 250_000, 0.20
#: Scripts written without blanks between words.
CJK = ((0x2E80, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))
OPENING, CLOSING = "([{“‘«（［｛《〈「『", ")]}”’»,.;:!?%，。；：！？、）］｝》〉」』"


def area(b: Box) -> float:
    return max(b[2] - b[0], 0.0) * max(b[3] - b[1], 0.0)


def common(a: Box, b: Box) -> Box:
    return max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])


def shared(a: Box, b: Box) -> float:
    c = common(a, b)
    return area(c) if c[0] < c[2] and c[1] < c[3] else 0.0


def around(boxes: Iterable[Box]) -> Box:
    left, top, right, bottom = zip(*boxes)
    return min(left), min(top), max(right), max(bottom)


def inside(outer: Box, inner: Box) -> bool:
    """Whether the centre of a box lies in another."""
    x, y = (inner[0] + inner[2]) / 2, (inner[1] + inner[3]) / 2
    return outer[0] <= x <= outer[2] and outer[1] <= y <= outer[3]


def union_area(boxes: list[Box]) -> float:
    """The area that some boxes cover together, by strips between their left and right edges."""
    xs, total = sorted({x for b in boxes for x in (b[0], b[2])}), 0.0
    for a, b in zip(xs, xs[1:]):
        reach = 0.0
        for top, bottom in sorted((x[1], x[3]) for x in boxes if x[0] <= a and x[2] >= b):
            total += (b - a) * max(bottom - max(top, reach), 0.0)
            reach = max(reach, bottom)
    return total


def grouped(boxes: list[Box], near: float) -> list[list[int]]:
    """Groups of boxes that touch once each is widened by `near`; boxes in order of their left edge meet those still open."""
    parent = list(range(len(boxes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    open_: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda k: boxes[k][0]):
        b = boxes[i]
        open_ = [k for k in open_ if boxes[k][2] + near >= b[0]]
        for k in open_:
            if boxes[k][1] - near <= b[3] and b[1] <= boxes[k][3] + near:
                parent[root(k)] = root(i)
        open_.append(i)
    out: dict[int, list[int]] = {}
    for i in range(len(boxes)):
        out.setdefault(root(i), []).append(i)
    return list(out.values())


def is_cjk(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in CJK)


def between(left: str, right: str) -> str:
    """What stands between two words of a line."""
    if not left or not right or is_cjk(left[-1]) or is_cjk(right[0]) or left[-1] in OPENING or right[0] in CLOSING:
        return ""
    return " "


def line_of(words: list[dict]) -> dict:
    """A line of words from left to right: text, box, mean size, the font that most words have (the first of equals)."""
    words = sorted(words, key=lambda w: w["box"][0])
    text = words[0]["text"]
    for a, b in zip(words, words[1:]):
        text += between(a["text"], b["text"]) + b["text"]
    return {"text": text, "box": around(w["box"] for w in words), "size": sum(w["size"] for w in words) / len(words), "font": Counter(w["font"] for w in words).most_common(1)[0][0]}


def lines_of(words: list[dict]) -> list[dict]:
    """Words put into lines by their centres; a line is parted where a gap is much wider than its words are high."""
    open_: list[list[dict]] = []
    done: list[list[dict]] = []
    for w in sorted(words, key=lambda w: ((w["box"][1] + w["box"][3]) / 2, w["box"][0])):
        centre, high = (w["box"][1] + w["box"][3]) / 2, w["box"][3] - w["box"][1]
        for line in reversed(open_):
            first = line[0]["box"]
            if abs((first[1] + first[3]) / 2 - centre) <= SAME_LINE * max(high, first[3] - first[1]):
                line.append(w)
                break
        else:
            open_.append([w])
            if len(open_) > OPEN_LINES:
                done.append(open_.pop(0))
    out = []
    for line in done + open_:
        part: list[dict] = []
        for w in sorted(line, key=lambda w: w["box"][0]):
            if part and w["box"][0] - max(x["box"][2] for x in part) > SPLIT_GAP * max(w["box"][3] - w["box"][1], 1e-6):
                out.append(line_of(part))
                part = []
            part.append(w)
        out.append(line_of(part))
    return out


def in_columns(blocks: list[dict]) -> list[dict]:
    """Blocks in reading order. Wide blocks part the page into runs; within a run two columns are read one after the other if a
    gap parts them and they stand side by side; else, and if there are more columns, from top to bottom."""

    def ordered(run: list[dict]) -> list[dict]:
        plain = sorted(run, key=lambda b: (b["box"][1], b["box"][0]))
        if len(run) < 2:
            return plain
        by_left = sorted(run, key=lambda b: b["box"][0])
        reach, cuts = by_left[0]["box"][2], []
        for b in by_left[1:]:
            if b["box"][0] > reach:
                cuts.append(((reach + b["box"][0]) / 2, b["box"][0] - reach))
            reach = max(reach, b["box"][2])
        starts = sorted(b["box"][0] for b in run)
        wide = [x for x in cuts if x[1] > 0 and any(b - a >= COLUMN_GAP for a, b in zip(starts, starts[1:]) if a < x[0] <= b)]
        if len(wide) != 1:
            return plain
        left, right = [b for b in run if b["box"][2] <= wide[0][0]], [b for b in run if b["box"][0] >= wide[0][0]]
        a, b = around(x["box"] for x in left), around(x["box"] for x in right)
        both = min(a[3], b[3]) - max(a[1], b[1])
        if both < COLUMN_OVERLAP * min(a[3] - a[1], b[3] - b[1]):
            return plain
        key = lambda x: (x["box"][1], x["box"][0])
        return sorted(left, key=key) + sorted(right, key=key)

    out, run = [], []
    for b in sorted(blocks, key=lambda b: (b["box"][1], b["box"][0])):
        if b["box"][2] - b["box"][0] >= WIDE_BLOCK:
            out += [*ordered(run), b]
            run = []
        else:
            run.append(b)
    return out + ordered(run)


def ambiguous(boxes: list[Box]) -> bool:
    """Whether two boxes overlap so much that their order is open; true as well if there are too many pairs to tell."""
    open_: list[Box] = []
    seen = 0
    for b in sorted(boxes, key=lambda b: b[1]):
        open_ = [o for o in open_ if o[3] > b[1]]
        seen += len(open_)
        if seen > COMPARISONS or any(shared(o, b) >= AMBIGUOUS * max(min(area(o), area(b)), 1e-12) for o in open_):
            return True
        open_.append(b)
    return False


def even(grid: list[list[str | None]]) -> list[list[str | None]]:
    """Cells stripped; short rows filled up with None."""
    most = max(map(len, grid), default=0)
    return [[c.strip() if c is not None else None for c in row] + [None] * (most - len(row)) for row in grid]


def captured(cells: str, whole: str) -> float:
    """The share of the characters of `whole` that `cells` have too, as multisets."""
    a, b = Counter("".join(whole.split())), Counter("".join(cells.split()))
    return sum((a & b).values()) / max(sum(a.values()), 1)


def is_table(grid: list[list[str | None]], words: list[dict]) -> bool:
    """Whether a grid over some words is a table: its size, how many cells are filled, unknown, and what it holds of the words."""
    cells = [c for row in grid for c in row]
    if len(grid) < 2 or len(grid[0]) < 2:
        return False
    text = " ".join(c for c in cells if c)
    filled, unknown = sum(bool(c) for c in cells) / len(cells), sum(c is None for c in cells) / len(cells)
    return filled >= FILLED_MIN and unknown <= UNKNOWN_MAX and captured(text, " ".join(w["text"] for w in words)) >= CAPTURED_MIN


def filled(xs: list[float], ys: list[float], words: list[dict]) -> list[list[str]]:
    """Texts of the cells between vertical edges `xs` and horizontal edges `ys`."""
    cells: dict[tuple[int, int], list[dict]] = {}
    for w in words:
        x, y = (w["box"][0] + w["box"][2]) / 2, (w["box"][1] + w["box"][3]) / 2
        row, col = next((i for i in range(len(ys) - 1) if ys[i] <= y < ys[i + 1]), None), next((i for i in range(len(xs) - 1) if xs[i] <= x < xs[i + 1]), None)
        if row is not None and col is not None:
            cells.setdefault((row, col), []).append(w)
    text = lambda ws: "\n".join(line["text"] for line in sorted(lines_of(ws), key=lambda x: (x["box"][1], x["box"][0])))
    return [[text(cells[r, c]) if (r, c) in cells else "" for c in range(len(xs) - 1)] for r in range(len(ys) - 1)]


def distinct(values: Iterable[float], near: float = 0.004) -> list[float]:
    """Sorted values, those closer than `near` as one."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > near:
            out.append(v)
    return out


def ruled(rules: list[Box], shapes: list[Box], words: list[dict]) -> list[dict]:
    """Tables between rules: each group of touching rules (or the sides of touching boxes) with two columns and rows of edges."""
    sides = [s for a, b, c, d in shapes for s in ((a, b, c, b), (a, d, c, d), (a, b, a, d), (c, b, c, d))]
    all_, out = [*rules, *sides], []
    for group in grouped(all_, 0.004):
        some = [all_[i] for i in group]
        xs = distinct(x for b in some if b[3] - b[1] > b[2] - b[0] for x in (b[0],))
        ys = distinct(y for b in some if b[2] - b[0] >= b[3] - b[1] for y in (b[1],))
        if len(xs) < 3 or len(ys) < 3:
            continue
        box = (xs[0], ys[0], xs[-1], ys[-1])
        own = [w for w in words if inside(box, w["box"])]
        grid = even(filled(xs, ys, own))
        if own and is_table(grid, own):
            out.append({"box": box, "grid": grid})
    return out


def is_number(cell: str) -> bool:
    try:
        float(cell.replace(",", "").strip("%$€£¥() "))
    except ValueError:
        return False
    return True


def loose(words: list[dict]) -> list[dict]:
    """A table without rules: rows of cells that stand on the same anchors, many of them numbers."""
    if not words or len(words) > LOOSE_WORDS:
        return []
    rows: list[list[dict]] = []
    for line in sorted(lines_of(words), key=lambda x: (x["box"][1], x["box"][0])):
        last = rows[-1][0]["box"] if rows else None
        if last and abs(last[1] + last[3] - line["box"][1] - line["box"][3]) / 2 <= SAME_LINE * max(last[3] - last[1], line["box"][3] - line["box"][1]):
            rows[-1].append(line)
        else:
            rows.append([line])
    best: list[dict] = []
    run: list[list[dict]] = []
    anchors: list[float] = []
    for row in [*rows, []]:
        here = [c["box"][0] for c in sorted(row, key=lambda c: c["box"][0])]
        fits = len(here) == len(anchors) and all(abs(a - b) <= ANCHOR for a, b in zip(anchors, here))
        if not fits:
            cells = [c["text"] for r in run for c in r]
            if len(run) >= LOOSE_ROWS and LOOSE_COLUMNS[0] <= len(anchors) <= LOOSE_COLUMNS[1] and sum(map(is_number, cells)) >= NUMERIC_MIN * len(cells):
                best.append({"box": around(c["box"] for r in run for c in r), "grid": [[c["text"] for c in sorted(r, key=lambda c: c["box"][0])] for r in run]})
            run, anchors = [], here
        run.append(row)
    return best


def text_of(table: dict) -> str:
    return " ".join(c for row in table["grid"] for c in row if c)


def canonical(tables: list[dict]) -> list[dict]:
    """Tables without doubles: larger ones (by cells, then area) take those that are the same by box, or lie within them and
    say the same."""
    kept: list[dict] = []
    rank = lambda i: (-sum(map(len, tables[i]["grid"])), -area(tables[i]["box"]), tables[i]["box"][1], tables[i]["box"][0], i)
    for i in sorted(range(len(tables)), key=rank):
        t = tables[i]
        for k in kept:
            both = shared(k["box"], t["box"])
            same = both >= SAME_BOX * max(area(k["box"]) + area(t["box"]) - both, 1e-12)
            nested = both >= 0.999 * min(area(k["box"]), area(t["box"])) and max(captured(text_of(k), text_of(t)), 0) >= SAME_TEXT
            if same or nested:
                break
        else:
            kept.append(t)
    return sorted(kept, key=lambda t: (t["box"][1], t["box"][0]))


def padded(b: Box) -> Box:
    return max(b[0] - PADDING, 0.0), max(b[1] - PADDING, 0.0), min(b[2] + PADDING, 1.0), min(b[3] + PADDING, 1.0)


def regions(candidates: list[tuple[Box, str]]) -> list[tuple[Box, list[str]]]:
    """Visual regions: candidates padded, and merged as long as any two touch or nearly do; with the reasons of their members."""
    held = [(padded(b), {reason}) for b, reason in candidates[:CANDIDATES]]
    while True:
        groups = grouped([b for b, _ in held], MERGE_GAP)
        if len(groups) == len(held):
            break
        held = [(around(held[i][0] for i in g), set().union(*(held[i][1] for i in g))) for g in groups]
    order = ("image", "drawing", "ambiguous_order")
    return sorted(((b, [r for r in order if r in reasons]) for b, reasons in held), key=lambda x: (x[0][1], x[0][0]))


def reliable(text: str, words: list[dict]) -> bool:
    n, bad, repeated, box, varied = facts(text)
    if text.strip() and not words or bad > BAD_MAX:
        return False
    spared = box and varied is not None and varied <= REPEATED_MAX
    return not (n >= REPEATED_FROM and repeated > REPEATED_MAX and not spared)


def page_blocks(page: dict) -> tuple[list[dict], dict]:
    """Blocks of a page in reading order (lines, tables and visual regions with boxes), and what its route depends on."""
    words = page["words"]
    tables = canonical(ruled(page["rules"], page["shapes"], words))
    free = [w for w in words if not any(inside(t["box"], w["box"]) for t in tables)]
    if not tables:
        tables = loose(words)
        free = [w for w in words if not any(inside(t["box"], w["box"]) for t in tables)]
    lines = lines_of(free)
    text = " ".join(w["text"] for w in words)
    images = [b for b in page["images"] if area(b) >= IMAGE_MIN or not words]
    drawn = [b for b in page["shapes"] + page["rules"] if not any(inside(t["box"], b) for t in tables)]
    drawings = [around(drawn[i] for i in g) for g in grouped(drawn, MERGE_GAP) if len(g) >= DRAWING]
    found = regions([(b, "image") for b in images] + [(b, "drawing") for b in drawings])
    if ambiguous([x["box"] for x in lines]):
        found = regions([*((b, r[0]) for b, r in found), (around(x["box"] for x in lines), "ambiguous_order")])
    about = {
        "failed": page["failed"], "has_text": bool(text.strip()), "reliable": reliable(text, words), "image_share": max(map(area, page["images"]), default=0.0),
        "regions": len(found), "union_share": union_area([b for b, _ in found]),
    }
    visual = [{"kind": "region", "box": b, "text": " ".join(reasons)} for b, reasons in found]
    blocks = in_columns([{**x, "kind": "line"} for x in lines] + [{**t, "kind": "table"} for t in tables] + visual)
    return blocks, about
