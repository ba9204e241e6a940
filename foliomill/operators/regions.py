"""Regions of a sheet: connected cells, their bounding boxes, and the dense grids of these."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Component number of each of some distinct cells; cells that share a side belong together. Union by least label."""
    order = np.lexsort((cols, rows))
    r, c = rows[order], cols[order]
    key = r.astype(np.int64) << 32 | c.astype(np.int64)
    parent = np.arange(len(key))
    below = np.searchsorted(key, (r + 1).astype(np.int64) << 32 | c)
    pairs = [np.stack([np.arange(len(key) - 1), np.arange(1, len(key))])[:, (r[1:] == r[:-1]) & (c[1:] == c[:-1] + 1)]]
    hit = (below < len(key)) & (key[np.minimum(below, len(key) - 1)] == ((r + 1).astype(np.int64) << 32 | c))
    pairs.append(np.stack([np.flatnonzero(hit), below[hit]]))
    a, b = np.concatenate(pairs, axis=1)
    while True:  # hooks the larger root to the smaller one, then shortens all paths
        pa_, pb = parent[a], parent[b]
        if (pa_ == pb).all():
            break
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    out = np.empty(len(key), np.int64)
    out[order] = parent
    return out


def components(cells: DataFrame, key: str) -> DataFrame:
    """key, row, col, region: connected components within each sheet, which is bounded by the limits on cells; region counts from 0
    in order of the components' first cells."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates()
        label = labelled(frame["row"].to_numpy(), frame["col"].to_numpy())
        return frame.assign(region=np.unique(label, return_inverse=True)[1])

    kind = cells.schema[key].dataType.simpleString()
    return cells.select(key, F.col("row").cast("int"), F.col("col").cast("int")).groupBy(key).applyInPandas(of, f"{key} {kind}, row int, col int, region int")


def boxes(regions: DataFrame, key: str) -> DataFrame:
    """key, region, top, left, bottom, right, n."""
    return regions.groupBy(key, "region").agg(F.min("row").alias("top"), F.min("col").alias("left"), F.max("row").alias("bottom"), F.max("col").alias("right"), F.count("*").alias("n"))


def dense(boxes_: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """key, region, grid: the texts (key, row, col, text) of every box, with empty strings between; overlapping boxes share cells."""
    spread = boxes_.select(key, "region", F.explode(F.sequence("top", "bottom")).alias("row"), "left", "right").select(key, "region", "row", F.explode(F.sequence("left", "right")).alias("col"))
    filled = spread.join(texts, [key, "row", "col"], "left").select(key, "region", "row", "col", F.coalesce("text", F.lit("")).alias("text"))
    lines = filled.groupBy(key, "region", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]).alias("cells"))
    return lines.groupBy(key, "region").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("grid"))


SHEET_BLOCK = "row int, col int, kind string, grid array<array<string>>, cells array<struct<row:int,column:int,row_span:int,column_span:int,text:string>>, row_count int, header_rows int"


def sheet_tables(texts: dict[tuple[int, int], str], merges: list[tuple], areas: list[tuple[tuple, int]]) -> list[dict]:
    """The tables of a sheet as rows of SHEET_BLOCK: its own tables first-class, then a table for each region of connected cells
    outside them. A merge belongs to the table that contains it, else its footprint joins regions; tables with merges are spanned.
    """
    holds = lambda outer, inner: outer[0] <= inner[0] and outer[1] <= inner[1] and outer[2] >= inner[2] and outer[3] >= inner[3]
    taken = {(r, c) for (t, l, b, q), _ in areas for r in range(t, b + 1) for c in range(l, q + 1)}
    free = {x for x in texts if x not in taken}
    loose = [m for m in merges if not any(holds(a, m) for a, _ in areas)]
    free |= {(r, c) for t, l, b, q in loose for r in range(t, b + 1) for c in range(l, q + 1)} - taken
    places = [(a, header, [m for m in merges if holds(a, m)]) for a, header in areas]
    if free:
        cells = np.array(sorted(free), np.int64)
        label = labelled(cells[:, 0], cells[:, 1])
        for n in np.unique(label):
            own = cells[label == n]
            box = (int(own[:, 0].min()), int(own[:, 1].min()), int(own[:, 0].max()), int(own[:, 1].max()))
            places.append((box, 0, [m for m in loose if holds(box, m)]))
    out = []
    for (top, left, bottom, right), header, own in places:
        grid = [[texts.get((r, c), "") for c in range(left, right + 1)] for r in range(top, bottom + 1)]
        if not any(x.strip() for row in grid for x in row):
            continue
        row = {"row": top, "col": left, "kind": "table", "grid": grid, "cells": None, "row_count": None, "header_rows": header}
        if own:
            span = {(t, l): (b - t + 1, q - l + 1) for t, l, b, q in own}
            hidden = {(r, c) for t, l, b, q in own for r in range(t, b + 1) for c in range(l, q + 1)} - set(span)
            cells_ = [{"row": r - top, "column": c - left, "row_span": span.get((r, c), (1, 1))[0], "column_span": span.get((r, c), (1, 1))[1], "text": texts.get((r, c), "")} for r in range(top, bottom + 1) for c in range(left, right + 1) if (r, c) not in hidden]
            row |= {"kind": "spanned_table", "grid": None, "cells": cells_, "row_count": bottom - top + 1}
        out.append(row)
    return out


def tables(parts: DataFrame, key: str) -> DataFrame:
    """key and SHEET_BLOCK: the tables of every sheet, from rows of kind text (row, col, text), merge and area (box, header_rows).
    A sheet is bounded by the limits on its cells."""

    def of(frame: pd.DataFrame) -> pd.DataFrame:
        some = frame[frame["kind"] == "text"]
        texts = dict(zip(zip(some["row"].astype(int), some["col"].astype(int)), some["text"]))
        box = lambda x: tuple(map(int, x))
        merges = [box(b) for b in frame[frame["kind"] == "merge"]["box"]]
        areas = [(box(b), int(h)) for b, h in zip(frame[frame["kind"] == "area"]["box"], frame[frame["kind"] == "area"]["header_rows"])]
        out = pd.DataFrame(sheet_tables(texts, sorted(merges), sorted(areas)), columns=["row", "col", "kind", "grid", "cells", "row_count", "header_rows"])
        out.insert(0, key, frame[key].iloc[0])
        return out.astype({"row_count": "Int32", "header_rows": "Int32"})

    kind = parts.schema[key].dataType.simpleString()
    return parts.select(key, "kind", "row", "col", "text", "box", "header_rows").groupBy(key).applyInPandas(of, f"{key} {kind}, {SHEET_BLOCK}")
