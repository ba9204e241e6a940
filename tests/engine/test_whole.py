"""Queries that take every row, against loops over the smallest tables."""

import os
from collections import Counter

import pytest

pa = pytest.importorskip("pyarrow")
pq = pytest.importorskip("pyarrow.parquet")

from pyspark.sql import functions as F  # noqa: E402

from foliomill.operators import geometry  # noqa: E402
from foliomill.plans import catalogue, core_queries  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows_of(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def boxes():
    at = lambda x: round((float(x) + 1) / 2, 3)
    for r in rows_of("embeddings"):
        a, b, c, d = map(at, r["embedding"][:4])
        yield r["vec_id"], r["label"], min(a, c), min(b, d), max(a, c), max(b, d)


def test_every_overlapping_pair_is_found(spark):
    found, all_ = {}, list(boxes())
    for a, la, l1, t1, r1, b1 in all_:
        for b, lb, l2, t2, r2, b2 in all_:
            i = max(min(r1, r2) - max(l1, l2), 0.0) * max(min(b1, b2) - max(t1, t2), 0.0)
            if la == lb and a < b and i > 0:
                found[a, b] = i / ((r1 - l1) * (b1 - t1) + (r2 - l2) * (b2 - t2) - i)
    got = {(r.a, r.b): r.iou for r in catalogue.QUERIES["bbox_pairs_iou"](spark, SF).collect()}
    assert got.keys() == found.keys() and all(abs(got[k] - found[k]) < 1e-8 for k in found)


@pytest.mark.parametrize("labels", [1, 10])
def test_pairs_of_a_crowded_label_are_shared_by_tasks(spark, tmp_path, labels):
    """Every two parts of a label meet in a task of their own, a box is sent to as many tasks whatever the table's size, and the pairs stay the same."""
    rows = [r | {"label": r["label"] % labels} for r in rows_of("embeddings")]
    rows += [r | {"vec_id": None} for r in rows[:3]] + [r | {"label": None} for r in rows[:3]] + rows[:2]  # no pairs, no pairs, pairs once more
    pq.write_table(pa.Table.from_pylist(rows, pq.read_schema(f"{SF}/embeddings.parquet")), f"{tmp_path}/embeddings.parquet")
    v = core_queries.vector_boxes(spark, str(tmp_path))
    a, b = v.select("label", F.col("vec_id").alias("a"), F.col("box").alias("x")), v.select("label", F.col("vec_id").alias("b"), F.col("box").alias("y"))
    want = a.join(b, "label").where((F.col("a") < F.col("b")) & (geometry.intersection(F.col("x"), F.col("y")) > 0)).select("a", "b", core_queries.nearest(geometry.iou(F.col("x"), F.col("y")), 9).alias("iou"))
    out = catalogue.QUERIES["bbox_pairs_iou"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b, r.iou) for r in out) == sorted(map(tuple, want.collect()))
    dealt = Counter(r.task for r in out)
    assert len(dealt) > 60 and max(dealt.values()) < len(out) / 20


def test_ratios_are_rounded_as_in_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    corners = [[0.15267886221408844, -0.21437402069568634, -0.20269203186035156, 0.13192246854305267], [0.04114542156457901, -0.048334673047065735, -0.208899587392807, -0.11442893743515015]]
    rows = [{"vec_id": i, "embedding": c, "label": 0} for i, c in enumerate([*corners, [-1.0, -1.0, 0.0, 0.0], [-0.75, -1.0, 0.25, 0.0]])]
    pq.write_table(pa.Table.from_pylist(rows, pq.read_schema(f"{SF}/embeddings.parquet")), f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = sorted(con.execute(catalogue.ORACLE_SQL["bbox_pairs_iou"]).fetchall())
    assert sorted(map(tuple, catalogue.QUERIES["bbox_pairs_iou"](spark, str(tmp_path)).collect())) == want
    assert (0, 1, 0.131054687) in want
    halves = spark.createDataFrame([(x,) for x in (0.5e-9, 1.5e-9, 1 / 1024, 3 / 1024, 0.0, 1.0, 1 / 3)], "x double").select("x", core_queries.nearest(F.col("x"), 9).alias("r")).collect()
    assert [r.r for r in halves] == [con.execute("SELECT round(?::DOUBLE, 9)", [r.x]).fetchone()[0] for r in halves]


def test_every_line_is_looked_at(spark):
    import re

    want, space = [], r"[^\S\n]"
    for r in rows_of("documents"):
        i = r["doc_id"]
        mark = {0: "- ", 1: f"{i % 50}. ", 2: "• "}.get(i % 4, "")
        for n, line in enumerate(r["text"].split("\n")):
            b = re.fullmatch(rf"[•◦▪‣⁃*+-]{space}+(.+)", mark + line)
            o = re.fullmatch(rf"([0-9]{{1,9}})[.)]{space}+(.+)", mark + line)
            want.append((i, n, "bullet" if b else "ordered" if o else None, int(o[1]) if o else None, b[1] if b else o[2] if o else None))
    got = [tuple(r[c] for c in ("doc_id", "line", "kind", "ordinal", "content")) for r in catalogue.QUERIES["list_markers"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(got) > len(rows_of("documents"))


def flooded():
    """sheet, row, col, region: of every event's cell."""
    cells = {(r["event_type"], r["user_id"], r["event_id"] % 37) for r in rows_of("events")}
    out, n = {}, {}
    for cell in sorted(cells):
        if cell not in out:
            out[cell], todo = n.setdefault(cell[0], 0), [cell]
            n[cell[0]] += 1
            while todo:
                s, r, c = todo.pop()
                for near in ((s, r + 1, c), (s, r - 1, c), (s, r, c + 1), (s, r, c - 1)):
                    if near in cells and near not in out:
                        out[near] = out[cell]
                        todo.append(near)
    return out


def test_regions_are_those_of_all_cells(spark):
    want = flooded()
    assert {(r.sheet, r.row, r.col): r.region for r in catalogue.QUERIES["grid_components"](spark, SF).collect()} == want
    grids = {}
    for key in {(s, n) for (s, _, _), n in want.items()}:
        own = [(r, c) for (s, r, c), n in want.items() if (s, n) == key]
        if len(own) > 2:
            rows, cols = zip(*own)
            line = lambda r: "|".join(f"{r},{c}" if (key[0], r, c) in want else "" for c in range(min(cols), max(cols) + 1))  # noqa: B023, E731
            grids[key] = "\n".join(line(r) for r in range(min(rows), max(rows) + 1))
    assert {(r.sheet, r.region): r.grid for r in catalogue.QUERIES["region_densify"](spark, SF).collect()} == grids
