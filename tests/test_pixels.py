"""Drawings to pixels and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import pixels
from weftgraph.render import raster

BOXES = "doc_id long, ord long, kind string, x double, y double, w double, h double"
EDGES = "doc_id long, ord long, source long, target long"


def plain_pieces(mask, corners):
    """Flood fill."""
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        stack, piece = [left.pop()], set()
        while stack:
            y, x = stack.pop()
            piece.add((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if (corners or not (dy and dx)) and (n := (y + dy, x + dx)) in left:
                        left.remove(n)
                        stack.append(n)
        out.append(frozenset(piece))
    return set(out)


def test_spans_and_squares_against_brute_force():
    rng = np.random.default_rng(3)
    for k in range(30):
        mask = rng.random((int(rng.integers(1, 14)), int(rng.integers(1, 14)))) < 0.5
        for corners in (True, False):
            y, a, b, name = pixels.spans(mask, corners=corners)
            got = {}
            for line, s, e, n in zip(y, a, b, name, strict=True):
                got.setdefault(n, set()).update((line, x) for x in range(s, e))
            assert {frozenset(p) for p in got.values()} == plain_pieces(mask, corners), k
        want = np.array([[all(mask[j, i] for j in range(max(0, y - 1), min(len(mask), y + 2)) for i in range(max(0, x - 1), min(mask.shape[1], x + 2))) for x in range(mask.shape[1])] for y in range(len(mask))])
        assert (pixels._filled(mask, 3, False) == want).all()


def test_ink():
    page = np.full((100, 100), 255, np.uint8)
    page[10:12, 10:90] = 190  # a light line stays ink beside a dark one
    page[50:52, 10:90] = 20
    assert pixels.ink(page).sum() == 320
    page[60:90, 10:90] = 180  # a fill of its own tone doesn't
    assert not pixels.ink(page)[65:85].any()
    assert not pixels.ink(np.full((5, 5), 255, np.uint8)).any()


def test_activity_round_trip(spark, tmp_path):
    rows = [(1, 0, "start", 100, 0, 50, 50), (1, 1, "action", 65, 120, 120, 50), (1, 2, "decision", 75, 240, 100, 80), (1, 3, "fork", 45, 400, 160, 10), (1, 4, "end", 100, 480, 50, 50), (2, 0, "action", 0, 0, 80, 40), (3, 0, "action", 0, 0, 99999, 40), (4, 0, "action", None, 0, 1, 1)]
    boxes = spark.createDataFrame([tuple(float(v) if k > 2 and v is not None else v for k, v in enumerate(r)) for r in rows], BOXES)
    edges = spark.createDataFrame([(1, k, k, k + 1) for k in range(4)] + [(2, 0, 0, 9)], EDGES)
    pages = {r.doc_id: r for r in raster.drawn(boxes, edges).collect()}
    assert set(pages) == {1, 2, 3} and "pixels" in pages[3].error and pages[3].png is None
    for k in (1, 2):
        (tmp_path / f"{k}.png").write_bytes(bytes(pages[k].png))
    (tmp_path / "broken.png").write_bytes(b"no image")
    read = pixels.decoded(spark, str(tmp_path))
    grey = {r.doc_id[-5:]: r for r in read.collect()}
    assert set(grey) == {"1.png", "2.png"} and bytes(grey["1.png"].grey) == bytes(pages[1].grey)
    assert grey["2.png"].width == pages[2].width * 4  # small pages are enlarged
    found = pixels.activity_shapes(pixels.runs(read.where(F.col("doc_id").endswith("1.png")))).collect()
    got = sorted((r.kind, r.x - 60 + 45, r.y - 60, r.w, r.h) for r in found)
    want = sorted(("bar" if r[2] == "fork" else r[2], *r[3:]) for r in rows if r[0] == 1)
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[1:] == pytest.approx(w[1:], abs=5), (g, w)
    assert pixels.runs(read.limit(0)).count() == 0


def test_class_boxes(spark):
    page = np.full((400, 500), 255, np.uint8)
    for y in (40, 80, 140, 200):  # a box with two dividers, another straight below, a line that is no box
        page[y : y + 2, 50:200] = 0
    page[40:202, 50:52] = page[40:202, 198:200] = 0
    for y in (240, 300):
        page[y : y + 2, 50:200] = 0
    page[240:302, 50:52] = page[240:302, 198:200] = 0
    page[100:102, 260:420] = 0
    pages = spark.createDataFrame([(7, 500, 400, page.tobytes()), (8, 0, 0, None)], "doc_id long, width long, height long, grey binary")
    got = sorted((r.doc_id, r.x, r.y, r.w, r.h, list(r.dividers)) for r in pixels.class_boxes(pixels.runs(pages)).collect())
    assert got == [(7, 50, 41, 150, 160, [81, 141]), (7, 50, 241, 150, 60, [])]


def test_a_long_drawing_is_read_back_from_sheets(spark):
    from pyspark.sql import functions as F

    from weftgraph.operators import pixels
    from weftgraph.render import raster

    boxes = spark.range(300).select(F.lit(1).cast("long").alias("d"), F.col("id").alias("ord"), F.lit("action").alias("kind"), (F.col("id") % 2 * 160.0).alias("x"), (F.floor(F.col("id") / 2) * 120.0 + F.col("id") % 2 * 30).alias("y"), F.lit(80.0).alias("w"), F.lit(60.0).alias("h"))
    cut = raster.sheets(boxes, "d").withColumn("doc_id", F.col("sheet"))
    assert {r.n for r in cut.groupBy(F.floor(F.col("ord") / 2)).agg(F.countDistinct("sheet").alias("n")).collect()} == {1}  # what shares a line isn't parted
    pages = raster.drawn(cut, cut.selectExpr("doc_id", "ord", "ord AS source", "ord AS target").limit(0))
    assert {(r.error, r.height <= raster.SHEET + 90 + 2 * raster.MARGIN) for r in pages.select("error", "height").collect()} == {(None, True)}
    found = pixels.activity_shapes(pixels.runs(pages, layers=("ink", "blank", "solid", "bar"))).join(pages.select("doc_id", "top"), "doc_id")
    assert sorted(r.y for r in found.select((F.col("y") + F.col("top")).cast("int").alias("y")).collect()) == sorted(r.y for r in boxes.select(F.col("y").cast("int").alias("y")).collect())
