"""Lines of drawings, drawn and read back."""

import numpy as np

from weftgraph.operators import connectors as C
from weftgraph.render import raster

BOXES = "doc_id long, ord long, kind string, x double, y double, w double, h double"
EDGES = "doc_id long, ord long, source long, target long, marker string, dashed boolean"
STYLES = [(None, False), ("arrow", False), ("arrow", True), ("triangle", False), ("triangle", True), ("hollow_diamond", False), ("filled_diamond", False), (None, True)]
TYPES = ["association", "association", "dependency", "inheritance", "realization", "aggregation", "composition", "dependency"]


def test_styles_in_four_directions(spark):
    boxes, edges = [], []
    for k, (dx, dy) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)]):
        for j, (marker, dashed) in enumerate(STYLES):
            doc = k * 10 + j
            boxes += [(doc, 0, "action", 0.0, 0.0, 100.0, 60.0), (doc, 1, "action", dx * 260.0, dy * 240.0, 100.0, 60.0)]
            edges.append((doc, 0, 0, 1, marker, dashed))
    boxes, edges = spark.createDataFrame(boxes, BOXES), spark.createDataFrame(edges, EDGES)
    pages = raster.drawn(boxes, edges)
    placed = boxes.join(pages.select("doc_id", "left", "top"), "doc_id").selectExpr("doc_id", "ord", "x - left AS x", "y - top AS y", "w", "h")
    got = {r.doc_id: r for r in C.connectors(pages, placed, reach=18).collect()}
    for doc in (k * 10 + j for k in range(4) for j in range(8)):
        marker, dashed = STYLES[doc % 10]
        r = got.get(doc)
        assert r, doc
        assert (r.marker, r.dashed, r.type) == (marker, dashed, TYPES[doc % 10]), (doc, r)
        if marker:
            assert (r.source, r.target) == ((1, 0) if "diamond" in marker else (0, 1)), (doc, r)
        else:
            assert {r.source, r.target} == {0, 1}


def test_bends_loops_neighbours_and_nothing(spark):
    page = np.full((400, 500), 255, np.uint8)
    places = [(0, 40, 40, 80, 60), (1, 40, 240, 80, 60), (2, 300, 40, 80, 60)]
    for _, x, y, w, h in places:
        page[y : y + h, [x, x + 1, x + w - 2, x + w - 1]] = 0
        page[[y, y + 1, y + h - 2, y + h - 1], x : x + w] = 0
    page[100:240, 60:62] = page[100:240, 67:69] = 0  # two lines closer to each other than a dash's gap
    page[270:272, 120:340] = page[100:272, 338:340] = 0  # round a corner
    page[55:57, 380:430] = page[55:87, 428:430] = page[85:87, 380:430] = 0  # to itself
    page[350:352, 20:400] = 0  # reaches no box
    pages = spark.createDataFrame([(1, 500, 400, page.tobytes()), (2, 0, 0, None), (None, 1, 1, b"\xff")], "doc_id long, width long, height long, grey binary")
    boxes = spark.createDataFrame([(d, *map(float, p)) for d in (1, 2) for p in places] + [(1, 3.0, None, 0.0, 1.0, 1.0)], "doc_id long, o double, x double, y double, w double, h double").selectExpr("doc_id", "cast(o as long) AS ord", "x", "y", "w", "h")
    got = sorted((r.doc_id, *sorted((r.source, r.target)), r.marker, r.dashed) for r in C.connectors(pages, boxes).collect())
    assert got == [(1, 0, 1, None, False), (1, 0, 1, None, False), (1, 1, 2, None, False), (1, 2, 2, None, False)]
    assert C.connectors(pages.limit(0), boxes).count() == 0
    assert C.connectors(pages, boxes.limit(0)).count() == 0
