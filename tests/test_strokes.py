"""Strokes as pixel graphs against brute force, and lines that cross or share ink."""

import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import connectors as C
from weftgraph.operators import routing
from weftgraph.operators import strokes as S
from weftgraph.render import raster
from weftgraph.sources.scratch import persisted

BOXES = "doc_id long, ord long, kind string, x double, y double, w double, h double"
EDGES = "doc_id long, ord long, source long, target long, marker string, dashed boolean"
PAGE = "doc_id long, width long, height long, grey binary"


def scribble(seed, side=120):
    """Random strokes, three pixels wide, some of them crossing."""
    rng, page = random.Random(seed), np.full((side, side), 255, np.uint8)
    for _ in range(4):
        x, y = rng.randrange(10, side - 10), rng.randrange(10, side - 10)
        for _ in range(3):
            to = rng.randrange(10, side - 10), rng.randrange(10, side - 10)
            raster._line(page, x, y, *to)
            x, y = to
    return page


def graph(line):
    """Neighbours by the definition: across a corner only without a pixel beside that joins the two."""
    on = {(int(y), int(x)) for y, x in zip(*np.nonzero(line), strict=True)}
    near = {}
    for y, x in on:
        straight = [(y + dy, x + dx) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)) if (y + dy, x + dx) in on]
        across = [(y + dy, x + dx) for dy in (-1, 1) for dx in (-1, 1) if (y + dy, x + dx) in on and (y, x + dx) not in on and (y + dy, x) not in on]
        near[y, x] = straight + across
    return near


def walked(near):
    """(node, node, steps) of all segments, from each of their ends."""
    out = []
    for p in near:
        if len(near[p]) != 2:
            for q in near[p]:
                before, here, n = p, q, 1
                while len(near[here]) == 2:
                    before, here, n = here, next(r for r in near[here] if r != before), n + 1
                out.append((p, here, n))
    return sorted(out)


def test_segments_and_distances_are_brute_force(spark):
    pages, want, far, starts = [], {}, {}, []
    for doc in range(5):
        page = scribble(doc)
        pages.append((doc, *page.shape[::-1], page.tobytes()))
        near = graph(S.thinned(S.outside(page.tobytes(), *page.shape, None)))
        want[doc] = walked(near)
        start = min(a for a, _, _ in want[doc])
        starts.append((doc, start[0] * S.ROW + start[1]))
        depth, queue = {start: 0}, deque([start])
        while queue:
            p = queue.popleft()
            for q in near[p]:
                if q not in depth:
                    depth[q] = depth[p] + 1
                    queue.append(q)
        far[doc] = depth
    pixels = S.skeleton(spark.createDataFrame([*pages, (9, 5, 5, b"\xff" * 25), (10, 0, 0, None)], PAGE))
    pieces = S.segments(pixels).persist()
    place = lambda i: (i // S.ROW, i % S.ROW)
    got = {}
    for r in pieces.collect():
        got.setdefault(r.doc_id, []).append((place(r.a), place(r.b), r.length))
    assert {k: sorted(v) for k, v in got.items()} == want
    found = S.farthest(pieces, spark.createDataFrame(starts, "doc_id long, id long")).collect()
    assert found
    for r in found:
        assert r.distance == far[r.doc_id][place(r.id)]
    for doc in range(5):
        # whatever hangs together with the start is one piece of ink
        assert {r.most for r in found if r.doc_id == doc} == {max(far[doc].values())}


def test_thinning_keeps_what_hangs_together():
    for seed in range(6):
        mask = scribble(seed) < 128
        line = S.thinned(mask)
        assert not (line & ~mask).any()
        assert len(np.unique(S.spans(mask)[3])) == len(np.unique(S.spans(line)[3]))
        assert line.sum() < 0.5 * mask.sum()
    assert not S.thinned(np.zeros((4, 4), bool)).any()


def test_main_axes_are_singular_vectors(spark):
    rng, rows, want = np.random.default_rng(4), [], {}
    for k in range(12):
        turn = k * math.pi / 12
        p = rng.normal(0, 1, (400, 2)) @ np.array([[20 * math.cos(turn), 20 * math.sin(turn)], [-3 * math.sin(turn), 3 * math.cos(turn)]])
        mask = np.zeros((200, 200), bool)
        mask[np.clip(p[:, 1] + 100, 0, 199).astype(int), np.clip(p[:, 0] + 100, 0, 199).astype(int)] = True
        y, a, b, _ = S.spans(mask)
        rows += [(k, int(v), int(s), int(e)) for v, s, e in zip(y, a, b, strict=True)]
        ys, xs = np.nonzero(mask)
        points = np.column_stack([xs, ys]).astype(float)
        _, size, axes = np.linalg.svd(points - points.mean(0), full_matrices=False)
        want[k] = points.mean(0), size, axes[0]
    for r in S.main_axes(spark.createDataFrame(rows, "k int, line long, start long, end long"), ["k"]).collect():
        middle, size, axis = want[r.k]
        assert (r.mx, r.my) == pytest.approx(tuple(middle))
        assert (r.long, r.short) == pytest.approx(tuple(size))
        assert abs(r.ax * axis[0] + r.ay * axis[1]) == pytest.approx(1)


def test_matching_is_greedy(spark):
    rng, rows = random.Random(6), []
    for doc in range(8):
        rows += [(doc, a, b, float(rng.randint(0, 5))) for a in range(12) for b in range(12, 24) if rng.random() < 0.4]
    rows += [(8, 0, 1, 1.0), (8, 1, 2, 1.0), (8, 0, 1, 0.5), (8, 3, 3, 0.0), (8, 4, 5, None)]
    got = {tuple(r) for r in routing.matched_ends(spark.createDataFrame(rows, "doc_id long, a long, b long, d double")).collect()}
    want = {(doc, a, b) for doc in range(9) for a, b in routing.greedy_pairs([(d, a, b) for k, a, b, d in rows if k == doc and d is not None and a != b])}
    assert got == want


def ring(doc, n, radius, turn, styles):
    """n boxes on a circle and lines between opposite ones, which all cross in the middle."""
    boxes = [(doc, k, "action", radius * math.cos(2 * math.pi * k / n + turn), radius * math.sin(2 * math.pi * k / n + turn), 70.0, 44.0) for k in range(n)]
    return boxes, [(doc, k, k, k + n // 2, *styles[k]) for k in range(n // 2)]


def test_lines_that_cross(spark):
    boxes, edges = [], []
    styles = [("arrow", False), ("triangle", False), ("filled_diamond", False)]
    for doc, (n, turn, of) in enumerate([(4, 0.0, styles), (4, 0.3, styles), (6, 0.3, styles), (4, 0.6, [("arrow", True), ("triangle", True)]), (6, 0.9, [(None, False)] * 3)]):
        b, e = ring(doc, n, 220 if n == 4 else 300, turn, of)
        boxes, edges = boxes + b, edges + e
    frames = spark.createDataFrame(boxes, BOXES), spark.createDataFrame(edges, EDGES)
    pages = raster.drawn(*frames).persist()
    placed = frames[0].join(pages.select("doc_id", "left", "top"), "doc_id").selectExpr("doc_id", "ord", "x - left AS x", "y - top AS y", "w", "h")
    got = sorted((r.doc_id, r.source, r.target, r.marker or "", r.dashed) for r in C.connectors(pages, placed, reach=18).collect())
    want = sorted((d, *((t, s) if m == "filled_diamond" else (s, t)), m or "", dashed) for d, _, s, t, m, dashed in edges)
    assert got == want


def bus(children, marked=True):
    """A parent over a bar that its children hang from."""
    width = 160 * children + 40
    page, places = np.full((400, width), 255, np.uint8), [(0, width // 2 - 50, 20, 100, 60)] + [(k + 1, 30 + 160 * k, 300, 100, 60) for k in range(children)]
    for _, x, y, w, h in places:
        page[y : y + h, x : x + w] = 0
        page[y + 3 : y + h - 3, x + 3 : x + w - 3] = 255
    middles = [x + w // 2 for _, x, _, w, _ in places]
    page[80:200, middles[0] - 1 : middles[0] + 2] = 0
    page[199:202, min(middles) - 1 : max(middles) + 2] = 0
    for m in middles[1:]:
        page[200:300, m - 1 : m + 2] = 0
    if marked:
        raster._marker(page, "triangle", middles[0], 150, middles[0], 84)
    return page, places


def test_shared_buses(spark):
    pages, boxes = [], []
    for doc, n in enumerate((2, 3, 5)):
        page, places = bus(n)
        pages.append((doc, *page.shape[::-1], page.tobytes()))
        boxes += [(doc, *map(float, p)) for p in places]
    boxes = spark.createDataFrame(boxes, "doc_id long, o double, x double, y double, w double, h double").selectExpr("doc_id", "cast(o as long) AS ord", "x", "y", "w", "h")
    got = sorted((r.doc_id, r.source, r.target, r.type) for r in C.connectors(spark.createDataFrame(pages, PAGE), boxes).collect())
    assert got == [(doc, k + 1, 0, "inheritance") for doc, n in enumerate((2, 3, 5)) for k in range(n)]


def test_markers_at_every_angle(spark):
    boxes, edges, kinds = [], [], ["arrow", "triangle", "hollow_diamond", "filled_diamond"]
    for j in range(8):
        for k in range(24):
            turn, doc = math.radians(15 * k), 100 * j + k
            boxes += [(doc, 0, "action", 0.0, 0.0, 60.0, 60.0), (doc, 1, "action", 260 * math.cos(turn), 260 * math.sin(turn), 60.0, 60.0)]
            edges.append((doc, 0, 0, 1, kinds[j % 4], j >= 4))
    frames = spark.createDataFrame(boxes, BOXES), spark.createDataFrame(edges, EDGES)
    pages = raster.drawn(*frames).persist()
    placed = frames[0].join(pages.select("doc_id", "left", "top"), "doc_id").selectExpr("doc_id", "ord", "x - left AS x", "y - top AS y", "w", "h")
    got = {r.doc_id: (r.marker, r.dashed, {r.source, r.target}) for r in C.connectors(pages, placed, reach=20).collect()}
    want = {d: (marker, dashed, {0, 1}) for d, _, _, _, marker, dashed in edges}
    assert [(d, got.get(d)) for d in want if got.get(d) != want[d]] == [] and len(got) == len(want)


def slanted():
    """Boxes at the corners, moved a little, and both diagonals with markers that their outlines' thinned ink turns most."""
    kinds, boxes, edges = ["arrow", "triangle", "hollow_diamond", "filled_diamond"], [], []
    for doc, ns in {46: (5, 3, 1, 11), 54: (5, 17, 1, 24), 81: (8, 0, 10, 11), 94: (18, 16, 9, 24), 141: (5, 21, 1, 1), 167: (4, 11, 10, 24), 248: (0, 8, 9, 19)}.items():
        boxes += [(doc, k, "action", (440.0 if k in (1, 2) else 0.0) + n % 7 * 5, (320.0 if k >= 2 else 0.0) + n % 5 * 6, 80.0, 50.0) for k, n in enumerate(ns)]
        edges += [(doc, k, k, k + 2, kinds[(ns[k] + k) % 4], False) for k in (0, 1)]
    return boxes, edges


def test_markers_of_crossing_lines_are_read_along_the_whole_line(spark):
    boxes, edges = slanted()
    frames = spark.createDataFrame(boxes, BOXES), spark.createDataFrame(edges, EDGES)
    pages = raster.drawn(*frames).persist()
    placed = frames[0].join(raster.corners(frames[0]), "doc_id").selectExpr("doc_id", "ord", "x - left AS x", "y - top AS y", "w", "h")
    got = sorted((r.doc_id, r.source, r.target, r.marker) for r in C.connectors(pages, placed, reach=20).collect())
    assert got == sorted((d, *((t, s) if m.endswith("diamond") else (s, t)), m) for d, _, s, t, m, _ in edges)


def test_an_images_segments_are_those_of_its_pixels(spark):
    pages = [(doc, *page.shape[::-1], page.tobytes()) for doc, page in enumerate(map(scribble, range(3)))]
    pages = spark.createDataFrame([*pages, (9, 5, 5, b"\xff" * 25), (10, 0, 0, None)], PAGE)
    names = ("doc_id", "wire", "piece", "a", "b", "e", "back", "length", "ahead")
    got = S.image_segments(pages).collect()
    assert got and sorted(tuple(r[c] for c in names) for r in got) == sorted(tuple(r[c] for c in names) for r in S.segments(S.skeleton(pages)).collect())
    for doc in range(3):
        near = graph(S.thinned(S.outside(scribble(doc).tobytes(), 120, 120, None)))
        inner = [p for p in near if len(near[p]) == 2]
        reached, todo = set(), [q for p in near if len(near[p]) != 2 for q in near[p]]
        while todo:
            p = todo.pop()
            if len(near[p]) == 2 and p not in reached:
                reached.add(p)
                todo += near[p]
        # each segment is there from both of its ends
        sums = [sum(r[c] for r in got if r.doc_id == doc) / 2 for c in S.SUMS]
        y, x = np.array([p for p in inner if p in reached], float).reshape(-1, 2).T
        assert sums == [len(x), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()]


def test_pages_and_written_tables_are_never_sent_round_whole(spark):
    boxes, edges = slanted()
    frames = spark.createDataFrame(boxes, BOXES), spark.createDataFrame(edges, EDGES)
    folder = persisted(frames[0]).withColumn("x", F.col("x") + 60).withColumn("y", F.col("y") + 60)
    pages = raster.drawn(persisted(frames[0]), persisted(frames[1]))
    found = C.wires(pages, folder)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_drawing_is_spread_over_tasks(spark):
    boxes = spark.createDataFrame([(d, 0, "action", 0.0, 0.0, 40.0, 30.0) for d in range(64)], BOXES)
    edges = spark.createDataFrame([], EDGES)
    pages = raster.drawn(persisted(boxes), persisted(edges))
    with_boxes = S.with_boxes(pages, persisted(boxes.selectExpr("doc_id", "ord", "x + 60 AS x", "y + 60 AS y", "w", "h")))
    for rows in (pages, with_boxes):
        tasks = rows.select(F.spark_partition_id().alias("t"), "doc_id").groupBy("t").count().collect()
        assert sum(r["count"] for r in tasks) == 64 and len(tasks) == 4
