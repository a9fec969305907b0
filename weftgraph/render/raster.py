"""Drawings as pixels: boxes and lines of a diagram to grey rasters and PNG files.

Where lines leave boxes is column arithmetic; only setting pixels is numpy, one
drawing at a time. No font is at hand, so labels stay in the tables.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.geometry import anchor

# Fixed values of the drawing: margin, stroke width, and the gap between a box and its line.
MARGIN, STROKE, EDGE_GAP = 60, 3, 14.0
#: Markers at the ends of lines: length of a triangle or arrow, of a diamond, half width; a dash and the gap behind it.
HEAD, DIAMOND, HALF_WIDTH, DASH, DASH_GAP = 18, 24, 9, 9, 6
#: Sides beyond this are refused, as one drawing is rasterised in one task.
MOST_SIDE = 16_384
#: How high the sheets are that a long drawing is cut into.
SHEET = 1_024
WHITE = 255


def _apart(x: Column, y: Column, tx: Column, ty: Column, w: Column, h: Column) -> Column:
    """Where a line from a box's centre to a target leaves it, with a gap; the centre itself for a point or a target at the centre."""
    at = anchor("rect", x, y, w, h, tx, ty)
    far = F.hypot(tx - x, ty - y)
    point = (w == 0) & (h == 0) | (far == 0)
    move = lambda p, c, t: F.when(point, c).otherwise(p + (t - c) / F.nullif(far, F.lit(0.0)) * EDGE_GAP)
    return F.struct(move(at["x"], x, tx).alias("x"), move(at["y"], y, ty).alias("y"))


def lines(edges: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, x1, y1, x2, y2, marker, dashed) for edges (ord, source, target) between boxes (ord, x, y, w, h); an edge without both boxes is left out.

    Columns marker (at the target) and dashed may be missing: plain lines.
    """
    style = [(F.col(c) if c in edges.columns else F.lit(None)).cast(t).alias(c) for c, t in (("marker", "string"), ("dashed", "boolean"))]
    end = lambda p: boxes.select(key, F.col("ord").alias({"a": "source", "b": "target"}[p]), (F.col("x") + F.col("w") / 2).alias(f"{p}x"), (F.col("y") + F.col("h") / 2).alias(f"{p}y"), F.col("w").alias(f"{p}w"), F.col("h").alias(f"{p}h"))
    met = edges.select(key, "ord", "source", "target", *style).join(end("a"), [key, "source"]).join(end("b"), [key, "target"])
    c = {n: F.col(n) for n in ("ax", "ay", "aw", "ah", "bx", "by", "bw", "bh")}
    met = met.withColumn("p", _apart(c["ax"], c["ay"], c["bx"], c["by"], c["aw"], c["ah"])).withColumn("q", _apart(c["bx"], c["by"], c["ax"], c["ay"], c["bw"], c["bh"]))
    return met.select(key, "ord", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"), "marker", "dashed")


def png(grey: np.ndarray) -> bytes:
    """An 8-bit grey PNG file."""
    h, w = grey.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.zeros((h, w + 1), np.uint8)  # a row begins with its filter: none
    rows[:, 1:] = grey
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def _inside(kind: str, x: np.ndarray, y: np.ndarray, w: float, h: float) -> np.ndarray:
    """Pixels of a figure of the given size round the origin."""
    if min(w, h) <= 0:
        return np.zeros(np.broadcast_shapes(x.shape, y.shape), bool)
    u, v = np.abs(x) / (w / 2), np.abs(y) / (h / 2)
    if kind == "decision":
        return u + v <= 1
    if kind in ("start", "end"):
        return u * u + v * v <= 1
    return (u <= 1) & (v <= 1)


def _draw(page: np.ndarray, kind: str, x: float, y: float, w: float, h: float) -> None:
    """Boxes have outlines; a start is a disk, an end a disk in a ring, forks and joins are bars."""
    x0, y0, x1, y1 = int(x), int(y), int(np.ceil(x + w)), int(np.ceil(y + h))
    px, py = (np.arange(x0, x1) + 0.5 - (x + w / 2))[None, :], (np.arange(y0, y1) + 0.5 - (y + h / 2))[:, None]
    ink = _inside(kind, px, py, w, h)
    if kind not in ("start", "fork", "join"):
        around = STROKE * (np.hypot(w, h) / max(min(w, h), 1.0) if kind == "decision" else 1)  # a slanted side is as thick as an upright one
        ink &= ~_inside(kind, px, py, w - 2 * around, h - 2 * around)
    if kind == "end":
        ink |= _inside(kind, px, py, w / 2, h / 2)
    page[y0:y1, x0:x1][ink] = 0


def _line(page: np.ndarray, x1: float, y1: float, x2: float, y2: float, dashed: bool | None = False) -> None:
    far = np.hypot(x2 - x1, y2 - y1)
    n = int(far * 2) + 2
    x, y = np.linspace(x1, x2, n).astype(int), np.linspace(y1, y2, n).astype(int)
    if dashed:
        on = np.linspace(0, far, n) % (DASH + DASH_GAP) < DASH
        x, y = x[on], y[on]
    for dx in range(-(STROKE // 2), STROKE // 2 + 1):
        for dy in range(-(STROKE // 2), STROKE // 2 + 1):
            page[np.clip(y + dy, 0, len(page) - 1), np.clip(x + dx, 0, page.shape[1] - 1)] = 0


def _marker(page: np.ndarray, kind: str, x1: float, y1: float, x2: float, y2: float) -> None:
    """A marker whose tip is the line's second end: "arrow" (open), "triangle" and "hollow_diamond" (white inside), "filled_diamond"."""
    far = np.hypot(x2 - x1, y2 - y1)
    if not far:
        return
    ux, uy = (x2 - x1) / far, (y2 - y1) / far
    x0, y0 = max(0, int(x2) - DIAMOND - 2), max(0, int(y2) - DIAMOND - 2)
    part = page[y0 : int(y2) + DIAMOND + 3, x0 : int(x2) + DIAMOND + 3]
    px, py = np.arange(part.shape[1])[None, :] + x0 - x2, np.arange(part.shape[0])[:, None] + y0 - y2
    back, aside = -(px * ux + py * uy), np.abs(py * ux - px * uy)
    if kind in ("triangle", "arrow"):
        edge = HALF_WIDTH * back / HEAD
        inside, core = (back >= 0) & (back <= HEAD) & (aside <= edge), (back <= HEAD - STROKE) & (aside <= edge - STROKE)
        if kind == "arrow":
            part[(back >= 0) & (back <= HEAD) & (np.abs(aside - edge) <= STROKE / 2)] = 0
            return
    else:
        edge = HALF_WIDTH * (1 - np.abs(2 * back / DIAMOND - 1))
        inside, core = (back >= 0) & (back <= DIAMOND) & (aside <= edge), aside <= edge - STROKE
    part[inside] = 0
    if kind != "filled_diamond":
        part[inside & core] = WHITE


def sheets(boxes: DataFrame, key: str = "doc_id", most: int = SHEET) -> DataFrame:
    """Boxes (ord, x, y, w, h) with the number of their sheet: long drawings without lines are cut between boxes.

    Boxes that share a line are on one sheet, however many hang together; sheets begin
    within ``most`` of each other, so one is at most that and what hangs together high.
    """
    by = Window.partitionBy(key).orderBy("y", "ord")
    bottom = F.max(F.col("y") + F.col("h")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(F.col("y") > bottom, F.lit(True)).cast("long")
    rows = boxes.withColumn("_row", F.sum(cut).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    top = F.min("y").over(Window.partitionBy(key, "_row"))
    return rows.withColumn("_top", top).withColumn("sheet", F.floor((F.col("_top") - F.min("y").over(Window.partitionBy(key))) / most)).drop("_row", "_top")


def _placed(boxes: DataFrame, *columns: str) -> DataFrame:
    """The boxes that can be drawn."""
    place = [F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]
    return boxes.select(*columns, *place).where("x is not null and y is not null and w >= 0 and h >= 0")


def corners(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, left, top) of each drawing's page as ``drawn`` gives them, without drawing it."""
    low = lambda c: (F.floor(F.min(c)) - MARGIN).alias({"x": "left", "y": "top"}[c])
    return _placed(boxes, key).groupBy(key).agg(low("x"), low("y"))


def drawn(boxes: DataFrame, edges: DataFrame, key: str = "doc_id", key_type: str = "long") -> DataFrame:
    """(key, error, left, top, width, height, grey, png) for each drawing of boxes (ord, kind, x, y, w, h) and edges (ord, source, target, perhaps marker and dashed).

    The page starts MARGIN left of and above the boxes, at (left, top). Boxes
    without a place or size aren't drawn; a page too large, or of null boxes only,
    has an error and no pixels.
    """
    boxes = _placed(boxes, key, "ord", "kind")
    of = boxes.groupBy(key).agg(F.collect_list(F.struct("kind", "x", "y", "w", "h")).alias("boxes"))
    way = lines(edges, boxes, key).groupBy(key).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2", "marker", "dashed")).alias("lines"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, "error", "left", "top", "width", "height", "grey", "png"]
        for part in parts:
            for k, found, ways in zip(part[key], part["boxes"], part["lines"], strict=True):
                left, top = (int(np.floor(min(b[c] for b in found))) - MARGIN for c in "xy")
                width, height = (int(np.ceil(max(b[c] + b[s] for b in found))) + MARGIN - o for c, s, o in (("x", "w", left), ("y", "h", top)))
                if max(width, height) > MOST_SIDE:
                    yield pd.DataFrame([[k, f"a drawing of {width} x {height} pixels", left, top, width, height, None, None]], columns=names)
                    continue
                page = np.full((height, width), WHITE, np.uint8)
                for a in ways if ways is not None else []:
                    way = a["x1"] - left, a["y1"] - top, a["x2"] - left, a["y2"] - top
                    _line(page, *way, a["dashed"])
                    if a["marker"]:
                        _marker(page, a["marker"], *way)
                for b in found:
                    _draw(page, b["kind"], b["x"] - left, b["y"] - top, b["w"], b["h"])
                yield pd.DataFrame([[k, None, left, top, width, height, page.tobytes(), png(page)]], columns=names)

    # boxes are few bytes and pages many: without a number of its own the shuffle would end in one task, and by the key itself it is left out after the join
    docs = of.join(way, key, "left").repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))
    return docs.mapInPandas(run, f"{key} {key_type}, error string, left long, top long, width long, height long, grey binary, png binary")
