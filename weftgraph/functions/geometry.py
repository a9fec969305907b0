"""Geometry of boxes, points and connectors as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 20


def edge_distance(px: Column, py: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Distance of a point to a box; 0 inside."""
    return F.hypot(px - F.greatest(x, F.least(px, x + w)), py - F.greatest(y, F.least(py, y + h)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.nullif(square, F.lit(0)))))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def overlap_area(x1, y1, w1, h1, x2, y2, w2, h2) -> Column:
    across = F.least(x1 + w1, x2 + w2) - F.greatest(x1, x2)
    down = F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2)
    return F.greatest(across, F.lit(0)) * F.greatest(down, F.lit(0))


def snap(v: Column, grid: int = GRID) -> Column:
    """The nearest grid line; halves go up."""
    return F.floor(v / grid + 0.5) * grid


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def normalized(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The box between two corners."""
    return F.struct(F.least(x1, x2).alias("x"), F.least(y1, y2).alias("y"), F.abs(x2 - x1).alias("width"), F.abs(y2 - y1).alias("height"))


def contains_centre(bx, by, bw, bh, x, y, w, h) -> Column:
    """Whether the second box's centre lies in the first."""
    cx, cy = x + w / 2, y + h / 2
    return cx.between(bx, bx + bw) & cy.between(by, by + bh)


def fit_view(x, y, w, h, view_w: float, view_h: float, margin: float = 40.0, most: float = 1.0) -> Column:
    """struct<zoom, x, y> that shows a bounding box in a view."""
    zoom = F.least(F.lit(most), F.lit(view_w - 2 * margin) / F.greatest(w, F.lit(1.0)), F.lit(view_h - 2 * margin) / F.greatest(h, F.lit(1.0)))
    return F.struct(zoom.alias("zoom"), (F.lit(view_w) / 2 - (x + w / 2) * zoom).alias("x"), (F.lit(view_h) / 2 - (y + h / 2) * zoom).alias("y"))


def anchor(shape: str, cx: Column, cy: Column, w: Column, h: Column, tx: Column, ty: Column) -> Column:
    """struct<x, y>: where the line from a shape's centre to a target leaves a "rect", "diamond" or "ellipse"."""
    dx, dy = tx - cx, ty - cy
    half_w, half_h = w / 2, h / 2
    zero = F.lit(0.0)
    if shape == "rect":
        scale = F.least(half_w / F.nullif(F.abs(dx), zero), half_h / F.nullif(F.abs(dy), zero))
    elif shape == "diamond":
        scale = F.lit(1.0) / F.nullif(F.abs(dx) / half_w + F.abs(dy) / half_h, zero)
    else:
        scale = F.lit(1.0) / F.nullif(F.hypot(dx / half_w, dy / half_h), zero)
    scale = F.coalesce(scale, zero)
    return F.struct((cx + dx * scale).alias("x"), (cy + dy * scale).alias("y"))


def circularity(area: Column, perimeter: Column) -> Column:
    return 4 * math.pi * area / F.nullif(perimeter * perimeter, F.lit(0.0))


def drawn_type(marker: Column, dashed: Column) -> Column:
    """struct<type, marker_is_source>: what an end marker and a line style mean.

    A diamond sits at the whole, which is the source; a triangle at the parent
    and an arrow at the used class, which are destinations.
    """
    kind = (
        F.when(marker == "filled_diamond", "composition").when(marker == "hollow_diamond", "aggregation").when(marker == "triangle", F.when(dashed, "realization").otherwise("inheritance")).when(dashed, "dependency").otherwise("association")
    )
    return F.struct(kind.alias("type"), F.coalesce(marker.isin("filled_diamond", "hollow_diamond"), F.lit(False)).alias("marker_is_source"))
