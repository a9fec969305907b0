"""Joins between points, boxes and connectors of the same drawing.

All start from an equi join on the drawing; within one, a coarse grid keeps
pairs near each other. What a drawing holds is small, how many drawings there
are is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.geometry import distance, overlap_area

NEAR = 20.0
TWIN_SOLIDITY = 0.25
OVERLAP = 0.15
LABEL_REACH = 36.0


def _cells(rows: DataFrame, x, y, w, h, cell, pad) -> DataFrame:
    """Rows once for each grid cell that a box comes within ``pad`` of; cell and pad: numbers or columns."""
    steps = lambda low, high: F.sequence(F.floor(low / cell), F.floor(high / cell))
    rows = rows.withColumn("_cx", F.explode(steps(x - pad, x + w + pad)))
    return rows.withColumn("_cy", F.explode(steps(y - pad, y + h + pad)))


def nearest_box(points: DataFrame, boxes: DataFrame, key: str = "doc_id", cutoff: float | None = NEAR) -> DataFrame:
    """points (px, py) with box_ord: the box at the least distance (the lowest ord of equals), null if none is nearer than the cutoff, and that distance d.

    Without a cutoff the bound is the drawing's largest width + height, which is then
    the side of its grid's cells too; with one cells are twice as wide as it is, or as
    the drawing's boxes are on average, so that a box is in few of them. Boxes meet
    points by cells, so distant pairs are never made. Of boxes at one place and of one
    size only that of the lowest ord can win, and points at one place have one answer,
    so both meet once a place, however many there are of them.
    """
    box = boxes.groupBy(key, "x", "y", "w", "h").agg(F.min("ord").alias("box_ord"))
    if cutoff is None:
        grid = boxes.groupBy(key).agg(F.max(F.col("w") + F.col("h")).cast("double").alias("far")).where("far > 0").withColumn("side", F.col("far"))
    else:
        side = F.greatest(F.lit(2.0 * cutoff), F.sqrt(F.avg(F.col("w") * F.col("h"))), F.avg(F.col("w") + F.col("h")) / 2, F.lit(1.0))
        grid = boxes.groupBy(key).agg(side.alias("side")).withColumn("far", F.lit(float(cutoff)))
    side, far = F.col("side"), F.col("far")
    at = points.select(key, "px", "py").where("px is not null and py is not null").distinct().join(grid.drop("far"), key)
    at = at.withColumns({"_cx": F.floor(F.col("px") / side), "_cy": F.floor(F.col("py") / side)}).drop("side")
    box = _cells(box.join(grid, key), F.col("x"), F.col("y"), F.col("w"), F.col("h"), side, far)
    # squares, which are exact where coordinates are: equal distances stay equal
    dx, dy = F.col("px") - F.greatest("x", F.least("px", F.col("x") + F.col("w"))), F.col("py") - F.greatest("y", F.least("py", F.col("y") + F.col("h")))
    met = at.join(box, [key, "_cx", "_cy"]).withColumn("d", dx * dx + dy * dy).where(F.col("d") < far * far)
    best = met.groupBy(key, "px", "py").agg(F.min(F.struct("d", "box_ord")).alias("b")).select(key, "px", "py", "b.box_ord", F.sqrt("b.d").alias("d"))
    return points.join(best, [key, "px", "py"], "left")


def nearest_of_all(points: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """points (px, py) with box_ord: the box at the least distance (the lowest ord of equals) however far it is, null only if the drawing has none, and that distance d.

    A drawing has grids of doubling sides, from the size of its boxes on average up to
    one cell for all of its points and boxes. A point takes the smallest cell around it
    that a box touches; the nearest there bounds how far off the nearest of all can be,
    so it lies in that cell or in one of 15 of its grid at most that are within this
    bound. Points with no box beside them so meet the boxes of wider cells: many far from
    many boxes at places of their own meet all of these. As in ``nearest_box``, boxes and
    points meet once a place.
    """
    right, low = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    box = boxes.groupBy(key, "x", "y", "w", "h").agg(F.min("ord").alias("box_ord"))
    at = points.select(key, "px", "py").where("px is not null and py is not null").distinct()
    size = F.greatest(F.sqrt(F.avg(F.col("w") * F.col("h"))), F.avg(F.col("w") + F.col("h")) / 2)
    ends = box.groupBy(key).agg(size.alias("size"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.greatest("x", right)).alias("x1"), F.max(F.greatest("y", low)).alias("y1"))
    seen = at.groupBy(key).agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("px", "py")])
    grid = ends.join(seen, key).select(key, "size", F.least("x0", "min_px").alias("ox"), F.least("y0", "min_py").alias("oy"), F.greatest("x1", "max_px").alias("ex"), F.greatest("y1", "max_py").alias("ey"))
    grid = grid.withColumn("span", F.greatest(F.col("ex") - F.col("ox"), F.col("ey") - F.col("oy"))).withColumn("side", F.greatest("size", F.col("span") / 2.0**40)).withColumn("side", F.when(F.col("side") > 0, F.col("side")).otherwise(1.0))
    grid = grid.select(key, "ox", "oy", "side", (F.greatest(F.ceil(F.log2(F.col("span") / F.col("side"))), F.lit(0)) + 1).cast("int").alias("top"))
    cx, cy = (lambda v: F.floor((v - F.col("ox")) / F.col("side"))), (lambda v: F.floor((v - F.col("oy")) / F.col("side")))
    up = lambda c: F.call_function("shiftright", c, F.col("level"))  # noqa: E731 - the cell of a wider grid

    box = box.join(grid, key).withColumn("level", F.explode(F.sequence(F.lit(0), "top")))
    box = box.withColumn("_cx", F.explode(F.sequence(up(cx(F.col("x"))), up(cx(right))))).withColumn("_cy", F.explode(F.sequence(up(cy(F.col("y"))), up(cy(low)))))
    box = box.select(key, "level", "_cx", "_cy", "x", "y", "w", "h", "box_ord")
    at = at.join(grid, key).withColumns({"cx": cx(F.col("px")), "cy": cy(F.col("py"))})
    cells = at.select(key, "top", "cx", "cy").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), "top"))).withColumns({"_cx": up(F.col("cx")), "_cy": up(F.col("cy"))})
    smallest = cells.join(box, [key, "level", "_cx", "_cy"], "left_semi").groupBy(key, "cx", "cy").agg(F.min("level").alias("level"))

    dx, dy = F.col("px") - F.greatest("x", F.least("px", right)), F.col("py") - F.greatest("y", F.least("py", low))
    d = dx * dx + dy * dy  # squares, as in nearest_box
    at = at.join(smallest, [key, "cx", "cy"]).withColumns({"_cx": up(F.col("cx")), "_cy": up(F.col("cy"))})
    near = at.join(box, [key, "level", "_cx", "_cy"]).groupBy(key, "px", "py", "ox", "oy", "side", "level").agg(F.min(d).alias("far"))
    reach = F.sqrt("far") * (1 + 1e-9)  # roots and sums are rounded: rather a cell too many
    wide = near.withColumn("_cx", F.explode(F.sequence(up(cx(F.col("px") - reach)), up(cx(F.col("px") + reach)))))
    wide = wide.withColumn("_cy", F.explode(F.sequence(up(cy(F.col("py") - reach)), up(cy(F.col("py") + reach)))))
    met = wide.join(box, [key, "level", "_cx", "_cy"]).withColumn("d", d).where("d <= far")
    best = met.groupBy(key, "px", "py").agg(F.min(F.struct("d", "box_ord")).alias("b")).select(key, "px", "py", "b.box_ord", F.sqrt("b.d").alias("d"))
    return points.join(best, [key, "px", "py"], "left")


def adjacency(connectors: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Connectors (x1, y1, x2, y2) whose ends are at two different boxes: (key, ord, source, target); parallel ones stay."""
    ends = connectors.select(key, "ord", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("x1").alias("px"), F.col("y1").alias("py")), F.struct(F.lit(1).alias("e"), F.col("x2").alias("px"), F.col("y2").alias("py")))).alias("p")).select(key, "ord", (F.col("ord") * 2 + F.col("p.e")).alias("point"), "p.e", "p.px", "p.py")
    at = nearest_box(ends, boxes, key)
    pairs = at.groupBy(key, "ord").agg(F.max(F.when(F.col("e") == 0, F.col("box_ord"))).alias("source"), F.max(F.when(F.col("e") == 1, F.col("box_ord"))).alias("target"))
    return pairs.where("source is not null and target is not null and source != target")


def without_twins(edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drops an edge (x1..y2, solidity) if a clearly more solid one joins the same two boxes with its ends beside the other's, in either direction."""
    a = edges.withColumns({"lo": F.least("source", "target"), "hi": F.greatest("source", "target"), "len": distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))})
    b = a.select(key, "lo", "hi", *[F.col(c).alias(f"b_{c}") for c in ("ord", "x1", "y1", "x2", "y2", "solidity", "len")])
    reach = F.least("len", "b_len")
    near = lambda p, q: distance(F.col(f"x{p}"), F.col(f"y{p}"), F.col(f"b_x{q}"), F.col(f"b_y{q}")) < reach
    beside = (near(1, 1) & near(2, 2)) | (near(1, 2) & near(2, 1))
    same = (a[key] == b[key]) & (a["lo"] == b["lo"]) & (a["hi"] == b["hi"])
    return a.join(b, same & (F.col("ord") != F.col("b_ord")) & (F.col("b_solidity") >= F.col("solidity") + TWIN_SOLIDITY) & beside, "left_anti").drop("lo", "hi", "len")


def overlaps(boxes: DataFrame, key: str = "doc_id", cell: float = 200.0) -> DataFrame:
    """Pairs of boxes i < j of a drawing that share area: (key, i, j, area, smaller)."""
    cells = _cells(boxes.select(key, "ord", "x", "y", "w", "h"), F.col("x"), F.col("y"), F.col("w"), F.col("h"), cell, 0.0)
    a = cells.select(key, "_cx", "_cy", *[F.col(c).alias(f"a_{c}") for c in ("ord", "x", "y", "w", "h")])
    b = cells.select(key, "_cx", "_cy", *[F.col(c).alias(f"b_{c}") for c in ("ord", "x", "y", "w", "h")])
    area = overlap_area(*[F.col(f"{s}_{c}") for s in "ab" for c in ("x", "y", "w", "h")])
    met = a.join(b, [key, "_cx", "_cy"]).where("a_ord < b_ord").withColumn("area", area).where("area > 0")
    return met.select(key, F.col("a_ord").alias("i"), F.col("b_ord").alias("j"), "area", (F.col("a_w") * F.col("a_h")).alias("a_area"), (F.col("b_w") * F.col("b_h")).alias("b_area")).distinct()


def without_overlaps(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drops the larger of two boxes that share more than OVERLAP of the smaller; of equals the second."""
    pairs = overlaps(boxes, key).where(F.col("area") > OVERLAP * F.least("a_area", "b_area"))
    gone = pairs.select(key, F.when(F.col("a_area") > F.col("b_area"), F.col("i")).otherwise(F.col("j")).alias("ord")).distinct()
    return boxes.join(gone, [key, "ord"], "left_anti")


def any_overlap(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, overlapping) for every drawing."""
    hit = overlaps(boxes, key).select(key).distinct().withColumn("overlapping", F.lit(True))
    return boxes.select(key).distinct().join(hit, key, "left").withColumn("overlapping", F.coalesce("overlapping", F.lit(False)))


def bounding_box(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    return boxes.groupBy(key).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"))


def mutual_nearest(contacts: DataFrame, key: list[str]) -> DataFrame:
    """Pairs (i, j, d) in which each is the other's nearest."""
    both = contacts.select(*key, "i", "j", "d").unionByName(contacts.select(*key, F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    best = both.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "i").orderBy("d", "j"))).where("_r = 1").drop("_r")
    back = best.select(*key, F.col("j").alias("i"), F.col("i").alias("j"))
    return best.join(back, [*key, "i", "j"], "left_semi").where("i < j")


def without_kind(shapes: DataFrame, edges: DataFrame, kind: str = "note", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Shapes without a kind, numbered anew from 0, and the edges between those left."""
    kept = shapes.where(F.col("kind") != kind).withColumn("new", F.row_number().over(Window.partitionBy(key).orderBy("ord")) - 1)
    at = kept.select(key, "ord", "new")
    moved = edges.join(at.select(key, F.col("ord").alias("source"), F.col("new").alias("_s")), [key, "source"]).join(at.select(key, F.col("ord").alias("target"), F.col("new").alias("_t")), [key, "target"])
    moved = moved.withColumn("source", F.col("_s")).withColumn("target", F.col("_t")).drop("_s", "_t")
    return kept.withColumn("ord", F.col("new")).drop("new"), moved


def ports(ends: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fractions of a box side at which edges leave: the k-th of n at k / (n + 1), by the other box's centre."""
    w = Window.partitionBy(key, "box", "side")
    rank = F.row_number().over(w.orderBy("other_centre", "edge"))
    return ends.withColumn("fraction", rank / (F.count("*").over(w) + 1))


def grid_layout(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Boxes of 200 x 140 in four columns, 60 apart."""
    i = F.row_number().over(Window.partitionBy(key).orderBy("ord")) - 1
    return rows.withColumn("position", F.struct(((i % 4) * 260).cast("double").alias("x"), (F.floor(i / 4) * 200).cast("double").alias("y"))).withColumn("size", F.struct(F.lit(200.0).alias("width"), F.lit(140.0).alias("height")))
