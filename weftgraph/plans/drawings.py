"""Registered queries of drawings as pixels: suppliers of a nation are the figures of a drawing, which is rasterised and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.operators import connectors, pixels, routing
from weftgraph.plans.queries import query, table
from weftgraph.render import raster

_PLACED = (
    "SELECT s_nationkey AS doc_id, k AS ord, CASE s_suppkey % 4 WHEN 0 THEN 'action' WHEN 1 THEN 'decision' WHEN 2 THEN 'end' ELSE 'start' END AS kind,"
    " (k % 6 * 160)::DOUBLE AS x, (k // 6 * 120)::DOUBLE AS y, (CASE WHEN s_suppkey % 4 >= 2 THEN 60 ELSE 80 + s_suppkey % 7 * 4 END)::DOUBLE AS w, 60::DOUBLE AS h"
    " FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS k FROM supplier)"
)


def _placed(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("k", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
    kind = F.col("s_suppkey") % 4
    return rows.select(
        F.col("s_nationkey").cast("long").alias("doc_id"), F.col("k").alias("ord"), F.when(kind == 0, "action").when(kind == 1, "decision").when(kind == 2, "end").otherwise("start").alias("kind"),
        (F.col("k") % 6 * 160.0).alias("x"), (F.floor(F.col("k") / 6) * 120.0).alias("y"), F.when(kind >= 2, 60.0).otherwise(80.0 + F.col("s_suppkey") % 7 * 4).alias("w"), F.lit(60.0).alias("h"),
    )


@query(f"SELECT doc_id::BIGINT AS doc_id, kind, (x + w / 2)::BIGINT AS cx, (y + h / 2)::BIGINT AS cy FROM ({_PLACED})")
def shapes_read_back(spark, sf_dir):
    """Figures drawn as pixels, found again by kind and centre; a long drawing is drawn on several sheets."""
    boxes = raster.sheets(_placed(spark, sf_dir)).withColumns({"drawing": F.col("doc_id"), "doc_id": F.concat_ws("/", "doc_id", "sheet")})
    pages = raster.drawn(boxes, boxes.selectExpr("doc_id", "ord", "ord AS source", "ord AS target").limit(0), key_type="string")
    page = pages.select("doc_id", F.col("left").alias("l"), F.col("top").alias("t")).join(boxes.select("doc_id", "drawing").distinct(), "doc_id")
    found = pixels.activity_shapes(pixels.runs(pages, layers=("ink", "blank", "solid", "bar")))
    return found.join(page, "doc_id").select(F.col("drawing").alias("doc_id"), "kind", F.round(F.col("x") + F.col("w") / 2 + F.col("l")).cast("long").alias("cx"), F.round(F.col("y") + F.col("h") / 2 + F.col("t")).cast("long").alias("cy"))


@query(
    f"WITH b AS ({_PLACED}), p AS (SELECT a.doc_id, a.ord, a.x + a.w / 2 AS ax, a.y + a.h / 2 AS ay, a.w AS aw, a.h AS ah, c.x + c.w / 2 AS gx, c.y + c.h / 2 AS gy FROM b a JOIN b c ON c.doc_id = a.doc_id AND c.ord = a.ord + 1),"
    " d AS (SELECT *, sqrt((gx - ax) ** 2 + (gy - ay) ** 2) AS far FROM p),"
    " t AS (SELECT *, least(coalesce(aw / 2 / nullif(abs(gx - ax) / far, 0), 1e9), coalesce(ah / 2 / nullif(abs(gy - ay) / far, 0), 1e9)) + 14 AS out FROM d)"
    " SELECT doc_id::BIGINT AS doc_id, ord::BIGINT AS ord, round(ax + (gx - ax) / far * out)::BIGINT AS x1, round(ay + (gy - ay) / far * out)::BIGINT AS y1 FROM t"
)
def drawn_line_starts(spark, sf_dir):
    """Where the line to the next figure leaves a box, beyond the gap."""
    boxes = _placed(spark, sf_dir)
    last = boxes.groupBy("doc_id").agg(F.max("ord").alias("last"))
    edges = boxes.join(last, "doc_id").where("ord < last").selectExpr("doc_id", "ord", "ord AS source", "ord + 1 AS target")
    return raster.lines(edges, boxes).select("doc_id", F.col("ord").cast("long").alias("ord"), F.round("x1").cast("long").alias("x1"), F.round("y1").cast("long").alias("y1"))


@query("SELECT n_nationkey::BIGINT AS doc_id, 0 AS x, 1 AS y, 100 + n_nationkey % 9 AS w, 140 AS h, 1 AS dividers FROM nation")
def class_boxes_read_back(spark, sf_dir):
    """A class box with one divider per page, drawn from column values, found by its rules and sides."""
    sizes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), (100 + F.col("n_nationkey") % 9).cast("double").alias("w"))
    part = lambda k, y, h: sizes.select("doc_id", F.lit(k).alias("ord"), F.lit("action").alias("kind"), F.lit(0.0).alias("x"), F.lit(y).alias("y"), "w", F.lit(h).alias("h"))
    boxes = part(0, 0.0, 60.0).unionByName(part(1, 57.0, 86.0))  # two compartments that share a rule
    pages = raster.drawn(boxes, boxes.selectExpr("doc_id", "ord", "ord AS source", "ord AS target").limit(0))
    found = pixels.class_boxes(pixels.runs(pages, coloured=False, layers=("rule", "side")))
    return found.select("doc_id", (F.col("x") - raster.MARGIN).cast("int").alias("x"), (F.col("y") - raster.MARGIN).cast("int").alias("y"), F.col("w"), F.col("h").cast("int").alias("h"), F.size("dividers").alias("dividers"))


_STYLES = [("arrow", False), ("arrow", True), ("triangle", False), ("triangle", True), ("hollow_diamond", False), ("filled_diamond", False)]


@query(
    "SELECT n_nationkey::BIGINT AS doc_id, (CASE WHEN k IN (4, 5) THEN 1 ELSE 0 END)::BIGINT AS source, (CASE WHEN k IN (4, 5) THEN 0 ELSE 1 END)::BIGINT AS target, k IN (1, 3) AS dashed,"
    " CASE k WHEN 0 THEN 'association' WHEN 1 THEN 'dependency' WHEN 2 THEN 'inheritance' WHEN 3 THEN 'realization' WHEN 4 THEN 'aggregation' ELSE 'composition' END AS type"
    " FROM (SELECT n_nationkey, (n_nationkey + n_regionkey) % 6 AS k FROM nation)"
)
def relationships_read_back(spark, sf_dir):
    """A relationship per page, drawn with its marker and dashes, found by the ink between the boxes."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), ((F.col("n_nationkey") + F.col("n_regionkey")) % 6).alias("k"), (F.col("n_nationkey") % 2 == 0).alias("down"))
    away = lambda on, by: F.when(on, by).otherwise(0.0)
    box = lambda k, x, y: rows.select("doc_id", F.lit(k).alias("ord"), F.lit("action").alias("kind"), x.alias("x"), y.alias("y"), F.lit(90.0).alias("w"), F.lit(60.0).alias("h"))
    boxes = box(0, F.lit(0.0), F.lit(0.0)).unionByName(box(1, away(~F.col("down"), 240.0), away(F.col("down"), 210.0)))
    style = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(d).alias("dashed")) for m, d in _STYLES])[F.col("k")]
    edges = rows.select("doc_id", F.lit(0).alias("ord"), F.lit(0).alias("source"), F.lit(1).alias("target"), style["marker"].alias("marker"), style["dashed"].alias("dashed"))
    pages = raster.drawn(boxes, edges)
    placed = boxes.select("doc_id", "ord", (F.col("x") + raster.MARGIN).alias("x"), (F.col("y") + raster.MARGIN).alias("y"), "w", "h")
    found = connectors.connectors(pages, placed, reach=int(raster.EDGE_GAP) + 4)
    return found.select("doc_id", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "dashed", "type")


_ENDS = (
    f"WITH b AS ({_PLACED}), m AS (SELECT a.doc_id, a.ord * 2 + j AS edge, a.ord AS s, c.ord AS t, a.x, a.y, a.w, a.h, c.x AS ox, c.y AS oy, c.w AS ow, c.h AS oh FROM b a CROSS JOIN (VALUES (0), (1)) v(j) JOIN b c ON c.doc_id = a.doc_id AND c.ord = a.ord + CASE j WHEN 0 THEN 1 ELSE 6 END),"
    " e AS (SELECT doc_id, edge, 0 AS n, s AS box, x, y, w, h, ox, oy, ow, oh FROM m UNION ALL SELECT doc_id, edge, 1, t, ox, oy, ow, oh, x, y, w, h FROM m),"
    " g AS (SELECT *, greatest(ox - x - w, x - ox - ow) AS gx, greatest(oy - y - h, y - oy - oh) AS gy, ox + ow / 2 AS cx, oy + oh / 2 AS cy FROM e),"
    " f AS (SELECT *, CASE WHEN CASE WHEN gx > 0 AND gx >= gy THEN true WHEN gy > 0 THEN false ELSE abs(cx - x - w / 2) >= abs(cy - y - h / 2) END THEN CASE WHEN cx >= x + w / 2 THEN 'right' ELSE 'left' END ELSE CASE WHEN cy >= y + h / 2 THEN 'bottom' ELSE 'top' END END AS side FROM g),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, box, side ORDER BY CASE WHEN side IN ('left', 'right') THEN cy ELSE cx END, edge) / (count(*) OVER (PARTITION BY doc_id, box, side) + 1) AS part FROM f),"
    " p AS (SELECT *, CASE side WHEN 'right' THEN x + w WHEN 'left' THEN x ELSE floor((x + w * part) / 10 + 0.5) * 10 END AS px, CASE side WHEN 'bottom' THEN y + h WHEN 'top' THEN y ELSE floor((y + h * part) / 10 + 0.5) * 10 END AS py FROM r)"
    " SELECT doc_id::BIGINT AS doc_id, edge::BIGINT AS edge, n::BIGINT AS n, side, px::DOUBLE AS px, py::DOUBLE AS py,"
    " (CASE side WHEN 'right' THEN ceil((px + 20) / 10) * 10 WHEN 'left' THEN floor((px - 20) / 10) * 10 ELSE px END)::DOUBLE AS sx, (CASE side WHEN 'bottom' THEN ceil((py + 20) / 10) * 10 WHEN 'top' THEN floor((py - 20) / 10) * 10 ELSE py END)::DOUBLE AS sy FROM p"
)


def _neighbours(spark, sf_dir):
    """Each figure's edges to the next one and to the one below."""
    boxes = _placed(spark, sf_dir)
    step = F.explode(F.array(F.struct(F.lit(0).alias("j"), F.lit(1).alias("by")), F.struct(F.lit(1).alias("j"), F.lit(6).alias("by"))))
    return boxes, boxes.withColumn("step", step).select("doc_id", (F.col("ord") * 2 + F.col("step.j")).alias("edge"), F.col("ord").alias("source"), (F.col("ord") + F.col("step.by")).alias("target"))


@query(_ENDS)
def edge_terminals(spark, sf_dir):
    """Sides that face each other, places along them, and the straight ends of routes."""
    boxes, edges = _neighbours(spark, sf_dir)
    return routing.terminals(edges, boxes).select("doc_id", "edge", F.col("end").cast("long").alias("n"), "side", "px", "py", "sx", "sy")


@query(f"SELECT doc_id, edge, max(CASE n WHEN 0 THEN px END) AS x1, max(CASE n WHEN 0 THEN py END) AS y1, max(CASE n WHEN 1 THEN px END) AS x2, max(CASE n WHEN 1 THEN py END) AS y2, true AS square FROM ({_ENDS}) GROUP BY doc_id, edge")
def routes_of_edges(spark, sf_dir):
    """Every edge is routed, from terminal to terminal, in right angles."""
    boxes, edges = _neighbours(spark, sf_dir)
    way = F.col("points")
    square = F.expr("forall(sequence(1, size(points) - 1), i -> points[i].x = points[i - 1].x OR points[i].y = points[i - 1].y)")
    first, last = way[0], F.element_at(way, -1)
    return routing.routed_edges(edges, boxes).select("doc_id", "edge", first["x"].alias("x1"), first["y"].alias("y1"), last["x"].alias("x2"), last["y"].alias("y2"), square.alias("square"))


@query(f"SELECT doc_id::BIGINT AS doc_id, ord::BIGINT AS edge, x + w AS x1, x + w + 40 AS x2, floor((y + h * 0.25) / 10 + 0.5) * 10 AS y1, floor((y + h * 0.75) / 10 + 0.5) * 10 AS y2 FROM ({_PLACED})")
def loops_of_boxes(spark, sf_dir):
    """Edges from a figure to itself."""
    boxes = _placed(spark, sf_dir)
    way = F.col("points")
    loops = routing.self_loops(boxes.selectExpr("doc_id", "ord AS edge", "ord AS source", "ord AS target"), boxes)
    return loops.select("doc_id", F.col("edge").cast("long").alias("edge"), way[0]["x"].alias("x1"), way[1]["x"].alias("x2"), way[0]["y"].alias("y1"), way[2]["y"].alias("y2"))
