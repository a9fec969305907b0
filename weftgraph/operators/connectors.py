"""Connectors in drawings: the lines between boxes, where they end, and what their ends mean.

Per image numpy takes the boxes out of the ink and names what is left: connected
pieces, and wires, which are pieces that lie no further apart than a dash's gap.
Which boxes a wire reaches and what its ends look like is joins and aggregates over
runs; only bounded windows at the ends are turned into pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.geometry import drawn_type
from weftgraph.operators import strokes
from weftgraph.operators.spatial import mutual_nearest
from weftgraph.sources.scratch import persisted

#: A wire ends at a box that is at most REACH away.
REACH = 8
#: Contacts on one side further apart than SPLIT are two. Windows at ends: half width, and depth beyond the reach.
SPLIT, HALF, DEPTH = 10, 14, 30
#: A dashed wire has at least so many pieces, or a traced line as many gaps. A traced end is a contact's that is at most MATCH away. Heights of boxes are met in bands of so many lines.
DASHES, BAND, MATCH = 3, 64, 40.0
#: A marker is wider than so many pixels and line widths; a diamond narrows to no less than TAIL behind its widest place; shares of ink.
MARKER_WIDTH, MARKER_TIMES, TAIL, CLOSED, SOLID = 9, 2.0, 0.4, 0.65, 0.85
#: The ink of a straight line spreads by so many pixels across it at most, markers included.
ACROSS = 4.5


def wires(pages: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, wire, piece, line, start, end): runs of ink outside the boxes (x, y, w, h). Pages without boxes or pixels have none."""
    names = ["wire", "piece", "line", "start", "end"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, width, height, grey, found in zip(part.column(0), *[part.column(i).to_pylist() for i in (1, 2, 3, 4)], strict=True):
                if not grey or not width or not height:
                    continue
                y, start, end, piece, wire = strokes.named(strokes.outside(grey, height, width, found))
                yield pa.RecordBatch.from_arrays([pa.repeat(k, len(y)), *[pa.array(c.astype(np.int64)) for c in (wire, piece, y, start, end)]], [key, *names])

    key_type = pages.schema[key].dataType.simpleString()
    of = strokes.with_boxes(pages.select(key, F.col("width").cast("long"), F.col("height").cast("long"), "grey"), boxes, key)
    return of.mapInArrow(run, f"{key} {key_type}, wire long, piece long, line long, start long, `end` long")


def _levels(found: DataFrame) -> DataFrame:
    """Each run once as a part of its wire and once of its piece: (level, id)."""
    level = F.explode(F.array(F.struct(F.lit("wire").alias("level"), F.col("wire").alias("id")), F.struct(F.lit("piece").alias("level"), F.col("piece").alias("id"))))
    return found.withColumn("l", level).select("*", "l.level", "l.id").drop("l")


def contacts(found: DataFrame, boxes: DataFrame, reach: int = REACH, key: str = "doc_id") -> DataFrame:
    """(key, level, id, box, side, k, px, py): where wires and pieces come within reach of a side of a box (ord, x, y, w, h)."""
    box = boxes.select(key, F.col("ord").alias("box"), *[F.round(c).cast("long").alias(c) for c in ("x", "y", "w", "h")])
    right, bottom = F.col("x") + F.col("w") - 1, F.col("y") + F.col("h") - 1
    box = box.withColumn("band", F.explode(F.sequence(F.floor((F.col("y") - reach) / BAND), F.floor((bottom + reach) / BAND))))
    met = found.withColumn("band", F.floor(F.col("line") / BAND)).join(box, [key, "band"])
    across = (F.col("start") <= right) & (F.col("end") > F.col("x"))
    beside = F.col("line").between(F.col("y"), bottom)
    near = lambda d: (d > 0) & (d <= reach)
    side = (
        F.when(across & near(F.col("y") - F.col("line")), "top").when(across & near(F.col("line") - bottom), "bottom")
        .when(beside & near(F.col("x") - F.col("end") + 1), "left").when(beside & near(F.col("start") - right), "right")
    )
    # beyond a corner the side that is further away counts, if the wire comes to the box nowhere else
    gap_x, gap_y = F.greatest(F.col("x") - F.col("end") + 1, F.col("start") - right), F.greatest(F.col("y") - F.col("line"), F.col("line") - bottom)
    corner = F.when((gap_x > 0) & (gap_y > 0) & (F.hypot(gap_x, gap_y) <= reach), F.when(gap_y >= gap_x, F.when(F.col("line") < F.col("y"), "top").otherwise("bottom")).otherwise(F.when(F.col("start") > right, "right").otherwise("left")))
    met = _levels(met.withColumns({"proper": side, "side": F.coalesce(side, corner)}).where("side is not null"))
    nearest = Window.partitionBy(key, "level", "id", "box").orderBy(F.col("proper").isNull(), F.hypot(gap_x, gap_y), "line", "start")
    met = met.withColumn("first", F.row_number().over(nearest)).where("proper is not null or first = 1")
    flat = F.col("side").isin("top", "bottom")
    met = met.withColumns({"lo": F.when(flat, F.least(F.greatest("start", "x"), right)).otherwise(F.least(F.greatest("line", "y"), bottom)), "hi": F.when(flat, F.greatest(F.least(F.col("end") - 1, right), "x")).otherwise(F.least(F.greatest("line", "y"), bottom))})
    part = Window.partitionBy(key, "level", "id", "box", "side").orderBy("lo", "hi", "line")
    before = F.max("hi").over(part.rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("new", F.coalesce(F.col("lo") > before + SPLIT, F.lit(False)).cast("int"))
    met = met.withColumn("k", F.sum("new").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.round((F.min("lo") + F.max("hi")) / 2).cast("long")
    edge = lambda name: F.first(name)
    out = met.withColumns({"right": right, "bottom": bottom}).groupBy(key, "level", "id", "box", "side", "k").agg(at.alias("at"), *[edge(c).alias(c) for c in ("x", "y", "right", "bottom")])
    px = F.when(F.col("side") == "left", F.col("x")).when(F.col("side") == "right", F.col("right")).otherwise(F.col("at"))
    py = F.when(F.col("side") == "top", F.col("y")).when(F.col("side") == "bottom", F.col("bottom")).otherwise(F.col("at"))
    return out.select(key, "level", "id", "box", "side", "k", px.alias("px"), py.alias("py"))


def two_ended(met: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contacts, numbered 0 and 1, of pieces that reach boxes at two places, and of wires without such a piece that do."""
    n = met.groupBy(key, "level", "id").count().where("count = 2").drop("count")
    piece = n.where("level = 'piece'")
    taken = piece.select(key, F.col("id").alias("piece")).join(found.select(key, "wire", "piece").distinct(), [key, "piece"]).select(key, F.col("wire").alias("id"))
    chosen = piece.unionByName(n.where("level = 'wire'").join(taken, [key, "id"], "left_anti"))
    chosen = met.join(chosen, [key, "level", "id"])
    order = Window.partitionBy(key, "level", "id").orderBy("box", "side", "k")
    return chosen.withColumn("end", F.row_number().over(order) - 1)


def leaving(ends: DataFrame, along: DataFrame, by: list[str]) -> DataFrame:
    """Ends (side, px, py) with ux, uy, ox, oy: the direction their line leaves in and a point of it at the box.

    ``along`` (by, ux, uy, x, y): directions and a point of the line where they are known; else it is square to the side.
    """
    side = F.col("side")
    square = lambda low, high: F.when(side == low, -1.0).when(side == high, 1.0).otherwise(0.0)
    met = ends.join(along.select(*by, "ux", "uy", "x", "y"), by, "left").withColumn("t", (F.col("px") - F.col("x")) * F.col("ux") + (F.col("py") - F.col("y")) * F.col("uy"))
    at = lambda p, c, u: F.coalesce(F.col(c) + F.col("t") * F.col(u), F.col(p).cast("double"))
    return met.withColumns({"ox": at("px", "x", "ux"), "oy": at("py", "y", "uy")}).withColumns({"ux": F.coalesce("ux", square("left", "right")), "uy": F.coalesce("uy", square("top", "bottom"))}).drop("x", "y", "t")


def straight_lines(ends: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, level, id, end, ux, uy, x, y): of lines whose ink lies about their main axis the direction out of each end, and their middle."""
    by = [key, "level", "id"]
    axes = strokes.main_axes(_levels(found), by).where((F.col("short") <= ACROSS * F.sqrt("n")) & (F.col("long") >= 4 * F.col("short")))
    met = ends.select(*by, "end", "px", "py").join(axes, by)
    sign = F.when((F.col("mx") - F.col("px")) * F.col("ax") + (F.col("my") - F.col("py")) * F.col("ay") < 0, -1.0).otherwise(1.0)
    return met.select(*by, "end", (sign * F.col("ax")).alias("ux"), (sign * F.col("ay")).alias("uy"), F.col("mx").alias("x"), F.col("my").alias("y"))


def end_markers(ends: DataFrame, found: DataFrame, reach: int = REACH, key: str = "doc_id") -> DataFrame:
    """(key, level, id, end, marker, widest): what an end (ox, oy, ux, uy) looks like by its width and ink at each distance from the box.

    Distances and widths are taken along and across the line's direction, whatever that
    is. Behind its widest place a diamond narrows slowly and anything else at once; a
    triangle has ink all across there, an open arrow only at its arms. What reaches
    the window's border is a bend of the line, and nothing behind it counts.
    """
    deep = reach + DEPTH
    runs = _levels(found).select(key, "level", "id", "line", "start", F.col("end").alias("stop"))
    met = runs.join(ends.select(key, "level", "id", "end", "ux", "uy", "ox", "oy"), [key, "level", "id"])
    # the window's bounds, and then its pixels
    box = lambda o, u, v: [F.col(o) + f for f in (F.least(F.lit(0.0), deep * F.col(u)) - HALF * F.abs(F.col(v)) - 2, F.greatest(F.lit(0.0), deep * F.col(u)) + HALF * F.abs(F.col(v)) + 2)]
    (left, right), (top, bottom) = box("ox", "ux", "uy"), box("oy", "uy", "ux")
    first, last = F.greatest("start", F.ceil(left)), F.least(F.col("stop") - 1, F.floor(right))
    dots = met.where(F.col("line").between(top, bottom) & (first <= last)).withColumn("at", F.explode(F.sequence(first, last)))
    dx, dy = F.col("at") - F.col("ox"), F.col("line") - F.col("oy")
    d, c = F.round(dx * F.col("ux") + dy * F.col("uy")), F.round(dy * F.col("ux") - dx * F.col("uy"))
    dots = dots.select(key, "level", "id", "end", d.cast("long").alias("d"), c.cast("long").alias("c")).where((F.abs("c") <= HALF) & F.col("d").between(0, deep))
    cuts = dots.groupBy(key, "level", "id", "end", "d").agg(F.count("*").alias("n"), (F.max("c") - F.min("c") + 1).alias("s"), F.max(F.abs("c")).alias("out"))
    seen = cuts.groupBy(key, "level", "id", "end").agg(F.sort_array(F.collect_list(F.struct("d", "s", "n"))).alias("all"), F.coalesce(F.min(F.when(F.col("out") >= HALF, F.col("d"))), F.lit(deep + 1)).alias("bend"))
    seen = seen.withColumn("cuts", F.expr("filter(all, p -> p.d < bend)")).where("size(cuts) > 0")
    seen = seen.withColumn("peak", F.expr("array_max(transform(cuts, p -> struct(p.s AS s, -p.d AS d)))")).withColumns({"wide": F.col("peak.s"), "at": -F.col("peak.d")})
    seen = seen.withColumns({
        "thin": F.expr("array_min(transform(cuts, p -> p.s))"),
        "tail": F.expr("coalesce(array_max(transform(filter(cuts, p -> p.d BETWEEN at + 4 AND at + 6), p -> p.s)), 0)"),
        "across": F.expr("aggregate(filter(cuts, p -> abs(p.d - at) <= 1), 0.0D, (t, p) -> t + p.n) / aggregate(filter(cuts, p -> abs(p.d - at) <= 1), 0.0D, (t, p) -> t + p.s)"),
        "dark": F.expr("aggregate(filter(cuts, p -> abs(p.d - at) <= 4), 0.0D, (t, p) -> t + p.n) / aggregate(filter(cuts, p -> abs(p.d - at) <= 4), 0.0D, (t, p) -> t + p.s)"),
    })
    marker = (
        F.when((F.col("wide") < MARKER_WIDTH) | (F.col("wide") < MARKER_TIMES * F.col("thin")), None)
        .when(F.col("tail") >= TAIL * F.col("wide"), F.when(F.col("dark") >= SOLID, "filled_diamond").otherwise("hollow_diamond"))
        .when(F.col("across") >= CLOSED, "triangle").otherwise("arrow")
    )
    return seen.select(key, "level", "id", "end", marker.alias("marker"), F.col("wide").alias("widest"))


def fused(pages: DataFrame, boxes: DataFrame, rest: DataFrame, reach: int = REACH, key: str = "doc_id") -> DataFrame:
    """(key, level, id, end, box, marker, widest, dashed): the lines of wires (runs ``rest``) that come to three contacts or more.

    A wire with one closed marker and no arrow is a shared bus: from the marked box
    (the first one if none is marked) a line goes to each other contact. Any other one
    is traced: if the lines that go straight on through its forks have a contact at
    either end, all of them, these are its lines; if not it is taken for a bus too.
    """
    at = [key, "id"]
    met = contacts(rest, boxes, reach, key).where("level = 'wire'")
    met = met.join(met.groupBy(*at).count().where("count >= 3").select(*at), at)
    met = persisted(met.withColumn("end", F.row_number().over(Window.partitionBy(*at).orderBy("box", "side", "k")) - 1))

    if met.isEmpty():  # most drawings have no line that crosses another
        none = lambda t: F.lit(None).cast(t)
        return met.select(key, none("string").alias("level"), "id", "end", "box", none("string").alias("marker"), none("long").alias("widest"), F.lit(False).alias("dashed"))

    # lines that go straight on, and which contacts their ends are
    of = met.select(key, F.col("id").alias("wire")).distinct()
    lines = strokes.image_segments(pages, boxes.join(of.select(key).distinct(), key, "left_semi"), key)
    lines = lines.join(of, [key, "wire"], "left_semi").join(rest.select(key, "piece").distinct(), [key, "piece"], "left_semi")
    ends, gaps = strokes.trails(lines, rest, boxes, reach, key)
    ends = persisted(ends)
    sound = ends.groupBy(key, "wire", "trail").agg(F.count("box").alias("boxes"), F.count("*").alias("n")).where("boxes > 0").withColumn("line", (F.col("boxes") == 2) & (F.col("n") == 2))
    sound = sound.groupBy(key, F.col("wire").alias("id")).agg(F.min("line").alias("all")).where("all").drop("all")
    ends = ends.where("box is not null").withColumnRenamed("wire", "id").withColumn("i", F.row_number().over(Window.partitionBy(*at).orderBy("trail", "box", "x", "y")))
    ends = persisted(ends.withColumn("n", F.row_number().over(Window.partitionBy(*at, "trail").orderBy("i")) - 1))
    far = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    pair = ends.join(met.select(*at, "box", "px", "py", "end"), [*at, "box"]).select(*at, "i", (-F.col("end") - 1).cast("int").alias("j"), far.alias("d")).where(F.col("d") <= MATCH)
    pair = persisted(mutual_nearest(pair, at).select(*at, F.col("j").alias("i"), (-F.col("i") - 1).alias("end")))
    along = ends.join(pair, [*at, "i"]).select(*at, "end", "ux", "uy", F.col("lx").alias("x"), F.col("ly").alias("y"))
    told = leaving(met, along, [*at, "end"])
    told = persisted(told.join(end_markers(told, rest, reach, key).where("level = 'wire'").select(*at, "end", "marker", "widest"), [*at, "end"], "left"))

    closed, arrow = F.col("marker").isin("triangle", "hollow_diamond", "filled_diamond"), F.col("marker") == "arrow"
    count = lambda c: F.count(F.when(c, 1))
    wire = persisted(told.groupBy(*at).agg(count(closed).alias("closed"), count(arrow).alias("arrows"), F.coalesce(F.min(F.when(closed, F.col("end"))), F.min("end")).alias("hub")))
    split = persisted(wire.where(~((F.col("closed") == 1) & (F.col("arrows") == 0))).select(*at).join(sound, at))
    marked = ends.join(split, at).join(pair, [*at, "i"], "left").join(told.select(*at, "end", "marker", "widest"), [*at, "end"], "left").join(gaps, [key, "trail"], "left")
    traced = marked.select(key, F.lit("trail").alias("level"), F.col("trail").alias("id"), F.col("n").alias("end"), "box", "marker", "widest", (F.coalesce("gaps", F.lit(0)) >= DASHES).alias("dashed"))

    # buses
    whole = wire.join(split, at, "left_anti").select(*at, "hub")
    hub = told.join(whole, at).where("end = hub").select(*at, "box", "marker", "widest")
    spokes = told.join(whole, at).where("end != hub").select(*at, F.concat_ws("/", F.lit("spoke"), "end").alias("level"), F.col("box").alias("other"))
    spokes = spokes.join(hub, at).withColumn("e", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("box").alias("box"), "marker", "widest"), F.struct(F.lit(1).alias("end"), F.col("other").alias("box"), F.lit(None).cast("string").alias("marker"), F.lit(None).cast("long").alias("widest")))))
    return traced.unionByName(spokes.select(key, "level", "id", "e.*", F.lit(False).alias("dashed")))


def connectors(pages: DataFrame, boxes: DataFrame, reach: int = REACH, key: str = "doc_id") -> DataFrame:
    """(key, source, target, marker, dashed, type) of the lines between boxes (ord, x, y, w, h) of pages (width, height, grey).

    A diamond marks its line's source, any other marker its target; of a line
    without markers the first box is the source. Lines that cross are traced, and a
    bus that several boxes share is a line for each (``fused``); dashed neighbours
    closer than a dash's gap that don't cross are one line. A line from a box to itself
    has both ends there.
    """
    found = persisted(wires(pages, boxes, key))  # read several times; the images are gone through once
    ends = persisted(two_ended(contacts(found, boxes, reach, key), found, key))
    pieces = _levels(found).groupBy(key, "level", "id").agg(F.countDistinct("piece").alias("pieces"))
    out = leaving(ends, straight_lines(ends, found, key), [key, "level", "id", "end"])
    both = ends.join(end_markers(out, found, reach, key), [key, "level", "id", "end"], "left").join(pieces, [key, "level", "id"])
    both = both.select(key, "level", "id", "end", "box", "marker", "widest", (F.col("pieces") >= DASHES).alias("dashed"))
    taken = ends.select(key, "level", "id").distinct()
    rest = found
    for level in ("wire", "piece"):
        rest = rest.join(taken.where(F.col("level") == level).select(key, F.col("id").alias(level)), [key, level], "left_anti")
    both = both.unionByName(fused(pages, boxes, persisted(rest), reach, key))
    told = both.groupBy(key, "level", "id").agg(
        F.max(F.when(F.col("marker").isNotNull(), F.struct("widest", -F.col("end"), "marker"))).alias("m"), F.max("dashed").alias("dashed"),
        *[F.max(F.when(F.col("end") == k, F.col("box"))).alias(n) for k, n in ((0, "a"), (1, "b"))],
    )
    marker, at_a = F.col("m.marker"), F.col("m.col2") == 0
    told = told.withColumns({"marker": marker, "means": drawn_type(marker, F.col("dashed"))})
    forward = marker.isNull() | (F.col("means.marker_is_source") == at_a)
    pick = lambda x, y: F.when(forward, F.col(x)).otherwise(F.col(y))
    return told.select(key, pick("a", "b").alias("source"), pick("b", "a").alias("target"), "marker", "dashed", F.col("means.type").alias("type"))
