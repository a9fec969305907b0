"""Drawings as pixels to tables: ink, runs, pieces, and the boxes and shapes they form.

Spark's ``image`` source decodes in the JVM. Per image, numpy finds the ink and the
runs of equal pixels with the piece that each belongs to; what the pieces are - rules,
class boxes, actions, decisions, starts, ends, bars - is then joins and aggregates
over the runs, so a crowded page costs rows and not a larger task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.routing import components
from weftgraph.sources.scratch import persisted

# Fixed values. Grey levels that are ink at least and at most; darker cuts tried when fills count as ink; share of a page that is a fill.
INK_FLOOR, INK_CEILING = 200, 225
FILL_CUTS = (150, 120, 90, 60)
FILL_SIDE, FILL_SHARE = 9, 0.01
# Fixed values. Small pages are enlarged.
SMALL_PAGE, LARGE_ENOUGH = 350, 700
# Fixed values. Rules and sides of class boxes.
RULE_LENGTH, SIDE_LENGTH, STROKE_THICKNESS, COMPARTMENT, EXTENT_TOLERANCE, SIDE_SEARCH, CORNER_SKIP, SIDE_COVERAGE = 45, 25, 7, 8, 14, 3, 2, 0.85
# Fixed values. Shapes of activities: least area and side of an interior, least solidity, shares of the bounding box that figures fill.
HOLE_AREA, HOLE_SIDE, SMALL_AREA, SMALL_SIDE = 300, 18, 100, 12
ACTION_EXTENT, ELLIPSE_EXTENT, DIAMOND_EXTENT, CIRCLE_ASPECT = 0.82, (0.7, 0.82), (0.4, 0.6), (0.8, 1.25)
SOLID_SIDE, SOLID_DIAMETER, SOLID_EXTENT, BAR_SIDE, BAR_ASPECT, BAR_LENGTH = 11, 18, 0.65, 7, 4.0, 40
OUTLINE, OUTLINE_MOST = 3, 12

LAYERS = ("ink", "blank", "rule", "side", "solid", "bar")


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, width, height, grey) of PNG and JPEG files: transparency on white, small pages enlarged; files that aren't images are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select(F.col("image.origin").alias("doc_id"), "image.width", "image.height", F.col("image.nChannels").alias("n"), "image.data")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                p = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["n"]).astype(np.float32)
                if r["n"] == 4:
                    alpha = p[:, :, 3:] / 255
                    p = p[:, :, :3] * alpha + 255 * (1 - alpha)
                grey = p[:, :, 0] if p.shape[2] == 1 else p @ np.array([0.114, 0.587, 0.299], np.float32)  # blue, green, red
                longer = max(grey.shape)
                times = -(-LARGE_ENOUGH // longer) if longer < SMALL_PAGE else 1
                grey = np.rint(grey).astype(np.uint8).repeat(times, 0).repeat(times, 1)
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "width": grey.shape[1], "height": grey.shape[0], "grey": grey.tobytes()}], pa.schema([("doc_id", pa.string()), ("width", pa.int64()), ("height", pa.int64()), ("grey", pa.binary())]))

    return rows.mapInArrow(run, "doc_id string, width long, height long, grey binary")


def _filled(mask: np.ndarray, k: int, off: bool) -> np.ndarray:
    """Where a square of side k round a pixel is all set; beyond the border counts as set unless ``off``."""
    low = k // 2
    wide, n = np.pad(mask, ((low, k - 1 - low),) * 2, constant_values=not off), 1
    while n < k:  # what is set over n pixels on, both ways; each turn doubles n
        on = min(n, k - n)
        wide = wide[:, : wide.shape[1] - on] & wide[:, on:]
        wide = wide[: wide.shape[0] - on] & wide[on:]
        n += on
    return wide


def closed(mask: np.ndarray, k: int) -> np.ndarray:
    return _filled(~_filled(~mask, k, False), k, False)


def opened(mask: np.ndarray, k: int) -> np.ndarray:
    return ~_filled(~_filled(mask, k, False), k, False)


def otsu(grey: np.ndarray) -> int:
    """The grey level that parts dark from light with the largest variance between them."""
    n = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / below[-1] - mass) ** 2 / (below * (below[-1] - below))
    return int(np.argmax(np.nan_to_num(between, nan=0.0, posinf=0.0)))


def ink(grey: np.ndarray, coloured: bool = True) -> np.ndarray:
    """Strokes: light grey ones too, unless that makes fills of them; ``coloured`` also looks for darker cuts, for nodes with dark fills."""
    part = otsu(grey)
    cut = lambda level: closed(grey <= level, 3)
    fill = lambda m: opened(m, FILL_SIDE).mean()
    wide = cut(min(INK_CEILING, max(part, INK_FLOOR)))
    share = fill(wide)
    if share <= FILL_SHARE:
        return wide
    dark = cut(part)
    out = dark if fill(dark) < share / 2 else wide
    if coloured and fill(out) > FILL_SHARE:
        return next((m for m in map(cut, FILL_CUTS) if fill(m) <= FILL_SHARE), out)
    return out


def spans(mask: np.ndarray, least: int = 1, corners: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, start, end, piece) of the runs of set pixels; runs of neighbouring lines that touch (at corners too) are one piece, named by its first run."""
    wide = np.pad(mask, ((0, 0), (1, 1)))
    edge = np.flatnonzero(wide[:, 1:] != wide[:, :-1])  # starts and ends in turns, as lines begin and end unset
    (y, a), b = np.divmod(edge[::2], mask.shape[1] + 1), edge[1::2] % (mask.shape[1] + 1)
    keep = b - a >= least
    y, a, b = y[keep], a[keep], b[keep]
    width, by = mask.shape[1] + 2, int(corners)
    first = np.searchsorted(y * width + b, (y + 1) * width + a - by, side="right")
    last = np.searchsorted(y * width + a, (y + 1) * width + b + by, side="left")
    n = np.maximum(last - first, 0)
    up = np.repeat(np.arange(len(y)), n)
    down = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    name = np.arange(len(y))
    while True:
        before = name.copy()
        low = np.minimum(name[up], name[down])
        np.minimum.at(name, up, low)
        np.minimum.at(name, down, low)
        name = name[name]
        if np.array_equal(name, before):
            return y, a, b, name


def runs(pages: DataFrame, coloured: bool = True, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """(doc_id, layer, piece, line, start, end) of pages (doc_id, width, height, grey).

    Layers: strokes ("ink"), enclosed white ("blank"), long rows and columns of ink
    ("rule", "side"; a side's line is its column), and what is left of the ink when
    squares are fitted in ("solid", "bar"). Pages without pixels have no runs.
    """
    key_type = pages.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key_type}, layer string, piece long, line long, start long, `end` long"

    def of(grey: np.ndarray) -> Iterator[tuple]:
        mask = ink(grey, coloured)
        for layer in layers:
            if layer == "blank":
                y, a, b, name = spans(np.pad(~mask, 1, constant_values=True), corners=False)
                out = name != 0  # the first run is the white round the drawing
                yield layer, y[out] - 1, a[out] - 1, b[out] - 1, name[out]
            elif layer == "ink":
                yield layer, *spans(mask)
            elif layer in ("rule", "side"):
                yield layer, *spans(mask.T if layer == "side" else mask, SIDE_LENGTH if layer == "side" else RULE_LENGTH)
            else:
                yield layer, *spans(opened(mask, SOLID_SIDE if layer == "solid" else BAR_SIDE))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, width, height, data in zip(part.column(0), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), strict=True):
                if not data.is_valid or not width or not height:
                    continue
                for layer, y, a, b, name in of(np.frombuffer(data.as_buffer(), np.uint8).reshape(height, width)):
                    yield pa.RecordBatch.from_arrays([pa.repeat(k, len(y)), pa.repeat(pa.scalar(layer), len(y)), *[pa.array(c.astype(np.int64)) for c in (name, y, a, b)]], ["doc_id", "layer", "piece", "line", "start", "end"])

    return pages.select("doc_id", F.col("width").cast("long"), F.col("height").cast("long"), "grey").mapInArrow(run, schema)


def measures(found: DataFrame) -> DataFrame:
    """One row per piece: bounds x, y, w, h; area; the area between each line's outermost pixels (``hull``); the line of the widest run; first and last line's extent."""
    lines = found.groupBy("doc_id", "layer", "piece", "line").agg(F.min("start").alias("a"), F.max("end").alias("b"), F.sum(F.col("end") - F.col("start")).alias("n"))
    out = lines.groupBy("doc_id", "layer", "piece").agg(
        F.min("a").alias("x"), F.min("line").alias("y"), F.max("b").alias("right"), (F.max("line") + 1).alias("bottom"), F.sum("n").alias("area"), F.sum(F.col("b") - F.col("a")).alias("hull"),
        F.max(F.struct(F.col("b") - F.col("a"), -F.col("line"))).alias("widest"), F.min(F.struct("line", "a", "b")).alias("first"), F.max(F.struct("line", "a", "b")).alias("last"),
    )
    w, h = F.col("right") - F.col("x"), F.col("bottom") - F.col("y")
    return out.withColumns({"w": w, "h": h}).withColumns({"aspect": F.col("w") / F.col("h"), "extent": F.col("hull") / (F.col("w") * F.col("h"))}).drop("right", "bottom")


def class_boxes(found: DataFrame) -> DataFrame:
    """(doc_id, x, y, w, h, dividers): rules of one extent, each joined to the next below it by both sides."""
    found = persisted(found)  # read several times; the images are gone through once
    m = measures(found.where("layer = 'rule'")).where(F.col("h") <= STROKE_THICKNESS)
    rule = m.select("doc_id", "piece", F.col("x").alias("a"), (F.col("x") + F.col("w")).alias("b"), (F.col("y") + F.floor(F.col("h") / 2)).alias("at"))
    bucket = lambda r: r.withColumn("cell", F.floor(F.col("a") / (2 * EXTENT_TOLERANCE)))
    low = bucket(rule.select("doc_id", F.col("piece").alias("lower"), "a", F.col("a").alias("la"), F.col("b").alias("lb"), F.col("at").alias("to"))).drop("a")
    near = bucket(rule).withColumn("cell", F.explode(F.array(*[F.col("cell") + k for k in (-1, 0, 1)])))
    pair = near.join(low, ["doc_id", "cell"]).where((F.abs(F.col("a") - F.col("la")) <= EXTENT_TOLERANCE) & (F.abs(F.col("b") - F.col("lb")) <= EXTENT_TOLERANCE) & (F.col("to") - F.col("at") >= COMPARTMENT))
    next_below = pair.groupBy("doc_id", "piece").agg(F.min(F.struct("to", "lower", "a", "b", "la", "lb", "at")).alias("n")).select("doc_id", "piece", "n.*")
    # both sides: of the columns beside an end, the one with the longest ink between the rules
    ends = next_below.select("doc_id", "piece", "lower", F.col("at") + CORNER_SKIP, F.col("to") - CORNER_SKIP + 1, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.least("a", "la").alias("col")), F.struct(F.lit(1).alias("side"), (F.greatest("b", "lb") - 1).alias("col")))).alias("e")).toDF("doc_id", "piece", "lower", "from", "until", "e")
    ends = ends.select("doc_id", "piece", "lower", "from", "until", "e.side", F.explode(F.sequence(F.col("e.col") - SIDE_SEARCH, F.col("e.col") + SIDE_SEARCH)).alias("line"))
    side = found.where("layer = 'side'").select("doc_id", "line", "start", "end")
    over = F.greatest(F.lit(0), F.least("until", "end") - F.greatest("from", "start"))
    column = ends.join(side, ["doc_id", "line"]).groupBy("doc_id", "piece", "lower", "side", "line").agg(F.sum(over).alias("n"), F.first(F.col("until") - F.col("from")).alias("full"))
    held = column.groupBy("doc_id", "piece", "lower", "side").agg((F.max(F.col("n") / F.greatest("full", F.lit(1)))).alias("share")).where(F.col("share") >= SIDE_COVERAGE)
    # rules too close for a side's least length count as joined, as nothing between them can be looked at
    close = next_below.where(F.col("to") - F.col("at") < SIDE_LENGTH).select("doc_id", "piece", "lower")
    joined = held.groupBy("doc_id", "piece", "lower").count().where("count = 2").select("doc_id", "piece", "lower").unionByName(close).distinct()
    chain = components(joined.select("doc_id", F.col("piece").alias("a"), F.col("lower").alias("b")), ["doc_id"])
    of = chain.join(rule, (chain["doc_id"] == rule["doc_id"]) & (chain["id"] == rule["piece"])).select(chain["doc_id"], "component", "a", "b", "at")
    box = of.groupBy("doc_id", "component").agg(F.min("a").alias("x"), F.min("at").alias("y"), (F.max("b") - F.min("a")).alias("w"), (F.max("at") - F.min("at")).alias("h"), F.sort_array(F.collect_list("at")).alias("ats"))
    return box.select("doc_id", "x", "y", "w", "h", F.expr("slice(ats, 2, size(ats) - 2)").alias("dividers"))


def activity_shapes(found: DataFrame) -> DataFrame:
    """(doc_id, kind, x, y, w, h): outlined figures by the white they enclose, starts and bars by their solid ink.

    A figure is told by the share of its bounds that it fills; what encloses the
    centre of a smaller one is a loop of lines and no figure.
    """
    found = persisted(found)  # read several times; the images are gone through once
    white = measures(found.where("layer = 'blank'"))
    least = F.least("w", "h")
    small = (F.col("hull") < HOLE_AREA) | (least < HOLE_SIDE)
    white = white.where(~small | (F.col("hull") >= SMALL_AREA) & (least >= SMALL_SIDE))
    middle = F.abs(-F.col("widest")["col2"] + 0.5 - (F.col("y") + F.col("h") / 2)) <= 0.15 * F.col("h")
    cut = lambda row: (F.col(row)["b"] - F.col(row)["a"]) < F.col("w") - 0.1 * least
    kind = (
        F.when((F.col("extent").between(*ELLIPSE_EXTENT)) & F.col("aspect").between(*CIRCLE_ASPECT), "end")
        .when((F.col("extent") >= ACTION_EXTENT) & (cut("first") != cut("last")), "note")
        .when(F.col("extent") >= ACTION_EXTENT, "action")
        .when(F.col("extent").between(*ELLIPSE_EXTENT), "action")
        .when(F.col("extent").between(*DIAMOND_EXTENT) & middle, "decision")
    )
    hole = white.withColumn("kind", kind).where(F.col("kind").isNotNull() & (~small | (F.col("kind") == "decision")))
    # an outline is as thick as the shorter of the runs left and right of its widest line
    hole = hole.withColumn("line", -F.col("widest")["col2"])
    beside = hole.join(found.where("layer = 'blank'").groupBy("doc_id", "piece", "line").agg(F.min("start").alias("a"), F.max("end").alias("b")), ["doc_id", "piece", "line"]).select("doc_id", "piece", "line", F.explode(F.array("a", "b")).alias("place"))
    stroke = found.where("layer = 'ink'").select("doc_id", "line", (F.col("end") - F.col("start")).alias("n"), F.explode(F.array("start", "end")).alias("place"))
    thick = beside.join(stroke, ["doc_id", "line", "place"]).groupBy("doc_id", "piece").agg(F.least(F.min("n"), F.lit(OUTLINE_MOST)).alias("t"))
    t = F.coalesce("t", F.lit(OUTLINE))
    outlined = hole.join(thick, ["doc_id", "piece"], "left").select("doc_id", "kind", (F.col("x") - t).alias("x"), (F.col("y") - t).alias("y"), (F.col("w") + 2 * t).alias("w"), (F.col("h") + 2 * t).alias("h"))
    solid = measures(found.where("layer in ('solid', 'bar')"))
    disk = (F.col("layer") == "solid") & (F.col("extent") >= SOLID_EXTENT) & (F.col("extent") < 0.9) & F.col("aspect").between(*CIRCLE_ASPECT) & (least >= SOLID_DIAMETER)
    bar = (F.col("layer") == "bar") & ((F.col("aspect") >= BAR_ASPECT) | (F.col("aspect") <= 1 / BAR_ASPECT)) & (F.greatest("w", "h") >= BAR_LENGTH) & (F.col("extent") >= ACTION_EXTENT)
    solid = solid.withColumn("kind", F.when(disk, "start").when(bar, "bar")).where("kind is not null").select("doc_id", "kind", "x", "y", "w", "h")
    # what lies in an outlined figure is part of it, and what holds a smaller outlined figure is a loop of lines
    in_hole = outlined.select("doc_id", *[F.col(c).alias(f"o_{c}") for c in ("x", "y", "w", "h")])
    centre = lambda lo, size: F.col(lo) + F.col(size) / 2
    within = (centre("x", "w").between(F.col("o_x"), F.col("o_x") + F.col("o_w"))) & (centre("y", "h").between(F.col("o_y"), F.col("o_y") + F.col("o_h")))
    bare = solid.alias("s").join(in_hole.alias("o"), (F.col("s.doc_id") == F.col("o.doc_id")) & within, "left_anti")
    smaller = in_hole.alias("o")
    holds = (centre("o_x", "o_w").between(F.col("x"), F.col("x") + F.col("w"))) & (centre("o_y", "o_h").between(F.col("y"), F.col("y") + F.col("h"))) & (F.col("o_w") * F.col("o_h") < F.col("w") * F.col("h"))
    return outlined.alias("s").join(smaller, (F.col("s.doc_id") == F.col("o.doc_id")) & holds, "left_anti").unionByName(bare)
