"""Strokes as graphs of pixels: thinning, segments between nodes, and lines that cross.

Per image numpy thins the ink to lines one pixel wide, tells which of its eight
neighbours each pixel has, and contracts the pixels with two neighbours by pointer
jumping: a step from a pixel to its neighbour points to the step after it, and every
round doubles how far steps see, so rounds are the logarithm of the longest segment.
Pixels with one, three or more neighbours are the nodes. ``segments`` does the same to
tables of pixels, which may be of any size. From there on strokes are edge tables.

Nodes that lie close together are one place: the two forks that thinning makes of a
crossing, and the outline of a marker beside its box. At a place that isn't at a box
the segments go on straight: of the pairs that lie in line those that are closest to
straight are taken first, each segment once, and two that are left over form a corner.
Loose ends that face each other across a gap, as dashes do, are joined in the same
manner. What hangs together then is a line; which places it ends at is a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.pixels import _filled, ink, spans
from weftgraph.operators.routing import components, facing_ends, matched_ends
from weftgraph.operators.spatial import nearest_box
from weftgraph.sources.scratch import persisted

#: Ink this near a box is the box's own; dashes are at most GAP apart.
ERASE, GAP = 3, 10
#: A pixel's id is y * ROW + x. Neighbours, in the order of the bits of ``near``.
ROW = 1 << 20
AROUND = ((-1, 0), (0, 1), (1, 0), (0, -1), (-1, 1), (1, 1), (1, -1), (-1, -1))
#: The sums of a segment's inner pixels: their number, x, y, and products.
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: Rounds after which a step has seen far enough to tell its segment's direction (2 ** LOOK pixels).
LOOK = 4
#: Segments up to JOINT pixels at a fork, and up to MARKER between places within ZONE of one box, are part of a place.
JOINT, MARKER, ZONE = 8, 32, 44
#: A ring up to this long at a place within ZONE of a box is a marker's outline.
RING = 100
#: Segments in line deviate by at most STRAIGHT; loose ends face each other across at most DASH_GAP.
STRAIGHT, DASH_GAP = math.radians(30), 34.0
#: Thinning takes so many pixels off the end of a line; those of a straight one spread by at most SPREAD across it.
SHORTER, SPREAD = 4, 1.5


def outside(grey: bytes, height: int, width: int, boxes: list | None) -> np.ndarray:
    """The ink that isn't in or beside a box."""
    mask = ink(np.frombuffer(grey, np.uint8).reshape(height, width), False).copy()
    for b in boxes or []:
        mask[max(0, b["y"] - ERASE) : max(0, b["y"] + b["h"] + ERASE), max(0, b["x"] - ERASE) : max(0, b["x"] + b["w"] + ERASE)] = False
    return mask


def named(mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """(line, start, end, piece, wire) of the runs of a mask: pieces hang together, wires do across a dash's gap."""
    y, start, end, piece = spans(mask)
    wide_y, wide_start, _, name = spans(~_filled(~mask, GAP + 1, False))
    width = mask.shape[1]
    return y, start, end, piece, name[np.searchsorted(wide_y * width + wide_start, y * width + start, side="right") - 1] if len(y) else piece


def thinned(mask: np.ndarray) -> np.ndarray:
    """Lines one pixel wide: border pixels are taken off in turns from two corners as long as their neighbours stay connected."""
    full, (ys, xs) = np.zeros_like(mask), np.nonzero(mask)
    if not len(ys):
        return full
    top, left = ys.min(), xs.min()
    m = np.pad(mask[top : ys.max() + 1, left : xs.max() + 1], 1)
    while True:
        before = m.sum()
        for turn in (0, 1):
            n = [np.zeros_like(m) for _ in range(8)]
            for k, (dy, dx) in enumerate(((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))):
                n[k][1:-1, 1:-1] = m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
            count = sum(x.astype(np.int8) for x in n)
            rises = sum((~a & b).astype(np.int8) for a, b in zip(n, [*n[1:], n[0]], strict=True))
            north, east, south, west = n[0], n[2], n[4], n[6]
            free = (~(north & east & south) & ~(east & south & west)) if turn == 0 else (~(north & east & west) & ~(north & south & west))
            m = m & ~((count >= 2) & (count <= 6) & (rises == 1) & free)
        if m.sum() == before:
            full[top : ys.max() + 1, left : xs.max() + 1] = m[1:-1, 1:-1]
            return full


def neighbours(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, x, near) of the pixels: near has the bits of the neighbours; one across a corner counts only if no pixel beside joins the two already."""
    p, (y, x) = np.pad(line, 1), np.nonzero(line)
    at = lambda dy, dx: p[y + 1 + dy, x + 1 + dx]
    near = np.zeros(len(y), np.int64)
    for k, (dy, dx) in enumerate(AROUND):
        near |= (at(dy, dx) if not dy or not dx else at(dy, dx) & ~at(dy, 0) & ~at(0, dx)).astype(np.int64) << k
    return y, x, near


def contracted(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(y, x, columns) of the segments of thinned ink from each of their ends: where the first node is, and a, b, e, back, length and ahead as ``segments`` has them, with SUMS."""
    y, x, near = neighbours(line)
    bits = near[:, None] >> np.arange(8) & 1
    at, way = np.nonzero(bits)
    dy, dx = np.array(AROUND).T
    width, back = line.shape[1], np.array([AROUND.index((-a, -b)) for a, b in AROUND])
    to = np.searchsorted(y * width + x, (y[at] + dy[way]) * width + x[at] + dx[way])
    number = np.cumsum(bits.ravel()).reshape(bits.shape) - 1
    # of a pixel with two neighbours a step goes on along the bit that it didn't come by
    degree = bits.sum(1)
    through = degree[to] == 2
    ways = (bits * np.arange(8)).sum(1)
    then = np.arange(len(at))
    then[through] = number[to[through], ways[to[through]] - back[way[through]]]
    px, py = x[to].astype(float), y[to].astype(float)
    sums = np.column_stack([np.ones(len(at)), px, py, px * px, py * py, px * py]) * through[:, None]
    first, rounds, ahead = np.flatnonzero(degree[at] != 2), 0, None
    while True:
        if rounds == LOOK:
            ahead = to[then[first]]
        if ahead is not None and not through[then[first]].any():
            break
        sums, then, rounds = sums + sums[then], then[then], rounds + 1
    last, id = then[first], y * ROW + x
    start = at[first]
    columns = {"a": id[start], "b": id[to[last]], "e": id[start] * 8 + way[first], "back": id[to[last]] * 8 + back[way[last]], "length": sums[first, 0].astype(np.int64) + 1, "ahead": id[ahead]}
    return y[start], x[start], columns | {k: sums[first, i] for i, k in enumerate(SUMS)}


def _thinned(pages: DataFrame, boxes: DataFrame | None, key: str, schema: str, rows) -> DataFrame:
    """(key, wire, piece, schema): ``rows`` (y, x, columns) of the thinned ink of pages (width, height, grey) outside the boxes."""
    kind = "array<struct<x:bigint,y:bigint,w:bigint,h:bigint>>"
    of = pages.withColumn("boxes", F.lit(None).cast(kind)) if boxes is None else with_boxes(pages, boxes, key)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, width, height, grey, found in zip(part.column(0), *[part.column(i).to_pylist() for i in (1, 2, 3, 4)], strict=True):
                if not grey or not width or not height:
                    continue
                mask = outside(grey, height, width, found)
                y, x, columns = rows(thinned(mask))
                run_y, start, _, piece, wire = named(mask)
                at = np.searchsorted(run_y * width + start, y * width + x, side="right") - 1
                found = {"wire": wire[at], "piece": piece[at]} | columns
                yield pa.RecordBatch.from_arrays([pa.repeat(k, len(y)), *[pa.array(c if c.dtype == float else c.astype(np.int64)) for c in found.values()]], [key, *found])

    key_type = pages.schema[key].dataType.simpleString()
    return of.select(key, F.col("width").cast("long"), F.col("height").cast("long"), "grey", "boxes").mapInArrow(run, f"{key} {key_type}, wire long, piece long, {schema}")


def with_boxes(pages: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages that have boxes (x, y, w, h), with these as a list.

    Pages are large, pack well, and little is known of their size before they are drawn:
    so it is said that the boxes are what is built of the join, and into how many parts
    it goes, or pages would go round whole or end in few tasks.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = boxes.where("x is not null and y is not null and w is not null and h is not null").groupBy(key).agg(F.collect_list(F.struct(*[F.round(c).cast("long").alias(c) for c in ("x", "y", "w", "h")])).alias("boxes"))
    return pages.repartition(parts, key).join(of.hint("shuffle_hash"), key)


def skeleton(pages: DataFrame, boxes: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, wire, piece, id, near): the thinned ink of pages (width, height, grey) outside the boxes (x, y, w, h); pages without pixels have none."""

    def rows(line: np.ndarray):
        y, x, near = neighbours(line)
        return y, x, {"id": y * ROW + x, "near": near}

    return _thinned(pages, boxes, key, "id long, near long", rows)


def image_segments(pages: DataFrame, boxes: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """What ``segments`` makes of the ``skeleton`` of pages, with the SUMS of each segment's pixels between its nodes; an image's pixels are never rows."""
    ids = ", ".join(f"{c} long" for c in ("a", "b", "e", "back", "length", "ahead"))
    return _thinned(pages, boxes, key, ids + "".join(f", {c} double" for c in SUMS), contracted)


def _beside(id: str = "id", near: str = "near") -> Column:
    """The ids of a pixel's neighbours."""
    by = ", ".join(str(dy * ROW + dx) for dy, dx in AROUND)
    return F.expr(f"transform(filter(sequence(0, 7), k -> (shiftright({near}, k) & 1) = 1), k -> {id} + array({by})[k])")


def _step(a: Column, b: Column) -> Column:
    """One number for the step from a pixel to its neighbour."""
    return a * 8 + F.array_position(F.array(*[F.lit(dy * ROW + dx).cast("long") for dy, dx in AROUND]), b - a) - 1


def segments(pixels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, wire, piece, a, b, e, back, length, ahead): every segment from each of its two ends.

    a, b: the nodes; e: the step it begins with, and back: that from the other end;
    length: in steps; ahead: the pixel 2 ** LOOK + 1 steps on, or the end. Rings without
    a node have no row, and neither have single pixels.
    """
    pixels = persisted(pixels)
    rows = pixels.withColumn("n", _beside()).withColumn("degree", F.size("n"))
    through = rows.where("degree = 2").select(key, "id", F.explode(F.expr("array(struct(n[0] AS a, n[1] AS c), struct(n[1] AS a, n[0] AS c))")).alias("p"))
    steps = through.select(key, F.col("p.a").alias("a"), F.col("id").alias("b"), F.col("id").alias("ta"), F.col("p.c").alias("tb"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("done"))
    last = rows.where("degree != 2").select(key, F.explode("n").alias("a"), F.col("id").alias("b"))
    steps = persisted(steps.unionByName(last.select(key, "a", "b", F.col("a").alias("ta"), F.col("b").alias("tb"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("done"))))
    nodes = persisted(rows.where("degree != 2").select(key, F.col("id").alias("a"), "wire", "piece"))
    open_, before, rounds, ahead = steps.where("not done").count(), -1, 0, None
    while True:
        if rounds == LOOK or ahead is None and (open_ in (0, before)):
            ahead = steps.join(nodes.select(key, "a"), [key, "a"], "left_semi").select(key, "a", "b", F.col("tb").alias("ahead"))
        if open_ in (0, before):
            break
        on = steps.select(key, F.col("a").alias("ta"), F.col("b").alias("tb"), F.col("ta").alias("ua"), F.col("tb").alias("ub"), F.col("n").alias("m"), F.col("done").alias("ended"))
        far = steps.where("not done").join(on, [key, "ta", "tb"]).select(key, "a", "b", F.col("ua").alias("ta"), F.col("ub").alias("tb"), (F.col("n") + F.col("m")).alias("n"), F.col("ended").alias("done"))
        steps = persisted(steps.where("done").unionByName(far))
        open_, before, rounds = steps.where("not done").count(), open_, rounds + 1
    whole = steps.where("done").join(nodes, [key, "a"]).join(ahead, [key, "a", "b"])
    return whole.select(key, "wire", "piece", "a", F.col("tb").alias("b"), _step(F.col("a"), F.col("b")).alias("e"), _step(F.col("tb"), F.col("ta")).alias("back"), (F.col("n") + 1).alias("length"), "ahead")


def at_pixel(id: str) -> tuple[Column, Column]:
    """(x, y) of an id."""
    return (F.col(id) % ROW).cast("double"), F.floor(F.col(id) / ROW).cast("double")


def tips(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, dx, dy): nodes with one segment, and the unit vector out of the stroke there."""
    one = pieces.groupBy(key, F.col("a").alias("id")).agg(F.count("*").alias("n"), F.first("ahead").alias("ahead")).where("n = 1")
    (x, y), (ax, ay) = at_pixel("id"), at_pixel("ahead")
    far = F.nullif(F.hypot(x - ax, y - ay), F.lit(0.0))
    return one.select(key, "id", ((x - ax) / far).alias("dx"), ((y - ay) / far).alias("dy"))


def farthest(pieces: DataFrame, starts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, distance, most): of every node its distance along the strokes from the starts (key, id), and how far the farthest pixel of its wire is.

    The farthest pixel may lie within a segment that is reached from both sides.
    """
    from weftgraph.operators.graph import shortest_paths

    edges = pieces.select(key, F.col("a").alias("source"), F.col("b").alias("target"), F.col("length").cast("double").alias("length"))
    best = persisted(shortest_paths(edges, starts, [key]))
    end = lambda n: best.select(key, F.col("id").alias(n), F.col("distance").alias(f"d{n}"))
    met = pieces.join(end("a"), [key, "a"]).join(end("b"), [key, "b"])
    most = met.groupBy(key, "piece").agg(F.max(F.floor((F.col("da") + F.col("db") + F.col("length")) / 2)).cast("double").alias("most"))
    of = pieces.select(key, F.col("a").alias("id"), "piece").distinct()
    return best.join(of, [key, "id"]).join(most, [key, "piece"]).select(key, "id", "distance", "most")


def places(pieces: DataFrame, boxes: DataFrame, reach: float, key: str = "doc_id") -> DataFrame:
    """(key, id, place, box, zone, cx, cy) of every node: what it is one place with, the place's middle, and the boxes that the place is at and near."""
    x, y = at_pixel("id")
    nodes = persisted(pieces.select(key, F.col("a").alias("id")).groupBy(key, "id").agg(F.count("*").alias("degree")).select(key, "id", "degree", F.col("id").alias("point"), x.alias("px"), y.alias("py")))
    placed = persisted(nearest_box(nodes, boxes, key, cutoff=ZONE).select(key, "id", "degree", "px", "py", F.col("box_ord").alias("zone"), "d"))
    end = lambda n: placed.select(key, F.col("id").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("degree", "zone")])
    met = pieces.select(key, "a", "b", "length").join(end("a"), [key, "a"]).join(end("b"), [key, "b"])
    joint = (F.col("length") <= JOINT) & (F.greatest("degree_a", "degree_b") >= 3)
    marker = (F.col("length") <= MARKER) & (F.col("zone_a") == F.col("zone_b"))
    one = components(met.where(joint | marker).where("a < b").select(key, "a", "b"), [key])
    of = placed.join(one, [key, "id"], "left").withColumn("place", F.coalesce("component", "id"))
    near = F.when(F.col("d") <= reach + SHORTER, F.struct("d", "zone"))
    middle = of.groupBy(key, "place").agg(F.min(near)["zone"].alias("box"), F.min(F.when(F.col("zone").isNotNull(), F.struct("d", "zone")))["zone"].alias("zone"), F.avg("px").alias("cx"), F.avg("py").alias("cy"))
    return of.select(key, "id", "place").join(middle, [key, "place"]).select(key, "id", "place", "box", "zone", "cx", "cy")


def main_axes(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mx, my, ax, ay, long, short): how many pixels runs (line, start, end) have, their middle, the direction they spread most in, and their spread along and across it.

    The direction is that of the first right singular vector of the centred pixels, and
    long and short are its singular values; of equal spreads it is the x axis.
    """
    n, a, b, y = (F.col("end") - F.col("start")).cast("double"), F.col("start").cast("double"), F.col("end").cast("double"), F.col("line").cast("double")
    x1 = n * (a + b - 1) / 2
    x2 = ((b - 1) * b * (2 * b - 1) - (a - 1) * a * (2 * a - 1)) / 6
    return axes_of_sums(found.where("end > start").select(*by, *[c.alias(a) for c, a in zip((n, x1, n * y, x2, n * y * y, x1 * y), SUMS, strict=True)]), by)


def axes_of_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """The main axes of what rows hold the SUMS of."""
    out = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n > 0")
    mx, my = F.col("sx") / F.col("n"), F.col("sy") / F.col("n")
    out = out.select(*by, "n", mx.alias("mx"), my.alias("my"), (F.col("sxx") - mx * F.col("sx")).alias("cxx"), (F.col("syy") - my * F.col("sy")).alias("cyy"), (F.col("sxy") - mx * F.col("sy")).alias("cxy"))
    turn = F.atan2(2 * F.col("cxy"), F.col("cxx") - F.col("cyy")) / 2
    half, apart = (F.col("cxx") + F.col("cyy")) / 2, F.hypot((F.col("cxx") - F.col("cyy")) / 2, F.col("cxy"))
    return out.select(*by, "n", "mx", "my", F.cos(turn).alias("ax"), F.sin(turn).alias("ay"), F.sqrt(F.greatest(half + apart, F.lit(0.0))).alias("long"), F.sqrt(F.greatest(half - apart, F.lit(0.0))).alias("short"))


def arms(pieces: DataFrame, at: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, wire, piece, place, box, e, seg, end, length, x, y, dx, dy): segments by the place they leave, with the direction they leave it in; those within one place aside.

    end: a number for this end of the segment.
    """
    begin = at.select(key, F.col("id").alias("a"), "place", "box", "zone", "cx", "cy")
    end = at.select(key, F.col("id").alias("b"), F.col("place").alias("other"))
    (x, y), (ax, ay) = at_pixel("a"), at_pixel("ahead")
    met = pieces.join(begin, [key, "a"]).join(end, [key, "b"]).where((F.col("place") != F.col("other")) | (F.col("length") > F.when(F.col("zone").isNotNull(), RING).otherwise(MARKER)))
    vx, vy = ax - F.col("cx"), ay - F.col("cy")
    far = F.nullif(F.hypot(vx, vy), F.lit(0.0))
    seg = F.least("e", "back")
    return met.select(key, "wire", "piece", "place", "box", "e", seg.alias("seg"), (seg * 2 + (F.col("e") != seg).cast("long")).alias("end"), "length", x.alias("x"), y.alias("y"), (vx / far).alias("dx"), (vy / far).alias("dy"), *SUMS)


def straight_on(leaving: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, a, b): steps of arms that go on into each other at places away from boxes."""
    free = persisted(leaving.where("box is null"))
    # directions meet by sectors, so that a fork of many arms makes few pairs
    n = round(2 * math.pi / STRAIGHT)
    sector = F.pmod(F.floor(F.atan2("dy", "dx") / STRAIGHT), F.lit(n))
    one = free.select(key, "place", "e", "dx", "dy", sector.alias("s"))
    other = free.select(key, "place", F.col("e").alias("f"), F.col("dx").alias("fx"), F.col("dy").alias("fy"), F.explode(F.array(*[F.pmod(sector + n // 2 + k, F.lit(n)) for k in (-1, 0, 1)])).alias("s"))
    turn = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -(F.col("dx") * F.col("fx") + F.col("dy") * F.col("fy")))))
    met = one.join(other, [key, "place", "s"]).where("e < f").withColumn("d", F.round(turn, 6)).where(F.col("d") <= STRAIGHT)
    pairs = matched_ends(met.select(key, F.col("e").alias("a"), F.col("f").alias("b"), "d"), key)
    used = pairs.select(key, F.explode(F.array("a", "b")).alias("e"))
    rest = free.join(used, [key, "e"], "left_anti").groupBy(key, "place").agg(F.count("*").alias("n"), F.min("e").alias("a"), F.max("e").alias("b")).where("n = 2")
    return pairs.unionByName(rest.select(key, "a", "b"))


def loose_ends(leaving: DataFrame, axes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, wire, seg, end, x, y, dx, dy): ends away from boxes that nothing else is at, with the direction out of them.

    A short segment, as a dash is, has the main axis (key, piece, ax, ay) of its piece
    as direction, since its thinned pixels are too few to tell it.
    """
    one = leaving.groupBy(key, "place").agg(F.count("*").alias("n"), F.first("box").alias("box"), *[F.first(c).alias(c) for c in ("wire", "piece", "seg", "end", "length", "x", "y", "dx", "dy")]).where("n = 1 and box is null")
    one = one.join(axes.select(key, "piece", "ax", "ay"), [key, "piece"], "left")
    along = -(F.col("dx") * F.col("ax") + F.col("dy") * F.col("ay"))
    short = (F.col("length") <= 1 << LOOK) & F.col("ax").isNotNull()
    sign = F.when(along < 0, -1.0).otherwise(1.0)
    out = lambda d, axis: F.when(short, sign * F.col(axis)).otherwise(-F.col(d))
    return one.select(key, "wire", "seg", "end", "x", "y", out("dx", "ax").alias("dx"), out("dy", "ay").alias("dy"))


def across_gaps(loose: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, a, b): ends that face each other across a gap, closest first."""
    ends = loose.select(key, F.col("seg").alias("stroke"), (F.col("end") % 2).alias("end"), "x", "y", "dx", "dy")
    return matched_ends(facing_ends(ends, (0.0, DASH_GAP), key=key), key)


def pointed_at(loose: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, end, box, x, y): the first box that an end points at within a marker's and a gap's reach, and where its straight way comes to it."""
    steps = int((ZONE + DASH_GAP) // SHORTER)
    on = loose.withColumn("t", F.explode(F.sequence(F.lit(SHORTER), F.lit(SHORTER * steps), F.lit(SHORTER))))
    on = on.withColumns({"px": F.col("x") + F.col("t") * F.col("dx"), "py": F.col("y") + F.col("t") * F.col("dy")}).withColumn("point", F.col("end") * 64 + F.floor(F.col("t") / SHORTER))
    hit = nearest_box(on.select(key, "end", "t", "px", "py", "point"), boxes, key, cutoff=2.0 * SHORTER).where("box_ord is not null")
    return hit.groupBy(key, "end").agg(F.min_by(F.struct(F.col("box_ord").alias("box"), F.col("px").alias("x"), F.col("py").alias("y")), "t").alias("h")).select(key, "end", "h.*")


def trails(pieces: DataFrame, found: DataFrame, boxes: DataFrame, reach: float, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """((key, wire, trail, box, x, y, ux, uy, lx, ly), (key, trail, gaps)): where lines that go straight on end at boxes, in which direction they leave there and by which point, and over how many gaps they go; loose ends have no box.

    ``pieces``: ``image_segments``. ``found``: the runs (piece, line, start, end) that they are of.
    A trail that is straight all along leaves along its main axis, which the outline of a
    marker beside an end can't turn.
    """
    pieces = persisted(pieces)
    at = persisted(places(pieces, boxes, reach, key))
    leaving = persisted(arms(pieces, at, key))
    loose = persisted(loose_ends(leaving, main_axes(found, [key, "piece"]), key))
    on, gaps = persisted(straight_on(leaving, key)), persisted(across_gaps(loose, key))
    seg = leaving.select(key, "e", "seg")
    link = on.join(seg.select(key, F.col("e").alias("a"), F.col("seg").alias("sa")), [key, "a"]).join(seg.select(key, F.col("e").alias("b"), F.col("seg").alias("sb")), [key, "b"]).select(key, F.col("sa").alias("a"), F.col("sb").alias("b"))
    half = lambda c: F.floor(F.col(c) / 2)
    one = persisted(components(link.unionByName(gaps.select(key, half("a").alias("a"), half("b").alias("b"))), [key]))
    of = leaving.select(key, "wire", "place", "box", "e", "end", F.col("seg").alias("id"), "x", "y", "dx", "dy", *SUMS).join(one, [key, "id"], "left").withColumn("trail", F.coalesce("component", "id"))
    of = persisted(of)
    axes = axes_of_sums(of.where("e = id"), [key, "trail"]).where((F.col("short") <= SPREAD * F.sqrt("n")) & (F.col("long") >= 4 * F.col("short")))
    used = on.select(key, F.explode(F.array("a", "b")).alias("e"))
    joined = gaps.select(key, F.explode(F.array("a", "b")).alias("end"))
    free = loose.join(joined, [key, "end"], "left_anti")
    aimed = pointed_at(free, boxes, key).select(key, "end", F.col("box").alias("to"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    ends = of.join(used, [key, "e"], "left_anti").join(joined, [key, "end"], "left_anti").join(aimed, [key, "end"], "left")
    ends = ends.join(axes.select(key, "trail", "mx", "my", "ax", "ay"), [key, "trail"], "left")
    sign = F.when(F.col("dx") * F.col("ax") + F.col("dy") * F.col("ay") < 0, -1.0).otherwise(1.0)
    place = {"x": F.coalesce("tx", "x"), "y": F.coalesce("ty", "y")}
    ends = ends.select(key, "wire", "trail", F.coalesce("box", "to").alias("box"), place["x"].alias("x"), place["y"].alias("y"), *[F.coalesce(sign * F.col(f"a{c}"), f"d{c}").alias(f"u{c}") for c in "xy"], *[F.coalesce(f"m{c}", place[c]).alias(f"l{c}") for c in "xy"])
    over = gaps.select(key, half("a").alias("id")).join(one, [key, "id"]).groupBy(key, F.col("component").alias("trail")).agg(F.count("*").alias("gaps"))
    return ends, over
