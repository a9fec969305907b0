"""Orthogonal edge routing and stroke pairing.

Where edges leave boxes is joins, windows and column arithmetic; only the search,
in which later edges avoid earlier ones, is sequential work on one drawing at a time.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.geometry import anchor, snap
from weftgraph.operators import spatial
from weftgraph.sources.scratch import persisted

# Fixed values of the router: grid, costs of a turn and of a cell that another edge uses, and how far a search may go.
CELL, TURN, SHARED, MOST = 10, 6, 4, 80_000
# Fixed values. Room kept round boxes, straight ends before the first turn, room searched beyond everything, width of an edge to its own box.
PADDING, STUB, MARGIN, LOOP = 16, 20, 120, 40
_STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


class Walls:
    """The cells strictly inside boxes that are each grown by ``pad``; boxes are kept by coarse squares, so a drawing costs its boxes and not its area."""

    SQUARE, WIDE = 64, 256

    def __init__(self, boxes: list[dict], pad: float = 0):
        within = lambda low, size: (math.floor((low - pad) / CELL) + 1, math.ceil((low + size + pad) / CELL))
        self.squares: dict[tuple[int, int], list[tuple]] = {}
        self.wide: list[tuple] = []
        for r in boxes:
            (left, right), (top, bottom) = within(r["x"], r["w"]), within(r["y"], r["h"])
            across, down = range(left // self.SQUARE, (right - 1) // self.SQUARE + 1), range(top // self.SQUARE, (bottom - 1) // self.SQUARE + 1)
            if len(across) * len(down) > self.WIDE:
                self.wide.append((left, right, top, bottom))
                continue
            for x in across:
                for y in down:
                    self.squares.setdefault((x, y), []).append((left, right, top, bottom))

    def __contains__(self, cell: tuple[int, int]) -> bool:
        x, y = cell
        near = self.squares.get((x // self.SQUARE, y // self.SQUARE), ())
        return any(a <= x < b and c <= y < d for a, b, c, d in (*near, *self.wide))


def route(blocked: Walls | set[tuple[int, int]], start: tuple[float, float], goal: tuple[float, float], used: set[tuple[int, int]], area: tuple[int, int, int, int] | None = None) -> list[tuple[float, float]] | None:
    """A path of right angles round blocked cells, by A* on a grid, inside an area (left, top, right, bottom in cells); None if there is none or the search is too long."""
    cell = lambda p: (round(p[0] / CELL), round(p[1] / CELL))
    a, b = cell(start), cell(goal)
    far = lambda c: abs(c[0] - b[0]) + abs(c[1] - b[1])
    best, came, queue, taken = {(a, -1): 0}, {}, [(far(a), 0, a, -1)], 0
    while queue and taken < MOST:
        _, cost, here, way = heapq.heappop(queue)
        if cost > best[here, way]:
            continue
        if here == b:
            path, at = [here], (here, way)
            while at in came:
                at = came[at]
                path.append(at[0])
            path.reverse()
            used.update(path)
            corners = [path[0], *[q for p, q, r in zip(path, path[1:], path[2:], strict=False) if (q[0] - p[0], q[1] - p[1]) != (r[0] - q[0], r[1] - q[1])], path[-1]]
            return [start, *[(x * CELL, y * CELL) for x, y in corners[1:-1]], goal]
        taken += 1
        for k, (dx, dy) in enumerate(_STEPS):
            to = here[0] + dx, here[1] + dy
            if to in blocked and to != b or area and not (area[0] <= to[0] <= area[2] and area[1] <= to[1] <= area[3]):
                continue
            price = cost + 1 + (TURN if way not in (-1, k) else 0) + (SHARED if to in used else 0)
            if price < best.get((to, k), math.inf):
                best[to, k] = price
                came[to, k] = (here, way)
                heapq.heappush(queue, (price + far(to), price, to, k))
    return None


def routed(drawings: DataFrame, key_type: str = "long") -> DataFrame:
    """(doc_id, error, edge, points) for drawings with boxes (x, y, w, h) and requests (edge, x1, y1, x2, y2); later edges avoid earlier ones."""
    from weftgraph.operators.flow import per_document

    def work(d: dict) -> list[dict]:
        used: set[tuple[int, int]] = set()
        blocked, out = Walls(d["boxes"]), []
        for r in d["requests"]:
            start, goal = (r["x1"], r["y1"]), (r["x2"], r["y2"])
            points = route(blocked, start, goal, used) or [start, goal]
            out.append({"edge": r["edge"], "points": [{"x": float(x), "y": float(y)} for x, y in points]})
        return out

    return per_document(drawings, work, f"doc_id {key_type}, error string, edge long, points array<struct<x:double,y:double>>")


def facing_side(x: Column, y: Column, w: Column, h: Column, ox: Column, oy: Column, ow: Column, oh: Column) -> Column:
    """The side of a box that faces another: by the wider gap between them, or between centres if they overlap in both directions."""
    across, down = F.greatest(ox - x - w, x - ox - ow), F.greatest(oy - y - h, y - oy - oh)
    right, below = ox + ow / 2 - x - w / 2, oy + oh / 2 - y - h / 2
    beside = F.when(F.greatest(across, down) > 0, (across > 0) & (across >= down)).otherwise(F.abs(right) >= F.abs(below))
    return F.when(beside, F.when(right >= 0, "right").otherwise("left")).otherwise(F.when(below >= 0, "bottom").otherwise("top"))


def terminals(edges: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, edge, end, side, px, py, sx, sy, ax, ay): where each edge (edge, source, target) meets its two boxes (ord, x, y, w, h).

    Edges at one side are spread along it. (sx, sy) is the end of the straight
    piece before the first turn, (ax, ay) where a straight line would leave.
    Edges to the same box, or without both boxes, have no terminals.
    """
    boxes = boxes.where("x is not null and y is not null and w is not null and h is not null")
    rect = lambda p, name: boxes.select(key, F.col("ord").alias(name), *[F.col(c).cast("double").alias(p + c) for c in "xywh"])
    met = edges.where("source != target").select(key, "edge", "source", "target").join(rect("", "source"), [key, "source"]).join(rect("o", "target"), [key, "target"])
    there = met.select(key, "edge", F.lit(0).alias("end"), F.col("source").alias("box"), "x", "y", "w", "h", "ox", "oy", "ow", "oh")
    back = met.select(key, "edge", F.lit(1).alias("end"), F.col("target").alias("box"), *[F.col("o" + c).alias(c) for c in "xywh"], *[F.col(c).alias("o" + c) for c in "xywh"])
    ends = there.unionByName(back).withColumn("side", facing_side(*map(F.col, ("x", "y", "w", "h", "ox", "oy", "ow", "oh"))))
    upright = F.col("side").isin("left", "right")
    ends = ends.withColumn("other_centre", F.when(upright, F.col("oy") + F.col("oh") / 2).otherwise(F.col("ox") + F.col("ow") / 2))
    ends = spatial.ports(ends, key)
    along = lambda low, size: snap(F.col(low) + F.col(size) * F.col("fraction"), CELL)
    px = F.when(upright, F.col("x") + F.when(F.col("side") == "right", F.col("w")).otherwise(0)).otherwise(along("x", "w"))
    py = F.when(upright, along("y", "h")).otherwise(F.col("y") + F.when(F.col("side") == "bottom", F.col("h")).otherwise(0))
    ends = ends.withColumns({"px": px.cast("double"), "py": py.cast("double")})
    out = lambda p, low, high: F.when(F.col("side") == high, F.ceil((F.col(p) + STUB) / CELL) * CELL).when(F.col("side") == low, F.floor((F.col(p) - STUB) / CELL) * CELL).otherwise(F.col(p)).cast("double")
    straight = anchor("rect", F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("w"), F.col("h"), F.col("ox") + F.col("ow") / 2, F.col("oy") + F.col("oh") / 2)
    return ends.select(key, "edge", "end", "side", "px", "py", out("px", "left", "right").alias("sx"), out("py", "top", "bottom").alias("sy"), straight["x"].alias("ax"), straight["y"].alias("ay"))


def self_loops(edges: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, edge, points) of edges from a box to itself: out of its right side at a quarter of the height, back at three quarters."""
    met = edges.where("source = target").select(key, "edge", F.col("source").alias("ord")).join(boxes.select(key, "ord", "x", "y", "w", "h"), [key, "ord"])
    right = (F.col("x") + F.col("w")).cast("double")
    at = lambda part: snap(F.col("y") + F.col("h") * part, CELL).cast("double")
    points = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((right, at(0.25)), (right + LOOP, at(0.25)), (right + LOOP, at(0.75)), (right, at(0.75)))])
    return met.select(key, "edge", points.alias("points"))


def routed_edges(edges: DataFrame, boxes: DataFrame, key: str = "doc_id", key_type: str = "long") -> DataFrame:
    """(key, edge, points) of edges (edge, source, target) between boxes (ord, x, y, w, h), by number of the edge.

    Routes keep PADDING away from all boxes but at their ends; where no route is
    found the edge is a straight line between the boxes.
    """
    from weftgraph.operators.flow import per_document

    places = boxes.where("x is not null and y is not null and w is not null and h is not null")
    names = ("px", "py", "sx", "sy", "ax", "ay")
    at = terminals(edges, places, key).groupBy(key, "edge").agg(*[F.max(F.when(F.col("end") == k, F.struct(*names))).alias(n) for k, n in ((0, "a"), (1, "b"))])
    of = places.groupBy(key).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in "xywh"])).alias("boxes"))
    docs = at.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("edge", "a", "b"))).alias("requests")).join(of, key).select(key, F.struct("boxes", "requests").alias("doc"))

    def work(d: dict) -> list[dict]:
        used: set[tuple[int, int]] = set()
        ends, span, out = [r[e] for r in d["requests"] for e in "ab"], [], []
        for c, size in (("x", "w"), ("y", "h")):
            found = [b[c] for b in d["boxes"]] + [b[c] + b[size] for b in d["boxes"]] + [e[p + c] for e in ends for p in "ps"]
            span.append((math.floor((min(found) - MARGIN) / CELL), math.ceil((max(found) + MARGIN) / CELL)))
        area = span[0][0], span[1][0], span[0][1], span[1][1]
        blocked = Walls(d["boxes"], PADDING)
        for r in d["requests"]:
            a, b = r["a"], r["b"]
            way = route(blocked, (a["sx"], a["sy"]), (b["sx"], b["sy"]), used, area)
            if way is None:
                points = [(a["ax"], a["ay"]), (b["ax"], b["ay"])]
            else:
                points = [(a["px"], a["py"]), *way, (b["px"], b["py"])]
                points = [p for k, p in enumerate(points) if not k or p != points[k - 1]]
                inner = [q for p, q, n in zip(points, points[1:], points[2:], strict=False) if not (p[0] == q[0] == n[0] or p[1] == q[1] == n[1])]
                points = [points[0], *inner, points[-1]]
            out.append({"edge": r["edge"], "points": [{"x": float(x), "y": float(y)} for x, y in points]})
        return out

    schema = f"{key} {key_type}, error string, edge long, points array<struct<x:double,y:double>>"
    return per_document(docs, work, schema, key).select(key, "edge", "points").unionByName(self_loops(edges, places, key))


def greedy_pairs(pairs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Candidate pairs (distance, end, end) taken closest first, each end once."""
    out, taken = [], set()
    for _, a, b in sorted(pairs):
        if not {a, b} & taken:
            taken |= {a, b}
            out.append((a, b))
    return out


def facing_ends(ends: DataFrame, gap: tuple[float, float] = (0.0, 40.0), most_angle: float = 0.5, key: str = "doc_id") -> DataFrame:
    """Pairs of stroke ends (stroke, end, x, y, dx, dy; the unit direction points out) that face each other within a gap: (doc_id, a, b, d)."""
    cell = max(gap[1], 1.0)
    e = ends.withColumn("id", F.col("stroke") * 2 + F.col("end")).withColumns({"cx": F.floor(F.col("x") / cell), "cy": F.floor(F.col("y") / cell)})
    near = e.withColumn("cx", F.explode(F.array(*[F.col("cx") + k for k in (-1, 0, 1)]))).withColumn("cy", F.explode(F.array(*[F.col("cy") + k for k in (-1, 0, 1)])))
    b = near.select(key, "cx", "cy", *[F.col(c).alias(f"b_{c}") for c in ("id", "stroke", "x", "y", "dx", "dy")])
    vx, vy = F.col("b_x") - F.col("x"), F.col("b_y") - F.col("y")
    met = e.join(b, [key, "cx", "cy"]).where("stroke < b_stroke").withColumn("d", F.hypot(vx, vy)).where(F.col("d").between(*gap))
    cos = math.cos(most_angle)
    ahead = (F.col("d") == 0) | ((vx * F.col("dx") + vy * F.col("dy") >= cos * F.col("d")) & (-vx * F.col("b_dx") - vy * F.col("b_dy") >= cos * F.col("d")))
    return met.where(ahead).select(key, F.col("id").alias("a"), F.col("b_id").alias("b"), "d")


def matched_ends(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, a, b): the greedy matching within each drawing.

    A pair that is the smallest (d, a, b) at both of its ends is one that the greedy
    order takes whatever else is taken, so each round takes all of these and drops what
    they touch, until no pair is left.
    """
    left = persisted(candidates.where("a != b and d is not null").groupBy(key, "a", "b").agg(F.min("d").alias("d")))
    taken = left.select(key, "a", "b").limit(0)
    while True:
        ends = left.select(key, F.explode(F.array("a", "b")).alias("id"), F.struct("d", "a", "b").alias("p"))
        least = ends.groupBy(key, "id").agg(F.min("p").alias("p"))
        chosen = persisted(least.groupBy(key, "p").count().where("count = 2").select(key, "p.a", "p.b"))
        if chosen.isEmpty():
            return taken
        taken = taken.unionByName(chosen)
        used = persisted(chosen.select(key, F.explode(F.array("a", "b")).alias("id")))
        for end in ("a", "b"):
            left = left.join(used.withColumnRenamed("id", end), [key, end], "left_anti")
        left = persisted(left)


def components(links: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """(key, id, component): the smallest id that links (key, a, b) lead to; smallest labels spread and chains halve each round."""
    key = list(key)
    both = persisted(links.select(*key, F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(*key, F.col("b").alias("id"), F.col("a").alias("other"))).distinct())
    label = persisted(both.groupBy(*key, "id").agg(F.least(F.min("other"), F.min("id")).alias("component")))
    while True:
        near = both.join(label.select(*key, F.col("id").alias("other"), "component"), [*key, "other"]).groupBy(*key, "id").agg(F.min("component").alias("near"))
        step = persisted(label.join(near, [*key, "id"]).select(*key, "id", "component", F.least("component", "near").alias("next")))
        jump = step.select(*key, F.col("id").alias("next"), F.col("next").alias("jump"))
        new = persisted(step.join(jump, [*key, "next"]).select(*key, "id", F.col("component").alias("before"), F.least("next", "jump").alias("component")))
        label = new.drop("before")
        if new.where("before != component").isEmpty():
            return label


def label_clusters(pieces: DataFrame, points: DataFrame, reach: float = 36.0, grow: float = 5.0, key: str = "doc_id") -> DataFrame:
    """For each point (point, px, py) the bounds of the text cluster nearest to it within reach; pieces (ord, x, y, w, h) that nearly touch are one cluster."""
    from weftgraph.operators.spatial import nearest_box, overlaps

    grown = pieces.select(key, "ord", *[(F.col(c) - grow / 2).alias(c) for c in ("x", "y")], *[(F.col(c) + grow).alias(c) for c in ("w", "h")])
    joined = components(overlaps(grown, key).select(key, F.col("i").alias("a"), F.col("j").alias("b")), [key])
    of = pieces.join(joined.withColumnRenamed("id", "ord"), [key, "ord"], "left").withColumn("cluster", F.coalesce("component", "ord"))
    bounds = of.groupBy(key, "cluster").agg(F.min("x").alias("bx"), F.min("y").alias("by"), F.max(F.col("x") + F.col("w")).alias("ex"), F.max(F.col("y") + F.col("h")).alias("ey"))
    found = nearest_box(points, pieces, key, cutoff=reach).join(of.select(key, F.col("ord").alias("box_ord"), "cluster"), [key, "box_ord"])
    return found.join(bounds, [key, "cluster"]).select(key, "point", F.col("bx").alias("x"), F.col("by").alias("y"), (F.col("ex") - F.col("bx")).alias("w"), (F.col("ey") - F.col("by")).alias("h"))
