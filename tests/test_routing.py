import heapq
import random

from pyspark.sql import functions as F

from weftgraph.operators import relate, routing
from weftgraph.operators.edits import coalesced
from weftgraph.streaming.edits import edit_sessions


def test_route():
    used = set()
    box = [{"x": 40.0, "y": -40.0, "w": 40.0, "h": 80.0}]
    path = routing.route(routing.Walls(box), (0.0, 0.0), (120.0, 0.0), used)
    assert path[0] == (0.0, 0.0) and path[-1] == (120.0, 0.0) and len(path) >= 4
    for (x1, y1), (x2, y2) in zip(path, path[1:], strict=False):
        assert x1 == x2 or y1 == y2
        assert not (y1 == y2 and -40 < y1 < 40 and min(x1, x2) < 80 and max(x1, x2) > 40)
    assert routing.route(set(), (0.0, 0.0), (50.0, 0.0), set()) == [(0.0, 0.0), (50.0, 0.0)]


def test_routed(spark):
    d = {"boxes": [{"x": 40.0, "y": -40.0, "w": 40.0, "h": 80.0}], "requests": [{"edge": 1, "x1": 0.0, "y1": 0.0, "x2": 120.0, "y2": 0.0}]}
    docs = spark.createDataFrame([(1, d)], "doc_id long, doc struct<boxes:array<struct<x:double,y:double,w:double,h:double>>,requests:array<struct<edge:long,x1:double,y1:double,x2:double,y2:double>>>")
    assert len(routing.routed(docs).first().points) >= 4


def plain_cost(blocked, start, goal, area):
    """Dijkstra over (cell, direction)."""
    best, queue = {}, [(0, start, None)]
    while queue:
        cost, here, way = heapq.heappop(queue)
        if best.setdefault((here, way), cost) < cost:
            continue
        if here == goal:
            return cost
        for step in ((1, 0), (0, 1), (-1, 0), (0, -1)):
            to = here[0] + step[0], here[1] + step[1]
            if (to not in blocked or to == goal) and area[0] <= to[0] <= area[2] and area[1] <= to[1] <= area[3] and (to, step) not in best:
                heapq.heappush(queue, (cost + 1 + (6 if way not in (None, step) else 0), to, step))
    return None


def test_routes_are_as_cheap_as_brute_force():
    rng, area, missing = random.Random(4), (0, 0, 9, 9), 0
    for _ in range(60):
        blocked = {(rng.randrange(10), rng.randrange(10)) for _ in range(35)}
        a, b = ((rng.randrange(10), rng.randrange(10)) for _ in range(2))
        got, want = routing.route(blocked, (a[0] * 10.0, a[1] * 10.0), (b[0] * 10.0, b[1] * 10.0), set(), area), plain_cost(blocked, a, b, area)
        assert (got is None) == (want is None)
        if want is None:
            missing += 1
            continue
        steps = [(q[0] - p[0], q[1] - p[1]) for p, q in zip(got, got[1:], strict=False) if p != q]
        assert sum(abs(x) + abs(y) for x, y in steps) / 10 + 6 * max(0, len(steps) - 1) == want
    assert missing


def test_routed_edges(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 60.0), (1, 1, 400.0, 0.0, 100.0, 60.0), (1, 2, 200.0, -40.0, 80.0, 140.0), (1, 3, None, 0.0, 1.0, 1.0)], "doc_id long, ord long, x double, y double, w double, h double")
    edges = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 0, 1), (1, 2, 2, 2), (1, 3, 0, 3), (1, 4, 0, 9), (2, 0, 0, 1)], "doc_id long, edge long, source long, target long")
    got = {(r.doc_id, r.edge): [(p.x, p.y) for p in r.points] for r in routing.routed_edges(edges, boxes).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2)}
    assert got[1, 2] == [(280.0, 0.0), (320.0, 0.0), (320.0, 70.0), (280.0, 70.0)]  # -5 goes up to 0, 65 to 70
    assert got[1, 0][0] == (100.0, 20.0) and got[1, 1][0] == (100.0, 40.0) and got[1, 0][-1] == (400.0, 20.0)
    cells = []
    for k in (0, 1):
        way, seen = got[1, k], set()
        for (x1, y1), (x2, y2) in zip(way, way[1:], strict=False):
            assert x1 == x2 or y1 == y2
            n = int(max(abs(x2 - x1), abs(y2 - y1)) / 10)
            for i in range(n + 1):
                x, y = x1 + (x2 - x1) * i / n, y1 + (y2 - y1) * i / n
                assert not (184 < x < 296 and -56 < y < 116), way  # 16 away from the box between
                seen.add((x, y))
        cells.append(seen)
    assert len(cells[0] & cells[1]) <= 4  # the second avoids the first
    wide = boxes.where("ord = 0").unionByName(boxes.where("ord = 1").withColumn("x", F.lit(1e8)))
    assert [(r.edge, len(r.points)) for r in routing.routed_edges(edges, wide).orderBy("edge").collect()] == [(0, 2), (1, 2)]  # too large to search
    assert {r.side for r in routing.terminals(edges, boxes).collect()} == {"left", "right"}


def test_strokes(spark):
    ends = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, -1.0, 0.0), (1, 0, 1, 10.0, 0.0, 1.0, 0.0), (1, 1, 0, 20.0, 0.0, -1.0, 0.0), (1, 1, 1, 30.0, 0.0, 1.0, 0.0), (1, 2, 0, 25.0, 1.0, -1.0, 0.0), (1, 2, 1, 60.0, 1.0, 1.0, 0.0)], "doc_id long, stroke long, end long, x double, y double, dx double, dy double")
    met = routing.facing_ends(ends)
    assert [(r.a, r.b) for r in routing.matched_ends(met).collect()] == [(1, 2)]
    links = spark.createDataFrame([(1, 5, 4), (1, 4, 3), (1, 9, 8), (2, 3, 4)], "doc_id long, a long, b long")
    assert {(r.doc_id, r.id, r.component) for r in routing.components(links).collect()} == {(1, 3, 3), (1, 4, 3), (1, 5, 3), (1, 8, 8), (1, 9, 8), (2, 3, 3), (2, 4, 3)}
    pieces = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 5.0), (1, 1, 12.0, 0.0, 10.0, 5.0), (1, 2, 200.0, 0.0, 5.0, 5.0)], "doc_id long, ord long, x double, y double, w double, h double")
    points = spark.createDataFrame([(1, 0, 30.0, 2.0), (1, 1, 100.0, 100.0)], "doc_id long, point long, px double, py double")
    assert [(r.point, r.x, r.w) for r in routing.label_clusters(pieces, points).collect()] == [(0, 0.0, 22.0)]


def test_lines_of_boxes(spark):
    lines = spark.createDataFrame([(1, "class_1", "attributes", 0, "+ a : int"), (1, "class_1", "methods", 1, "run()"), (1, "class_1", "methods", 2, "noise"), (1, "class_1", "attributes", 3, "go() : bool")], "doc_id int, id string, compartment string, ord int, line string")
    r = relate.members_of_lines(lines).first()
    assert [a.name for a in r.attributes] == ["a"] and [m.name for m in r.methods] == ["run", "go"]


def test_edit_runs_in_batch_and_stream(spark, tmp_path):
    rows = spark.sql("SELECT 1L AS doc_id, id AS edit_id, 'move' AS edit, timestamp_micros(id * 100000 + IF(id > 5, 2000000, 0)) AS ts FROM range(10)")
    assert [(r.entry, r.n) for r in coalesced(rows).orderBy("entry").collect()] == [(1, 6), (2, 4)]
    rows.write.parquet(str(tmp_path / "in"))
    stream = edit_sessions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("edit_sessions").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("edit_sessions").collect()) == [4, 6]


def least_cost(blocked, start, goal, used, area):
    """Dijkstra over (cell, direction) by the definition: a step costs 1, a turn TURN more, a cell in use SHARED more."""
    import heapq

    best, queue = {}, [(0, start, None)]
    while queue:
        cost, at, way = heapq.heappop(queue)
        if (at, way) in best:
            continue
        best[at, way] = cost
        if at == goal:
            return cost
        for step in ((1, 0), (0, 1), (-1, 0), (0, -1)):
            to = at[0] + step[0], at[1] + step[1]
            if area[0] <= to[0] <= area[2] and area[1] <= to[1] <= area[3] and (to not in blocked or to == goal):
                heapq.heappush(queue, (cost + 1 + (routing.TURN if way not in (None, step) else 0) + (routing.SHARED if to in used else 0), to, step))
    return None


def test_routes_have_the_least_cost():
    import random

    rng = random.Random(12)
    found = 0
    for _ in range(150):
        blocked = {(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(60))}
        used = {(rng.randrange(12), rng.randrange(12)) for _ in range(rng.randrange(40))}
        a, b, area = (rng.randrange(12), rng.randrange(12)), (rng.randrange(12), rng.randrange(12)), (0, 0, 11, 11)
        want, taken = least_cost(blocked, a, b, used, area), set(used)
        path = routing.route(blocked, (a[0] * 10.0, a[1] * 10.0), (b[0] * 10.0, b[1] * 10.0), taken, area)
        assert (path is None) == (want is None)
        if path is None or a == b:
            continue
        cells, way, cost = [tuple(round(v / 10) for v in p) for p in path], None, 0
        for p, q in zip(cells, cells[1:], strict=False):
            step = ((q[0] > p[0]) - (q[0] < p[0]), (q[1] > p[1]) - (q[1] < p[1]))
            while p != q:
                p = p[0] + step[0], p[1] + step[1]
                assert p not in blocked or p == b
                cost += 1 + (routing.TURN if way not in (None, step) else 0) + (routing.SHARED if p in used else 0)
                way = step
        assert cost == want
        found += 1
    assert found > 50


def test_a_wide_drawing_is_routed(spark):
    """5,000,000 cells, most of them empty: the route goes round the box between."""
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 60.0), (1, 1, 900.0, 0.0, 100.0, 60.0), (1, 2, 400.0, -40.0, 80.0, 140.0), (1, 3, 22_000.0, 22_000.0, 50.0, 50.0), (1, 4, 5_000.0, 3_000.0, 9_000.0, 9_000.0)], "doc_id long, ord long, x double, y double, w double, h double")
    edges = spark.createDataFrame([(1, 0, 0, 1)], "doc_id long, edge long, source long, target long")
    (way,) = [[(p.x, p.y) for p in r.points] for r in routing.routed_edges(edges, boxes).collect()]
    assert len(way) > 2 and all(a[0] == b[0] or a[1] == b[1] for a, b in zip(way, way[1:], strict=False))
    blocked = routing.Walls([{"x": 5_000.0, "y": 3_000.0, "w": 9_000.0, "h": 9_000.0}, {"x": 0.0, "y": 0.0, "w": 30.0, "h": 30.0}])
    assert (600, 400) in blocked and (1, 1) in blocked and (500, 400) not in blocked and (3, 1) not in blocked
