"""The catalog, relationships, drawings and edits on small tables."""

import pytest
from pyspark.sql import functions as F

from weftgraph import schemas as S
from weftgraph.operators import catalog, edits, relate, spatial

EMPTY = '{"classes": [], "relationships": []}'
ONE = '{"classes": [{"id": "class_1", "name": "A", "position": {"x": 1.0, "y": 2.0}, "size": {"width": 3.0, "height": 4.0}}], "relationships": []}'
FLOW = '{"nodes": [{"id": "n1", "type": "start", "label": "", "position": {"x": 5.0, "y": 6.0}, "size": {"width": 7.0, "height": 8.0}}], "edges": []}'


def projects(spark, rows):
    base = spark.createDataFrame(rows, "id int, name string, project_type string, document string, activity_document string, owner_id int")
    return catalog.evolved(base, S.PROJECTS).withColumn("updated_at", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, id)"))


def test_listing(spark):
    p = projects(spark, [(k, n, "uml", EMPTY, None, 1) for k, n in enumerate(["Billing API", "Order Service", "billing ui", "100% done", "plain", "a_b"])] + [(9, "other", "uml", EMPTY, None, 2)])
    names = lambda **k: [r.name for r in catalog.listing(p, 1, **k)[0].collect()]
    assert names(search="BILL", sort="name") == ["Billing API", "billing ui"]
    assert names(search="%") == ["100% done"] and names(search="_") == ["a_b"] and names(search="  ", limit=2) == ["a_b", "plain"]
    assert names(limit=2, offset=4) == ["Order Service", "Billing API"]
    assert catalog.listing(p, 1, "bill")[1].first().total == 2
    with pytest.raises(ValueError):
        catalog.listing(p, 1, limit=101)
    with pytest.raises(catalog.NotFound):
        catalog.owned(p, 1, 9)
    with pytest.raises(catalog.NameTaken):
        catalog.check_name(p, 1, "  PLAIN ")
    catalog.check_name(p, 1, "  PLAIN ", exclude=4)
    catalog.check_name(p, 2, "plain")


def test_summaries_and_backfill(spark):
    p = projects(spark, [(1, "a", "uml", EMPTY, None, 1), (2, "b", "uml", EMPTY, FLOW, 1), (3, "c", "uml", ONE, FLOW, 1)])
    typed = catalog.backfilled_types(p)
    assert [r.project_type for r in typed.orderBy("id").collect()] == ["uml", "activity", "uml"]
    got = {r.id: r for r in catalog.summaries(typed).collect()}
    assert (got[1].class_count, got[1].node_count, got[1].class_boxes) == (0, 0, [])
    assert (got[2].node_count, tuple(got[2].class_boxes[0])) == (1, (5.0, 6.0, 7.0, 8.0))
    assert (got[3].class_count, tuple(got[3].class_boxes[0])) == (1, (1.0, 2.0, 3.0, 4.0))
    back = catalog.stored(catalog.opened(p))
    assert catalog.summaries(back).count() == 3
    changed = catalog.updated(p, spark.createDataFrame([(1, "new", None)], "id int, name string, document string"))
    assert {(r.id, r.name, r.document) for r in changed.collect()} == {(1, "new", EMPTY), (2, "b", EMPTY), (3, "c", ONE)}
    assert catalog.deleted(p, spark.createDataFrame([(2,)], "id int")).count() == 2


def test_usernames(spark):
    emails = ["sam@a.com", "sam@b.com", "x@c.com", "sam2@d.com", "SAM@e.com"]
    users = catalog.evolved(spark.createDataFrame(list(enumerate(emails)), "id int, email string"), S.USERS)
    assert [r.username for r in catalog.backfilled_usernames(users).orderBy("id").collect()] == ["sam", "sam2", "user", "sam22", "SAM3"]
    some = spark.createDataFrame([(1, "sam@x.org", None), (2, "kim@x.org", "sam"), (3, "sam@y.org", None), (4, "boss@x.org", "Boss")], "id int, email string, username string")
    assert {r.id: r.username for r in catalog.backfilled_usernames(some).collect()} == {1: "sam2", 2: "sam", 3: "sam3", 4: "Boss"}


def test_relationships(spark):
    e = spark.createDataFrame([(1, "a", "b", "association", False, 2), (1, "a", "b", "association", True, 5), (1, "a", "c", "association", False, 1)], "doc_id int, source string, destination string, type string, many boolean, ord int")
    assert [(r.id, r.destination, r.multiplicity) for r in relate.deduplicated(e).orderBy("id").collect()] == [("rel_1", "c", "1"), ("rel_2", "b", "*")]
    n = spark.createDataFrame([(1, "userName", 0), (1, "UserName", 1), (1, "username", 2), (2, "UserName", 0)], "doc_id int, name string, ord int")
    assert {(r.doc_id, r.name) for r in relate.reconciled(n).collect()} == {(1, "username"), (2, "UserName")}
    c = spark.createDataFrame([(1, "class_1", "Wheel", 0)], "doc_id int, id string, name string, ord int")
    hints = relate.hinted_types(spark.createDataFrame([(1, x) for x in ("frontWheel", "wheels", "is_open", "email", "age", "price", "foo")], "doc_id int, name string"), c)
    assert {(r.name, r.hint) for r in hints.collect()} == {("frontWheel", "Wheel"), ("wheels", "List[Wheel]"), ("is_open", "bool"), ("email", "String"), ("age", "int"), ("price", "float"), ("foo", None)}
    o = spark.createDataFrame([("a", "int"), ("a", "int"), ("b", "int"), ("b", None), ("c", "int"), ("c", "String")], "n string, datatype string")
    assert {(r.n, r.datatype) for r in relate.unanimous(o, ["n"]).collect()} == {("a", "int"), ("b", None), ("c", None)}


def test_drawings(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 100.0, 0.0, 10.0, 10.0), (1, 2, 101.0, 1.0, 10.0, 10.0)], "doc_id int, ord int, x double, y double, w double, h double")
    points = spark.createDataFrame([(1, 0, 15.0, 5.0), (1, 1, 30.0, 5.0), (1, 2, 105.0, 5.0), (2, 3, 0.0, 0.0)], "doc_id int, point int, px double, py double")
    assert {(r.point, r.box_ord) for r in spatial.nearest_box(points, boxes).collect()} == {(0, 0), (1, None), (2, 1), (3, None)}
    assert [r.ord for r in spatial.without_overlaps(boxes).orderBy("ord").collect()] == [0, 1]
    lines = spark.createDataFrame([(1, 0, 5.0, 5.0, 105.0, 5.0), (1, 1, 5.0, 5.0, 6.0, 6.0)], "doc_id int, ord int, x1 double, y1 double, x2 double, y2 double")
    assert [(r.ord, r.source, r.target) for r in spatial.adjacency(lines, boxes).collect()] == [(0, 0, 1)]


def test_nearest_box_meets_once_a_place(spark):
    from pyspark.sql import functions as F

    boxes = spark.range(20_000).select(F.lit(1).alias("doc_id"), (20_000 - F.col("id")).alias("ord"), (F.col("id") % 2 * 50.0).alias("x"), F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    points = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("point"), (F.col("id") % 3 * 30.0).alias("px"), F.lit(5.0).alias("py"))
    # at 30 both boxes are 20 away: the lowest ord, but 20 is not nearer than a cutoff or a width + height of 20
    for cutoff, middle in ((None, None), (21.0, 1), (20.0, None)):
        best = spatial.nearest_box(points, boxes, cutoff=cutoff)  # 400 million pairs of points and boxes
        assert {(r.px, r.box_ord, r.n) for r in best.groupBy("px", "box_ord").agg(F.count("*").alias("n")).collect()} == {(0.0, 2, 6667), (30.0, middle, 6667), (60.0, 1, 6666)}
    # squares are equal where roots are rounded apart
    two = spark.createDataFrame([(1, k, float(x), float(y), 1.0, 1.0) for k, (x, y) in enumerate([(5, 5), (1, 7), (7, 1)])], "doc_id int, ord int, x double, y double, w double, h double")
    origin = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, None, 0.0)], "doc_id int, point int, px double, py double")
    assert {(r.point, r.box_ord) for r in spatial.nearest_box(origin, two, cutoff=9.0).collect()} == {(0, 0), (1, None)}


def test_nearest_of_all_boxes_however_far(spark, tmp_path):
    import random

    from weftgraph.plans.more import nearest_of_all_boxes

    # boxes at (63, 161) and (72, 184) of 40 x 24: the points are further than width + height off, but for one; no box in drawing 2
    spark.createDataFrame([(1, 8), (1, 7)], "s_nationkey int, s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 1), (1, 250), (1, 200), (1, 100), (2, 1)], "c_nationkey int, c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert {(r.doc_id, r.point, r.box_ord) for r in nearest_of_all_boxes(spark, str(tmp_path)).collect()} == {(1, 1, 7), (1, 250, 8), (1, 200, 8), (1, 100, 7), (2, 1, None)}

    # all drawings against all pairs: whole numbers tie, shapes of no size, one wide box among small ones, drawings of one box, negative and distant places
    rnd, boxes, points = random.Random(5), [], []
    for doc, (n, area, size) in enumerate([(1, 10, 5), (30, 100, 20), (30, 100, 0), (40, 10_000, 9), (0, 10, 1), (5, 10**9, 30)]):
        boxes += [(doc, doc * 100 + k, float(rnd.randint(-area, area // 4)), float(rnd.randint(-area, area)), *((900.0, 700.0) if doc == 3 and k == 0 else (float(size), float(size) / 2))) for k in range(n)]
        points += [(doc, k, float(f * rnd.randint(-area, area)), f * rnd.uniform(-area, area) if doc % 2 else float(f * rnd.randint(-area, area))) for k in range(60) for f in [rnd.choice([1, 1, 20])]]
    points += [(1, 60, None, 0.0), (1, 61, *points[60][2:])]
    rnd.shuffle(boxes)

    def nearest(doc, px, py):
        at = [((px - max(x, min(px, x + w))) ** 2 + (py - max(y, min(py, y + h))) ** 2, k) for d, k, x, y, w, h in boxes if d == doc and px is not None]
        return min(at)[1] if at else None

    found = spatial.nearest_of_all(spark.createDataFrame(points, "doc_id int, point int, px double, py double"), spark.createDataFrame(boxes, "doc_id int, ord int, x double, y double, w double, h double")).collect()
    assert len(found) == len(points) and {(r.doc_id, r.point, r.box_ord) for r in found} == {(doc, k, nearest(doc, px, py)) for doc, k, px, py in points}


def test_edits(spark):
    rows = spark.createDataFrame([(1, "n1", "start", 0, (0.0, 0.0)), (1, "n7", "action", 1, (1.0, 1.0)), (1, "zz", "action", 2, (2.0, 2.0))], "doc_id int, id string, type string, ord int, position struct<x:double,y:double>")
    assert edits.next_number(rows, "n").first()["next"] == 8
    got = edits.duplicated(rows, rows.select("doc_id", "id"), "n").orderBy("ord").collect()
    assert [(r.id, r.position.x) for r in got[3:]] == [("n8", 33.0), ("n9", 34.0)]
    e = spark.createDataFrame([(1, "n1", "n7")], "doc_id int, source string, target string")
    want = spark.createDataFrame([(1, "n1", "n7"), (1, "n7", "n7"), (1, "n7", "zz"), (1, "n7", "zz")], "doc_id int, source string, target string")
    assert [(r.source, r.target) for r in edits.new_edges(e, want).collect()] == [("n7", "zz")]
    left, kept = edits.delete_with_edges(rows, e, spark.createDataFrame([(1, "n7")], "doc_id int, id string"), ("source", "target"))
    assert left.count() == 2 and kept.count() == 0
