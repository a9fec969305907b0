"""Images and texts to documents."""

from pyspark.sql import functions as F

from weftgraph import schemas as S
from weftgraph.operators import assembly
from weftgraph.render import raster

BOXES = "doc_id long, ord long, kind string, x double, y double, w double, h double"
EDGES = "doc_id long, ord long, source long, target long, marker string, dashed boolean"
TEXTS = "doc_id long, x double, y double, w double, h double, text string"


def test_texts_lie_in_the_smallest_box(spark):
    boxes = spark.createDataFrame([(1, 0, "", 0.0, 0.0, 500.0, 500.0), (1, 1, "", 10.0, 10.0, 100.0, 50.0), (2, 0, "", 0.0, 0.0, 10.0, 10.0)], BOXES)
    texts = spark.createDataFrame([(1, 20.0, 20.0, 20.0, 10.0, "in"), (1, 300.0, 300.0, 20.0, 10.0, "out"), (1, 900.0, 900.0, 2.0, 2.0, "nowhere"), (1, 20.0, 20.0, 20.0, 10.0, None), (2, 90.0, 0.0, 2.0, 2.0, "beside"), (3, 0.0, 0.0, 1.0, 1.0, "no drawing")], TEXTS)
    assert sorted((r.doc_id, r.ord, r.text or "") for r in assembly.within(texts, boxes).collect()) == [(1, 0, "out"), (1, 1, ""), (1, 1, "in")]


def test_class_document_of_a_drawing(spark):
    parts = [(1, 10 * k + j, "action", x, y + top, 150.0, h) for k, (x, y) in enumerate([(0.0, 0.0), (380.0, 0.0)]) for j, (top, h) in enumerate([(0.0, 140.0), (0.0, 40.0), (37.0, 53.0)])]
    pages = raster.drawn(spark.createDataFrame(parts, BOXES), spark.createDataFrame([(1, 0, 0, 10, "triangle", True)], EDGES)).persist()
    m = raster.MARGIN
    said = [(1, m + 10.0, m + 18.0, 60.0, 12.0, "Dog"), (1, m + 10.0, m + 50.0, 60.0, 12.0, "- age: int = 3"), (1, m + 10.0, m + 105.0, 60.0, 12.0, "+ bark(loud: bool): void"), (1, m + 390.0, m + 4.0, 60.0, 10.0, "<<interface>>"), (1, m + 390.0, m + 20.0, 60.0, 10.0, "Animal"), (1, m + 390.0, m + 60.0, 60.0, 10.0, "move(): void")]
    docs = assembly.class_documents(pages, spark.createDataFrame(said, TEXTS), reach=18)
    assert docs.schema["doc"].dataType == S.schema(S.CLASS_DOC)
    (doc,) = [r.doc for r in docs.collect()]
    dog, animal = doc.classes
    assert (dog.id, dog.name, dog.kind, animal.id, animal.name, animal.kind) == ("class_1", "Dog", "class", "class_2", "Animal", "interface")
    assert [(a.name, a.datatype, a.visibility, a.default_value) for a in dog.attributes] == [("age", "int", "private", "3")]
    assert [(x.name, [(p.name, p.datatype) for p in x.parameters]) for x in dog.methods] == [("bark", [("loud", "bool")])]
    assert not animal.attributes and [x.name for x in animal.methods] == ["move"]  # a call is a method in any compartment
    assert [(r.id, r.source, r.destination, r.type, r.multiplicity.source) for r in doc.relationships] == [("rel_1", "class_1", "class_2", "realization", "1")]
    bare = assembly.class_documents(pages, spark.createDataFrame([], TEXTS), reach=18).first().doc
    assert [c.name for c in bare.classes] == ["Class1", "Class2"] and assembly.class_documents(pages.limit(0), spark.createDataFrame([], TEXTS)).count() == 0


def test_activity_of_a_drawing(spark):
    shapes = [("start", 0.0, 0.0, 40.0, 40.0), ("action", -30.0, 120.0, 100.0, 50.0), ("decision", -40.0, 260.0, 120.0, 80.0), ("action", -30.0, 430.0, 100.0, 50.0), ("end", 300.0, 280.0, 44.0, 44.0)]
    boxes = [(d, k, *s) for d in (1, 2) for k, s in enumerate(shapes) if (d, k) != (2, 0)]
    edges = [(d, k, a, b, "arrow", False) for d in (1, 2) for k, (a, b) in enumerate([(0, 1), (1, 2), (2, 3), (2, 4)])]
    pages = raster.drawn(spark.createDataFrame(boxes, BOXES), spark.createDataFrame(edges, EDGES)).persist()
    left, top = pages.where("doc_id = 1").select("left", "top").first()
    texts = spark.createDataFrame([(1, -10.0 - left, 135.0 - top, 40.0, 12.0, "read"), (1, -10.0 - left, 450.0 - top, 40.0, 12.0, "write")], TEXTS)
    nodes, links, errors = assembly.activity_graphs(pages, texts, reach=18)
    name = {r.ord: (r.type, r.label) for r in nodes.where("doc_id = 1").collect()}
    assert sorted((name[r.source], name[r.target]) for r in links.collect()) == sorted([(("start", ""), ("action", "read")), (("action", "read"), ("decision", "")), (("decision", ""), ("action", "write")), (("decision", ""), ("end", ""))])
    assert [(r.doc_id, "start" in r.error) for r in errors.collect()] == [(2, True)]
    assert nodes.where(F.col("doc_id") == 2).count() == 4
