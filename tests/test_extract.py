"""Class models and flows from Python sources, and diagrams and code from models."""

import ast

from pyspark.sql import functions as F

from weftgraph import schemas as S
from weftgraph.extract import python_source as P
from weftgraph.extract import tables
from weftgraph.operators import relate, validate
from weftgraph.render import codegen, mermaid

SHOP = '''
from typing import Final, List
class Engine: pass
class Wheel: pass
class Person:
    def __init__(self, name: str, age=3):
        self.name = name
        self._age = age
class Car:
    LIMIT: Final[int] = 5
    def __init__(self, owner: Person, wheels: List[Wheel]):
        self.owner = owner
        self.wheels = wheels
        self.engine = Engine()
        self.__secret = None
        self.trips = []
    @staticmethod
    def make(): return Car(None, [])
    def add(self, trip: "Trip"):
        self.trips.append(trip)
    def ratio(self, a: int, b: int): return a / b
class Trip: pass
class Mechanic:
    def repair(self, car: Car) -> Car: return car
'''


def test_model():
    d = P.parse(SHOP)
    car = next(c for c in d["classes"] if c["name"] == "Car")
    attrs = {a["name"]: a for a in car["attributes"]}
    assert attrs["LIMIT"] == {"name": "LIMIT", "datatype": "int", "visibility": "public", "default_value": "5", "static": True, "final": True}
    assert (attrs["__secret"]["visibility"], attrs["trips"]["datatype"], attrs["engine"]["datatype"], attrs["wheels"]["datatype"]) == ("private", "List[Trip]", "Engine", "List[Wheel]")
    assert [(m["name"], m["static"], m["return_type"]) for m in car["methods"]] == [("make", True, "Car"), ("add", False, "void"), ("ratio", False, "float")]
    names = {c["id"]: c["name"] for c in d["classes"]}
    got = {(names[r["source"]], names[r["destination"]], r["type"], r["multiplicity"]["destination"]) for r in d["relationships"]}
    assert got == {("Car", "Person", "association", "1"), ("Car", "Wheel", "aggregation", "*"), ("Car", "Engine", "composition", "1"), ("Car", "Trip", "aggregation", "*"), ("Mechanic", "Car", "dependency", "1")}
    person = next(c for c in d["classes"] if c["name"] == "Person")
    assert [(a["name"], a["datatype"], a["visibility"]) for a in person["attributes"]] == [("name", "String", "public"), ("_age", "int", "protected")]


def test_kinds_and_bases():
    d = P.parse("from abc import ABC, abstractmethod\nclass Shape(ABC):\n    @abstractmethod\n    def area(self): ...\nclass Base(ABC):\n    x = 1\n    def f(self): raise NotImplementedError\nclass Sq(Shape, Base, Other): pass\n")
    assert [c["kind"] for c in d["classes"]] == ["interface", "abstract", "class"]
    assert [(r["source"], r["destination"], r["type"]) for r in d["relationships"]] == [("class_3", "class_1", "realization"), ("class_3", "class_2", "inheritance")]


def _flow(body: str) -> dict:
    return P.control_flow("class A:\n    def m(self):\n" + "\n".join("        " + x for x in body.split("\n")), "A", "m")


def test_flows():
    d = _flow("y = x + 1\nz = y * 2\nreturn z")
    assert [(n["type"], n["label"]) for n in d["nodes"]] == [("start", ""), ("end", ""), ("action", "Calculate y; Calculate z; Return z")]
    assert [(e["source"], e["target"]) for e in d["edges"]] == [("n1", "n3"), ("n3", "n2")]
    assert [n["label"] for n in _flow("pass")["nodes"]][2:] == ["Do nothing"]
    d = _flow("while n > 0:\n    n -= 1")
    assert [(e["source"], e["target"], e["label"]) for e in d["edges"]] == [("n1", "n3", ""), ("n3", "n4", "yes"), ("n4", "n3", ""), ("n3", "n2", "no")]
    d = _flow("try:\n    a()\nexcept ValueError:\n    b()\nfinally:\n    c()")
    assert [n["label"] for n in d["nodes"]][2:] == ["except ValueError?", "B", "A", "finally", "C"]


def test_tables_and_rendering(spark):
    rows = [(1, "python", SHOP), (2, "python", "class ("), (3, "python", " "), (4, "cobol", "x")]
    sources = spark.createDataFrame(rows, "doc_id long, language string, source string")
    docs = tables.class_documents(sources).cache()
    got = {r.doc_id: r for r in docs.collect()}
    assert got[1].error is None and all(got[k].error for k in (2, 3, 4))
    flows = tables.method_flows(sources).collect()
    assert {(r.class_name, r.method_name) for r in flows if r.doc_id == 1} == {("Car", "make"), ("Car", "add"), ("Car", "ratio"), ("Mechanic", "repair")}
    good = docs.where("error is null")
    text = good.select(mermaid.class_diagram(F.col("doc"))).first()[0]
    assert '    Car "1" o-- "*" Wheel' in text and "        +ratio(a: int, b: int) float" in text and "    Mechanic ..> Car" in text
    assert validate.class_violations(good).count() == 0
    for language in codegen.LANGUAGES:
        files = {r.filename: r.content for r in codegen.generated(good, language).collect()}
        assert len(files) == 6
    files = {r.filename: r.content for r in codegen.generated(good, "python").collect()}
    for content in files.values():
        ast.parse(content)
    assert "from .Engine import Engine" in files["Car.py"] and "self.wheels: List[Wheel] = None" in files["Car.py"]
    again = P.parse(files["Mechanic.py"])
    assert [m["name"] for m in again["classes"][0]["methods"]] == ["repair"]
    bases = relate.parents(S.classes(good), S.relationships(good)).collect()
    assert all(r.parent is None and r.interfaces == [] for r in bases)


def test_obligations(spark):
    from weftgraph.operators import graph

    source = "from abc import ABC, abstractmethod\nclass I(ABC):\n    @abstractmethod\n    def a(self): ...\n    @abstractmethod\n    def b(self): ...\nclass M(I):\n    def a(self): pass\nclass N(M):\n    def c(self): pass\n"
    docs = spark.createDataFrame([(1, P.parse(source))], f"doc_id long, doc {S.CLASS_DOC}")
    got = graph.obligations(S.classes(docs), S.members(docs, "methods"), S.relationships(docs)).collect()
    assert {(r.id, r.name, r.from_class) for r in got} == {("class_2", "b", "class_1"), ("class_3", "a", "class_1"), ("class_3", "b", "class_1")}
    files = codegen.class_files(P.parse(source), "java")
    assert "public interface I {" in files["I.java"] and "public class M implements I {" in files["M.java"] and "void b() {" in files["M.java"].replace("Object b", "void b")
