"""Class models and flows from Java and JavaScript sources."""

import pytest

from weftgraph.extract import java_source as J
from weftgraph.extract import javascript_source as S
from weftgraph.extract.curly import rendered, tokens

JAVA = """
package a.b; import java.util.*;
/** doc */
public class Engine { private int horsepower; public Engine(int horsepower) { this.horsepower = horsepower; } }
class Wheel { int size; }
class Person {}
interface Shape { double area(); }
enum Color { RED, GREEN { void f() {} } }
@Deprecated(since = "1")
public abstract class Car<T extends Object> extends Base implements Shape {
    public static final int MAX = 5;
    private Engine engine;
    protected Person owner, driver;
    private List<Wheel> wheels = new ArrayList<>();
    boolean[] flags;
    Map<String, List<Person>> people;
    public Car(Person owner) { this.engine = new Engine(300); this.owner = owner; }
    public void grow() { Wheel w = new Wheel(); wheels.add(w); }
    abstract boolean ready(String... names);
    protected <X> Color paint(final Color c, int[] xs) throws Exception { return c; }
    static class Inner { int hidden; }
    { int block; }
    public int run(int x) {
        int y = x + 1;
        for (int i = 0; i < y; i++) { y += i; }
        for (Wheel w : wheels) { w.turn(); }
        if (x > 0) { return y; } else if (x == 0) y = 2; else throw new IllegalStateException("bad");
        try { y = risky(y); } catch (IOException | RuntimeException e) { y = 0; } finally { close(); }
        do { y--; } while (y > 0);
        return y;
    }
}
"""

SCRIPT = """
import { x } from './x.js';
class Item {}
/** A cart. */
export class Cart extends Base {
  constructor(owner, limit = 10, name) {
    super();
    this.items = [];
    this.first = new Item();
    this.limit = limit;
    this.name = name;
    this._secret = "s";
    if (limit) { this.open = true; }
    /** @type {Map<string, Item>} */
    this.index = null;
  }
  add(n) { const item = new Item(n); this.items.push(item); return item; }
  /** @param {number} price @returns {boolean} */
  cheap(price) { return price < 3; }
  static make() { return new Cart(); }
  total(a, b) { let t = 1 + 2; return t * 2; }
  label() { return `x${this.name}`; }
  run(list) {
    for (const i of list) { console.log(i); }
    for (let k = 0; k < 3; k++) { this.items.push(k); }
    while (!done) { step(); }
    try { risky(); } catch (e) { fail(e); } finally { close(); }
    if (a) { return 1; }
    const f = (q) => { return q; };
    throw new Error("x");
  }
}
export default class Other { use(c) { return Cart.make(); } }
"""


def test_java_model():
    d = J.parse(JAVA)
    by = {c["name"]: c for c in d["classes"]}
    assert list(by) == ["Engine", "Wheel", "Person", "Shape", "Car"]
    assert (by["Shape"]["kind"], by["Car"]["kind"], by["Engine"]["kind"]) == ("interface", "abstract", "class")
    assert [(a["name"], a["datatype"], a["visibility"], a["default_value"], a["static"], a["final"]) for a in by["Car"]["attributes"]] == [
        ("MAX", "int", "public", "5", True, True), ("engine", "Engine", "private", None, False, False), ("owner", "Person", "protected", None, False, False), ("driver", "Person", "protected", None, False, False),
        ("wheels", "List[Wheel]", "private", None, False, False), ("flags", "List[bool]", "package", None, False, False), ("people", "Map[String, List[Person]]", "package", None, False, False),
    ]
    assert [(m["name"], m["return_type"], m["abstract"], [p["datatype"] for p in m["parameters"]]) for m in by["Car"]["methods"]] == [("grow", "void", False, []), ("ready", "bool", True, ["List[String]"]), ("paint", "Color", False, ["Color", "List[int]"]), ("run", "int", False, ["int"])]
    names = {c["id"]: c["name"] for c in d["classes"]}
    assert {(names[r["source"]], names[r["destination"]], r["type"], r["multiplicity"]["destination"]) for r in d["relationships"]} == {("Car", "Engine", "composition", "1"), ("Car", "Person", "association", "1"), ("Car", "Wheel", "composition", "*"), ("Car", "Shape", "realization", "1")}


def test_java_flow():
    assert ("Car", "run") in J.methods(JAVA) and ("Car", "ready") not in J.methods(JAVA)
    d = J.control_flow(JAVA, "Car", "run")
    labels = [n["label"] for n in d["nodes"] if n["type"] == "decision"]
    assert labels == ["for(; i < y; )", "for w : wheels", "x > 0", "x == 0", "catch IOException | RuntimeException?", "y > 0"]
    said = [n["label"] for n in d["nodes"] if n["type"] == "action"]
    assert said[:3] == ["Calculate y", "Increase y", "Turn w"] and "Throw IllegalStateException" in said and "finally" in said
    for bad in ("class {", "class A { int }", "class A { void f() { }", "int x;"):
        with pytest.raises(ValueError, match="Java"):
            J.parse(bad)
    with pytest.raises(ValueError, match="not found"):
        J.control_flow(JAVA, "Nope", "run")


def test_javascript_model():
    d = S.parse(SCRIPT)
    by = {c["name"]: c for c in d["classes"]}
    assert list(by) == ["Item", "Cart", "Other"]
    assert [(a["name"], a["datatype"], a["visibility"], a["default_value"]) for a in by["Cart"]["attributes"]] == [
        ("items", "List[Item]", "public", None), ("first", "Item", "public", None), ("limit", "int", "public", None), ("name", "String", "public", None), ("_secret", "String", "private", "s"), ("open", "boolean", "public", "True"), ("index", "Map[String, Item]", "public", "None"),
    ]
    assert [(m["name"], m["return_type"], m["static"]) for m in by["Cart"]["methods"]] == [("add", "Item", False), ("cheap", "boolean", False), ("make", "Cart", True), ("total", "int", False), ("label", "String", False), ("run", "int", False)]
    names = {c["id"]: c["name"] for c in d["classes"]}
    assert {(names[r["source"]], names[r["destination"]], r["type"], r["multiplicity"]["destination"]) for r in d["relationships"]} == {("Cart", "Item", "composition", "*"), ("Cart", "Item", "association", "1"), ("Other", "Cart", "dependency", "1")}


def test_javascript_flow():
    assert ("Cart", "run") in S.methods(SCRIPT) and ("Cart", "constructor") not in S.methods(SCRIPT)
    d = S.control_flow(SCRIPT, "Cart", "run")
    assert [n["label"] for n in d["nodes"] if n["type"] == "decision"] == ["for..of list", "k < 3", "!done", "exception thrown?", "a"]
    assert [n["label"] for n in d["nodes"] if n["type"] == "action"][:3] == ["Print i", "Add k to items", "Step"]
    with pytest.raises(ValueError, match="JavaScript"):
        S.parse("class A { f() { }")


def test_rendering():
    for text in ("a + b * c", "f(a, b)", "this.items.push(item)", "new Foo(1)", "!x && y", "a[0]", "-1", "x == -1", "return a / b", "const x = new Loan(b)"):
        assert rendered(tokens(text, "x")) == text
