"""Structuring of activity graphs, their layout, and graph operators over many documents."""

import inspect

import pytest
from pyspark.sql import functions as F

from weftgraph import schemas as S
from weftgraph.operators import flow, graph, validate
from weftgraph.render import codegen, mermaid


def doc(nodes: str, edges: str) -> dict:
    """"n1:start n2:action:do work", "n1>n2 n2>n3:yes"."""
    ns = [dict(zip(("id", "type", "label"), (*p.replace("_", " ").split(":"), ""), strict=False)) for p in nodes.split()]
    es = [{"id": f"e{k}", "source": e.split(">")[0], "target": e.split(">")[1].split(":")[0], "label": (e.split(":") + [""])[1]} for k, e in enumerate(edges.split(), 1)]
    return {"nodes": [{**n, "position": {"x": 0.0, "y": 0.0}, "size": {"width": 1.0, "height": 1.0}} for n in ns], "edges": es}


def said(tree):
    out = []
    for s in tree:
        if s["kind"] == "action":
            out.append(s["label"])
        else:
            out.append((s["kind"], s["label"], *[said(s[p]) for p in ("then", "else", "body") if p in s]))
    return out


GOOD = [
    ("n1:start n2:action:do_work n3:end", "n1>n2 n2>n3", ["do work"]),
    ("n1:start n2:decision:x n3:action:p n4:action:q n5:end", "n1>n2 n2>n3:yes n2>n4:no n3>n5 n4>n5", [("if", "x", ["p"], ["q"])]),
    ("n1:start n2:decision:x n3:action:p n4:action:q n5:end", "n1>n2 n2>n3:yes n2>n4:no n3>n4 n4>n5", [("if", "x", ["p"], []), "q"]),
    ("n1:start n2:decision:n n3:action:dec n4:end", "n1>n2 n2>n3:yes n3>n2 n2>n4:no", [("while", "n", ["dec"])]),
    ("n1:start n2:decision:n n3:decision:m n4:action:a n5:action:b n6:end", "n1>n2 n2>n3 n3>n4 n3>n5 n4>n2 n5>n2 n2>n6", [("while", "n", [("if", "m", ["a"], ["b"])])]),
]
BAD = [
    ("n1:start n2:fork n3:end", "n1>n2 n2>n3", "fork/join"),
    ("n1:start n2:decision n3:end", "n1>n2 n2>n3", "exactly 2 outgoing edges"),
    ("n1:start n2:decision n3:end n4:end", "n1>n2 n2>n3 n2>n4", "no reconvergence point"),
    ("n1:start n2:decision n3:action n4:action n5:end", "n1>n2 n2>n3 n2>n4 n3>n2 n4>n2", "back edge on both branches"),
    ("n1:start n2:action n3:end n4:end", "n1>n2 n2>n3 n2>n4", "exactly one outgoing edge"),
    ("n1:start n2:action n3:end", "n1>n2", "exactly one outgoing edge"),
]


@pytest.mark.parametrize(("nodes", "edges", "tree"), GOOD)
def test_structure(nodes, edges, tree):
    d = doc(nodes, edges)
    assert said(flow.Graph(d["nodes"], d["edges"]).tree()) == tree


@pytest.mark.parametrize(("nodes", "edges", "message"), BAD)
def test_rejects(nodes, edges, message):
    d = doc(nodes, edges)
    with pytest.raises(flow.Unstructured, match=message):
        flow.Graph(d["nodes"], d["edges"]).tree()


def test_many_documents(spark):
    rows = [(k, doc(n, e)) for k, (n, e, _) in enumerate(GOOD + BAD)]
    docs = spark.createDataFrame(rows, f"doc_id long, doc {S.ACTIVITY_DOC}")
    got = flow.structured(docs).orderBy("doc_id", "path").collect()
    assert [(r.path, r.part, r.kind, r.label) for r in got if r.doc_id == 1] == [([0], "", "if", "x"), ([0, 0, 0], "then", "action", "p"), ([0, 1, 0], "else", "action", "q")]
    assert all("fork/join" in r.error for r in got if r.doc_id == len(GOOD))
    code = {r.doc_id: r for r in codegen.generated(docs, "python", function="flow").collect()}
    assert code[3].content == "def flow():\n    while False:  # n\n        # TODO: dec\n        pass\n"
    for d, r in code.items():
        if d < len(GOOD):
            compile(r.content, "flow.py", "exec")
    java = {r.doc_id: r.content for r in codegen.generated(docs, "java", function="Flow").collect()}
    assert "while (Boolean.FALSE) {  // n" in java[3]
    text = {r.doc_id: r.t for r in docs.select("doc_id", mermaid.flowchart(F.col("doc")).alias("t")).collect()}
    assert text[1].split("\n")[:5] == ["flowchart TD", '    n1(("Start"))', '    n2{"x"}', '    n3["p"]', '    n4["q"]']
    assert '    n2 -->|"yes"| n3' in text[1]
    spots = {(r.doc_id, r.id): (r.x, r.y) for r in flow.layout(docs).collect()}
    assert spots[1, "n1"][1] < spots[1, "n2"][1] < spots[1, "n3"][1] == spots[1, "n4"][1] < spots[1, "n5"][1]
    assert spots[1, "n3"][0] == -spots[1, "n4"][0]
    nodes, edges = S.nodes(docs), S.edges(docs)
    lost = graph.unreachable(nodes, edges).collect()
    assert {(r.doc_id, r.id) for r in lost} == {(len(GOOD) + 3, "n5"), (len(GOOD) + 5, "n3")}
    meet = graph.convergence(edges, spark.createDataFrame([(1, "n3", "n4"), (2, "n3", "n4")], "doc_id long, a string, b string"), nodes).collect()
    assert {(r.doc_id, r.meet) for r in meet} == {(1, "n5"), (2, "n4")}
    pairs = spark.createDataFrame([(3, "n3", "n2"), (3, "n4", "n2"), (4, "n4", "n3")], "doc_id long, id string, target string")
    wall = spark.createDataFrame([(4, "n2")], "doc_id long, id string")
    assert {(r.doc_id, r.id): r.reaches for r in graph.reaches(edges, pairs, wall).collect()} == {(3, "n3"): True, (3, "n4"): False, (4, "n4"): False}
    assert validate.activity_violations(docs).count() == 0
    broken = spark.createDataFrame([(0, doc("n1:action", "n1>n9")), (1, {"nodes": [], "edges": []})], f"doc_id long, doc {S.ACTIVITY_DOC}")
    assert {(r.doc_id, r.rule) for r in validate.activity_violations(broken).collect()} == {(0, "unknown_target_node"), (0, "one_start"), (0, "some_end"), (1, "one_start"), (1, "some_end")}


def test_depths_go_on_until_nothing_is_new(spark):
    edges = spark.createDataFrame([(1, k, k + 1) for k in range(12)], "doc_id long, source long, target long")
    start = spark.createDataFrame([(1, 0, 0)], "doc_id long, origin long, id long")
    assert inspect.signature(graph.depths).parameters["most"].default is None
    assert sorted((r.id, r.depth) for r in graph.depths(edges, start).collect()) == [(k, k) for k in range(13)]
    assert graph.depths(edges, start, most=12).count() == 13
    with pytest.raises(RuntimeError, match="more than 11 steps"):
        graph.depths(edges, start, most=11)


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "c", 1.0), (1, "a", "c", 5.0), (1, "c", "a", 0.0)], "doc_id long, source string, target string, length double")
    got = graph.shortest_paths(edges, spark.createDataFrame([(1, "a")], "doc_id long, id string")).collect()
    assert {(r.id, r.distance) for r in got} == {("a", 0.0), ("b", 1.0), ("c", 2.0)}


def test_shortest_paths_of_long_chains_and_negative_cycles(spark, monkeypatch):
    """Rounds go on as long as something gets shorter; only a cycle of negative length is refused."""
    monkeypatch.setattr(graph, "PATIENCE", 3)
    n = 10  # more than the rounds after which nodes are counted
    chain = spark.createDataFrame([(1, k, k + 1, 1.0) for k in range(n)] + [(1, 0, None, 1.0)], "doc_id long, source long, target long, length double")
    start = spark.createDataFrame([(1, 0), (1, None)], "doc_id long, id long")
    assert max(r.distance for r in graph.shortest_paths(chain, start).collect()) == n
    ring = spark.createDataFrame([(1, 0, 1, 1.0), (1, 1, 0, -2.0)], "doc_id long, source long, target long, length double")
    with pytest.raises(RuntimeError, match="negative"):
        graph.shortest_paths(ring, start)


def test_closure_is_breadth_first_search(spark):
    """Long chains, cycles and short cuts; 300 steps take nine rounds."""
    import random

    rng = random.Random(5)
    rows = [(1, k, k + 1) for k in range(300)] + [(2, rng.randrange(25), rng.randrange(25)) for _ in range(45)] + [(3, 0, 0), (3, None, 1), (3, 1, None)]
    want = set()
    for doc in (1, 2, 3):
        out = {}
        for d, a, b in rows:
            if d == doc and a is not None and b is not None:
                out.setdefault(a, set()).add(b)
        for a in out:
            depth, newest = {a: 0}, [a]
            while newest:
                newest = [b for x in newest for b in out.get(x, ()) if b not in depth and not depth.update({b: depth[x] + 1})]
            want |= {(doc, a, b, n) for b, n in depth.items() if n}
    got = graph.closure(spark.createDataFrame(rows, "doc_id long, source long, target long"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_orientation():
    shapes = [{"kind": "start", "y": 0}, {"kind": "action", "y": 50}, {"kind": "decision", "y": 100}, {"kind": "end", "y": 150}]
    links = [{"a": 1, "b": 0, "length": 30.0}, {"a": 1, "b": 2, "length": 30.0}, {"a": 2, "b": 3, "length": 30.0}, {"a": 1, "b": 2, "length": 90.0}]
    assert sorted(flow.oriented(shapes, links)) == [(0, 1, 0), (1, 2, 1), (2, 1, 3), (2, 3, 2)]
    with pytest.raises(ValueError, match="doesn't lead"):
        flow.oriented(shapes, links[:2])
    three = [{"kind": "start", "y": 0}, {"kind": "action", "y": 50}, {"kind": "action", "y": 60}]
    short_cut = [{"a": 0, "b": 1, "length": 10.0}, {"a": 1, "b": 2, "length": 1.0}, {"a": 0, "b": 2, "length": 1.0}]
    assert sorted(flow.oriented(three, short_cut)) == [(0, 1, 0), (0, 2, 2), (2, 1, 1)]  # 1 is further away than 2
    down = [{"kind": "start", "y": 100}, {"kind": "action", "y": 0}, {"kind": "action", "y": 20}]
    with pytest.raises(ValueError, match="leads down"):
        flow.oriented(down, [{"a": 0, "b": 1, "length": 1.0}, {"a": 1, "b": 2, "length": 1.0}, {"a": 2, "b": 0, "length": 9.0}])
