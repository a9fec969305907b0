"""Graphs of many rounds: nothing stops before the last node."""

import pytest

from weftgraph.operators import graph
from weftgraph.sources import scratch


def test_a_long_chain_is_followed_to_its_end(spark):
    n = 40
    edges = spark.createDataFrame([(1, str(k), str(k + 1)) for k in range(n)], "doc_id long, source string, target string")
    starts = spark.createDataFrame([(1, "0", "0")], "doc_id long, origin string, id string")
    got = {r.id: r.depth for r in graph.depths(edges, starts).collect()}
    assert got == {str(k): k for k in range(n + 1)}
    nodes = spark.createDataFrame([(1, str(k), "start" if k == 0 else "action") for k in range(n + 1)] + [(1, "alone", "action")], "doc_id long, id string, type string")
    assert [r.id for r in graph.unreachable(nodes, edges).collect()] == ["alone"]
    with pytest.raises(RuntimeError):
        graph.depths(edges, starts, most=5)


def test_a_cluster_must_name_its_shared_folder():
    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.base_folder(Session())
    Session.conf = Conf({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared"})
    assert scratch.base_folder(Session()) == "hdfs:///shared"


def test_shortest_paths_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    import heapq
    import random

    rng, n = random.Random(3), 300
    links = [(k, k + s, float(rng.randint(1, 9))) for k in range(n) for s in (1, 2) if k + s < n] + [(k + 7, k, 1.0) for k in range(0, n - 7, 13)] + [(5, 5, 2.0), (9, 10, -0.5)]
    edges = spark.createDataFrame([(d, a, b, w) for d in (1, 2) for a, b, w in links], "doc_id long, source long, target long, length double")
    made, write = [], graph.persisted
    monkeypatch.setattr(graph, "persisted", lambda df: made.append(1) or write(df))
    got = {(r.doc_id, r.id): r.distance for r in graph.shortest_paths(edges, spark.createDataFrame([(1, 0), (2, 150)], "doc_id long, id long")).collect()}
    assert len(made) < 200  # a table a round of each kind; a round a step would make 600
    want = {}
    for doc, start in ((1, 0), (2, 150)):
        best, queue = {start: 0.0}, [(0.0, start)]
        while queue:
            d, v = heapq.heappop(queue)
            for a, b, w in links:
                if a == v and d + w < best.get(b, float("inf")):
                    best[b] = d + w
                    heapq.heappush(queue, (d + w, b))
        want |= {(doc, v): d for v, d in best.items()}
    assert got == want


def test_a_negative_cycle_far_away_raises(spark):
    n = 40
    links = [(k, k + 1, 1.0) for k in range(n)] + [(n, n - 20, -25.0)]
    edges = spark.createDataFrame([(1, a, b, w) for a, b, w in links], "doc_id long, source long, target long, length double")
    with pytest.raises(RuntimeError):
        graph.shortest_paths(edges, spark.createDataFrame([(1, 0)], "doc_id long, id long"))
    # one that no source leads to doesn't
    away = spark.createDataFrame([(1, a + (a > 15) * 100, b + (b > 15) * 100, w) for a, b, w in links if a != 15], "doc_id long, source long, target long, length double")
    assert graph.shortest_paths(away, spark.createDataFrame([(1, 0)], "doc_id long, id long")).count() == 16


def test_depths_send_no_table_round(spark, monkeypatch):
    plans, write = [], graph.persisted
    monkeypatch.setattr(graph, "persisted", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "doc_id long, source long, target long")
    got = graph.depths(edges, spark.createDataFrame([(1, 0, 0)], "doc_id long, origin long, id long"))
    assert {(r.id, r.depth) for r in got.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
