"""Scratch tables and their scopes."""

import os

from weftgraph.operators import graph, routing
from weftgraph.sources import scratch


def tables(spark):
    return {x for x in os.listdir(scratch.base_folder(spark).removeprefix("file:")) if x.startswith("graph-")}


def test_a_scope_deletes_what_was_written_in_it(spark):
    links = spark.createDataFrame([(1, 5, 4), (1, 4, 3), (2, 3, 4)], "doc_id long, a long, b long")
    kept = routing.components(links)
    before = tables(spark)
    with scratch.scope(spark):
        assert routing.components(links).count() == 5
        inner = tables(spark)
        with scratch.scope(spark):
            edges = spark.createDataFrame([(1, "a", "b")], "doc_id long, source string, target string")
            assert graph.depths(edges, spark.createDataFrame([(1, "a", "a")], "doc_id long, origin string, id string")).count() == 2
            assert tables(spark) > inner
        assert tables(spark) == inner > before
    assert tables(spark) == before and kept.count() == 5
    try:
        with scratch.scope(spark):
            routing.components(links)
            raise ValueError
    except ValueError:
        assert tables(spark) == before
