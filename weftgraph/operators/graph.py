"""Reachability, depths, convergence and inheritance over the graphs of many documents at once.

Each round joins the newest nodes with the edges and keeps what is new, so the
work of a round is its frontier's edges; rounds are as many as the longest
shortest path. Cycles end because a node is reached once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.scratch import persisted

#: Rounds of shortest paths after which nodes are taken out of the graph, if they have at most so many pairs of an edge in and one out.
PATIENCE, PAIRS = 12, 16


def depths(edges: DataFrame, sources: DataFrame, key: list[str] = ("doc_id",), most: int | None = None, boundary: DataFrame | None = None) -> DataFrame:
    """(key, origin, id, depth) of every node that a source (key, origin, id) reaches, by fewest edges.

    boundary: nodes (key, id) that are reached but not left. most: rounds after which it raises if nodes are still found; without it rounds go on until none is.
    """
    key = list(key)
    steps = edges.select(*key, F.col("source").alias("id"), "target").distinct()
    if boundary is not None:
        steps = steps.join(boundary.select(*key, "id").distinct(), [*key, "id"], "left_anti")
    # tables of ids are small as files and many times larger in memory, so none is sent round whole
    steps = persisted(steps).hint("merge")
    seen = persisted(sources.select(*key, "origin", "id", F.lit(0).cast("long").alias("depth")).distinct())
    newest, depth = seen, 0
    while True:
        depth += 1
        ahead = newest.join(steps, [*key, "id"]).select(*key, "origin", F.col("target").alias("id")).distinct()
        ahead = persisted(ahead.join(seen.select(*key, "origin", "id").hint("merge"), [*key, "origin", "id"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if ahead.isEmpty():
            return seen
        if most is not None and depth > most:
            raise RuntimeError(f"nodes are more than {most} steps away")
        seen = seen.unionByName(ahead)
        if depth % 8 == 0:
            seen = persisted(seen)
        newest = ahead


def reaches(edges: DataFrame, pairs: DataFrame, boundary: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """pairs (key, id, target) with reaches: whether the target can be come to without passing a boundary node (the target itself may be one)."""
    key = list(key)
    got = depths(edges, pairs.select(*key, F.col("id").alias("origin"), "id"), key, boundary=boundary)
    hit = got.select(*key, F.col("origin").alias("id"), F.col("id").alias("target")).distinct().withColumn("reaches", F.lit(True))
    return pairs.join(hit, [*key, "id", "target"], "left").withColumn("reaches", F.coalesce("reaches", F.lit(False)))


def convergence(edges: DataFrame, branches: DataFrame, nodes: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """branches (key, a, b) with meet: the node that both reach with the least sum of depths, the first in the document of equals."""
    key = list(key)
    starts = branches.select(*key, F.explode(F.array("a", "b")).alias("id")).distinct().select(*key, F.col("id").alias("origin"), "id")
    got = persisted(depths(edges, starts, key))
    left = branches.select(*key, "a", "b").join(got.select(*key, F.col("origin").alias("a"), "id", F.col("depth").alias("da")), [*key, "a"])
    both = left.join(got.select(*key, F.col("origin").alias("b"), "id", F.col("depth").alias("db")), [*key, "b", "id"])
    both = both.join(nodes.select(*key, "id", "ord"), [*key, "id"])
    best = both.groupBy(*key, "a", "b").agg(F.min_by("id", F.struct(F.col("da") + F.col("db"), "ord")).alias("meet"))
    return branches.join(best, [*key, "a", "b"], "left")


def unreachable(nodes: DataFrame, edges: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """Nodes that no start node leads to."""
    key = list(key)
    starts = nodes.where("type = 'start'").select(*key, F.col("id").alias("origin"), "id")
    got = depths(edges, starts, key).select(*key, "id").distinct()
    return nodes.join(got, [*key, "id"], "left_anti")


def closure(edges: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """(key, origin, id, depth): of every node what it leads to, by fewest edges, itself aside.

    Rounds double what is known: a path of more than 2 ** k and at most 2 ** (k + 1)
    edges is a known one and one of exactly 2 ** k, so rounds are the logarithm of the
    longest shortest path, and each pair is made once for each of its shortest paths.
    """
    key = list(key)
    reach = edges.select(*key, F.col("source").alias("origin"), F.col("target").alias("id")).where("origin is not null and id is not null and origin != id").distinct()
    reach, size = persisted(reach.withColumn("depth", F.lit(1).cast("long"))), 1
    while True:
        on = reach.where(F.col("depth") == size).select(*key, F.col("origin").alias("id"), F.col("id").alias("to"))
        ahead = reach.join(on, [*key, "id"]).where("origin != to").groupBy(*key, "origin", F.col("to").alias("id")).agg((F.min("depth") + size).alias("depth"))
        new = persisted(ahead.join(reach.select(*key, "origin", "id"), [*key, "origin", "id"], "left_anti"))
        if new.isEmpty():
            return reach
        reach, size = persisted(reach.unionByName(new)), 2 * size


def ancestors(classes: DataFrame, edges: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """(key, origin, id, depth): all classes above each class along inheritance and realization."""
    key = list(key)
    up = edges.where(F.col("type").isin("inheritance", "realization")).select(*key, "source", F.col("destination").alias("target"))
    return closure(up, key).join(classes.select(*key, F.col("id").alias("origin")).distinct(), [*key, "origin"], "left_semi").select(*key, "origin", "id", "depth")


def obligations(classes: DataFrame, methods: DataFrame, edges: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """(key, id, name, from_class): methods of interfaces and abstract methods above a class that it neither declares nor, being abstract, may leave.

    Of equal names the one of the nearest class counts, then of the first in the document.
    """
    key = list(key)
    kinds = classes.select(*key, F.col("id").alias("class_id"), F.col("kind").alias("_kind"), F.col("ord").alias("_class_ord"))
    promised = methods.join(kinds, [*key, "class_id"]).where("_kind = 'interface' or abstract")
    above = ancestors(classes, edges, key).join(classes.where("kind != 'abstract'").select(*key, F.col("id").alias("origin")), [*key, "origin"], "left_semi").where("origin != id")
    due = above.join(promised.select(*key, F.col("class_id").alias("id"), "name", "_class_ord", "ord"), [*key, "id"])
    due = due.join(methods.select(*key, F.col("class_id").alias("origin"), "name"), [*key, "origin", "name"], "left_anti")
    return due.groupBy(*key, F.col("origin").alias("id"), "name").agg(F.min_by(due["id"], F.struct("depth", "_class_ord", "ord")).alias("from_class"))


def shortest_paths(edges: DataFrame, sources: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """(key, id, distance) from the sources (key, id) over edges with a length, by relaxing until nothing gets shorter.

    Paths of more than PATIENCE edges aren't followed step by step: nodes with few edges
    are taken out first (``_contracted``), what is left is relaxed, and the nodes come
    back in the opposite order. So rounds are the logarithm of a long path where nodes
    have few edges. Lengths of a path may be added up in any order.

    The shortest path of a node has fewer edges than there are nodes, so only a cycle
    of negative length still finds shorter ones after as many rounds: that raises.
    """
    key = list(key)
    edges = persisted(edges.select(*key, F.col("source").alias("id"), "target", "length").where("id is not null and target is not null and length is not null"))
    best = persisted(sources.select(*key, "id", F.lit(0.0).alias("distance")).where("id is not null").distinct())
    best, settled = _relaxed(edges, best, key, PATIENCE)
    if settled:
        return best
    edges, best, taken = _contracted(edges, best, key)
    nodes = edges.select(*key, "id").union(edges.select(*key, "target")).distinct().groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    best, settled = _relaxed(edges, best, key, nodes)
    if not settled:
        raise RuntimeError("the paths don't settle: a cycle of negative length")
    for into in reversed(taken):
        ahead = best.join(into, [*key, "id"]).select(*key, F.col("target").alias("id"), (F.col("distance") + F.col("length")).alias("distance"))
        best = persisted(_least(best.unionByName(ahead), key))
    return best


def _least(found: DataFrame, key: list[str]) -> DataFrame:
    return found.groupBy(*key, "id").agg(F.min("distance").alias("distance"))


def _relaxed(edges: DataFrame, best: DataFrame, key: list[str], most: int) -> tuple[DataFrame, bool]:
    """(distances after at most so many rounds, whether no round finds shorter ones)."""
    newest, rounds = best, 0
    while True:
        ahead = newest.join(edges, [*key, "id"]).groupBy(*key, F.col("target").alias("id")).agg(F.min(F.col("distance") + F.col("length")).alias("new"))
        both = ahead.join(best, [*key, "id"], "left").where("distance is null or new < distance")
        newest = persisted(both.select(*key, "id", F.col("new").alias("distance")))
        if newest.isEmpty():
            return best, True
        if rounds == most:
            return best, False
        rounds += 1
        best = persisted(_least(best.unionByName(newest), key))


def _contracted(edges: DataFrame, best: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(edges, best, taken): what is left when nodes with few edges are taken out, and by round the edges that led into these.

    A round takes nodes that aren't beside each other, by lot. Their neighbours get
    edges past them and the distances that they pass on, so distances of the nodes left
    stay as they were. A node on a negative cycle of its own stays.
    """
    taken: list[DataFrame] = []
    while True:
        ends = edges.select(*key, F.col("id").alias("v"), F.col("target").alias("other"), F.lit(1).alias("out"), F.lit(0).alias("in"))
        ends = ends.unionByName(edges.select(*key, F.col("target").alias("v"), F.col("id").alias("other"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        few = (F.sum("out") * F.sum("in") <= PAIRS) & ~F.bool_or(F.col("v") == F.col("other"))
        nodes = persisted(ends.groupBy(*key, "v").agg(F.when(few, F.xxhash64("v", F.lit(len(taken)))).alias("lot")))
        if (nodes.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) <= PATIENCE:
            return edges, best, taken
        free = nodes.where("lot is not null")
        beside = ends.join(free.select(*key, F.col("v").alias("other"), F.col("lot").alias("near")), [*key, "other"]).groupBy(*key, "v").agg(F.min(F.struct("near", "other")).alias("near"))
        gone = persisted(free.join(beside, [*key, "v"], "left").where(F.col("near").isNull() | (F.struct(F.col("lot").alias("near"), F.col("v").alias("other")) < F.col("near"))).select(*key, "v"))
        if gone.isEmpty():
            return edges, best, taken
        at = lambda c: gone.withColumnRenamed("v", c)  # noqa: E731, B023
        into, on = persisted(edges.join(at("target"), [*key, "target"], "left_semi").select(*key, "id", "target", "length")), edges.join(at("id"), [*key, "id"], "left_semi")
        past = into.select(*key, "id", F.col("target").alias("v"), F.col("length").alias("before")).join(on.select(*key, F.col("id").alias("v"), "target", "length"), [*key, "v"]).select(*key, "id", "target", (F.col("before") + F.col("length")).alias("length"))
        ahead = best.join(on, [*key, "id"]).select(*key, F.col("target").alias("id"), (F.col("distance") + F.col("length")).alias("distance"))
        best = persisted(_least(best.unionByName(ahead), key))
        rest = edges.join(at("id"), [*key, "id"], "left_anti").join(at("target"), [*key, "target"], "left_anti")
        rest = rest.select(*key, "id", "target", "length").unionByName(past).groupBy(*key, "id", "target").agg(F.min("length").alias("length"))
        edges = persisted(rest.where("id != target or length < 0"))
        taken.append(into)
