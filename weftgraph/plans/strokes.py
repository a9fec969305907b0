"""Registered queries of strokes and of ends that meet: lines that cross, shared buses, main axes, greedy pairs, weighted distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import assembly, connectors, edits, graph, relate, routing, spatial, strokes, validate
from weftgraph.plans.queries import query, table
from weftgraph.render import raster

_RING = "SELECT s_suppkey // 4 AS doc_id, s_suppkey % 4 AS ord, s_nationkey FROM supplier"


def _ring(spark, sf_dir):
    """Four suppliers are the corners of a drawing, moved by their nations."""
    rows = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 4).alias("doc_id"), (F.col("s_suppkey") % 4).cast("long").alias("ord"), F.col("s_nationkey").alias("n"))
    x, y = F.when(F.col("ord").isin(1, 2), 440.0).otherwise(0.0) + F.col("n") % 7 * 5, F.when(F.col("ord") >= 2, 320.0).otherwise(0.0) + F.col("n") % 5 * 6
    return rows.select("doc_id", "ord", "n", F.lit("action").alias("kind"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(80.0).alias("w"), F.lit(50.0).alias("h"))


def _placed(boxes, corners):
    return boxes.join(corners, "doc_id").select("doc_id", "ord", (F.col("x") - F.col("left")).alias("x"), (F.col("y") - F.col("top")).alias("y"), "w", "h")


@query(
    f"WITH r AS ({_RING}), e AS (SELECT a.doc_id, a.ord AS s, b.ord AS t, (a.s_nationkey + a.ord) % 4 AS k FROM r a JOIN r b ON b.doc_id = a.doc_id AND b.ord = a.ord + 2 WHERE a.ord < 2)"
    " SELECT doc_id::BIGINT AS doc_id, (CASE WHEN k >= 2 THEN t ELSE s END)::BIGINT AS source, (CASE WHEN k >= 2 THEN s ELSE t END)::BIGINT AS target, CASE k WHEN 0 THEN 'arrow' WHEN 1 THEN 'triangle' WHEN 2 THEN 'hollow_diamond' ELSE 'filled_diamond' END AS marker FROM e"
)
def crossing_lines(spark, sf_dir):
    """Both diagonals of each drawing, which cross, with markers at their slanted ends."""
    boxes = _ring(spark, sf_dir)
    end = boxes.select("doc_id", (F.col("ord") - 2).alias("ord"), F.col("ord").alias("target"))
    kind = F.array(*[F.lit(m) for m in ("arrow", "triangle", "hollow_diamond", "filled_diamond")])[(F.col("n") + F.col("ord")).cast("int") % 4]
    edges = boxes.where("ord < 2").join(end, ["doc_id", "ord"]).select("doc_id", "ord", F.col("ord").alias("source"), "target", kind.alias("marker"), F.lit(False).alias("dashed"))
    pages = raster.drawn(boxes, edges)
    found = connectors.connectors(pages, _placed(boxes, raster.corners(boxes)), reach=int(raster.EDGE_GAP) + 6)
    return found.select("doc_id", "source", "target", "marker")


@query("SELECT (s_suppkey // 5)::BIGINT AS doc_id, (s_suppkey % 5)::BIGINT AS source, 0::BIGINT AS target, 'inheritance' AS type FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey // 5 IN (SELECT s_suppkey // 5 FROM supplier GROUP BY ALL HAVING count(*) = 5)")
def shared_buses(spark, sf_dir):
    """I4: a supplier is the parent of the next four, which hang from one bar; the bus comes back as a line for each."""
    rows = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 5).alias("doc_id"), (F.col("s_suppkey") % 5).cast("long").alias("ord"), (F.col("s_nationkey") % 6 * 4.0).alias("shift"))
    whole = rows.groupBy("doc_id").count().where("count = 5").select("doc_id")
    rows = rows.join(whole, "doc_id")
    x = F.when(F.col("ord") == 0, 270.0).otherwise((F.col("ord") - 1) * 180.0 + F.col("shift"))
    boxes = rows.select("doc_id", "ord", F.lit("action").alias("kind"), x.alias("x"), F.when(F.col("ord") == 0, 0.0).otherwise(260.0).alias("y"), F.lit(100.0).alias("w"), F.lit(60.0).alias("h"))
    # corners of the bus are boxes without a size, over each box's middle
    corners = boxes.select("doc_id", (F.col("ord") + 10).alias("ord"), F.lit("point").alias("kind"), (F.col("x") + 50).alias("x"), F.lit(170.0).alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    down = boxes.select("doc_id", "ord", (F.col("ord") + 10).alias("source"), F.col("ord").alias("target"), F.when(F.col("ord") == 0, "triangle").alias("marker"), F.lit(False).alias("dashed"))
    bar = whole.select("doc_id", F.lit(20).cast("long").alias("ord"), F.lit(11).cast("long").alias("source"), F.lit(14).cast("long").alias("target"), F.lit(None).cast("string").alias("marker"), F.lit(False).alias("dashed"))
    pages = raster.drawn(boxes.unionByName(corners), down.unionByName(bar))
    found = connectors.connectors(pages, _placed(boxes, raster.corners(boxes.unionByName(corners))), reach=int(raster.EDGE_GAP) + 4)
    return found.select("doc_id", "source", "target", "type")


@query(
    "WITH p AS (SELECT l_suppkey AS k, unnest(range(l_quantity::BIGINT, l_quantity::BIGINT + l_linenumber))::DOUBLE AS x, (l_partkey % 50)::DOUBLE AS y FROM lineitem),"
    " m AS (SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS cxx, var_pop(y) * count(*) AS cyy, covar_pop(x, y) * count(*) AS cxy FROM p GROUP BY k)"
    " SELECT k, n::BIGINT AS n, round(mx, 4) AS mx, round(my, 4) AS my, round(sqrt((cxx + cyy) / 2 + sqrt((cxx - cyy) ** 2 / 4 + cxy ** 2)), 4) AS long, round(sqrt((cxx + cyy) / 2 - sqrt((cxx - cyy) ** 2 / 4 + cxy ** 2)), 4) AS short FROM m"
)
def main_axes(spark, sf_dir):
    """M6: second moments of each supplier's lines, taken as runs of pixels."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") % 50).alias("line"), F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity").cast("long") + F.col("l_linenumber")).alias("end"))
    out = strokes.main_axes(rows, ["k"])
    return out.select("k", F.col("n").cast("long").alias("n"), *[F.round(c, 4).alias(c) for c in ("mx", "my", "long", "short")])


_PAIRS = "SELECT o_custkey AS doc_id, month(o_orderdate) AS a, 100 + (o_orderkey % 7) AS b, min(o_totalprice) AS d FROM orders GROUP BY ALL"


@query(
    f"WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, a, b) AS i FROM ({_PAIRS})),"
    " g AS (SELECT doc_id, 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS a, NULL::BIGINT AS b FROM (SELECT DISTINCT doc_id FROM p)"
    " UNION ALL SELECT p.doc_id, p.i, CASE WHEN free THEN list_concat(taken, [p.a, p.b]) ELSE taken END, CASE WHEN free THEN p.a END, CASE WHEN free THEN p.b END"
    " FROM (SELECT g.doc_id, g.taken, p.i, p.a::BIGINT AS a, p.b::BIGINT AS b, NOT list_has_any(g.taken, [p.a::BIGINT, p.b::BIGINT]) AS free FROM g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1) p)"
    " SELECT doc_id, a, b FROM g WHERE a IS NOT NULL"
)
def greedy_end_pairs(spark, sf_dir):
    """Months and days of a customer's orders as ends, paired by price, smallest first, each end once."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_custkey").alias("doc_id"), F.month("o_orderdate").cast("long").alias("a"), (100 + F.col("o_orderkey") % 7).cast("long").alias("b"), F.col("o_totalprice").alias("d"))
    return routing.matched_ends(rows).select("doc_id", "a", "b")


_HOPS = "SELECT s_nationkey AS doc_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, (s_suppkey % 11 + 1)::DOUBLE AS one, (s_suppkey % 17 + 1)::DOUBLE AS two FROM supplier"


@query(
    f"WITH RECURSIVE s AS ({_HOPS}), d AS (SELECT doc_id, k, 0::DOUBLE AS here, 1e18::DOUBLE AS before, 1e18::DOUBLE AS skip FROM s WHERE k = 1"
    " UNION ALL SELECT s.doc_id, s.k, least(d.here + p.one, d.skip), d.here, d.here + p.two FROM d JOIN s ON s.doc_id = d.doc_id AND s.k = d.k + 1 JOIN s p ON p.doc_id = d.doc_id AND p.k = d.k)"
    " SELECT doc_id, k AS id, here AS distance FROM d"
)
def weighted_distances(spark, sf_dir):
    """Shortest distances from a nation's first supplier, over steps to the next one and the one after."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("long").alias("k"), (F.col("s_suppkey") % 11 + 1).cast("double").alias("one"), (F.col("s_suppkey") % 17 + 1).cast("double").alias("two"))
    step = lambda n, c: s.select("doc_id", F.col("k").alias("source"), (F.col("k") + n).alias("target"), F.col(c).alias("length"))
    edges = step(1, "one").unionByName(step(2, "two")).join(s.select("doc_id", F.col("k").alias("target")), ["doc_id", "target"])
    return graph.shortest_paths(edges, s.where("k = 1").select("doc_id", F.col("k").alias("id"))).select("doc_id", "id", "distance")


_TWINS = "SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_suppkey % 3 AS source, l_suppkey % 3 + 1 AS target, (l_quantity % 10)::DOUBLE AS x1, (l_partkey % 12)::DOUBLE AS y1, (l_quantity % 10 + 6)::DOUBLE AS x2, (l_partkey % 12 + 8)::DOUBLE AS y2, l_discount::DOUBLE * 8 AS solidity FROM lineitem"


@query(
    f"WITH e AS (SELECT *, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS len FROM ({_TWINS})) SELECT doc_id, ord, solidity FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.doc_id = a.doc_id AND b.source = a.source AND b.target = a.target AND b.ord <> a.ord AND b.solidity >= a.solidity + 0.25"
    " AND (sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) < least(a.len, b.len) AND sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) < least(a.len, b.len) OR sqrt((a.x1 - b.x2) ** 2 + (a.y1 - b.y2) ** 2) < least(a.len, b.len) AND sqrt((a.x2 - b.x1) ** 2 + (a.y2 - b.y1) ** 2) < least(a.len, b.len)))"
)
def edges_without_twins(spark, sf_dir):
    """Of edges that lie beside each other those that aren't clearly less solid."""
    rows = table(spark, sf_dir, "lineitem")
    num = lambda c: c.cast("double")
    q, p, s = F.col("l_quantity") % 10, F.col("l_partkey") % 12, F.col("l_suppkey") % 3
    edges = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), s.alias("source"), (s + 1).alias("target"), num(q).alias("x1"), num(p).alias("y1"), num(q + 6).alias("x2"), num(p + 8).alias("y2"), (num(F.col("l_discount")) * 8).alias("solidity"))
    return spatial.without_twins(edges).select("doc_id", "ord", "solidity")


@query("SELECT o_orderkey AS id, o_orderpriority AS priority, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' WHEN '5-LOW' THEN 'later' ELSE o_orderpriority END AS due FROM orders")
def mapped_priorities(spark, sf_dir):
    """A lookup that lets unknown values pass."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    return relate.mapped(rows, "priority", {"1-URGENT": "now", "2-HIGH": "soon", "5-LOW": "later"}, "due")


@query("SELECT doc_id, 'too_long' AS rule, 0 AS ord, 'lang' AS message FROM documents WHERE length(lang) > 255 UNION ALL SELECT doc_id, 'too_long', 1, 'source' FROM documents WHERE length(source) > 255 UNION ALL SELECT doc_id, 'too_long', 2, 'body' FROM (SELECT doc_id, repeat(text, 20) AS body FROM documents) WHERE length(body) > 200000")
def overlong_documents(spark, sf_dir):
    """Texts beyond the bounds of a request (each text twenty times, as few are that long)."""
    rows = table(spark, sf_dir, "documents").withColumn("body", F.repeat("text", 20))
    return validate.too_long(rows, ("lang", "source"), "body")


@query("SELECT c_custkey AS id, c_mktsegment AS \"defaultValue\", c_name AS \"returnType\" FROM customer")
def editor_names(spark, sf_dir):
    """Attributes under the names that the editor uses, there and back."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("default_value"), F.col("c_name").alias("return_type"))
    return edits.to_editor(edits.to_wire(edits.to_editor(rows)))


_CLASSES = "SELECT s_suppkey // 4 AS doc_id, s_suppkey % 4 AS k, s_nationkey AS n, s_suppkey AS s, row_number() OVER (PARTITION BY s_suppkey // 4 ORDER BY s_suppkey % 4) AS id FROM supplier"


@query(
    f"WITH r AS ({_CLASSES}), e AS (SELECT a.doc_id, a.id AS x, b.id AS y, (a.n + v.t) % 4 AS m FROM r a JOIN (VALUES (0, 1), (0, 2), (1, 3)) v(f, t) ON v.f = a.k JOIN r b ON b.doc_id = a.doc_id AND b.k = v.t)"
    " SELECT doc_id::BIGINT AS doc_id, CASE WHEN n % 3 = 0 THEN 'interface' ELSE 'class' END AS what, 'class_' || id AS a, 'Supplier' || s AS b, 'nation' || n || ': int' AS attribute, 'run' || k AS method FROM r"
    " UNION ALL SELECT doc_id::BIGINT, CASE m WHEN 0 THEN 'association' WHEN 1 THEN 'inheritance' WHEN 2 THEN 'aggregation' ELSE 'composition' END, 'class_' || CASE WHEN m >= 2 THEN y ELSE x END, 'class_' || CASE WHEN m >= 2 THEN x ELSE y END, NULL, NULL FROM e"
)
def image_documents(spark, sf_dir):
    """Class boxes of suppliers drawn with lines between them, and their texts as a table, come back as the documents they were drawn from."""
    rows = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 4).alias("doc_id"), (F.col("s_suppkey") % 4).cast("long").alias("k"), F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("s"))
    rows = rows.withColumns({"x": (F.col("k") % 2 * 380.0).cast("double"), "y": (F.floor(F.col("k") / 2) * 330.0).cast("double"), "w": (150.0 + F.col("n") % 5 * 4).cast("double")})
    box = lambda ord, top, h: rows.select("doc_id", (F.col("k") + ord).alias("ord"), F.lit("action").alias("kind"), "x", (F.col("y") + top).alias("y"), "w", F.lit(h).alias("h"))
    boxes = box(0, 0.0, 140.0).unionByName(box(10, 0.0, 40.0)).unionByName(box(20, 37.0, 53.0))
    ends = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(t).alias("t")) for f, t in ((0, 1), (0, 2), (1, 3))])).alias("v")
    kind = F.array(*[F.lit(m) for m in ("arrow", "triangle", "hollow_diamond", "filled_diamond")])[(F.col("n") + F.col("v.t")).cast("int") % 4]
    edges = rows.select("doc_id", "k", "n", ends).where("k = v.f").select("doc_id", F.col("v.t").alias("ord"), F.col("k").alias("source"), F.col("v.t").cast("long").alias("target"), kind.alias("marker"), F.lit(False).alias("dashed"))
    pages = raster.drawn(boxes, edges)
    said = F.explode(F.filter(F.array(
        F.struct(F.lit(2.0).alias("at"), F.when(F.col("n") % 3 == 0, F.lit("<<interface>>")).alias("text")), F.struct(F.lit(18.0).alias("at"), F.concat(F.lit("Supplier"), "s").alias("text")),
        F.struct(F.lit(55.0).alias("at"), F.concat(F.lit("- nation"), "n", F.lit(": int")).alias("text")), F.struct(F.lit(105.0).alias("at"), F.concat(F.lit("+ run"), "k", F.lit("(): void")).alias("text")),
    ), lambda t: t["text"].isNotNull()))
    texts = rows.withColumn("t", said).join(raster.corners(boxes), "doc_id").select("doc_id", (F.col("x") + 10 - F.col("left")).alias("x"), (F.col("y") + F.col("t.at") - F.col("top")).alias("y"), F.lit(80.0).alias("w"), F.lit(14.0).alias("h"), "t.text")
    docs = assembly.class_documents(pages, texts, int(raster.EDGE_GAP) + 4)
    classes = docs.select("doc_id", F.explode("doc.classes").alias("c")).select("doc_id", F.col("c.kind").alias("what"), F.col("c.id").alias("a"), F.col("c.name").alias("b"), F.array_join(F.transform("c.attributes", lambda a: F.concat(a["name"], F.lit(": "), a["datatype"])), ", ").alias("attribute"), F.array_join(F.transform("c.methods", lambda m: m["name"]), ", ").alias("method"))
    none = F.lit(None).cast("string")
    return classes.unionByName(docs.select("doc_id", F.explode("doc.relationships").alias("r")).select("doc_id", F.col("r.type").alias("what"), F.col("r.source").alias("a"), F.col("r.destination").alias("b"), none.alias("attribute"), none.alias("method")))
