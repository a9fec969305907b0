"""Further registered queries: relationships, drawings, validation, catalog and text functions over the driver's tables.

An order stands in for a document, its lines for classes and edges; suppliers are boxes, customers points and connectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import geometry, phrasing, text
from weftgraph.operators import catalog, edits, graph, relate, spatial, validate
from weftgraph.plans.queries import _BOXES, _drawing, query, table

_CLASSES = "SELECT l_orderkey AS doc_id, l_linenumber AS id, 'Part' || (l_partkey % 20)::VARCHAR AS name, CASE WHEN l_linestatus = 'O' THEN 'interface' WHEN l_returnflag = 'R' THEN 'abstract' ELSE 'class' END AS kind FROM lineitem"
_EDGES = "SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_linenumber AS source, l_linenumber - 1 - l_partkey % 2 AS destination, CASE l_suppkey % 4 WHEN 0 THEN 'composition' WHEN 1 THEN 'aggregation' WHEN 2 THEN 'realization' ELSE 'inheritance' END AS type, CASE WHEN l_quantity > 25 THEN '0..*' ELSE '1' END AS multiplicity FROM lineitem"


def _model(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linestatus") == "O", "interface").when(F.col("l_returnflag") == "R", "abstract").otherwise("class")
    classes = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("Part"), F.col("l_partkey") % 20).alias("name"), kind.alias("kind"))
    way = F.col("l_suppkey") % 4
    edges = rows.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").alias("source"), (F.col("l_linenumber") - 1 - F.col("l_partkey") % 2).cast("int").alias("destination"),
        F.when(way == 0, "composition").when(way == 1, "aggregation").when(way == 2, "realization").otherwise("inheritance").alias("type"), F.when(F.col("l_quantity") > 25, "0..*").otherwise("1").alias("multiplicity"),
    )
    return classes, edges


@query(f"SELECT e.doc_id, e.source AS id, e.ord, c.name AS part, contains(e.multiplicity, '*') AS many FROM ({_EDGES}) e JOIN ({_CLASSES}) c ON c.doc_id = e.doc_id AND c.id = e.destination WHERE e.type IN ('composition', 'aggregation')")
def relationship_fields(spark, sf_dir):
    """The fields that a whole gets from its parts."""
    return relate.relationship_fields(*_model(spark, sf_dir))


@query(
    f"WITH f AS (SELECT e.doc_id, e.source AS id, e.ord, c.name FROM ({_EDGES}) e JOIN ({_CLASSES}) c ON c.doc_id = e.doc_id AND c.id = e.destination WHERE e.type IN ('composition', 'aggregation')),"
    " a AS (SELECT l_orderkey AS doc_id, l_linenumber AS id, 'Part' || (l_suppkey % 5)::VARCHAR AS name FROM lineitem) SELECT f.doc_id, f.id, f.name, min(f.ord) AS ord FROM f ANTI JOIN a ON a.doc_id = f.doc_id AND a.id = f.id AND a.name = f.name GROUP BY ALL"
)
def undeclared_fields(spark, sf_dir):
    """Derived fields that the class doesn't declare itself."""
    fields = relate.relationship_fields(*_model(spark, sf_dir)).withColumnRenamed("part", "name")
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("class_id"), F.concat(F.lit("Part"), F.col("l_suppkey") % 5).alias("name"))
    return relate.undeclared_fields(fields, own).select("doc_id", "id", "name", "ord")


_TYPES = "SELECT l_orderkey AS doc_id, l_linenumber AS id, 'Part' || (l_suppkey % 20)::VARCHAR AS t FROM lineitem"


@query(f"WITH c AS ({_CLASSES}), t AS ({_TYPES}) SELECT doc_id, id, string_agg(t, ',' ORDER BY t) AS imports FROM (SELECT DISTINCT t.doc_id, t.id, t.t FROM t JOIN c o ON o.doc_id = t.doc_id AND o.id = t.id WHERE t.t <> o.name AND EXISTS (SELECT 1 FROM c WHERE c.doc_id = t.doc_id AND c.name = t.t)) GROUP BY ALL")
def used_classes(spark, sf_dir):
    """Classes of the document that a type text names."""
    types = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id"), F.concat(F.lit("Part"), F.col("l_suppkey") % 20).alias("datatype"))
    return relate.used_classes(types, _model(spark, sf_dir)[0]).select("doc_id", "id", F.array_join("imports", ",").alias("imports"))


@query(f"WITH c AS ({_CLASSES}), t AS ({_TYPES}) SELECT t.doc_id, t.id, t.t AS name FROM t WHERE EXISTS (SELECT 1 FROM c WHERE c.doc_id = t.doc_id AND c.name = t.t)")
def mentioned_classes(spark, sf_dir):
    """Classes named inside a type text such as Map[String, X[]]."""
    types = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id"), F.concat(F.lit("Map[String, Part"), F.col("l_suppkey") % 20, F.lit("[]]")).alias("datatype"))
    return relate.mentioned_classes(types, _model(spark, sf_dir)[0]).select("doc_id", "id", "name")


@query(f"WITH c AS ({_CLASSES}), e AS ({_EDGES}) SELECT doc_id, id, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.doc_id = c.doc_id AND e.destination = c.id AND e.type = 'realization') THEN 'interface' ELSE kind END AS kind FROM c")
def realized_kinds(spark, sf_dir):
    """A5: a class that something realizes is an interface."""
    return relate.realized_interfaces(*_model(spark, sf_dir)).select("doc_id", "id", "kind")


@query(
    "WITH e AS (SELECT o_custkey AS doc_id, o_orderstatus AS source, substr(o_orderpriority, 1, 1) AS target, bool_or(o_totalprice > 250000) AS created, bool_or(o_totalprice < 20000) AS many, bool_or(o_totalprice > 150000) AS held, min(o_orderkey) AS ord FROM orders GROUP BY ALL)"
    " SELECT doc_id, source, target AS destination, CASE WHEN created THEN 'composition' WHEN held AND many THEN 'aggregation' WHEN held THEN 'association' ELSE 'dependency' END AS type, many, ord FROM e WHERE held OR created OR source <> target"
)
def classified_edges(spark, sf_dir):
    """Findings of one class about another, as one classified edge."""
    price = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("source"), F.substring("o_orderpriority", 1, 1).alias("target"), (price > 250000).alias("created"), (price < 20000).alias("many"), (price > 150000).alias("held"), F.col("o_orderkey").alias("ord"))
    return relate.class_edges(rows)


@query("SELECT o_custkey AS doc_id, o_orderpriority AS name, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS datatype FROM orders GROUP BY ALL")
def unanimous_types(spark, sf_dir):
    """A type is known only if all observations agree."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("datatype"))
    return relate.unanimous(rows, ["doc_id", "name"])


@query("SELECT doc_id, name, ord FROM (SELECT o_custkey AS doc_id, o_orderpriority AS name, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderstatus = 'P' DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_assignments(spark, sf_dir):
    """The first assignment of a name, constructors first."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") == "P").alias("is_constructor"))
    return relate.first_assigned(rows, ["doc_id", "name"]).select("doc_id", "name", "ord")


@query("SELECT doc_id, id, string_agg(DISTINCT module, ',' ORDER BY module) AS imports FROM (SELECT o_custkey AS doc_id, o_orderstatus AS id, o_orderpriority AS mapped FROM orders) JOIN (VALUES ('1-URGENT', 'java.util.List'), ('2-HIGH', 'java.util.Map'), ('5-LOW', 'java.util.List')) m(mapped, module) USING (mapped) GROUP BY ALL")
def standard_imports(spark, sf_dir):
    """Imports that mapped types need, each once."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("id"), F.col("o_orderpriority").alias("mapped"))
    out = relate.standard_imports(rows, {"1-URGENT": "java.util.List", "2-HIGH": "java.util.Map", "5-LOW": "java.util.List"})
    return out.select("doc_id", "id", F.array_join("imports", ",").alias("imports"))


@query("SELECT doc_id, source, destination, ord FROM (SELECT o_custkey AS doc_id, o_orderstatus AS source, CASE WHEN o_totalprice > 150000 THEN 'F' ELSE 'O' END AS destination, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_totalprice > 150000 ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1 AND source <> destination")
def first_lines(spark, sf_dir):
    """A5: of drawn lines between two boxes the first, none from a box to itself."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("source"), F.when(F.col("o_totalprice") > 150000, "F").otherwise("O").alias("destination"), F.col("o_orderkey").alias("ord"))
    return relate.first_of_pair(rows)


@query(
    f"WITH b AS ({_BOXES}), p AS (SELECT c_nationkey AS doc_id, c_custkey AS point, (c_custkey % 331)::DOUBLE AS px, (c_custkey % 257)::DOUBLE AS py FROM customer),"
    " d AS (SELECT p.doc_id, point, ord, (px - greatest(x, least(px, x + w))) ** 2 + (py - greatest(y, least(py, y + h))) ** 2 AS d FROM p JOIN b USING (doc_id)), k AS (SELECT doc_id, point, ord, row_number() OVER (PARTITION BY doc_id, point ORDER BY d, ord) AS r FROM d)"
    " SELECT p.doc_id, p.point, k.ord AS box_ord FROM p LEFT JOIN k ON k.doc_id = p.doc_id AND k.point = p.point AND k.r = 1"
)
def nearest_of_all_boxes(spark, sf_dir):
    """The nearest of all boxes of a drawing, however far it is."""
    return spatial.nearest_of_all(*_drawing(spark, sf_dir)).select("doc_id", "point", "box_ord")


@query(
    f"WITH b AS ({_BOXES}), p AS (SELECT c_nationkey AS doc_id, c_custkey AS ord, e, CASE WHEN e = 0 THEN c_custkey % 331 ELSE c_custkey % 97 END::DOUBLE AS px, CASE WHEN e = 0 THEN c_custkey % 257 ELSE c_custkey % 211 END::DOUBLE AS py FROM customer, (VALUES (0), (1)) v(e)),"
    " d AS (SELECT p.doc_id, p.ord, e, b.ord AS box, row_number() OVER (PARTITION BY p.doc_id, p.ord, e ORDER BY (px - greatest(x, least(px, x + w))) ** 2 + (py - greatest(y, least(py, y + h))) ** 2, b.ord) AS r FROM p JOIN b USING (doc_id) WHERE (px - greatest(x, least(px, x + w))) ** 2 + (py - greatest(y, least(py, y + h))) ** 2 < 400)"
    " SELECT s.doc_id, s.ord, s.box AS source, t.box AS target FROM d s JOIN d t ON s.doc_id = t.doc_id AND s.ord = t.ord WHERE s.r = 1 AND t.r = 1 AND s.e = 0 AND t.e = 1 AND s.box <> t.box"
)
def drawn_adjacency(spark, sf_dir):
    """Connectors whose ends lie at two different boxes."""
    points, boxes = _drawing(spark, sf_dir)
    lines = points.select("doc_id", F.col("point").alias("ord"), F.col("px").alias("x1"), F.col("py").alias("y1"), (F.col("point") % 97 * 1.0).alias("x2"), (F.col("point") % 211 * 1.0).alias("y2"))
    return spatial.adjacency(lines, boxes)


_MEETS = f"WITH b AS ({_BOXES}), o AS (SELECT a.doc_id, a.ord AS i, c.ord AS j, greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS area FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.ord < c.ord)"


@query(f"{_MEETS} SELECT doc_id, ord FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = b.doc_id AND o.j = b.ord AND area > 0.15 * 960)")
def boxes_without_overlaps(spark, sf_dir):
    """Of two boxes that share much of their area the second goes, as they are equally large here."""
    return spatial.without_overlaps(_drawing(spark, sf_dir)[1]).select("doc_id", "ord")


@query(f"{_MEETS} SELECT DISTINCT doc_id, EXISTS (SELECT 1 FROM o WHERE o.doc_id = b.doc_id AND area > 0) AS overlapping FROM b")
def any_overlap(spark, sf_dir):
    """J16."""
    return spatial.any_overlap(_drawing(spark, sf_dir)[1])


@query(
    "WITH p AS (SELECT c_custkey AS id, (c_custkey % 331)::DOUBLE AS px, (c_custkey % 257)::DOUBLE AS py, (c_custkey % 7 * 10)::DOUBLE AS x1, (c_custkey % 5 * 10)::DOUBLE AS y1, (c_custkey % 11 * 10)::DOUBLE AS x2, (c_custkey % 13 * 10)::DOUBLE AS y2 FROM customer),"
    " t AS (SELECT *, CASE WHEN x1 = x2 AND y1 = y2 THEN 0 ELSE greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / nullif((x2 - x1) ** 2 + (y2 - y1) ** 2, 0))) END AS t FROM p)"
    " SELECT id, round(sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2), 6) AS d, round(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 6) AS length FROM t"
)
def segment_distances(spark, sf_dir):
    """Distances of points to segments, and the segments' lengths."""
    k = F.col("c_custkey")
    c = [F.expr(x) for x in ("c_custkey % 331D", "c_custkey % 257D")] + [(k % n * 10).cast("double") for n in (7, 5, 11, 13)]
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.round(geometry.segment_distance(*c), 6).alias("d"), F.round(geometry.distance(*c[2:]), 6).alias("length"))


@query(
    "SELECT c_custkey AS id, floor(c_acctbal / 20 + 0.5)::BIGINT * 20 AS snapped, greatest(0.0, least(5000.0, c_acctbal)) AS clamped, least(c_custkey % 331, c_custkey % 97)::BIGINT AS x, least(c_custkey % 257, c_custkey % 211)::BIGINT AS y, abs(c_custkey % 97 - c_custkey % 331)::BIGINT AS width, abs(c_custkey % 211 - c_custkey % 257)::BIGINT AS height,"
    " c_custkey % 331 + 5 BETWEEN 100 AND 200 AND c_custkey % 257 + 5 BETWEEN 50 AND 250 AS inside FROM customer"
)
def box_arithmetic(spark, sf_dir):
    """Grid lines, limits, boxes between corners, and whether a box's centre lies in another."""
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    n = geometry.normalized(k % 331, k % 257, k % 97, k % 211)
    inside = geometry.contains_centre(F.lit(100), F.lit(50), F.lit(100), F.lit(200), k % 331, k % 257, F.lit(10), F.lit(10))
    return table(spark, sf_dir, "customer").select(k.alias("id"), geometry.snap(b).alias("snapped"), geometry.clamp(b, 0.0, 5000.0).alias("clamped"), n["x"].alias("x"), n["y"].alias("y"), n["width"].alias("width"), n["height"].alias("height"), inside.alias("inside"))


@query(
    "WITH p AS (SELECT c_custkey AS id, (c_custkey % 331 - 150)::DOUBLE AS dx, (c_custkey % 257 - 120)::DOUBLE AS dy FROM customer), s AS (SELECT *, least(coalesce(30 / nullif(abs(dx), 0), 1e300), coalesce(20 / nullif(abs(dy), 0), 1e300)) AS r, 1 / nullif(abs(dx) / 30 + abs(dy) / 20, 0) AS d, 1 / nullif(sqrt((dx / 30) ** 2 + (dy / 20) ** 2), 0) AS e FROM p)"
    " SELECT id, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dx * r END, 6) AS rx, round(CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE dy * r END, 6) AS ry, round(dx * coalesce(d, 0), 6) AS dx, round(dy * coalesce(d, 0), 6) AS dy, round(dx * coalesce(e, 0), 6) AS ex, round(dy * coalesce(e, 0), 6) AS ey FROM s"
)
def shape_anchors(spark, sf_dir):
    """M4: where a line from the centre leaves a rectangle, a diamond and an ellipse."""
    k, zero = F.col("c_custkey"), F.lit(0.0)
    at = {s: geometry.anchor(s, zero, zero, F.lit(60.0), F.lit(40.0), (k % 331 - 150).cast("double"), (k % 257 - 120).cast("double")) for s in ("rect", "diamond", "ellipse")}
    return table(spark, sf_dir, "customer").select(k.alias("id"), *[F.round(at[s][c], 6).alias(s[0] + c) for s in at for c in "xy"])


@query(
    "WITH s AS (SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'filled_diamond' WHEN '2-HIGH' THEN 'hollow_diamond' WHEN '3-MEDIUM' THEN 'triangle' END AS m, o_orderstatus = 'O' AS dashed FROM orders)"
    " SELECT id, CASE WHEN m = 'filled_diamond' THEN 'composition' WHEN m = 'hollow_diamond' THEN 'aggregation' WHEN m = 'triangle' THEN CASE WHEN dashed THEN 'realization' ELSE 'inheritance' END WHEN dashed THEN 'dependency' ELSE 'association' END AS type, coalesce(m IN ('filled_diamond', 'hollow_diamond'), false) AS marker_is_source FROM s"
)
def marker_meanings(spark, sf_dir):
    """What an end marker and a line style mean."""
    p = F.col("o_orderpriority")
    marker = F.when(p == "1-URGENT", "filled_diamond").when(p == "2-HIGH", "hollow_diamond").when(p == "3-MEDIUM", "triangle")
    said = geometry.drawn_type(marker, F.col("o_orderstatus") == "O")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), said["type"].alias("type"), said["marker_is_source"].alias("marker_is_source"))


_FLOW = "WITH n AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE l_partkey % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'end' WHEN 2 THEN 'start' ELSE 'action' END AS type FROM lineitem), d AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 - l_suppkey % 2 AS ord, count(*) AS c FROM lineitem GROUP BY ALL)"


def _steps(spark, sf_dir):
    rows, way = table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 4
    nodes = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").cast("string").alias("id"), F.when(way == 0, "decision").when(way == 1, "end").when(way == 2, "start").otherwise("action").alias("type"))
    return nodes, rows.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1 - F.col("l_suppkey") % 2).cast("string").alias("source"), F.col("l_linenumber").cast("string").alias("target"))


@query(
    f"{_FLOW} SELECT doc_id, 'out_degree' AS rule, ord, ord::VARCHAR || ': ' || m AS message FROM (SELECT n.doc_id, n.ord, CASE WHEN type = 'decision' THEN CASE WHEN coalesce(c, 0) < 2 THEN 'a decision needs at least two outgoing edges' END WHEN type = 'end' THEN CASE WHEN coalesce(c, 0) > 0 THEN 'an end has no outgoing edge' END WHEN coalesce(c, 0) = 0 THEN 'a node needs an outgoing edge' END AS m"
    " FROM n LEFT JOIN d ON d.doc_id = n.doc_id AND d.ord = n.ord) WHERE m IS NOT NULL"
)
def out_degree_problems(spark, sf_dir):
    """Nodes whose outgoing edges don't fit their type."""
    return validate.out_degree_problems(*_steps(spark, sf_dir))


@query(
    f"{_FLOW}, k AS (SELECT doc_id, count(*) FILTER (type = 'start') AS s, count(*) FILTER (type = 'end') AS e FROM n GROUP BY doc_id)"
    " SELECT doc_id, CASE WHEN s <> 1 THEN 'exactly one start node is needed, found ' || s::VARCHAR ELSE 'at least one end node is needed' END AS message FROM k WHERE s <> 1 OR e = 0"
)
def first_problem(spark, sf_dir):
    """The first violation of each document."""
    return validate.first_violation(validate.start_and_end(_steps(spark, sf_dir)[0]))


@query("SELECT doc_id, 'too_long' AS rule, CASE f WHEN 'lang' THEN 0 ELSE 1 END AS ord, f AS message FROM (SELECT doc_id, unnest(['lang', 'text']) AS f, unnest([length(lang), length(text)]) AS n FROM documents) WHERE n > 255")
def too_long_fields(spark, sf_dir):
    """P10: fields over 255 characters."""
    return validate.too_long(table(spark, sf_dir, "documents"), ("lang", "text"))


@query("SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT < epoch(o_orderdate + INTERVAL 1 DAY * (o_custkey % 3 - 1))::BIGINT AND o_custkey % 5 <> 0 AS cut FROM orders")
def token_cut_offs(spark, sf_dir):
    """Q2: tokens issued before the password changed (every fifth account never changed it)."""
    changed = F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_custkey") % 3 - 1).cast("int")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), catalog.token_cut_off(F.col("o_orderdate"), changed).alias("cut"))


@query("SELECT c_name || '@x' AS email, lower(c_name) AS username, taken FROM customer, (VALUES ('email'), ('username')) t(taken) WHERE CASE taken WHEN 'email' THEN c_custkey % 3 = 0 ELSE c_custkey % 2 = 0 END")
def taken_accounts(spark, sf_dir):
    """Q1: candidates whose email or username is taken (a third and a half of the customers have accounts)."""
    rows = table(spark, sf_dir, "customer")
    users = rows.select(F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("@x"))).alias("email"), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).alias("username"))
    return catalog.taken_accounts(users, rows.select(F.concat("c_name", F.lit("@x")).alias("email"), F.lower("c_name").alias("username")))


@query("SELECT c_custkey AS id, c_name AS username FROM customer WHERE lower(c_name) = (SELECT lower(max(c_name)) FROM customer)")
def account_of_name(spark, sf_dir):
    """An account by its name, without regard to case."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    return catalog.find_user(users, username=users.agg(F.max(F.upper("username"))).first()[0])


@query("SELECT p_partkey AS id, list_filter([CASE WHEN length(trim(p_name)) NOT BETWEEN 1 AND 20 THEN NULL END, CASE WHEN p_brand <> 'Brand#1' AND p_size % 3 = 0 THEN 'project_type' END, CASE WHEN CASE WHEN p_size % 3 = 1 THEN p_size % 2 ELSE p_size % 5 END = 0 THEN 'payload' END], lambda x: x IS NOT NULL)::VARCHAR AS problems FROM part")
def project_problems(spark, sf_dir):
    """Problems of new projects' fields."""
    size = F.col("p_size")
    kind = F.when(size % 3 == 1, "activity").when((size % 3 == 0) & (F.col("p_brand") != "Brand#1"), "drawing").otherwise("uml")
    found = catalog.valid_project(F.col("p_name"), kind, size % 5 != 0, size % 2 != 0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("problems"))


@query("SELECT l_orderkey AS doc_id, max(l_partkey) + 1 AS next FROM lineitem GROUP BY l_orderkey")
def next_numbers(spark, sf_dir):
    """One more than the largest number behind a prefix."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(F.concat(F.lit("node_"), "l_partkey"), F.concat(F.lit("n"), "l_suppkey"))).alias("id"))
    return edits.next_number(rows, "node_")


@query("WITH e AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey % 7 AS source, l_partkey % 7 AS target FROM lineitem) SELECT doc_id, source, target FROM e WHERE source <> target AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = doc_id AND source = o_custkey % 7 AND target = (o_custkey + 1) % 7)")
def edges_to_add(spark, sf_dir):
    """Wanted edges that may be added."""
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 7).alias("source"), (F.col("l_partkey") % 7).alias("target"))
    have = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 7).alias("source"), ((F.col("o_custkey") + 1) % 7).alias("target"))
    return edits.new_edges(have, wanted)


@query(f"WITH RECURSIVE c AS ({_CLASSES}), e AS (SELECT * FROM ({_EDGES}) WHERE type IN ('realization', 'inheritance')), r AS (SELECT doc_id, source AS origin, destination AS id, 1 AS depth FROM e UNION SELECT r.doc_id, r.origin, e.destination, depth + 1 FROM r JOIN e ON e.doc_id = r.doc_id AND e.source = r.id) SELECT doc_id, origin, id, min(depth)::BIGINT AS depth FROM r GROUP BY ALL")
def class_ancestors(spark, sf_dir):
    """G1: all classes above each class."""
    return graph.ancestors(*_model(spark, sf_dir))


@query(
    f"WITH RECURSIVE c AS ({_CLASSES}), e AS (SELECT * FROM ({_EDGES}) WHERE type IN ('realization', 'inheritance')), r AS (SELECT doc_id, source AS origin, destination AS id, 1 AS depth FROM e UNION SELECT r.doc_id, r.origin, e.destination, depth + 1 FROM r JOIN e ON e.doc_id = r.doc_id AND e.source = r.id),"
    " m AS (SELECT l_orderkey AS doc_id, l_linenumber AS class_id, 'run' || (l_suppkey % 3)::VARCHAR AS name, l_tax > 0.04 AS abstract FROM lineitem), due AS (SELECT r.doc_id, r.origin, m.name, min(r.depth * 100 + r.id) AS k FROM r JOIN c ON c.doc_id = r.doc_id AND c.id = r.id JOIN m ON m.doc_id = r.doc_id AND m.class_id = r.id JOIN c o ON o.doc_id = r.doc_id AND o.id = r.origin WHERE (c.kind = 'interface' OR m.abstract) AND o.kind <> 'abstract' GROUP BY ALL)"
    " SELECT doc_id, origin AS id, name, (k % 100)::INTEGER AS from_class FROM due WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = due.doc_id AND m.class_id = due.origin AND m.name = due.name)"
)
def inherited_obligations(spark, sf_dir):
    """G1: methods that a class owes, from the nearest class that asks."""
    classes, edges = _model(spark, sf_dir)
    methods = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("class_id"), F.lit(0).alias("ord"), F.concat(F.lit("run"), F.col("l_suppkey") % 3).alias("name"), (F.col("l_tax") > 0.04).alias("abstract"))
    return graph.obligations(classes, methods, edges)


@query(
    "WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, 10 + l_suppkey % 4 AS j, l_quantity AS d FROM lineitem), b AS (SELECT doc_id, i, j, d FROM c UNION ALL SELECT doc_id, j, i, d FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY d, j) AS r FROM b)"
    " SELECT DISTINCT x.doc_id, x.i, x.j, x.d FROM r x JOIN r y ON x.doc_id = y.doc_id AND x.i = y.j AND x.j = y.i WHERE x.r = 1 AND y.r = 1 AND x.i < x.j"
)
def mutual_nearest(spark, sf_dir):
    """Pairs in which each is the other's nearest."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("i"), (10 + F.col("l_suppkey") % 4).alias("j"), F.col("l_quantity").alias("d"))
    return spatial.mutual_nearest(rows, ["doc_id"]).distinct()


@query(
    "WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS o, CASE WHEN l_returnflag = 'R' THEN 'note' ELSE 'class' END AS kind FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS n FROM s WHERE kind <> 'note')"
    " SELECT doc_id, a.n::BIGINT AS source, b.n::BIGINT AS target FROM (SELECT l_orderkey AS doc_id, l_linenumber AS s, l_linenumber + 1 AS t FROM lineitem) e JOIN k a USING (doc_id) JOIN k b USING (doc_id) WHERE a.o = e.s AND b.o = e.t"
)
def edges_without_notes(spark, sf_dir):
    """Edges between the shapes that are left once notes are gone, by their new numbers."""
    rows = table(spark, sf_dir, "lineitem")
    shapes = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_returnflag") == "R", "note").otherwise("class").alias("kind"))
    edges = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("source"), (F.col("l_linenumber") + 1).alias("target"))
    return spatial.without_kind(shapes, edges)[1].select("doc_id", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"))


@query(
    r"SELECT p_partkey AS id, lower(left(n, 1)) || substr(n, 2) AS lowered, replace(n || chr(34), chr(34), chr(39)) AS label, split_part(n || '.' || p_brand, '.', -1) AS tail, upper(left(n, 1)) || lower(substr(n, 2)) AS said, length(regexp_replace(n, '[^A-Z]', '', 'g')) AS capitals, p_brand LIKE '%*%' AS many FROM (SELECT *, upper(left(p_name, 1)) || substr(p_name, 2) AS n FROM part)"
)
def name_forms(spark, sf_dir):
    """Forms of names."""
    n = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 1 << 30))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text.decapitalize(n).alias("lowered"), text.escape_label(F.concat(n, F.lit('"'))).alias("label"), text.last_segment(F.concat_ws(".", n, "p_brand")).alias("tail"),
        text.sentence(F.split(n, " ")).alias("said"), text.capitals(n).alias("capitals"), text.is_many("p_brand").alias("many"),
    )


@query(
    "SELECT p_partkey AS id, 'a' || p_partkey::VARCHAR AS name, CASE p_size % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'String[]' ELSE 'Object' END AS datatype, CASE p_size % 5 WHEN 0 THEN 'private' WHEN 1 THEN 'protected' WHEN 2 THEN 'package' ELSE 'public' END AS visibility, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR END AS default_value FROM part"
)
def attribute_lines(spark, sf_dir):
    """Attribute lines that are made of a part's size, read again."""
    s = F.col("p_size")
    mark = F.when(s % 5 == 0, "-").when(s % 5 == 1, "#").when(s % 5 == 2, "~").when(s % 5 == 3, "+").otherwise("")
    line = F.concat(mark, F.lit("  a"), "p_partkey", F.when(s % 3 == 0, " ; int").when(s % 3 == 1, " :  String [ ]").otherwise(""), F.when(s % 2 == 0, F.concat(F.lit(" = "), s)).otherwise(""), F.lit(" |"))
    got = text.attribute_line(line)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[got[c].alias(c) for c in ("name", "datatype", "visibility", "default_value")])


@query(
    "SELECT p_partkey AS id, 'do' || p_partkey::VARCHAR AS name, CASE p_size % 3 WHEN 0 THEN 'private' ELSE 'public' END AS visibility, CASE WHEN p_size % 2 = 0 THEN 'x int,y Object' ELSE '' END AS parameters, CASE WHEN p_size % 5 = 0 THEN 'float' ELSE 'void' END AS return_type FROM part"
)
def method_lines(spark, sf_dir):
    """Method lines that are made of a part's size, read again."""
    s = F.col("p_size")
    line = F.concat(F.when(s % 3 == 0, "- ").otherwise("+"), F.lit("do"), "p_partkey", F.when(s % 2 == 0, "(x: int, y)").otherwise("( )"), F.when(s % 5 == 0, " : float").otherwise(""))
    got = text.method_line(line)
    given = F.array_join(F.transform(got["parameters"], lambda p: F.concat_ws(" ", p["name"], p["datatype"])), ",")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), got["name"].alias("name"), got["visibility"].alias("visibility"), given.alias("parameters"), got["return_type"].alias("return_type"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'Calculate total' || l_suppkey::VARCHAR WHEN 1 THEN 'Add line' || l_linenumber::VARCHAR || ' to orders' WHEN 2 THEN 'Return ' || l_suppkey::VARCHAR WHEN 3 THEN 'Decrease stock' ELSE 'Create Order' || l_linenumber::VARCHAR END AS phrase FROM lineitem"
)
def statement_phrases(spark, sf_dir):
    """phrases of statements that are made of a line's numbers."""
    k = F.col("l_partkey") % 5
    said = F.when(k == 0, F.concat(F.lit("int total"), "l_suppkey", F.lit(" = a * 2"))).when(k == 1, F.concat(F.lit("shop.orders.add(line"), "l_linenumber", F.lit(", 1)"))).when(k == 2, F.concat(F.lit("return "), "l_suppkey", F.lit(";"))).when(k == 3, "this.stock -= 1").otherwise(F.concat(F.lit("o = new Order"), "l_linenumber", F.lit("()")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", phrasing.phrase(said).alias("phrase"))


@query("WITH p AS (SELECT s_nationkey AS doc_id, s_suppkey AS ord, s_suppkey % 37 * 3.0::DOUBLE AS x, s_suppkey % 11 * 5.0::DOUBLE AS y, 10.0::DOUBLE AS w, 6.0::DOUBLE AS h FROM supplier) SELECT doc_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM p GROUP BY doc_id")
def label_bounds(spark, sf_dir):
    """A10: the bounds of text pieces."""
    s = F.col("s_suppkey")
    return spatial.bounding_box(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), (s % 37 * 3.0).alias("x"), (s % 11 * 5.0).alias("y"), F.lit(10.0).alias("w"), F.lit(6.0).alias("h")))

