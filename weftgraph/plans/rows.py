"""Registered queries of row-wise operators that had none: texts and names, hints, checks of edges, cascades, copies and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import catalog, edits, graph, relate, routing, validate
from weftgraph.plans.queries import query, table

_FIXES = [(";", ":"), ("—", "-"), ("–", "-"), ("·", "."), ("“", '"'), ("”", '"'), ("‘", "''"), ("’", "''"), ("{)", "()"), ("(}", "()")]
_FIXED = "text"
for _a, _b in _FIXES:
    _FIXED = f"replace({_FIXED}, '{_a}', '{_b}')"
_BLANK = r"[\x09-\x0D\x20\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(rf"SELECT doc_id, sha256(regexp_replace(trim(regexp_replace({_FIXED}, '{_BLANK}', ' ', 'g')), '[\s|_\\/!]+$', '')) AS line FROM documents WHERE text IS NOT NULL")
def normalised_lines(spark, sf_dir):
    """whole texts with misreads repaired, blanks squeezed and border noise cut off."""
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.sha2(T.normalize("text"), 256).alias("line"))


@query("SELECT doc_id, len(l)::INTEGER AS n, sha256(array_to_string(l, '|')) AS lines FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)")
def lines_of_texts(spark, sf_dir):
    """the trimmed lines of whole texts that aren't empty."""
    rows = table(spark, sf_dir, "documents").where("text is not null").withColumn("l", T.text_lines("text"))
    return rows.select("doc_id", F.size("l").alias("n"), F.sha2(F.array_join("l", "|"), 256).alias("lines"))


_WORD = "unnest(regexp_extract_all(text, '[A-Za-z_]+'))"


@query(f"SELECT word, regexp_replace(CASE WHEN regexp_matches(word, '^ls[A-Z]') THEN 'is' || substr(word, 3) ELSE word END, '([a-z])ln([A-Z])', '\\1In\\2', 'g') AS repaired, true AS valid FROM (SELECT DISTINCT 'ls' || upper(w[1]) || substr(w, 2) AS word FROM (SELECT {_WORD} AS w FROM documents)) WHERE length(word) > 2")
def repaired_identifiers(spark, sf_dir):
    """F8: words of all texts behind a misread prefix."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z_]+)"), 1)).alias("w"))
    word = F.concat(F.lit("ls"), F.upper(F.substring("w", 1, 1)), F.substring("w", 2, 1 << 30))
    rows = words.select(word.alias("word")).distinct().where(F.length("word") > 2)
    return rows.select("word", T.repair_identifier(F.col("word")).alias("repaired"), T.is_identifier(F.col("word")).alias("valid"))


_MARKED = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '__' || c_mktsegment || '__' WHEN 1 THEN '__' || c_mktsegment WHEN 2 THEN '_' || c_mktsegment ELSE c_mktsegment END AS name FROM customer"


@query(f"SELECT id, name, CASE WHEN name LIKE '\\_\\_%' ESCAPE '\\' THEN CASE WHEN name LIKE '%\\_\\_' ESCAPE '\\' THEN 'public' ELSE 'private' END WHEN name LIKE '\\_%' ESCAPE '\\' THEN 'protected' ELSE 'public' END AS python, CASE WHEN name LIKE '\\_%' ESCAPE '\\' THEN 'private' ELSE 'public' END AS javascript FROM ({_MARKED})")
def visibilities_of_names(spark, sf_dir):
    """visibilities that underscores mean."""
    k, s = F.col("c_custkey") % 4, F.col("c_mktsegment")
    name = F.when(k == 0, F.concat(F.lit("__"), s, F.lit("__"))).when(k == 1, F.concat(F.lit("__"), s)).when(k == 2, F.concat(F.lit("_"), s)).otherwise(s)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"))
    return rows.select("id", "name", T.visibility_of_name("name", "python").alias("python"), T.visibility_of_name("name", "javascript").alias("javascript"))


@query(
    "WITH c AS (SELECT p_brand AS doc_id, min(p_type) AS t, string_split(lower(min(p_type)), ' ')[-1] AS class FROM part GROUP BY 1), n AS (SELECT p_partkey, p_brand AS doc_id, string_split(lower(p_type), ' ')[-1] || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS last FROM part)"
    " SELECT p_partkey AS id, CASE WHEN last = class THEN class WHEN last = class || 's' AND class NOT LIKE '%e' THEN 'List[' || class || ']' END AS hint FROM n JOIN c USING (doc_id)"
)
def hinted_parts(spark, sf_dir):
    """The last words of parts' types, half of them in the plural, against the class of their brand."""
    part = table(spark, sf_dir, "part")
    last = lambda c: F.element_at(F.split(F.lower(c), " "), -1)
    classes = part.groupBy(F.col("p_brand").alias("doc_id")).agg(last(F.min("p_type")).alias("name"))
    names = part.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("id"), F.concat_ws("_", F.regexp_replace(F.lower("p_type"), " [^ ]*$", ""), F.concat(last("p_type"), F.when(F.col("p_partkey") % 2 == 0, "s").otherwise(""))).alias("name"))
    return relate.hinted_types(names, classes).select("id", "hint")


_LINKS = "SELECT o_custkey AS doc_id, o_orderkey AS id, (o_orderkey % 7)::VARCHAR AS source, (o_orderkey % 11)::VARCHAR AS target, o_orderkey AS ord FROM orders"


@query(
    f"WITH e AS ({_LINKS}), n AS (SELECT DISTINCT o_custkey AS doc_id, (o_orderkey % 9)::VARCHAR AS id FROM orders)"
    " SELECT e.doc_id, 'unknown_source_node' AS rule, 2 * ord AS ord, 'Edge ''' || e.id || ''' references unknown source node ''' || source || '''' AS message FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = e.doc_id AND n.id = e.source)"
    " UNION ALL SELECT e.doc_id, 'unknown_target_node', 2 * ord + 1, 'Edge ''' || e.id || ''' references unknown target node ''' || target || '''' FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = e.doc_id AND n.id = e.target)"
)
def dangling_flow_edges(spark, sf_dir):
    """Edges of flows whose ends are no node."""
    rows = table(spark, sf_dir, "orders")
    text = lambda n: (F.col("o_orderkey") % n).cast("string")
    edges = rows.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"), text(7).alias("source"), text(11).alias("target"), F.col("o_orderkey").alias("ord"))
    nodes = rows.select(F.col("o_custkey").alias("doc_id"), text(9).alias("id"))
    return validate.unknown_ends(edges, nodes, {"source": "source node", "target": "target node"}, "Edge")


@query(
    "WITH g AS (SELECT l_orderkey AS doc_id, l_linenumber AS id FROM lineitem WHERE l_returnflag = 'R')"
    " SELECT l_orderkey AS doc_id, l_linenumber AS source, l_linenumber + 1 AS destination, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = l.l_orderkey AND g.id IN (l.l_linenumber, l.l_linenumber + 1)) GROUP BY ALL"
)
def edges_after_deletion(spark, sf_dir):
    """Relationships that are left when returned lines are deleted as classes."""
    rows = table(spark, sf_dir, "lineitem")
    boxes = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id"))
    edges = boxes.select("doc_id", F.col("id").alias("source"), (F.col("id") + 1).alias("destination"))
    _, left = edits.delete_with_edges(boxes, edges, rows.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id")).distinct())
    return left.groupBy("doc_id", "source", "destination").agg(F.count("*").alias("n"))


@query(
    "WITH r AS (SELECT s_nationkey AS doc_id, 'class_' || s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS ord, s_suppkey AS k FROM supplier), m AS (SELECT doc_id, max(k) AS k, max(ord) AS ord FROM r GROUP BY 1),"
    " c AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM r WHERE k % 3 = 0)"
    " SELECT doc_id, id, ord::INTEGER AS ord, k::DOUBLE AS x FROM r UNION ALL SELECT c.doc_id, 'class_' || (m.k + i), (m.ord + i)::INTEGER, (c.k + 32)::DOUBLE FROM c JOIN m USING (doc_id)"
)
def copied_boxes(spark, sf_dir):
    """Every third supplier's box copied, with a fresh id and a step aside."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.concat(F.lit("class_"), "s_suppkey").alias("id"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("ord"), F.struct(F.col("s_suppkey").cast("double").alias("x"), F.lit(0.0).alias("y")).alias("position"), "s_suppkey")
    chosen = rows.where("s_suppkey % 3 = 0").select("doc_id", "id")
    return edits.duplicated(rows.drop("s_suppkey"), chosen, "class_").select("doc_id", "id", "ord", F.col("position.x").alias("x"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'renamed ' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey::VARCHAR ELSE c_mktsegment END AS document, c_custkey % 5 = 0 AS updated FROM customer")
def partial_updates(spark, sf_dir):
    """P5: of changes only what isn't null overwrites."""
    rows = table(spark, sf_dir, "customer")
    then = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    projects = rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("document"), then.alias("updated_at"))
    changes = rows.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("renamed "), "c_custkey").alias("name"), F.when(F.col("c_custkey") % 10 == 0, F.col("c_nationkey").cast("string")).alias("document"))
    return catalog.updated(projects, changes).select("id", "name", "document", (F.col("updated_at") > then).alias("updated"))


@query("SELECT o_orderkey AS id, o_custkey AS owner_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def projects_of_users_left(spark, sf_dir):
    """When users are deleted their projects go with them."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    projects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"))
    return catalog.without_users(customers, projects, customers.where("c_acctbal < 0"))[1]


_FLOW = "SELECT s_nationkey AS doc_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k, s_suppkey % 4 = 0 AS wall FROM supplier"


@query(f"WITH s AS ({_FLOW}) SELECT a.doc_id, a.k AS id, b.k AS target, NOT EXISTS (SELECT 1 FROM s w WHERE w.doc_id = a.doc_id AND w.wall AND w.k >= a.k AND w.k < b.k) AS reaches FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.k = a.k + 3")
def reach_before_boundaries(spark, sf_dir):
    """Whether the supplier three on is come to without leaving a boundary on the way."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("k"), (F.col("s_suppkey") % 4 == 0).alias("wall"))
    on = s.select("doc_id", F.col("k").alias("source"), (F.col("k") + 1).alias("target"))
    pairs = s.select("doc_id", F.col("k").alias("id"), (F.col("k") + 3).alias("target")).join(s.select("doc_id", F.col("k").alias("target")), ["doc_id", "target"])
    got = graph.reaches(on, pairs, s.where("wall").select("doc_id", F.col("k").alias("id")))
    return got.select("doc_id", "id", "target", "reaches")


@query(
    "WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, min((l_partkey % 40) * 12.0)::DOUBLE AS x FROM lineitem GROUP BY ALL), o AS (SELECT *, lag(x) OVER w AS before FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY x, ord)),"
    " c AS (SELECT *, sum(CASE WHEN before IS NULL OR x - before >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x, ord) AS c FROM o), b AS (SELECT doc_id, c, min(x) AS x, max(x) + 10 AS e FROM c GROUP BY ALL),"
    " d AS (SELECT b.*, abs(least(greatest(240.0, x), e) - 240.0) AS d FROM b)"
    " SELECT doc_id, x, e - x AS w FROM d WHERE d < 36 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, x) = 1 AND count(*) OVER (PARTITION BY doc_id, d) = 1"
)
def nearest_label_clusters(spark, sf_dir):
    """Pieces of a label that nearly touch are one; the one nearest to a line's end, where one is nearest."""
    pieces = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("ord")).agg(F.min(F.col("l_partkey") % 40 * 12).cast("double").alias("x"))
    pieces = pieces.select("doc_id", "ord", "x", F.lit(0.0).alias("y"), F.lit(10.0).alias("w"), F.lit(10.0).alias("h"))
    points = pieces.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("point"), F.lit(240.0).alias("px"), F.lit(5.0).alias("py"))
    found = routing.label_clusters(pieces, points)
    # where two lie at the same distance either may be the nearest
    clusters = pieces.select("doc_id", "x", F.abs(F.least(F.greatest(F.lit(240.0), "x"), F.col("x") + 10) - 240).alias("d")).where("d < 36").groupBy("doc_id", "d").agg(F.collect_set("x").alias("xs"))
    least = clusters.groupBy("doc_id").agg(F.min_by("xs", "d").alias("xs"))
    inside = F.expr("forall(xs, v -> v >= x AND v <= x + w)")
    return found.join(least, "doc_id").where(inside).select("doc_id", "x", "w")
