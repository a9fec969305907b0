"""The registered queries: each applies operators to the driver's tables, beside SQL that states the same rows.

The tables hold no diagrams, so columns stand in for them: parts for projects, event
types for the steps of a flow, suppliers and customers for boxes and points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import schemas as S
from weftgraph.extract import tables
from weftgraph.functions import text
from weftgraph.operators import catalog, edits, flow, graph, relate, routing, spatial, validate
from weftgraph.render import codegen, mermaid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PART = "SELECT p_partkey AS id, p_name AS name, p_brand AS owner, p_type AS project_type FROM part"


def _projects(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("owner_id"), F.col("p_type").alias("project_type"))


@query(r"SELECT p_partkey AS id, p_name AS name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND lower(p_name) LIKE '%a%' ESCAPE '\' ORDER BY lower(p_name), p_partkey LIMIT 12 OFFSET 2")
def project_listing_page(spark, sf_dir):
    """One page of an owner's matching projects by name."""
    rows = _projects(spark, sf_dir)
    owner = rows.agg(F.min("owner_id")).first()[0]
    return catalog.listing(rows, owner, "A", "name", 12, 2)[0].select("id", "name")


@query("SELECT count(*) AS total FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND contains(lower(p_name), 'a')")
def project_listing_total(spark, sf_dir):
    """A1 P2."""
    rows = _projects(spark, sf_dir)
    return catalog.listing(rows, rows.agg(F.min("owner_id")).first()[0], "a", "name")[1]


@query("SELECT p_brand AS owner, lower(trim(p_type)) AS name_key, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def owner_name_conflicts(spark, sf_dir):
    """Names that an owner uses twice (a part's type as its name)."""
    return catalog.name_conflicts(table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner_id"), F.col("p_type").alias("name")))


_STEPS = "SELECT user_id, event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target, event_id FROM events"


def _steps(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target"))


@query(f"SELECT source, target, count(*) AS n, count(DISTINCT user_id) AS users FROM ({_STEPS}) WHERE target IS NOT NULL GROUP BY ALL")
def event_flow_edges(spark, sf_dir):
    """Directly-follows edges of the flow that events trace."""
    return _steps(spark, sf_dir).where("target is not null").groupBy("source", "target").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


_EDGES = f"SELECT DISTINCT user_id, source, target FROM ({_STEPS}) WHERE target IS NOT NULL"


def _flow(spark, sf_dir):
    edges = _steps(spark, sf_dir).where("target is not null").select(F.col("user_id").alias("doc_id"), "source", "target").distinct()
    nodes = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("id"), F.lit("bar").alias("type")).distinct()
    return nodes, edges


@query(
    f"WITH e AS ({_EDGES}), n AS (SELECT DISTINCT user_id, event_type AS id FROM events), o AS (SELECT user_id, source AS id, count(*) AS c FROM e GROUP BY ALL), i AS (SELECT user_id, target AS id, count(*) AS c FROM e GROUP BY ALL)"
    " SELECT n.user_id AS doc_id, n.id, coalesce(i.c, 0)::BIGINT AS in_degree, coalesce(o.c, 0)::BIGINT AS out_degree, CASE WHEN coalesce(i.c, 0) > coalesce(o.c, 0) THEN 'join' ELSE 'fork' END AS type FROM n LEFT JOIN i USING (user_id, id) LEFT JOIN o USING (user_id, id)"
)
def flow_node_degrees(spark, sf_dir):
    """Degrees, and bars told apart as joins and forks."""
    return relate.degrees(*_flow(spark, sf_dir)).select("doc_id", "id", "in_degree", "out_degree", "type")


@query(
    f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT DISTINCT user_id, source AS origin, source AS id, 0 AS depth FROM e UNION SELECT r.user_id, r.origin, e.target, r.depth + 1 FROM r JOIN e ON e.user_id = r.user_id AND e.source = r.id WHERE r.depth < 6)"
    " SELECT user_id AS doc_id, origin, id, min(depth)::BIGINT AS depth FROM r GROUP BY ALL"
)
def flow_reachability_depth(spark, sf_dir):
    """Fewest steps from every event type of a user to every other."""
    _, edges = _flow(spark, sf_dir)
    return graph.depths(edges, edges.select("doc_id", F.col("source").alias("origin"), F.col("source").alias("id")).distinct())


@query(
    f"WITH RECURSIVE e AS ({_EDGES}), r AS (SELECT DISTINCT user_id, source AS origin, source AS id, 0 AS depth FROM e UNION SELECT r.user_id, r.origin, e.target, r.depth + 1 FROM r JOIN e ON e.user_id = r.user_id AND e.source = r.id WHERE r.depth < 6),"
    " d AS (SELECT user_id, origin, id, min(depth) AS depth FROM r GROUP BY ALL), b AS (SELECT user_id, min(target) AS a, max(target) AS b FROM e GROUP BY user_id HAVING min(target) <> max(target)),"
    " m AS (SELECT b.user_id, b.a, b.b, x.id, row_number() OVER (PARTITION BY b.user_id ORDER BY x.depth + y.depth, x.id) AS k FROM b JOIN d x ON x.user_id = b.user_id AND x.origin = b.a JOIN d y ON y.user_id = b.user_id AND y.origin = b.b AND y.id = x.id)"
    " SELECT b.user_id AS doc_id, b.a, b.b, m.id AS meet FROM b LEFT JOIN m ON m.user_id = b.user_id AND m.k = 1"
)
def flow_convergence(spark, sf_dir):
    """Where a user's first and last branch in the order of names meet."""
    nodes, edges = _flow(spark, sf_dir)
    ends = edges.groupBy("doc_id").agg(F.min("target").alias("a"), F.max("target").alias("b")).where("a != b")
    ranked = nodes.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")))
    return graph.convergence(edges, ends, ranked)


@query(
    "WITH s AS (SELECT user_id, event_id, ts, event_type, coalesce(event_type = 'purchase' OR lag(event_type) OVER w = 'purchase', true) AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),"
    " i AS (SELECT *, sum(turn::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM s) SELECT user_id AS doc_id, island::BIGINT AS island, count(*) AS n, string_agg(event_type, '; ' ORDER BY event_id) AS text FROM i GROUP BY ALL"
)
def step_islands(spark, sf_dir):
    """Straight runs of steps as one action each."""
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("label"))
    return edits.step_islands(steps, F.col("label") == "purchase")


@query(
    "WITH s AS (SELECT user_id, event_id, ts, event_type, coalesce(lag(event_type) OVER w <> event_type OR ts - lag(ts) OVER w >= INTERVAL 600 MILLISECONDS, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),"
    " e AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS entry FROM s), g AS (SELECT user_id, entry, max(event_type) AS edit, count(*) AS n FROM e GROUP BY ALL)"
    " SELECT user_id AS doc_id, entry::BIGINT AS entry, edit, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY entry DESC) AS r FROM g) WHERE r <= 50"
)
def edit_coalescing(spark, sf_dir):
    """History entries of the last 50 runs of equal edits."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("edit_id"), F.col("event_type").alias("edit"), "ts")
    return edits.coalesced(rows).select("doc_id", "entry", "edit", "n")


@query("SELECT 'orders' AS source, 'lineitem' AS destination, CASE WHEN max(c) > 1 THEN '*' ELSE '1' END AS multiplicity, count(*) AS parents FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1)")
def fk_multiplicity(spark, sf_dir):
    """How many parts a whole has, from a foreign key."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count()
    return counts.agg(F.when(F.max("count") > 1, "*").otherwise("1").alias("multiplicity"), F.count("*").alias("parents")).select(F.lit("orders").alias("source"), F.lit("lineitem").alias("destination"), "multiplicity", "parents")


@query("SELECT 'customer_nation' AS doc_id, 'unknown_nation' AS rule, 'Customer ''' || c_name || ''' references unknown nation ''' || (c_nationkey % 30)::VARCHAR || '''' AS message FROM customer WHERE c_nationkey % 30 NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)")
def fk_orphans(spark, sf_dir):
    """References to nations that aren't there (those of one region are left out)."""
    rows = table(spark, sf_dir, "customer").select(F.lit("customer_nation").alias("doc_id"), F.lit(0).alias("ord"), F.col("c_name").alias("id"), (F.col("c_nationkey") % 30).cast("string").alias("nation"))
    known = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.lit("customer_nation").alias("doc_id"), F.col("n_nationkey").cast("string").alias("id"))
    return validate.unknown_ends(rows, known, {"nation": "nation"}, "Customer").drop("ord")


@query(
    "WITH g AS (SELECT o_custkey AS doc_id, o_orderstatus AS source, o_orderpriority AS destination, 'association' AS type, bool_or(o_totalprice > 150000) AS many, min(o_orderkey) AS ord FROM orders GROUP BY ALL)"
    " SELECT doc_id, source, destination, type, many, 'rel_' || row_number() OVER (PARTITION BY doc_id ORDER BY ord, source, destination, type)::VARCHAR AS id, CASE WHEN many THEN '*' ELSE '1' END AS multiplicity FROM g"
)
def edge_dedup_or_merge(spark, sf_dir):
    """Equal edges become one, many if any is, and get ids in the order first seen."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("destination"), F.lit("association").alias("type"), (F.col("o_totalprice") > 150000).alias("many"), F.col("o_orderkey").alias("ord"))
    return relate.deduplicated(rows).drop("ord")


def _drawing(spark, sf_dir):
    boxes = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") % 37 * 9.0).alias("x"), (F.col("s_suppkey") % 11 * 23.0).alias("y"), F.lit(40.0).alias("w"), F.lit(24.0).alias("h"))
    points = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("point"), (F.col("c_custkey") % 331 * 1.0).alias("px"), (F.col("c_custkey") % 257 * 1.0).alias("py"))
    return points, boxes


_BOXES = "SELECT s_nationkey AS doc_id, s_suppkey AS ord, s_suppkey % 37 * 9.0::DOUBLE AS x, s_suppkey % 11 * 23.0::DOUBLE AS y, 40.0::DOUBLE AS w, 24.0::DOUBLE AS h FROM supplier"


@query(
    f"WITH b AS ({_BOXES}), p AS (SELECT c_nationkey AS doc_id, c_custkey AS point, (c_custkey % 331)::DOUBLE AS px, (c_custkey % 257)::DOUBLE AS py FROM customer),"
    " d AS (SELECT p.doc_id, point, ord, (px - greatest(x, least(px, x + w))) ** 2 + (py - greatest(y, least(py, y + h))) ** 2 AS d FROM p JOIN b ON p.doc_id = b.doc_id),"
    " k AS (SELECT doc_id, point, ord, row_number() OVER (PARTITION BY doc_id, point ORDER BY d, ord) AS r FROM d WHERE d < 400)"
    " SELECT p.doc_id, p.point, k.ord AS box_ord FROM p LEFT JOIN k ON k.doc_id = p.doc_id AND k.point = p.point AND k.r = 1"
)
def nearest_box(spark, sf_dir):
    """The nearest box of the same drawing within 20 pixels."""
    return spatial.nearest_box(*_drawing(spark, sf_dir)).select("doc_id", "point", "box_ord")


@query(
    f"WITH b AS ({_BOXES}) SELECT a.doc_id, a.ord AS i, c.ord AS j, (least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * (least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS area FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.ord < c.ord"
    " WHERE a.x < c.x + c.w AND c.x < a.x + a.w AND a.y < c.y + c.h AND c.y < a.y + a.h"
)
def overlap_pairs(spark, sf_dir):
    """Boxes of a drawing that overlap."""
    return spatial.overlaps(_drawing(spark, sf_dir)[1]).select("doc_id", "i", "j", "area")


@query(
    "WITH t AS (SELECT source AS doc_id, unnest(string_split_regex(text, '[^A-Za-z]+')) AS name, doc_id AS ord FROM documents), n AS (SELECT doc_id, name, min(ord) AS ord FROM t WHERE name <> '' GROUP BY ALL),"
    " k AS (SELECT doc_id, ord, name AS spelling, first_value(name) OVER (PARTITION BY doc_id, lower(name) ORDER BY length(regexp_replace(name, '[^A-Z]', '', 'g')), ord, name) AS name FROM n) SELECT doc_id, ord, spelling, name FROM k WHERE spelling <> name"
)
def name_reconciliation(spark, sf_dir):
    """Spellings that differ in case only become one; the rows whose spelling changes."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ord"), F.explode(F.split("text", "[^A-Za-z]+")).alias("name"))
    names = rows.where("name != ''").groupBy("doc_id", "name").agg(F.min("ord").alias("ord")).withColumn("spelling", F.col("name"))
    return relate.reconciled(names).where("spelling != name").select("doc_id", "ord", "spelling", "name")


@query(r"SELECT doc_id, trim(regexp_replace(replace(replace(replace(text, '—', '-'), '–', '-'), '·', '.'), '\s+', ' ', 'g')) AS label FROM documents")
def label_normalise(spark, sf_dir):
    """F9."""
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_label("text").alias("label"))


@query(r"WITH l AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 60 THEN left(s, 59) || '…' ELSE s END AS label FROM l")
def label_truncate(spark, sf_dir):
    """F15."""
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate("text").alias("label"))


@query("SELECT DISTINCT w AS word, CASE WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN w || 'es' WHEN regexp_matches(w, '[^aeiou]y$') THEN left(w, length(w) - 1) || 'ies' ELSE w || 's' END AS plural, CASE WHEN w LIKE '%ies' AND length(w) > 3 THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%es' AND length(w) > 3 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 2 THEN left(w, length(w) - 1) ELSE w END AS singular FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part)")
def plural_names(spark, sf_dir):
    """F16 F17."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word")).distinct()
    return words.select("word", text.plural("word").alias("plural"), text.singular("word").alias("singular"))


@query(r"SELECT word, CASE WHEN t IN ('yes', 'y', 'true', 't') THEN 'yes' WHEN t IN ('no', 'n', 'false', 'f') THEN 'no' ELSE '' END AS guard FROM (SELECT DISTINCT word, regexp_replace(lower(word), '[^a-z]', '', 'g') AS t FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM conversations)) WHERE word <> ''".replace("\\\\", "\\"))
def guard_exact(spark, sf_dir):
    """every word as a guard, by the known tokens."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word != ''").distinct()
    return words.select("word", text.guard_exact("word").alias("guard"))


@query("SELECT doc_id, guard FROM (SELECT o_orderkey AS doc_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'yes' WHEN '2-HIGH' THEN 'no' WHEN '3-MEDIUM' THEN 'yes' WHEN '4-NOT SPECIFIED' THEN '' ELSE 'no' END AS guard FROM orders)")
def guard_misread(spark, sf_dir):
    """known tokens, near ones (ves, nno) and others, one for each priority."""
    p = F.col("o_orderpriority")
    said = F.when(p == "1-URGENT", " Yes.").when(p == "2-HIGH", "[F]").when(p == "3-MEDIUM", "ves").when(p == "4-NOT SPECIFIED", "quantity").otherwise("nno")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.guard(said).alias("guard"))


@query("SELECT n_regionkey AS doc_id, '    ' || r_name || ' \"1\" *-- \"*\" ' || n_name AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def mermaid_lines(spark, sf_dir):
    """Relationship lines; a region is the whole, its nations are parts."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nation = nations.select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    region = regions.select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"))
    rels = nations.select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("destination"), F.lit("composition").alias("type"), F.lit("1").alias("source_multiplicity"), F.lit("*").alias("multiplicity"), F.lit("").alias("label"))
    return mermaid.relationship_lines(relate.named(rels, nation.unionByName(region))).select("doc_id", "line")


@query("SELECT r_regionkey AS doc_id, 'classDiagram' || chr(10) || string_agg('    class ' || n_name || ' {' || chr(10) || '        +int key' || chr(10) || '    }', chr(10) ORDER BY n_nationkey) AS text FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey")
def class_diagrams(spark, sf_dir):
    """A class diagram per region with a class per nation."""
    cls = F.struct(F.col("n_nationkey").alias("k"), F.concat(F.lit("class_"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("class").alias("kind"), F.array(F.struct(F.lit("key").alias("name"), F.lit("int").alias("datatype"), F.lit("public").alias("visibility"), F.lit(None).cast("string").alias("default_value"), F.lit(False).alias("static"), F.lit(False).alias("final"))).alias("attributes"), F.lit(None).cast(f"array<{S.METHOD}>").alias("methods"))
    docs = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg(F.struct(F.sort_array(F.collect_list(cls)).alias("classes"), F.lit(None).cast(f"array<{S.RELATIONSHIP}>").alias("relationships")).alias("doc"))
    return docs.select("doc_id", mermaid.class_diagram(F.col("doc")).alias("text"))


@query("SELECT (c_custkey % 7) AS box, side, edge, rank() OVER (PARTITION BY c_custkey % 7, side ORDER BY c_acctbal, edge) / (count(*) OVER (PARTITION BY c_custkey % 7, side) + 1) AS fraction FROM (SELECT c_custkey, c_acctbal, c_mktsegment AS side, c_custkey AS edge FROM customer)")
def port_spreading(spark, sf_dir):
    """Edges spread along the sides of boxes."""
    ends = table(spark, sf_dir, "customer").select(F.lit(0).alias("doc_id"), (F.col("c_custkey") % 7).alias("box"), F.col("c_mktsegment").alias("side"), F.col("c_custkey").alias("edge"), F.col("c_acctbal").alias("other_centre"))
    return spatial.ports(ends).select("box", "side", "edge", "fraction")


def _values(rows: list[tuple], names: str) -> str:
    """Golden rows as SQL: they state what is expected, they don't compute it."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


_SOURCES = [
    (1, "python", "class Engine: pass\nclass Wheel: pass\nclass Person: pass\nclass Car:\n    def __init__(self, owner: Person, wheels: list[Wheel]):\n        self.owner = owner\n        self.wheels = wheels\n        self.engine = Engine()\n    def run(self, n):\n        while n > 0:\n            n -= 1\n        return n\n"),
    (2, "java", "class Engine {} class Wheel {} class Person {} class Car { private Engine engine; private Person owner; private List<Wheel> wheels; Car() { this.engine = new Engine(); } int run(int n) { while (n > 0) { n -= 1; } return n; } }"),
    (3, "javascript", "class Engine {} class Wheel {} class Person {} class Car { constructor(owner, wheels) { this.owner = owner; this.engine = new Engine(); this.people = [new Person()]; } run(n) { while (n > 0) { n -= 1; } return n; } }"),
    (4, "python", "class ("),
]
_LINKS = [(1, "Car", "Engine", "composition", "1"), (1, "Car", "Person", "association", "1"), (1, "Car", "Wheel", "aggregation", "*"), (2, "Car", "Engine", "composition", "1"), (2, "Car", "Person", "association", "1"), (2, "Car", "Wheel", "aggregation", "*"), (3, "Car", "Engine", "composition", "1"), (3, "Car", "Person", "composition", "*"), (3, "Car", "Wheel", "dependency", "1")]
_SAID = [(d, "Car", "run", k, t, s) for d in (1, 2, 3) for k, (t, s) in enumerate([("start", ""), ("end", ""), ("decision", "n > 0"), ("action", "Decrease n"), ("action", "Return n")])]


def _sources(spark):
    return spark.createDataFrame(_SOURCES, "doc_id long, language string, source string")


@query(_values(_LINKS, "doc_id, source_name, destination_name, type, multiplicity"))
def extract_goldens(spark, sf_dir):
    """Relationships of small sources in three languages; golden rows."""
    docs = tables.class_documents(_sources(spark)).where("error is null")
    return relate.named(S.relationships(docs), S.classes(docs)).select("doc_id", "source_name", "destination_name", "type", "multiplicity")


@query(_values(_SAID, "doc_id, class_name, method_name, ord, type, label"))
def control_flow_goldens(spark, sf_dir):
    """Nodes of each method's flow; golden rows."""
    flows = tables.method_flows(_sources(spark)).where("error is null")
    return flows.select("doc_id", "class_name", "method_name", F.posexplode("doc.nodes").alias("ord", "n")).select("doc_id", "class_name", "method_name", "ord", "n.type", "n.label")


@query(_values([(d, p, part, kind, label) for d in (1, 2, 3) for p, part, kind, label in [("0", "", "while", "n > 0"), ("0.2.0", "body", "action", "Decrease n"), ("1", "", "action", "Return n")]], "doc_id, place, part, kind, label"))
def structure_goldens(spark, sf_dir):
    """The statements that the extracted flows stand for; golden rows."""
    flows = tables.method_flows(_sources(spark)).where("error is null and method_name = 'run'")
    return flow.structured(flows).select("doc_id", F.array_join("path", ".").alias("place"), "part", "kind", "label")


@query(_values([("Car.py", "class Car:"), ("Engine.py", "class Engine:"), ("Person.py", "class Person:"), ("Wheel.py", "class Wheel:")], "filename, head"))
def codegen_goldens(spark, sf_dir):
    """A file per class; golden rows."""
    files = codegen.generated(tables.class_documents(_sources(spark)).where("doc_id = 1"), "python")
    return files.select("filename", F.regexp_extract("content", r"(?m)^(class .*)$", 1).alias("head"))


@query(r"SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_linenumber::VARCHAR || '..*' WHEN l_returnflag = 'R' THEN l_linenumber::VARCHAR || '..' || l_linenumber::VARCHAR WHEN l_linestatus = 'O' THEN '*' END AS multiplicity FROM lineitem")
def multiplicity_repair(spark, sf_dir):
    """F7 on texts made of flags: lost, doubled and odd dots, and texts that are none."""
    raw = F.when(F.col("l_returnflag") == "A", F.concat("l_linenumber", F.lit(" ,.n"))).when(F.col("l_returnflag") == "R", F.concat("l_linenumber", F.lit("..."), "l_linenumber")).when(F.col("l_linestatus") == "O", "'n'").otherwise("x..1")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.multiplicity(raw).alias("multiplicity"))


@query("SELECT n_regionkey AS doc_id, n_nationkey AS ord, ((row_number() OVER w - 1) % 4 * 260)::DOUBLE AS x, ((row_number() OVER w - 1) // 4 * 200)::DOUBLE AS y FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def grid_layout(spark, sf_dir):
    """Classes in four columns."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("ord"))
    return spatial.grid_layout(rows).select("doc_id", "ord", "position.x", "position.y")


@query(f"SELECT doc_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM ({_BOXES}) GROUP BY doc_id")
def bounding_boxes(spark, sf_dir):
    """A10."""
    return spatial.bounding_box(_drawing(spark, sf_dir)[1])


@query("SELECT c_custkey AS id, list_filter([CASE WHEN NOT regexp_full_match(c_name || '@x.' || c_mktsegment, '[^@]+@[^@]*\\.[^@]*') THEN 'email' END, CASE WHEN NOT regexp_full_match(c_name, '[A-Za-z0-9_.-]{3,30}') THEN 'username' END, CASE WHEN length(c_mktsegment) < 9 - 1 THEN 'password' END], lambda x: x IS NOT NULL)::VARCHAR AS problems FROM customer".replace("\\\\", "\\"))
def account_problems(spark, sf_dir):
    """Problems of account fields (a customer's name and segment stand in)."""
    rows = table(spark, sf_dir, "customer")
    found = catalog.valid_account(F.concat("c_name", F.lit("@x."), "c_mktsegment"), F.col("c_name"), F.col("c_mktsegment"))
    return rows.select(F.col("c_custkey").alias("id"), F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")).alias("problems"))


@query("SELECT o_custkey AS doc_id, o_orderkey AS ord, 'domain_status' AS rule, 'unknown value ''' || o_orderstatus || '''' AS message FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def domain_violations(spark, sf_dir):
    """Values outside an enumeration."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("status"))
    return validate.outside_domain(rows, "status", ("F", "O"))


_DAYS = "SELECT user_id * 100000 + date_diff('day', DATE '1970-01-01', ts::DATE) AS doc_id, event_type AS source, lead(event_type) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS target FROM events"


@query(
    f"WITH RECURSIVE d AS ({_DAYS}), e AS (SELECT DISTINCT * FROM d WHERE target IS NOT NULL), n AS (SELECT DISTINCT doc_id, source AS id FROM d), s AS (SELECT doc_id, min(id) AS id FROM n GROUP BY doc_id),"
    " r AS (SELECT doc_id, id FROM s UNION SELECT r.doc_id, e.target FROM r JOIN e ON e.doc_id = r.doc_id AND e.source = r.id) SELECT n.doc_id, n.id FROM n ANTI JOIN r ON r.doc_id = n.doc_id AND r.id = n.id"
)
def flow_unreachable(spark, sf_dir):
    """Nodes of a user's day that its start (the first event type by name) doesn't lead to."""
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select((F.col("user_id") * 100000 + day).alias("doc_id"), F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target"))
    starts = Window.partitionBy("doc_id")
    nodes = steps.select("doc_id", F.col("source").alias("id")).distinct().withColumn("type", F.when(F.col("id") == F.min("id").over(starts), "start").otherwise("action"))
    return graph.unreachable(nodes, steps.where("target is not null").distinct()).select("doc_id", "id")


@query(
    "WITH RECURSIVE l AS (SELECT s_nationkey AS doc_id, s_suppkey AS a, s_suppkey + 25 * (1 + s_suppkey % 2) AS b FROM supplier), both AS (SELECT doc_id, a, b FROM l UNION SELECT doc_id, b, a FROM l), r AS (SELECT doc_id, a AS id, a AS other FROM both UNION SELECT r.doc_id, r.id, x.b FROM r JOIN both x ON x.doc_id = r.doc_id AND x.a = r.other)"
    " SELECT doc_id, id, min(other) AS component FROM r GROUP BY ALL".replace("both", "ends")
)
def stroke_components(spark, sf_dir):
    """Strokes that touch, directly or over others."""
    s = table(spark, sf_dir, "supplier")
    return routing.components(s.select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 25 * (1 + F.col("s_suppkey") % 2)).alias("b")))


@query(
    "WITH c AS (SELECT n_regionkey AS doc_id, n_nationkey AS ord, CASE WHEN n_nationkey % 4 = 0 THEN 'interface' ELSE 'class' END AS kind, n_name AS name FROM nation), e AS (SELECT s.doc_id, s.ord AS id, s.kind AS k, d.ord, d.kind AS dk, d.name FROM c s JOIN c d ON s.doc_id = d.doc_id AND d.ord < s.ord)"
    " SELECT c.doc_id, c.ord AS id, (SELECT arg_min(name, e.ord) FROM e WHERE e.id = c.ord AND e.k <> 'interface' AND e.dk <> 'interface') AS parent, coalesce((SELECT string_agg(name, ', ' ORDER BY e.ord) FROM e WHERE e.id = c.ord AND (e.k = 'interface' OR e.dk = 'interface')), '') AS interfaces FROM c"
)
def class_parents(spark, sf_dir):
    """The parent class and the interfaces of each class (a nation inherits from all before it in its region)."""
    c = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, "interface").otherwise("class").alias("kind"), F.col("n_name").alias("name"))
    d = c.select("doc_id", F.col("id").alias("destination"))
    e = c.select("doc_id", F.col("id").alias("source")).join(d, "doc_id").where("destination < source").select("doc_id", "source", "destination", F.lit("inheritance").alias("type"), F.col("destination").alias("ord"))
    return relate.parents(c, e).select("doc_id", "id", "parent", F.array_join("interfaces", ", ").alias("interfaces"))


from weftgraph.plans import drawings as drawings  # noqa: E402  registers its queries
from weftgraph.plans import more as more  # noqa: E402  registers its queries
from weftgraph.plans import strokes as strokes  # noqa: E402  registers its queries
from weftgraph.plans import rows as rows  # noqa: E402  registers its queries
