"""Images to documents: what the pixels show and a table of the texts in them, joined.

Boxes, their compartments and the lines between them come from the pixels. Texts come
as a table (key, x, y, w, h, text), as a text recogniser gives them; each belongs to
the box and the compartment, or to the figure, that its middle lies in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schemas as S
from weftgraph.functions import text as T
from weftgraph.operators import connectors, flow, pixels, relate
from weftgraph.operators.spatial import _cells
from weftgraph.sources.scratch import persisted

CELL = 200.0


def within(texts: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """texts with the ord of the smallest box (ord, x, y, w, h) that their middle lies in, and how far down it; others are left out."""
    mx, my = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    t = texts.select(key, "text", mx.alias("mx"), my.alias("my"), F.xxhash64("x", "y", "w", "h", "text").alias("t"))
    t = t.withColumns({"_cx": F.floor(F.col("mx") / CELL), "_cy": F.floor(F.col("my") / CELL)})
    b = _cells(boxes.select(key, "ord", "x", "y", "w", "h"), F.col("x"), F.col("y"), F.col("w"), F.col("h"), CELL, 0.0)
    met = t.join(b, [key, "_cx", "_cy"]).where(F.col("mx").between(F.col("x"), F.col("x") + F.col("w")) & F.col("my").between(F.col("y"), F.col("y") + F.col("h")))
    least = F.row_number().over(Window.partitionBy(key, "t", "mx", "my").orderBy(F.col("w") * F.col("h"), "ord"))
    return met.withColumn("_r", least).where("_r = 1").select(key, "ord", "text", "mx", "my")


def numbered_boxes(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Boxes with ord, from 0, by their place from the top."""
    return boxes.withColumn("ord", (F.row_number().over(Window.partitionBy(key).orderBy("y", "x", "w", "h")) - 1).cast("long"))


def class_parts(boxes: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, name, kind, attributes, methods) of class boxes (ord, x, y, w, h, dividers).

    The first compartment holds the name and a stereotype, the second attributes and
    the third methods; a line with a call's parenthesis is a method wherever it stands.
    A box without a readable name is called by its number.
    """
    placed = persisted(within(texts, boxes, key).join(boxes.select(key, "ord", "dividers"), [key, "ord"]))
    part = F.size(F.filter("dividers", lambda d: d < F.col("my")))
    lines = placed.withColumn("part", part)
    head = lines.where("part = 0").groupBy(key, "ord").agg(T.class_header(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("my", "mx", "text"))), lambda t: t["text"]), "\n")).alias("head"))
    place = F.row_number().over(Window.partitionBy(key, "ord").orderBy("my", "mx", "text"))
    body = lines.where("part > 0").select(key, F.col("ord").alias("id"), F.when(F.col("part") == 1, "attributes").otherwise("methods").alias("compartment"), place.alias("ord"), F.col("text").alias("line"))
    members = relate.members_of_lines(body, (key, "id")).withColumnRenamed("id", "ord")
    name = F.coalesce(F.when(F.col("head.name") != "", F.col("head.name")), F.concat(F.lit("Class"), F.col("ord") + 1))
    kind = F.when(F.col("head.stereotype").isin("interface", "abstract"), F.col("head.stereotype")).otherwise("class")
    return boxes.join(head, [key, "ord"], "left").join(members, [key, "ord"], "left").select(key, "ord", name.alias("name"), kind.alias("kind"), "attributes", "methods")


def class_documents(pages: DataFrame, texts: DataFrame, reach: int = connectors.REACH, key: str = "doc_id") -> DataFrame:
    """(key, doc): the class document of every page (width, height, grey) with a class box; ``doc`` is of the type of schemas.CLASS_DOC."""
    boxes = persisted(numbered_boxes(pixels.class_boxes(pixels.runs(pages, coloured=False, layers=("rule", "side"))), key))
    parts = class_parts(boxes, texts, key).join(boxes, [key, "ord"])
    id = lambda c: F.concat(F.lit("class_"), F.col(c) + 1)
    attribute = lambda a: F.struct(a["name"].alias("name"), a["datatype"].alias("datatype"), a["visibility"].alias("visibility"), a["default_value"].alias("default_value"), F.lit(False).alias("static"), F.lit(False).alias("final"))
    method = lambda m: F.struct(m["name"].alias("name"), m["visibility"].alias("visibility"), m["parameters"].alias("parameters"), m["return_type"].alias("return_type"), F.lit(False).alias("static"), F.lit(False).alias("abstract"))
    made = F.struct(
        "ord", id("ord").alias("id"), "name", "kind", F.transform("attributes", attribute).alias("attributes"), F.transform("methods", method).alias("methods"),
        F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("position"), F.struct(F.col("w").cast("double").alias("width"), F.col("h").cast("double").alias("height")).alias("size"),
    )
    classes = parts.groupBy(key).agg(F.sort_array(F.collect_list(made)).alias("classes"))
    lines = connectors.connectors(pages, boxes, reach, key)
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("source", "target", "type", F.coalesce("marker", F.lit("")))))
    one = F.struct(F.lit("1").alias("source"), F.lit("1").alias("destination"))
    relation = F.struct("n", F.concat(F.lit("rel_"), "n").alias("id"), id("source").alias("source"), id("target").alias("destination"), "type", one.alias("multiplicity"), F.lit("").alias("label"))
    relations = lines.groupBy(key).agg(F.sort_array(F.collect_list(relation)).alias("relationships"))
    both = classes.join(relations, key, "left")
    bare = lambda column, names: F.transform(column, lambda x: F.struct(*[x[c].alias(c) for c in names]))
    doc = F.struct(
        bare("classes", ("id", "name", "kind", "attributes", "methods", "position", "size")).alias("classes"),
        F.coalesce(bare("relationships", ("id", "source", "destination", "type", "multiplicity", "label")), F.array().cast(f"array<{S.RELATIONSHIP}>")).alias("relationships"),
    )
    return both.select(key, doc.cast(S.schema(S.CLASS_DOC)).alias("doc"))


def activity_graphs(pages: DataFrame, texts: DataFrame, reach: int = connectors.REACH, key: str = "doc_id", key_type: str = "long") -> tuple[DataFrame, DataFrame, DataFrame]:
    """((key, ord, type, label, x, y, w, h), (key, source, target, ord), (key, error)) of pages with figures of activities.

    Lines are directed by a walk from the start (``flow.oriented``), shorter ones first;
    a drawing that it can't be told for, as one without a single start, has an error and
    no edges. Notes are no nodes.
    """
    shapes = persisted(numbered_boxes(pixels.activity_shapes(pixels.runs(pages, layers=("ink", "blank", "solid", "bar"))).where("kind != 'note'"), key))
    label = within(texts, shapes, key).groupBy(key, "ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("my", "mx", "text"))), lambda t: t["text"]), " ").alias("label"))
    nodes = shapes.join(label, [key, "ord"], "left").select(key, "ord", F.when(F.col("kind") == "bar", "fork").otherwise(F.col("kind")).alias("type"), T.normalize_label(F.coalesce("label", F.lit(""))).alias("label"), "x", "y", "w", "h")
    lines = connectors.connectors(pages, shapes, reach, key).where("source != target")
    centre = lambda n: shapes.select(key, F.col("ord").alias(n), (F.col("x") + F.col("w") / 2).alias(f"{n}_x"), (F.col("y") + F.col("h") / 2).alias(f"{n}_y"))
    met = lines.join(centre("source"), [key, "source"]).join(centre("target"), [key, "target"])
    link = F.struct(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.hypot(F.col("source_x") - F.col("target_x"), F.col("source_y") - F.col("target_y")).alias("length"))
    links = met.groupBy(key).agg(F.sort_array(F.collect_list(link)).alias("links"))
    drawn = shapes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "kind", F.col("y").cast("double").alias("y")))).alias("shapes"))
    docs = drawn.join(links, key, "left").select(key, F.struct("shapes", "links").alias("doc"))

    def work(d: dict) -> list[dict]:
        return [{"source": a, "target": b, "ord": i} for a, b, i in flow.oriented(d["shapes"], d["links"] or [])]

    told = persisted(flow.per_document(docs, work, f"{key} {key_type}, error string, source long, target long, ord long", key))
    return nodes, told.where("error is null").drop("error"), told.where("error is not null").select(key, "error")
