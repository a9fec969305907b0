"""Diagram text of documents, built from their nested columns; no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import escape_label

# The diagram language's signs.
MEMBER = {"public": "+", "private": "-", "protected": "#", "package": "~"}
ARROWS = {"inheritance": "--|>", "realization": "..|>", "composition": "*--", "aggregation": "o--", "association": "-->", "dependency": "..>"}
QUANTIFIED = ("association", "aggregation", "composition")
SHAPES = {"start": ("((", "))"), "end": ("((", "))"), "action": ("[", "]"), "decision": ("{", "}"), "fork": ("[[", "]]"), "join": ("[[", "]]")}
NAMES = {"start": "Start", "end": "End", "fork": "fork", "join": "join"}


def looked_up(value: Column, pairs: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(value == k, v) for k, v in pairs.items()], F.lit(""))


def _flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def _attribute(a: Column) -> Column:
    return F.concat(F.lit("        "), looked_up(a["visibility"], MEMBER), a["datatype"], F.lit(" "), a["name"], F.when(_flag(a["static"]), "$").otherwise(""))


def _method(m: Column) -> Column:
    params = F.array_join(F.transform(F.coalesce(m["parameters"], F.array().cast("array<struct<name:string,datatype:string>>")), lambda p: F.concat(p["name"], F.lit(": "), p["datatype"])), ", ")
    mark = F.when(_flag(m["static"]), "$").when(_flag(m["abstract"]), "*").otherwise("")
    return F.concat(F.lit("        "), looked_up(m["visibility"], MEMBER), m["name"], F.lit("("), params, F.lit(") "), F.coalesce(m["return_type"], F.lit("void")), mark)


def _class(c: Column) -> Column:
    none = F.array().cast("array<string>")
    kind = F.when(c["kind"].isin("interface", "abstract"), F.array(F.concat(F.lit("        <<"), c["kind"], F.lit(">>")))).otherwise(none)
    return F.concat(
        F.array(F.concat(F.lit("    class "), c["name"], F.lit(" {"))), kind, F.coalesce(F.transform(c["attributes"], _attribute), none), F.coalesce(F.transform(c["methods"], _method), none), F.array(F.lit("    }"))
    )


def class_diagram(doc: Column) -> Column:
    """A class document (a struct column) as text."""
    # ids of a document are unique; of repeated ones the last names the class
    name = lambda i: F.element_at(F.filter(doc["classes"], lambda c: c["id"] == i), -1)["name"]

    def line(r: Column) -> Column:
        arrow = F.concat(F.lit(" "), looked_up(r["type"], ARROWS), F.lit(" "))
        label = F.when(F.coalesce(r["label"], F.lit("")) != "", F.concat(F.lit(" : "), r["label"])).otherwise("")
        quoted = lambda m: F.concat(F.lit('"'), m, F.lit('"'))
        middle = F.when(r["type"].isin(*QUANTIFIED), F.concat(F.lit(" "), quoted(r["multiplicity"]["source"]), arrow, quoted(r["multiplicity"]["destination"]), F.lit(" "))).otherwise(arrow)
        return F.concat(F.lit("    "), name(r["source"]), middle, name(r["destination"]), label)

    none = F.array().cast("array<string>")
    classes = F.coalesce(F.flatten(F.transform(doc["classes"], _class)), none)
    return F.array_join(F.concat(F.array(F.lit("classDiagram")), classes, F.coalesce(F.transform(doc["relationships"], line), none)), "\n")


def flowchart(doc: Column) -> Column:
    """An activity document (a struct column) as text."""

    def node(n: Column) -> Column:
        label = F.when(F.coalesce(n["label"], F.lit("")) != "", n["label"]).otherwise(looked_up(n["type"], NAMES))
        return F.concat(F.lit("    "), n["id"], looked_up(n["type"], {k: v[0] for k, v in SHAPES.items()}), F.lit('"'), escape_label(label), F.lit('"'), looked_up(n["type"], {k: v[1] for k, v in SHAPES.items()}))

    def edge(e: Column) -> Column:
        arrow = F.when(F.coalesce(e["label"], F.lit("")) != "", F.concat(F.lit(' -->|"'), escape_label(e["label"]), F.lit('"| '))).otherwise(" --> ")
        return F.concat(F.lit("    "), e["source"], arrow, e["target"])

    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(F.lit("flowchart TD")), F.coalesce(F.transform(doc["nodes"], node), none), F.coalesce(F.transform(doc["edges"], edge), none)), "\n")


def relationship_lines(edges: DataFrame) -> DataFrame:
    """Adds ``line`` to edges with source_name, destination_name, source_multiplicity, multiplicity and label."""
    arrow = looked_up(F.col("type"), ARROWS)
    middle = F.when(F.col("type").isin(*QUANTIFIED), F.concat(F.lit('"'), "source_multiplicity", F.lit('" '), arrow, F.lit(' "'), "multiplicity", F.lit('"'))).otherwise(arrow)
    return edges.withColumn("line", F.concat(F.lit("    "), F.concat_ws(" ", "source_name", middle, "destination_name"), F.when(F.col("label") != "", F.concat(F.lit(" : "), "label")).otherwise("")))


