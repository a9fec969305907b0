"""Relationships: de-duplication, classification, lookups and name reconciliation over many documents at once.

Tables carry the key of their document; order is in ``ord`` columns, never in the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.extract.model import ASKING, REAL_NAMES, TEXT_NAMES, WHOLE_NAMES
from weftgraph.functions.text import attribute_line, capitals, identifier_words, is_many, is_method_line, method_line, singular

SUBTYPE = ("inheritance", "realization")
OWNING = ("aggregation", "composition")


def numbered(rows: DataFrame, prefix: str, order: list, key: list[str], name: str = "id") -> DataFrame:
    """Ids prefix1, prefix2, ... within each key."""
    return rows.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("string")))


def deduplicated(edges: DataFrame, key: list[str] = ("doc_id",)) -> DataFrame:
    """One edge per (source, destination, type): many if any is, in the order first seen, numbered anew."""
    key = list(key)
    one = edges.groupBy(*key, "source", "destination", "type").agg(F.bool_or("many").alias("many"), F.min("ord").alias("ord"))
    return numbered(one, "rel_", ["ord", "source", "destination", "type"], key).withColumn("multiplicity", F.when(F.col("many"), "*").otherwise("1"))


def first_of_pair(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Drawn lines: the first of each (source, destination), whatever its type; none from a box to itself."""
    w = Window.partitionBy(key, "source", "destination").orderBy("ord")
    return lines.where("source != destination").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def realized_interfaces(classes: DataFrame, edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """A class that something realizes is an interface."""
    targets = edges.where("type = 'realization'").select(key, F.col("destination").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return classes.join(targets, [key, "id"], "left").withColumn("kind", F.when(F.col("_hit"), "interface").otherwise(F.col("kind"))).drop("_hit")


def classified(created: Column, many: Column, held: Column) -> Column:
    """What the evidence of one class about another amounts to."""
    return F.when(created, "composition").when(held & many, "aggregation").when(held, "association").otherwise("dependency")


def class_edges(evidence: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (source, target, created, many, held, ord) of single findings to classified edges.

    A class that is held needs no dependency besides; nothing depends on itself by use alone.
    """
    one = evidence.groupBy(key, "source", "target").agg(F.bool_or("created").alias("created"), F.bool_or("many").alias("many"), F.bool_or("held").alias("held"), F.min("ord").alias("ord"))
    one = one.where("held or created or source != target")
    return one.select(key, "source", F.col("target").alias("destination"), classified(F.col("created"), F.col("many"), F.col("held")).alias("type"), "many", "ord")


def subtype_edges(bases: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Named bases that are known classes: realization of an interface by a class, else inheritance."""
    child = classes.select(key, F.col("name").alias("child"), F.col("id").alias("source"), F.col("kind").alias("_kind"))
    parent = classes.select(key, F.col("name").alias("base"), F.col("id").alias("destination"), F.col("kind").alias("_base"))
    rows = bases.join(child, [key, "child"]).join(parent, [key, "base"])
    return rows.select(key, "source", "destination", F.when((F.col("_base") == "interface") & (F.col("_kind") != "interface"), "realization").otherwise("inheritance").alias("type"), "ord")


def named(edges: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Edges with source_name and destination_name."""
    names = classes.select(key, "id", "name")
    out = edges.join(names.select(key, F.col("id").alias("source"), F.col("name").alias("source_name")), [key, "source"])
    return out.join(names.select(key, F.col("id").alias("destination"), F.col("name").alias("destination_name")), [key, "destination"])


def mapped(rows: DataFrame, column: str, pairs: dict[str, str], out: str | None = None) -> DataFrame:
    """A dictionary lookup that lets unknown values pass."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return rows.withColumn(out or column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


def parents(classes: DataFrame, edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, parent, interfaces): the first base that is no interface, and the interfaces in order; an interface has no parent."""
    child = classes.select(key, F.col("id").alias("source"), F.col("kind").alias("_kind"))
    base = classes.select(key, F.col("id").alias("destination"), F.col("kind").alias("_base"), F.col("name").alias("_name"))
    rows = edges.where(F.col("type").isin(*SUBTYPE)).join(child, [key, "source"]).join(base, [key, "destination"])
    faced = (F.col("_base") == "interface") | (F.col("_kind") == "interface")
    found = rows.groupBy(key, F.col("source").alias("id")).agg(
        F.min_by(F.when(~faced, F.col("_name")), F.when(~faced, F.struct("ord"))).alias("parent"),
        F.transform(F.sort_array(F.collect_list(F.when(faced, F.struct("ord", "_name")))), lambda x: x["_name"]).alias("interfaces"),
    )
    return classes.select(key, "id").join(found, [key, "id"], "left").withColumn("interfaces", F.coalesce("interfaces", F.array().cast("array<string>")))


def relationship_fields(classes: DataFrame, edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, ord, part, many): the fields that a whole gets from its parts."""
    part = classes.select(key, F.col("id").alias("destination"), F.col("name").alias("part"))
    rows = edges.where(F.col("type").isin(*OWNING)).join(part, [key, "destination"])
    return rows.select(key, F.col("source").alias("id"), "ord", "part", is_many(F.col("multiplicity")).alias("many"))


def undeclared_fields(fields: DataFrame, attributes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Derived fields (with a ``name``) that no attribute declares; the first of each name."""
    left = fields.join(attributes.select(key, F.col("class_id").alias("id"), "name"), [key, "id", "name"], "left_anti")
    return left.withColumn("_r", F.row_number().over(Window.partitionBy(key, "id", "name").orderBy("ord"))).where("_r = 1").drop("_r")


def used_classes(types: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id, imports): known classes other than itself that a class's type texts name exactly."""
    names = classes.select(key, F.col("name").alias("datatype"))
    own = classes.select(key, "id", F.col("name").alias("_own"))
    rows = types.join(names, [key, "datatype"], "left_semi").join(own, [key, "id"]).where("datatype != _own")
    return rows.groupBy(key, "id").agg(F.sort_array(F.collect_set("datatype")).alias("imports"))


def mentioned_classes(types: DataFrame, classes: DataFrame, column: str = "datatype", key: str = "doc_id") -> DataFrame:
    """Known classes named anywhere in a type text such as List[Wheel]: its identifiers meet the names by an equi join."""
    words = types.withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(r"(\w+)"), 1))))
    return words.join(classes.select(key, "name"), [key, "name"], "left_semi")


def hinted_types(names: DataFrame, classes: DataFrame, column: str = "name", key: str = "doc_id") -> DataFrame:
    """A type from a name alone: its last word is a class, or many of one; else a known word or a yes-or-no prefix. Null if none tells."""
    rows = names.withColumn("_words", identifier_words(column)).withColumn("_last", F.try_element_at("_words", F.lit(-1)))
    by = classes.select(key, F.lower("name").alias("_key"), "name").groupBy(key, "_key").agg(F.min("name").alias("_class"))
    rows = rows.join(by.withColumnRenamed("_key", "_last"), [key, "_last"], "left").withColumn("_one", singular("_last"))
    rows = rows.join(by.select(key, F.col("_key").alias("_one"), F.col("_class").alias("_item")), [key, "_one"], "left")
    asks = F.get("_words", F.lit(0)).isin(*ASKING) & (F.size("_words") > 1)
    word = F.when(asks, "bool").when(F.col("_last").isin(*TEXT_NAMES), "String").when(F.col("_last").isin(*WHOLE_NAMES), "int").when(F.col("_last").isin(*REAL_NAMES), "float")
    many = F.when(F.col("_item").isNotNull() & (F.col("_one") != F.col("_last")), F.concat(F.lit("List["), "_item", F.lit("]")))
    return rows.withColumn("hint", F.coalesce("_class", many, word)).drop("_words", "_last", "_class", "_one", "_item")


def unanimous(observations: DataFrame, keys: list[str], column: str = "datatype") -> DataFrame:
    """A type is known only if all observations agree and none is unknown."""
    return observations.groupBy(*keys).agg(F.when((F.count_distinct(column) == 1) & F.bool_and(F.col(column).isNotNull()), F.max(column)).alias(column))


def first_assigned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first assignment of each name; constructors come first."""
    w = Window.partitionBy(*keys).orderBy(F.col("is_constructor").desc(), "ord")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def reconciled(names: DataFrame, key: str = "doc_id", column: str = "name") -> DataFrame:
    """Spellings of a name that differ in case only become the one with fewest capitals (the first of equals)."""
    w = Window.partitionBy(key, F.lower(column)).orderBy(capitals(column), "ord", column)
    return names.withColumn(column, F.first(column).over(w))


def standard_imports(types: DataFrame, table: dict[str, str], key: str = "doc_id") -> DataFrame:
    """(key, id, imports) of the mapped types that need an import."""
    spark = types.sparkSession
    need = F.broadcast(spark.createDataFrame(sorted(table.items()), "mapped string, module string"))
    return types.join(need, "mapped").groupBy(key, "id").agg(F.sort_array(F.collect_set("module")).alias("imports"))


def degrees(nodes: DataFrame, edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """nodes with in_degree and out_degree; a bar with more edges in than out is a join, else a fork."""
    ends = edges.select(key, F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy(key, F.col("e.id").alias("id")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    out = nodes.join(counts, [key, "id"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree")})
    return out.withColumn("type", F.when(F.col("type") == "bar", F.when(F.col("in_degree") > F.col("out_degree"), "join").otherwise("fork")).otherwise(F.col("type")))


def members_of_lines(lines: DataFrame, key: list[str] = ("doc_id", "id")) -> DataFrame:
    """Recognised lines (compartment, ord, line) of class boxes to attributes and methods.

    A line with a call's parenthesis is a method, whatever its compartment; any
    other line of the method compartment is dropped. Names are reconciled later.
    """
    rows = lines.withColumns({"is_method": is_method_line("line"), "attribute": attribute_line("line"), "method": method_line("line")})
    rows = rows.where((F.col("is_method") & F.col("method").isNotNull()) | (~F.col("is_method") & (F.col("compartment") != "methods") & F.col("attribute").isNotNull()))
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("m"))))), lambda x: x["m"])
    return rows.groupBy(*key).agg(ordered("attribute").alias("attributes"), ordered("method").alias("methods"))
