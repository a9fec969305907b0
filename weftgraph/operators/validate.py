"""Violations of documents as rows: (doc_id, rule, ord, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import schemas as S


def unknown_ends(edges: DataFrame, ids: DataFrame, ends: dict[str, str], what: str, key: str = "doc_id") -> DataFrame:
    """Edges whose ends are no known id; ends: column -> the word that names it. One anti join for each end."""
    out = []
    for place, (column, said) in enumerate(ends.items()):
        known = ids.select(key, F.col("id").alias(column)).distinct()
        lost = edges.join(known, [key, column], "left_anti")
        message = F.format_string(f"{what} '%s' references unknown {said} '%s'", F.col("id"), F.col(column))
        out.append(lost.select(key, F.lit(f"unknown_{said.replace(' ', '_')}").alias("rule"), (F.col("ord") * len(ends) + place).alias("ord"), message.alias("message")))
    return reduce(DataFrame.unionByName, out)


def outside_domain(rows: DataFrame, column: str, domain: tuple[str, ...], key: str = "doc_id") -> DataFrame:
    bad = rows.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False)))
    return bad.select(key, F.lit(f"domain_{column}").alias("rule"), "ord", F.format_string("unknown value '%s'", F.col(column)).alias("message"))


def class_violations(docs: DataFrame) -> DataFrame:
    """All problems of class documents."""
    classes, rels = S.classes(docs), S.relationships(docs)
    parts = [
        unknown_ends(rels, classes, {"source": "source class", "destination": "destination class"}, "Relationship"),
        outside_domain(classes, "kind", S.CLASS_KINDS),
        outside_domain(rels, "type", S.RELATIONSHIP_TYPES),
        outside_domain(S.members(docs, "attributes"), "visibility", S.VISIBILITIES),
        outside_domain(S.members(docs, "methods"), "visibility", S.VISIBILITIES),
    ]
    return reduce(DataFrame.unionByName, parts)


def start_and_end(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without exactly one start or without an end."""
    counts = nodes.groupBy(key).agg(F.count_if(F.col("type") == "start").alias("starts"), F.count_if(F.col("type") == "end").alias("ends"))
    one = counts.where("starts != 1").select(key, F.lit("one_start").alias("rule"), F.lit(0).alias("ord"), F.format_string("exactly one start node is needed, found %d", F.col("starts")).alias("message"))
    end = counts.where("ends = 0").select(key, F.lit("some_end").alias("rule"), F.lit(1).alias("ord"), F.lit("at least one end node is needed").alias("message"))
    return one.unionByName(end)


def activity_violations(docs: DataFrame) -> DataFrame:
    """All problems that keep an activity document from being stored."""
    nodes, edges = S.nodes(docs), S.edges(docs)
    empty = docs.where("coalesce(size(doc.nodes), 0) <= 0").select("doc_id", F.explode(F.array(F.struct(F.lit("one_start").alias("rule"), F.lit(0).alias("ord"), F.lit("exactly one start node is needed, found 0").alias("message")), F.struct(F.lit("some_end").alias("rule"), F.lit(1).alias("ord"), F.lit("at least one end node is needed").alias("message")))).alias("v")).select("doc_id", "v.*")
    return reduce(DataFrame.unionByName, [unknown_ends(edges, nodes, {"source": "source node", "target": "target node"}, "Edge"), start_and_end(nodes), empty, outside_domain(nodes, "type", S.NODE_TYPES)])


def out_degree_problems(nodes: DataFrame, edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Nodes whose outgoing edges don't fit their type: decisions need two or more, an end none, others at least one."""
    counts = edges.groupBy(key, F.col("source").alias("id")).agg(F.count("*").alias("n"))
    rows = nodes.join(counts, [key, "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = F.when(F.col("type") == "decision", F.when(F.col("n") < 2, "a decision needs at least two outgoing edges")).when(F.col("type") == "end", F.when(F.col("n") > 0, "an end has no outgoing edge")).when(F.col("n") == 0, "a node needs an outgoing edge")
    return rows.where(bad.isNotNull()).select(key, F.lit("out_degree").alias("rule"), "ord", F.concat_ws(": ", "id", bad).alias("message"))


def first_violation(violations: DataFrame, key: str = "doc_id") -> DataFrame:
    return violations.groupBy(key).agg(F.min_by("message", F.struct("ord", "rule", "message")).alias("message"))


def too_long(rows: DataFrame, fields: tuple[str, ...], source: str | None = None, key: str = "doc_id") -> DataFrame:
    """Fields over 255 characters, and a source text over 200,000."""
    parts = [rows.where(F.length(c) > n).select(key, F.lit("too_long").alias("rule"), F.lit(k).alias("ord"), F.lit(c).alias("message")) for k, (c, n) in enumerate([(c, 255) for c in fields] + ([(source, 200_000)] if source else []))]
    return reduce(DataFrame.unionByName, parts)


def supported_language(language: str) -> None:
    if language not in S.LANGUAGES:
        raise ValueError(f"language '{language}' is not one of {S.LANGUAGES}")
