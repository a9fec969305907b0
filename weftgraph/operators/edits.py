"""Editor operations over tables: ids, cascades, guards, copies and the edit history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY, COALESCE_MS = 50, 600
SHIFT = 32.0


def next_number(ids: DataFrame, prefix: str, key: str = "doc_id") -> DataFrame:
    """(key, next): one more than the largest number behind the prefix; other ids are ignored."""
    number = F.try_to_number(F.regexp_extract("id", f"^{prefix}([0-9]+)$", 1), F.lit("999999999999")).cast("long")
    return ids.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))


def delete_with_edges(boxes: DataFrame, edges: DataFrame, gone: DataFrame, ends: tuple[str, str] = ("source", "destination"), key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Boxes without the given ids, and the edges that touch none of them."""
    for end in ends:
        edges = edges.join(gone.select(key, F.col("id").alias(end)), [key, end], "left_anti")
    return boxes.join(gone.select(key, "id"), [key, "id"], "left_anti"), edges


def new_edges(edges: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Wanted edges that may be added: none to itself, none that is there, each once."""
    fresh = wanted.where("source != target").dropDuplicates([key, "source", "target"])
    return fresh.join(edges.select(key, "source", "target"), [key, "source", "target"], "left_anti")


def duplicated(rows: DataFrame, chosen: DataFrame, prefix: str, key: str = "doc_id") -> DataFrame:
    """Copies of chosen rows with fresh ids, a step aside; a start node is never copied."""
    copies = rows.join(chosen.select(key, "id"), [key, "id"], "left_semi")
    if "type" in rows.columns:
        copies = copies.where("type != 'start'")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    copies = copies.withColumn("_r", rank).join(next_number(rows, prefix, key), key)
    copies = copies.withColumn("id", F.concat(F.lit(prefix), (F.col("next") + F.col("_r") - 1).cast("string")))
    copies = copies.withColumn("position", F.struct((F.col("position.x") + SHIFT).alias("x"), (F.col("position.y") + SHIFT).alias("y")))
    last = rows.groupBy(key).agg(F.max("ord").alias("_last"))
    copies = copies.join(last, key).withColumn("ord", (F.col("_last") + F.col("_r")).cast(dict(rows.dtypes)["ord"]))
    return rows.unionByName(copies.select(*rows.columns))


def coalesced(edits: DataFrame, key: str = "doc_id", kind: str = "edit", at: str = "ts") -> DataFrame:
    """Edits of one kind less than COALESCE_MS apart become one entry: (key, entry, kind, first, last, n), the last HISTORY of each document."""
    w = Window.partitionBy(key).orderBy(at, "edit_id")
    apart = F.col(at) >= F.lag(at).over(w) + F.make_dt_interval(secs=F.lit(COALESCE_MS / 1000))
    fresh = F.coalesce((F.lag(kind).over(w) != F.col(kind)) | apart, F.lit(True))
    rows = edits.withColumn("entry", F.sum(fresh.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(key, "entry").agg(F.max(kind).alias(kind), F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.col("entry").desc()))
    return out.withColumn("_r", newest).where(F.col("_r") <= HISTORY).drop("_r")


def step_islands(steps: DataFrame, breaks: Column, label: str = "label", key: str = "doc_id") -> DataFrame:
    """Straight runs of steps as one action: (key, island, n, text); a breaking step ends a run and stands alone."""
    w = Window.partitionBy(key).orderBy("ord")
    turned = F.coalesce(breaks | F.lag(breaks).over(w), F.lit(True))
    rows = steps.withColumn("island", F.sum(turned.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.col(label).alias("label")))), lambda s: s["label"]), "; ")
    return rows.groupBy(key, "island").agg(F.count("*").alias("n"), said.alias("text"))


def to_editor(attributes: DataFrame) -> DataFrame:
    return attributes.withColumnRenamed("default_value", "defaultValue").withColumnRenamed("return_type", "returnType")


def to_wire(attributes: DataFrame) -> DataFrame:
    return attributes.withColumnRenamed("defaultValue", "default_value").withColumnRenamed("returnType", "return_type")
