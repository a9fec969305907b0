"""Bounded samples of labelled rows, and the rule that holds rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.store import dropped, written


def held_out(id: str = "doc_id") -> Column:
    """Rows whose crc32(id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> DataFrame:
    """(doc_id, label, text) of the labelled rows that are learned from.

    Of each class the ``per_class`` ids with the smallest hashes among those
    that have a document, and of their different texts ``per_class`` at most:
    one of each id first, then more in the order of a hash. Of these each is
    taken that still fits in ``max_chars`` characters together; one that doesn't
    is passed over (one longer than ``max_chars`` takes no place at all). Both
    bounds keep what the driver and the broadcast hold independent of the input.
    Held-out rows, null ids and null labels are left out.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    hashed = F.xxhash64("doc_id", F.lit(11))
    size = F.coalesce(F.length("text"), F.lit(0))
    # one scan finds the labelled texts by hash and size; all choices are made on this table
    sized = docs.where(size <= max_chars).select("doc_id", F.xxhash64("text").alias("same"), size.alias("n")).distinct()
    sized = written(sized.join(known, "doc_id"))
    present = sized.select("doc_id", "label").distinct()
    parts = [present.where(F.col("label") == k).orderBy(hashed, "doc_id").limit(per_class) for k in (0, 1)]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * per_class rows at most
    texts = written(sized.join(sample, ["doc_id", "label"]).select("doc_id", "label", "same", "n"))
    one = texts.groupBy("doc_id", "label").agg(F.min("same").alias("same")).withColumn("first", F.lit(0))
    ranked = texts.join(one, ["doc_id", "label", "same"], "left").select("doc_id", "label", "same", "n", F.coalesce("first", F.lit(1)).alias("later"), F.when(F.col("first") == 0, hashed).otherwise(F.xxhash64("same", "doc_id")).alias("h"))
    order = ["later", "h", "doc_id", "same"]
    parts = [ranked.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    left, chosen = {0: max_chars, 1: max_chars}, set()
    for r in sorted(parts[0].unionByName(parts[1]).collect(), key=lambda r: [r[c] for c in order]):
        if r["n"] <= left[r["label"]]:
            left[r["label"]] -= r["n"]
            chosen.add((r["doc_id"], r["label"], r["same"]))
    for table in (sized, texts):
        dropped(table)
    small = spark.createDataFrame(sorted(chosen), "doc_id long, label int, same long")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("same")).join(F.broadcast(small), ["doc_id", "same"])
    return rows.select("doc_id", "label", "text").distinct()
