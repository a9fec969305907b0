"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

A document's set holds the hashes of its distinct word shingles. Its sketch has
t coordinates, filled in rounds: in the first t rounds each element falls into
a hashed bin, in round t + j every element competes for bin j, and a value of an
earlier round always wins. So every coordinate fills, with the concentration of
independent MinHash at a cost near t log t + set size (Dahlgaard, Knudsen,
Thorup 2017). Bands of ``ROWS`` coordinates send similar sets into common
buckets; the number of bands follows from the threshold and MISS.

Buckets give only star links (member, smallest member) - never all pairs. Their
connected components are candidate clusters, in which all pairs are compared on
full sets, block by block: a cluster too large for a task is dealt into classes
by set size (sets whose sizes differ by more than the threshold can't be
similar) and salted blocks, and only blocks of equal or adjacent classes meet.

Defined cases: texts with equal sets form one class before anything is compared;
null, empty or wordless texts have an empty set and are linked with nothing; rows
that repeat a doc_id count as one document; a row with a null doc_id is linked
with nothing and kept; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.arrays import U, Words, as_bytes, batches, mix
from weftgraph.llm.components import components
from weftgraph.llm.store import dropped, released, written

ROWS = 8
#: Chance that two sets exactly at the threshold share no band.
MISS = 1e-6
#: Most documents and shingles of a block of the verification.
BLOCK_DOCS, BLOCK_SHINGLES = 1500, 1_500_000
_FULL = U((1 << 64) - 1)


def bands_for(num: int, den: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (num / den) ** ROWS))


def sketches(doc: np.ndarray, element: np.ndarray, n: int, t: int) -> np.ndarray:
    """(n, t) sketch values of n sets, given as (set, distinct element) pairs. A set without elements stays at the largest value."""
    bins = np.full(n * t, _FULL, U)
    for turn in range(2 * t):
        if not len(doc):
            break
        g = mix(element, turn + 1)
        value = (g >> U(16)) | (U(turn) << U(48))
        if turn < t:
            to = ((mix(g, 3) >> U(32)) * U(t)) >> U(32)
        else:
            to = U(turn - t)
        np.minimum.at(bins, doc * t + to.astype(np.int64), value)
        open_ = (bins.reshape(n, t) == _FULL).any(1)
        left = open_[doc]
        if not left.all():
            doc, element = doc[left], element[left]
    return bins.reshape(n, t)


def _sketched(words: int, num: int, den: int):
    n_bands = bands_for(num, den)
    t = n_bands * ROWS

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = zip(part.column(0).to_pylist(), map(lambda x: as_bytes(x, "ascii"), part.column(1).to_pylist()), strict=True)
            for batch in batches(rows, lambda r: len(r[1]) + 4 * t):  # a short text's sketch is larger than the text
                w = Words([x for _, x in batch])
                doc, element = w.shingles(words)
                n = len(batch)
                size = np.bincount(doc, minlength=n)
                key = np.zeros((2, n), U)
                for k in (0, 1):
                    np.add.at(key[k], doc, mix(element, 91 + k))
                sig = sketches(doc, element, n, t).reshape(n, n_bands, ROWS)
                band = np.zeros((n, n_bands), U)
                for k in range(ROWS):
                    band = mix(band ^ sig[:, :, k], k + 1)
                band = mix(band + np.arange(n_bands, dtype=U)).view(np.int64)
                band_lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_bands), pa.array(band.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in batch], pa.int64()), pa.array(size), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), band_lists],
                    ["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return run


def linked(doc: np.ndarray, element: np.ndarray, n: int, num: int, den: int) -> np.ndarray:
    """For each of n sets the smallest index of a set that it is linked with, directly or over others. Exact."""
    size = np.bincount(doc, minlength=n)
    values, column, df = np.unique(element, return_inverse=True, return_counts=True)
    common = np.zeros((n, n))  # a block of columns is exact in single precision, their sum needs double
    dense = np.flatnonzero(df > 12)
    place = np.full(len(values), -1)
    for at in range(0, len(dense), 2048):
        now = dense[at : at + 2048]
        place[:] = -1
        place[now] = np.arange(len(now))
        use = place[column] >= 0
        one = np.zeros((n, len(now)), np.float32)
        one[doc[use], place[column[use]]] = 1
        common += one @ one.T
    rare = np.flatnonzero((df[column] > 1) & (df[column] <= 12))
    rare = rare[np.argsort(column[rare], kind="stable")]
    c, d = column[rare], doc[rare]
    for gap in range(1, 12):
        same = np.flatnonzero(c[gap:] == c[:-gap])
        if not len(same):
            break
        i, j = d[same], d[same + gap]
        np.add.at(common, (i, j), 1)
        np.add.at(common, (j, i), 1)
    link = (den + num) * common.astype(np.int64) >= num * (size[:, None] + size[None, :])
    link &= (size > 0)[:, None] & (size > 0)[None, :]
    label = np.arange(n)
    seen = size == 0
    for i in range(n):
        if not seen[i]:
            frontier = np.zeros(n, bool)
            frontier[i] = True
            member = frontier.copy()
            while frontier.any():
                frontier = link[frontier].any(0) & ~member
                member |= frontier
            label[member] = i
            seen |= member
    return label


def _verified(words: int, num: int, den: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        rep, other = [], []
        for _, group in part.groupby("block", sort=False):
            group = group.drop_duplicates(["rep", "text"]).sort_values("rep", kind="stable")
            ids = group["rep"].to_numpy()
            doc, element, base = [], [], 0
            for batch in batches((as_bytes(x, "ascii") for x in group["text"]), lambda x: len(x) + 1):
                d, e = Words(batch).shingles(words)
                doc.append(d + base)
                element.append(e)
                base += len(batch)
            label = linked(np.concatenate(doc), np.concatenate(element), len(ids), num, den)
            rep.append(ids)
            other.append(ids[label])
        out = pd.DataFrame({"rep": np.concatenate(rep), "other": np.concatenate(other)})
        return out[out.rep != out.other]

    return run


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked where den * intersection >= num * union."""
    spark = docs.sparkSession
    source = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = source.mapInArrow(_sketched(words, num, den), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")
    made = written(made)
    key = ["k1", "k2", "n_shingles"]
    full = made.where("n_shingles > 0 and doc_id is not null")
    every = written(made.drop("bands"))
    reps = written(full.groupBy(*key).agg(F.min(F.struct("doc_id", "bands")).alias("r")).select(*key, F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands")))
    dropped(made)
    classes = written(reps.drop("bands"))
    rows = reps.select("rep", F.explode("bands").alias("band"))
    centres = rows.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre != last").drop("last")
    stars = rows.join(centres, "band").where("rep != centre").select("rep", "centre").distinct()
    # each set's smallest centre stands for it, so that the many centres of a large group shrink to a few links
    stars = written(stars)
    first = written(stars.groupBy("rep").agg(F.min("centre").alias("least")))
    ends = stars.join(first, "rep").select(F.col("least").alias("a"), "centre").distinct()
    ends = ends.join(first.select(F.col("rep").alias("centre"), F.col("least").alias("b")), "centre", "left").select("a", F.coalesce("b", "centre").alias("b")).distinct()
    links = first.select(F.col("rep").alias("a"), F.col("least").alias("b")).unionByName(ends)
    clusters = components(links, "a", "b").withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster")
    dropped(reps)
    sized = written(clusters.join(classes.select("rep", F.col("n_shingles").alias("size")), "rep"))
    released(spark)
    totals = sized.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("size").alias("shingles"))
    totals = totals.withColumn("large", (F.col("docs") > BLOCK_DOCS) | (F.col("shingles") > BLOCK_SHINGLES))
    totals = written(totals)
    tasks = max(1, math.ceil((totals.agg(F.sum(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES))).first()[0] or 0) * 2))
    small = sized.join(totals.where("not large").select("cluster"), "cluster").select("rep", F.col("cluster").cast("string").alias("block"), F.pmod(F.xxhash64("cluster"), F.lit(tasks)).cast("string").alias("task"))
    placed, any_large = small, totals.where("large").limit(1).count() > 0
    if any_large:
        step = math.log(den / num)
        large = sized.join(totals.where("large").select("cluster"), "cluster").withColumn("klass", F.floor(F.log("size") / step).cast("int"))
        deal = large.groupBy("cluster", "klass").agg(F.ceil(2 * F.greatest(F.count("*") / BLOCK_DOCS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("salts"))
        large = large.join(deal, ["cluster", "klass"])
        for side in (-1, 1):
            beside = deal.select("cluster", (F.col("klass") - side).alias("klass"), F.col("salts").alias(f"salts{side}"))
            large = large.join(beside, ["cluster", "klass"], "left")
        large = large.withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))
        name = lambda *x: F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in x])
        own = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: name("cluster", "klass", F.least("salt", s), "klass", F.greatest("salt", s)))
        up = F.when(F.col("salts1").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("salts1") - 1), lambda s: name("cluster", "klass", "salt", F.col("klass") + 1, s)))
        down = F.when(F.col("salts-1").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("salts-1") - 1), lambda s: name("cluster", F.col("klass") - 1, s, "klass", "salt")))
        # a block of one salt with itself is covered by any block with another
        blocks = F.array_distinct(F.concat(own, F.coalesce(up, F.array().cast("array<string>")), F.coalesce(down, F.array().cast("array<string>"))))
        large = large.select("rep", F.explode(blocks).alias("block"))
        placed = small.unionByName(large.withColumn("task", F.col("block")))
    placed = written(placed)
    found = source.withColumnRenamed("doc_id", "rep").join(placed, "rep").groupBy("task").applyInPandas(_verified(words, num, den), "rep long, other long")
    joined = components(written(found), "rep", "other") if any_large else found.groupBy(F.col("rep").alias("node")).agg(F.min("other").alias("component"))
    joined = written(joined)
    for table in (stars, first, sized, totals, placed):
        dropped(table)
    class_of = classes.select(*key, "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component"))
    out = every.join(class_of, key, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def near_duplicate_stage(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one document of each component left; rows that repeat a doc_id are one document and share its verdict."""
    verdict = near_duplicates(docs, **params)
    gone = verdict.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
