"""Quality rules by cross-document line frequency, in DataFrame functions only.

A line is normalised (lower case, white space runs to one space, trimmed) and
hashed; for each host the distinct documents (by text) that hold it are
counted. Lines in more than ``share`` of a host's documents, and in more than
``least`` of them, are removed: boilerplate of a part of a host counts too, so the
share is small, and the least keeps what a few documents of a small host quote; a document that loses more than ``deplete`` of
its words is rejected, as is one that fails the base rules.

Defined cases: null or empty text has no words and fails the base rules; a null
host is a host of its own; copies of one text count once; rows that repeat are
judged alike; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.store import written

SPACES = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SALTS = 16


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(HAS_WORD))


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACES, " ")))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a plain column that is used often would be copied when filters are pushed down."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(hashes: Column) -> Column:
    """Words that lie in windows found twice or more, from the words' hashes."""

    def covered(at: Column) -> Column:
        reach = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1), p + WINDOW) - p))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def places(s: Column) -> Column:
        again = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | (F.get(s, j + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def of_windows(w: Column) -> Column:
        # only texts in which a window returns are sorted
        ordered = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(ordered, places)).otherwise(F.lit(0))

    def doubled(h: Column, k: int) -> Column:
        """Hashes of windows twice as long, from those of windows of k words."""
        return F.zip_with(F.slice(h, F.lit(1), F.size(h) - k), F.slice(h, F.lit(k + 1), F.size(h) - k), lambda a, b: F.xxhash64(a, b))

    windows = let(doubled(hashes, 1), lambda two: let(doubled(two, 2), lambda four: doubled(four, 4)))  # of WINDOW words
    return F.when(F.size(hashes) >= WINDOW, let(windows, of_windows)).otherwise(F.lit(0))


def with_metrics(docs: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    counts = let(F.transform(words(whole), lambda w: F.xxhash64(w)), lambda h: F.struct(F.size(h).alias("n"), _repeated(h).alias("r")))
    out = docs.withColumn("_counts", counts).withColumns({"n_words": F.col("_counts.n").cast("long"), "n_repeat_words": F.col("_counts.r").cast("long")}).drop("_counts")
    return out.withColumns(
        {
            "word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines(whole), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", share: float = 0.005, least: int = 10) -> DataFrame:
    """One row per host that has such lines: host_key, and hot: the keys of its too frequent lines."""
    texts = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("copy"), F.col(text).alias("text"))
    rows = texts.select("host_key", "copy", F.explode(F.array_distinct(F.transform(lines(F.col("text")), line_key))).alias("line"))
    seen = rows.groupBy("host_key", "line").agg(F.count_distinct("copy").alias("n_docs")).where(F.col("n_docs") > least)
    hosts = texts.groupBy("host_key").agg(F.count_distinct("copy").alias("host_docs"))
    hot = seen.join(hosts, "host_key").where(F.col("n_docs") > share * F.col("host_docs"))
    # of a host's lines at most (its lines a document) / share can pass, so a row stays small
    return written(hot.groupBy("host_key").agg(F.collect_set("line").alias("hot")))


def judged(docs: DataFrame, text: str = "text", host: str = "source", share: float = 0.005, least: int = 10, deplete: float = 0.70) -> DataFrame:
    """docs with the metrics, n_lost_words (words in removed lines), kept, and clean_text.

    The hosts' lists are joined without a hint: their file size decides whether they are broadcast.
    """
    hot = frequent_lines(docs, text, host, share, least).withColumnRenamed("host_key", "_host").withColumnRenamed("hot", "_hot")
    # a host may have a third of all rows: its documents are dealt over SALTS shares, each with a copy of the list
    hot = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = with_metrics(docs, text).withColumns({"_host": F.coalesce(F.col(host).cast("string"), F.lit("")), "_salt": F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int")}).join(hot, ["_host", "_salt"], "left").drop("_salt")
    all_lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rest = F.filter(all_lines, lambda x: ~(x.rlike(HAS_WORD) & F.array_contains("_hot", line_key(x))))
    cut = let(rest, lambda r: F.when(F.size(r) < F.size(all_lines), F.array_join(r, "\n")))
    out = out.withColumn("_cut", F.when(F.col("_hot").isNotNull(), cut))
    out = out.withColumn("n_lost_words", F.when(F.col("_cut").isNotNull(), F.col("n_words") - F.size(words(F.col("_cut")))).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn("clean_text", F.coalesce("_cut", F.col(text)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= deplete * F.col("n_words"))).drop("_host", "_hot", "_cut")


def quality_stage(docs: DataFrame, **params) -> DataFrame:
    """The documents that pass, without their too frequent lines, in the columns of ``documents`` (others are dropped)."""
    out = judged(docs.select("doc_id", "text", "lang", "source", "n_chars"), **params)
    # the row number keeps the filter above the metrics, which would else be computed twice
    out = out.withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0")
    return out.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", F.length("clean_text").cast("long").alias("n_chars"))
