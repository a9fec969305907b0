"""Edits and documents as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edit_sessions(edits: DataFrame, key: str = "doc_id", kind: str = "edit", at: str = "ts", gap: str = "600 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Runs of edits of one kind as session windows, for unbounded input: (key, kind, first, last, n).

    The batch form ends a run at an edit of another kind too; a session window knows time alone, which is stated here rather than hidden.
    """
    w = F.session_window(F.col(at), gap)
    return edits.withWatermark(at, late).groupBy(key, kind, w).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).select(key, kind, "first", "last", "n")


def step_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of steps by kind in tumbling windows."""
    w = F.window(F.col(at), width)
    return events.withWatermark(at, late).groupBy(w, kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
