"""Source code columns to documents: one row in, one row (or one per method) out, failures as data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schemas as S
from weftgraph.extract import java_source, javascript_source, python_source


@dataclass(frozen=True)
class Reader:
    parse: Callable[[str], dict]
    methods: Callable[[str], list[tuple[str, str]]]
    control_flow: Callable[[str, str, str], dict]


READERS: dict[str, Reader] = {name: Reader(m.parse, m.methods, m.control_flow) for name, m in (("python", python_source), ("java", java_source), ("javascript", javascript_source))}


def register(language: str, reader: Reader) -> None:
    READERS[language] = reader


def _reader(language: str) -> Reader:
    if language not in READERS:
        raise ValueError(f"no reader for language '{language}'")
    return READERS[language]


def _read(source: str | None, language: str) -> dict:
    if not (source or "").strip():
        raise ValueError("the source is empty")
    return _reader(language).parse(source)


def class_documents(sources: DataFrame, key_type: str = "long") -> DataFrame:
    """(doc_id, language, source) to (doc_id, doc, error)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, language, source in zip(part["doc_id"], part["language"], part["source"], strict=True):
                try:
                    rows.append((key, _read(source, language), None))
                except (ValueError, RecursionError) as e:
                    rows.append((key, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "doc", "error"])

    return sources.select("doc_id", "language", "source").mapInPandas(run, f"doc_id {key_type}, doc {S.CLASS_DOC}, error string")


def method_flows(sources: DataFrame, key_type: str = "long") -> DataFrame:
    """(doc_id, class_name, method_name, doc, error): a row per method; a source that can't be read is one row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, language, source in zip(part["doc_id"], part["language"], part["source"], strict=True):
                try:
                    found = _reader(language).methods(source or "")
                except ValueError as e:
                    rows.append((key, None, None, None, str(e)))
                    continue
                for c, m in found:
                    try:
                        rows.append((key, c, m, READERS[language].control_flow(source, c, m), None))
                    except (ValueError, RecursionError) as e:
                        rows.append((key, c, m, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "class_name", "method_name", "doc", "error"])

    return sources.select("doc_id", "language", "source").mapInPandas(run, f"doc_id {key_type}, class_name string, method_name string, doc {S.ACTIVITY_DOC}, error string")


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """Source files as (path, language, source), whole."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("source"))
    ends = {"py": "python", "java": "java", "js": "javascript"}
    suffix = F.lower(F.substring_index("path", ".", -1))
    return rows.withColumn("language", F.coalesce(*[F.when(suffix == k, v) for k, v in ends.items()]))
