"""Written intermediate tables in the folder named by ``spark.checkpoint.dir``: lineage ends there and lost executors cost nothing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Paths that were written in the open scopes, the innermost last.
_scopes: list[list[str]] = []


@cache
def _own() -> str:
    """A local folder for sessions without the setting, as in tests."""
    return tempfile.mkdtemp(prefix="weftgraph-")


def base_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; only a session that runs on one machine, as in tests, may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base or _own()


def noted(path: str) -> str:
    """``path``, which the innermost scope deletes at its end."""
    if _scopes:
        _scopes[-1].append(path)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that operators write within it. Results are lazy and read them, so write or collect results inside.

    For one driver thread at a time, and for classic sessions.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            deleted(spark, path)


def persisted(df: DataFrame) -> DataFrame:
    """Written once and read back.

    What a table's files take says little of its rows in memory, as ids and repeated
    values are packed, so joins with it go by shuffles and not by sending it round whole.
    """
    spark = df.sparkSession
    base = base_folder(spark)
    path, schema = noted(f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path).hint("merge")
