"""Written intermediate tables in the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from weftgraph.sources.scratch import base_folder, deleted, noted


def folder(spark: SparkSession) -> str:
    """A fresh path in the shared folder."""
    return f"{base_folder(spark).rstrip('/')}/weftgraph-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here, and sizes are known to the planner."""
    spark, path = df.sparkSession, noted(folder(df.sparkSession))
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._weft_path = path
    return out


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more; they would else stay on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    deleted(df.sparkSession, df._weft_path)
