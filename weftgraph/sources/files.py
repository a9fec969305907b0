"""Files in and out: images, generated code, diagram text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def images(spark: SparkSession, path: str) -> DataFrame:
    """PNG and JPEG files with bytes: (path, content, length); what the first bytes show counts, not the name."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content", "length").where("length > 0")
    head = F.hex(F.substring("content", 1, 4))
    return rows.where((head == "89504E47") | head.startswith("FFD8FF"))


def write_code(files: DataFrame, path: str) -> None:
    """Generated files as Parquet, by language and document; of equal names of a document the last written counts."""
    files.where("error is null").write.mode("overwrite").parquet(path)


def write_text(lines: DataFrame, path: str, column: str = "text") -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def base64_images(rows: DataFrame, column: str = "content") -> DataFrame:
    return rows.withColumn("image_base64", F.base64(column))
