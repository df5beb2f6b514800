"""Volumes as Parquet tables, and horizons, wells and headers as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_volume(traces: DataFrame, meta: dict, path: str, partition: str | None = None, group_bytes: int | None = None) -> None:
    """A folder with the traces as Parquet (in row groups of about ``group_bytes``) and the metadata as a one-row table; partitioned by a column of few labels."""
    writer = traces.write.mode("overwrite")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/traces")
    traces.sparkSession.createDataFrame([(json.dumps({k: v for k, v in meta.items() if v is not None}),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")


def read_volume(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/traces"), json.loads(spark.read.parquet(f"{path}/meta").first()[0])


def read_points(spark: SparkSession, path: str, columns: list[str], comment: str = "#") -> DataFrame:
    """Numeric columns of a text file with white space between them."""
    lines = spark.read.text(path).select(F.trim(F.translate("value", "\t", " ")).alias("value")).where((F.col("value") != "") & ~F.col("value").startswith(comment))
    parts = F.split("value", r"\s+")
    return lines.select(*[F.get(parts, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(columns)])


def write_headers(headers: DataFrame, path: str) -> None:
    headers.write.mode("overwrite").option("header", True).csv(path)


def file_type(path: str) -> str | None:
    """segy or volume by the ending of a path, else None."""
    ending = path.rsplit(".", 1)[-1].lower()
    return "segy" if ending in ("sgy", "segy") else "volume" if ending in ("parquet", "volume") else None
