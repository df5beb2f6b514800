"""Header statistics and dead traces of trace tables that grow, as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.grid import dead


def arriving_traces(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Traces of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_stats(headers: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, minimum and maximum of each column over all traces so far (complete mode)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")
    return headers.select(pairs).select("p.*").groupBy("field").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"))


def dead_counts(traces: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Dead and live traces by time window; windows close when no trace of theirs may still come (append mode)."""
    is_dead = dead(F.col("samples"), zeros=True).cast("int")
    rows = traces.withWatermark(time, late).groupBy(F.window(time, window))
    return rows.agg(F.sum(is_dead).alias("dead"), F.sum(1 - is_dead).alias("live"))
