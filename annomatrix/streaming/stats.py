"""Counts and sums of a growing matrix. Chunks of entries arrive as new Parquet files; the running totals are a
stateful aggregate, the streaming form of accumulating chunk by chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Direction


def read_entry_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Entries (obs_idx, var_idx, value) of the Parquet files that appear in a folder."""
    reader = spark.readStream.schema("obs_idx long, var_idx long, value double")
    return reader.option("maxFilesPerTrigger", files_per_batch).parquet(path)


def streaming_axis_stats(entries: DataFrame, direction: Direction) -> DataFrame:
    """Running count and sum per group seen so far; write it in complete or update mode. Groups without entries are
    not known to the stream: join the result to obs or var when it is read."""
    v = F.col("value").cast("double")
    return entries.groupBy(direction.key).agg(F.count(F.lit(1)).alias("count"), F.sum(v).alias("sum"))
