"""Annotated matrices over the driver's tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..model import AnnotatedMatrix
from ..operators.positions import numbered
from ..sources import from_arrays, from_triplets


def orders_by_part(spark: SparkSession, sf_dir: str) -> AnnotatedMatrix:
    """Sparse: quantity of each part in each order."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    obs = read("orders").select(F.col("o_orderkey").alias("obs_idx"), "o_orderpriority", "o_totalprice")
    var = read("part").select(
        F.col("p_partkey").alias("var_idx"), F.col("p_name").alias("var_name"), (F.col("p_size") > 40).alias("large")
    )
    return from_triplets(read("lineitem"), obs, var, "l_orderkey", "l_partkey", "l_quantity")


def users_by_event(spark: SparkSession, sf_dir: str) -> AnnotatedMatrix:
    """Dense: summed value of each event type of each user. Types are numbered in alphabetic order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    types = events.where("event_type is not null").select(F.col("event_type").alias("var_name")).distinct()
    var = numbered(types, "var_name", "var_idx")
    x = events.join(var, F.col("event_type") == F.col("var_name"))
    return from_triplets(x, None, var.select("var_idx", "var_name"), "user_id", "var_idx", "value")


def vectors(spark: SparkSession, sf_dir: str) -> AnnotatedMatrix:
    """Dense with negative values: one observation per embedding."""
    return from_arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
