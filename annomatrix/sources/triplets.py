"""Annotated matrices from DataFrames."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import NUMERIC, AnnotatedMatrix

#: Bytes of compressed files whose entries a task groups at once.
PART_BYTES = 1 << 22


def _named(df: DataFrame, key: str, name: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.col(key).cast("string"))


def _by_observation(x: DataFrame) -> DataFrame:
    """x dealt by obs_idx, in parts of some PART_BYTES of the files that it is read from. A number that follows the input keeps
    a task's groups few, as Spark would join parts by their compressed bytes; and what is grouped by observation, or joined
    by it, needs no further shuffle."""
    if x.isStreaming:
        return x
    jvm, conf = x.sparkSession._jvm, x.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in x.inputFiles()]
    size = sum(path.getFileSystem(conf).getFileStatus(path).getLen() for path in paths)
    least = x.sparkSession.sparkContext.defaultParallelism
    return x.repartition(max(least, -(-size // PART_BYTES)), "obs_idx") if size else x.repartition("obs_idx")


def from_triplets(
    x: DataFrame,
    obs: DataFrame | None = None,
    var: DataFrame | None = None,
    obs_col: str = "obs_idx",
    var_col: str = "var_idx",
    value_col: str = "value",
    layout: str = "csr",
    unique: bool = False,
) -> AnnotatedMatrix:
    """x: one row per entry. Repeated coordinates are summed unless unique says that there are none, which saves a
    shuffle. Rows with a null coordinate or value are no entries. Without obs or var, the axis is what x mentions."""
    if not isinstance(x.schema[value_col].dataType, NUMERIC):
        raise TypeError(f"values are numbers, not {x.schema[value_col].dataType.simpleString()}")
    x = x.select(
        F.col(obs_col).cast("long").alias("obs_idx"),
        F.col(var_col).cast("long").alias("var_idx"),
        F.col(value_col).cast("double").alias("value"),
    ).where("obs_idx is not null and var_idx is not null and value is not null")
    if not unique:
        x = _by_observation(x).groupBy("obs_idx", "var_idx").agg(F.sum("value").alias("value"))
    obs = x.select("obs_idx").distinct() if obs is None else obs
    var = x.select("var_idx").distinct() if var is None else var
    return AnnotatedMatrix(x, _named(obs, "obs_idx", "obs_name"), _named(var, "var_idx", "var_name"), layout=layout)


def from_arrays(
    df: DataFrame, id_col: str, array_col: str, var: DataFrame | None = None, layout: str = "csr"
) -> AnnotatedMatrix:
    """df: one row per observation with its values in one array. Every position is stored, zeros too; a null element
    is not. Other columns of df annotate obs. Without var, it has as many rows as the longest array, found in one
    pass."""
    keep = [c for c in df.columns if c not in (id_col, array_col, "obs_idx")]
    obs = df.select(F.col(id_col).cast("long").alias("obs_idx"), *keep)
    x = df.select(F.col(id_col).cast("long").alias("obs_idx"), F.posexplode(array_col).alias("var_idx", "value"))
    x = x.where("obs_idx is not null and value is not null").select(
        "obs_idx", F.col("var_idx").cast("long").alias("var_idx"), F.col("value").cast("double").alias("value")
    )
    if var is None:
        widest = df.agg(F.max(F.size(array_col)).alias("n"))
        var = widest.where("n > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("var_idx"))
    return AnnotatedMatrix(x, _named(obs, "obs_idx", "obs_name"), _named(var, "var_idx", "var_name"), layout=layout)


def from_nested(
    df: DataFrame, id_col: str, array_col: str, trailing: tuple[int, ...] | None = None, layout: str = "csr"
) -> AnnotatedMatrix:
    """df: one row per observation with its values in an array of arrays, nested to any depth. The first axis and the
    trailing ones become columns, the last running fastest; trailing says how long each of those is, or else one pass finds
    the longest of each. Values that are no numbers are 0, null ones are not stored; a null array has no entries, a short one
    leaves those beyond it out, and one longer than trailing says is an error. A plain array, or no array, is a TypeError."""
    depth, kind = 0, df.schema[array_col].dataType
    while isinstance(kind, T.ArrayType):
        depth, kind = depth + 1, kind.elementType
    if depth < 2 or not isinstance(kind, (*NUMERIC, T.StringType, T.BooleanType)):
        raise TypeError(f"an array of arrays of numbers, not {df.schema[array_col].dataType.simpleString()}")
    id_long, arrays = F.col(id_col).cast("long").alias("obs_idx"), F.col(array_col)
    levels = [f"i{k}" for k in range(depth)]
    x = df.select(id_long, arrays.alias("a"))
    for i in levels:
        x = x.select("obs_idx", *levels[: levels.index(i)], F.posexplode("a").alias(i, "a"))
    if trailing is None:
        longest = x.agg(*[F.max(i) for i in levels[1:]]).first()  # one row
        trailing = tuple((n if n is not None else -1) + 1 for n in longest)
    if len(trailing) != depth - 1 or min(trailing) < 0:
        raise ValueError(f"{depth - 1} lengths of trailing axes, none negative")
    at = F.col("i0").cast("long")
    for i, n in zip(levels[1:], trailing, strict=True):
        at = at * n + F.when(F.col(i) < n, F.col(i)).otherwise(F.raise_error(F.lit(f"an array is longer than {n}")).cast("int"))
    value = F.when(F.col("a").isNotNull(), F.coalesce(F.col("a").try_cast("double"), F.lit(0.0)))
    x = x.select("obs_idx", at.alias("var_idx"), value.alias("value")).where("obs_idx is not null and value is not null")
    width = F.lit(prod(trailing)).cast("long") * F.coalesce(F.max(F.size(arrays)), F.lit(0))
    var = df.agg(width.alias("n")).where("n > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("var_idx"))
    keep = [c for c in df.columns if c not in (id_col, array_col, "obs_idx")]
    obs = df.select(id_long, *[F.col("`" + c.replace("`", "``") + "`") for c in keep])
    return AnnotatedMatrix(x, _named(obs, "obs_idx", "obs_name"), _named(var, "var_idx", "var_name"), layout=layout)


def from_dense(df: DataFrame, id_col: str, value_cols: list[str], layout: str = "csr") -> AnnotatedMatrix:
    """df: one numeric column per variable. var_name is the column's name."""
    spark = df.sparkSession
    pairs = [F.struct(F.lit(i).cast("long").alias("var_idx"), F.col(c).cast("double").alias("value")) for i, c in enumerate(value_cols)]
    x = df.select(F.col(id_col).cast("long").alias("obs_idx"), F.inline(F.array(*pairs))).where("value is not null")
    schema = T.StructType([T.StructField("var_idx", T.LongType(), False), T.StructField("var_name", T.StringType(), False)])
    var = spark.createDataFrame(list(enumerate(value_cols)), schema)
    obs = df.select(F.col(id_col).cast("long").alias("obs_idx"), *[c for c in df.columns if c not in (id_col, *value_cols)])
    return AnnotatedMatrix(x, _named(obs, "obs_idx", "obs_name"), var, layout=layout)
