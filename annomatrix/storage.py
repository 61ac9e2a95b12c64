"""Tables that cut the lineage of iterative operators, in the folder that the cluster's machines share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def new_path(spark: SparkSession) -> str:
    """A path in spark.checkpoint.dir that nothing uses yet. Where the setting is unset, a session of one machine gets a
    temporary folder, and one on a cluster an error."""
    folder = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT} to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(CHECKPOINT, folder)
    return f"{folder.rstrip('/')}/matrix/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes df once, as Parquet at a new path of the shared folder, and reads it again."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what stored() wrote."""
    spark: SparkSession = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
