"""Tables that cut a job's lineage, in the folder that the cluster's machines share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"
#: Bytes of the rows that a Python worker gets at once, and that the JVM holds for it.
BATCH_BYTES = 1 << 21
#: The sets of tables of the open scopes of one thread, so that queries in several threads drop only their own.
_scopes: ContextVar[tuple[set[str], ...]] = ContextVar("scopes", default=())
_lock = Lock()
_bounded: dict[int, list] = {}


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a session of one machine gets a temporary folder, and
    one on a cluster an error, as no folder of a single machine is seen by the others."""
    found = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getConf().get(CHECKPOINT, None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT} to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(CHECKPOINT, found)
    return found


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds the Arrow batches of what is run inside by bytes, as those of whole texts grow large by rows. Of threads that
    are inside at the same time the last one out sets the session's own bound again."""
    key, own = "spark.sql.execution.arrow.maxBytesPerBatch", id(spark)
    with _lock:
        use = _bounded.setdefault(own, [0, spark.conf.get(key)])
        use[0] += 1
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        with _lock:
            use[0] -= 1
            if not use[0]:
                spark.conf.set(key, use[1])
                del _bounded[own]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to a new path of the shared folder and reads it again, so that a lost executor costs no
    recomputation of what came before. Inside scratch() the table is dropped at the end; the tables that a lazy result
    still reads stay in the folder for its owner to clear."""
    spark = df.sparkSession
    path = table_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    if scopes := _scopes.get():
        scopes[-1].add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Drops the tables made inside it, but for those put on the list, which go over to the scope outside."""
    kept: list[DataFrame] = []
    made: set[str] = set()
    outside = _scopes.get()
    _scopes.set((*outside, made))
    try:
        yield kept
    finally:
        _scopes.set(outside)
        stay = {df.table_path for df in kept} & made
        for path in made - stay:
            drop(spark, path)
        if outside:
            outside[-1].update(stay)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the integer columns keys, for input sorted by them. One run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys], 1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        edges = [0, *cuts.tolist(), len(batch)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and last != tuple(k[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(k[a])
    if held:
        yield pa.Table.from_batches(held)
