"""Annotated matrices as Parquet: a folder with x, obs, var and one folder per embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import AnnotatedMatrix
from ..params import FileScope


def write_matrix(am: AnnotatedMatrix, path: str, partitions: int | None = None) -> None:
    """Writes to a new path. x is range-partitioned and sorted by obs_idx, so that readers of a few observations
    skip row groups by their statistics. x, obs and var files stay immutable afterwards."""
    x = am.x.repartitionByRange(partitions, "obs_idx") if partitions else am.x.repartitionByRange("obs_idx")
    x.sortWithinPartitions("obs_idx", "var_idx").write.parquet(f"{path}/x")
    am.obs.write.parquet(f"{path}/obs")
    am.var.write.parquet(f"{path}/var")
    for kind, frames in (("obsm", am.obsm), ("varm", am.varm)):
        for name, df in frames.items():
            df.write.parquet(f"{path}/{kind}/{name}")


def read_matrix(
    spark: SparkSession,
    path: str,
    scope: FileScope = FileScope.READ,
    cache: bool = False,
    obsm: tuple[str, ...] = (),
    varm: tuple[str, ...] = (),
    layout: str = "csr",
) -> AnnotatedMatrix:
    """Reads lazily; cache keeps x in memory and on local disk. Files are immutable, so READ_WRITE differs from READ
    only in intent: results go to a new path."""
    if not isinstance(scope, FileScope):
        raise TypeError("scope is a FileScope")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    embed = lambda kind, names: {n: read(f"{kind}/{n}") for n in names}
    am = AnnotatedMatrix(read("x"), read("obs"), read("var"), embed("obsm", obsm), embed("varm", varm), layout=layout)
    return am.persist() if cache else am


def entries(am: AnnotatedMatrix) -> DataFrame:
    """The stored entries with the names of both axes, for exports."""
    named = am.x.join(am.obs.select("obs_idx", "obs_name"), "obs_idx", "left")
    return named.join(am.var.select("var_idx", "var_name"), "var_idx", "left")
