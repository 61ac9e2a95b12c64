"""HDF5 annotated-matrix files, where h5py is installed. The driver reads names, types and lengths only; tasks open the
file for their own blocks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..model import AnnotatedMatrix
from ..params import FileScope

BLOCK = 10_000
ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise RuntimeError("reading .h5ad needs h5py; export the matrix to Parquet otherwise") from e
    return h5py


def _text(v) -> str:
    return v.decode() if isinstance(v, bytes) else str(v)


def _type(data) -> str:
    return {"b": "boolean", "i": "long", "u": "long", "f": "double"}.get(data.dtype.kind, "string")


def _array(values: np.ndarray, kind: str, null: np.ndarray | None = None) -> pa.Array:
    data = [_text(v) for v in values] if kind == "string" else np.asarray(values)
    return pa.array(data, ARROW[kind], mask=null) if null is None or kind != "string" else pa.array([None if x else v for v, x in zip(data, null, strict=True)], ARROW[kind])


def _is_data(node) -> bool:
    return hasattr(node, "shape")


def _column(group, name: str) -> tuple[str, str] | None:
    """(form, type) of a column: plain, categorical (codes and categories), coded (codes whose categories lie in
    __categories, as older files have them) or nullable (values and mask); None for any other."""
    node = group[name]
    if _is_data(node):
        if len(node.shape) != 1:
            return None
        older = group["__categories"] if "__categories" in group else ()
        return ("coded", _type(older[name])) if name in older else ("plain", _type(node))
    if "categories" in node and "codes" in node:
        return "categorical", _type(node["categories"])
    if "values" in node and "mask" in node:
        return "nullable", _type(node["values"])
    return None


def _values(group, name: str, form: str, kind: str, lo: int, hi: int) -> pa.Array:
    node = group[name]
    if form == "plain":
        return _array(node[lo:hi], kind)
    if form == "nullable":
        return _array(node["values"][lo:hi], kind, np.asarray(node["mask"][lo:hi], dtype=bool))
    codes, categories = (node["codes"], node["categories"]) if form == "categorical" else (node, group["__categories"][name])
    at = np.asarray(codes[lo:hi], dtype="int64")
    return _array(categories[:], kind).take(pa.array(at, mask=at < 0))


def _blocks(spark: SparkSession, path: str, n: int, schema: str, read: Callable) -> DataFrame:
    """read(file, lo, hi) gives the columns of schema for a block of rows."""
    names = [c.split("` ")[0].strip("`") for c in schema.split(", `")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h5 = _h5py()
        for batch in batches:
            with h5.File(path, "r") as f:
                for lo in batch.column("id").to_pylist():
                    yield pa.RecordBatch.from_arrays(read(f, lo, min(n, lo + BLOCK)), names=names)

    return spark.range(0, n, BLOCK, max(1, -(-n // BLOCK))).mapInArrow(run, schema)


def _axis(spark: SparkSession, path: str, f, part: str, key: str, name: str, skip: set[str]) -> tuple[DataFrame, int]:
    group = f[part]
    index = _text(group.attrs.get("_index", "_index"))
    forms = {c: _column(group, c) for c in group if c not in (index, "__categories") and f"{part}/{c}" not in skip}
    for c, form in forms.items():
        if form is None:
            raise ValueError(f"{part}/{c} is of a kind that is not read; name it in skip to leave it out")
        if c.lower() in (key, name):
            raise ValueError(f"{part}/{c} has a name that the matrix uses itself; name it in skip to leave it out")

    def read(f, lo: int, hi: int) -> list[pa.Array]:
        g = f[part]
        return [pa.array(np.arange(lo, hi)), _array(g[index][lo:hi], "string"), *(_values(g, c, *form, lo, hi) for c, form in forms.items())]

    schema = ", ".join(f"`{c}` {t}" for c, t in [(key, "long"), (name, "string"), *((c, form[1]) for c, form in forms.items())])
    n = group[index].shape[0]
    return _blocks(spark, path, n, schema, read), n


def _vectors(spark: SparkSession, path: str, f, part: str, key: str, n: int, skip: set[str]) -> dict[str, DataFrame]:
    def one(name: str) -> DataFrame:
        def read(f, lo: int, hi: int) -> list[pa.Array]:
            rows = np.asarray(f[part][name][lo:hi], dtype="float64").reshape(hi - lo, -1)
            ends = pa.array(np.arange(rows.shape[0] + 1) * rows.shape[1], pa.int32())
            return [pa.array(np.arange(lo, hi)), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))]

        return _blocks(spark, path, n, f"`{key}` long, `vec` array<double>", read)

    names = [c for c in (f[part] if part in f else ()) if f"{part}/{c}" not in skip]
    for c in names:
        if not _is_data(f[part][c]):
            raise ValueError(f"{part}/{c} is no array; name it in skip to leave it out")
    return {c: one(c) for c in names}


def read_h5ad(
    spark: SparkSession, path: str, scope: FileScope = FileScope.READ, cache: bool = False, skip: tuple[str, ...] = ()
) -> AnnotatedMatrix:
    """path is on a file system that every executor mounts. X, obs, var, obsm and varm are read, in blocks of rows (of
    the compressed axis for X); categorical columns as their categories, masked values as nulls. A column or array of
    another kind is an error that names it, unless it is listed in skip, as 'obs/name'. layers, raw, obsp, varp and
    uns are not read."""
    if not isinstance(scope, FileScope):
        raise TypeError("scope is a FileScope")
    h5py, left_out = _h5py(), set(skip)
    with h5py.File(path, "r") as f:
        kind = _text(f["X"].attrs.get("encoding-type", "array"))
        if kind not in ("array", "csr_matrix", "csc_matrix"):
            raise ValueError(f"X is of the kind {kind}, which is not read")
        obs, n_obs = _axis(spark, path, f, "obs", "obs_idx", "obs_name", left_out)
        var, n_var = _axis(spark, path, f, "var", "var_idx", "var_name", left_out)
        obsm = _vectors(spark, path, f, "obsm", "obs_idx", n_obs, left_out)
        varm = _vectors(spark, path, f, "varm", "var_idx", n_var, left_out)
    columns_first = kind == "csc_matrix"

    def read(f, lo: int, hi: int) -> list[pa.Array]:
        x = f["X"]
        if kind == "array":
            block = np.asarray(x[lo:hi], dtype="float64")
            major, minor, value = np.repeat(np.arange(lo, hi), block.shape[1]), np.tile(np.arange(block.shape[1]), hi - lo), block.ravel()
        else:
            ptr = np.asarray(x["indptr"][lo : hi + 1], dtype="int64")
            major = np.repeat(np.arange(lo, hi), np.diff(ptr))
            minor, value = np.asarray(x["indices"][ptr[0] : ptr[-1]], dtype="int64"), np.asarray(x["data"][ptr[0] : ptr[-1]], dtype="float64")
        rows, cols = (minor, major) if columns_first else (major, minor)
        return [pa.array(rows), pa.array(cols), pa.array(value)]

    entries = _blocks(spark, path, n_var if columns_first else n_obs, "`obs_idx` long, `var_idx` long, `value` double", read)
    am = AnnotatedMatrix(entries, obs, var, obsm, varm, layout="csc" if columns_first else "csr")
    return am.persist() if cache else am
