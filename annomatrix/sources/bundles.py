"""A matrix in a folder that grows by column groups, read and written at the same time.

Data lie in groups, Parquet folders that are never changed: the entries, each set of columns of obs or var, each embedding.
A version is one small manifest that names its groups, put in place by one atomic step, so a reader sees all of a version or
nothing of it and goes on with its own while others are written. Adding columns writes only those columns; x stays.
Writers may race where the file system refuses to rename onto a file, as HDFS does, or is a machine's own.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AnnotatedMatrix
from ..params import Direction, FileScope

#: Times that a writer starts again from a version that another one committed first.
ATTEMPTS = 20


def _link(aside: str, target: str, text: str) -> bool:
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(aside, "w", encoding="utf-8") as f:
        f.write(text)
    try:
        os.link(aside, target)
    except FileExistsError:
        return False
    finally:
        os.remove(aside)
    return True


class Bundle:
    """An opened bundle. READ allows matrix() and versions(), READ_WRITE all methods. Writers may work at the same time:
    one that finds its version taken adds its change to the version that took it, and of two that write the same column the
    later one's stays."""

    def __init__(self, spark: SparkSession, path: str, scope: FileScope = FileScope.READ) -> None:
        if not isinstance(scope, FileScope):
            raise TypeError("scope is a FileScope")
        self.spark, self.path, self.scope = spark, path.rstrip("/"), scope
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # Files

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _own_machine(self) -> bool:
        return self._fs().getUri().getScheme() == "file"

    def _names(self, folder: str) -> list:
        fs = self._fs()
        return list(fs.listStatus(self._at(folder))) if fs.exists(self._at(folder)) else []

    def _drop(self, name: str) -> None:
        self._fs().delete(self._at(name), True)

    def _put(self, version: int, manifest: dict) -> bool:
        """Whether the manifest became this version; False if there is one. It is written aside first; then a rename that
        fails where the target is there, or on a machine's own file system, whose rename does not, a link."""
        aside, target = self._at(f"versions/_{uuid.uuid4().hex}"), self._at(f"versions/{version:012d}")
        fs, text = self._fs(), json.dumps(manifest)
        if self._own_machine():
            return _link(fs.makeQualified(aside).toUri().getPath(), fs.makeQualified(target).toUri().getPath(), text)
        out = fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(aside, target, plain)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                return False
            raise
        return True

    def _manifest(self, version: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/versions/{version:012d}", wholetext=True).collect()  # one small file
        return json.loads(rows[0].value)

    # Reading

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        names = [s.getPath().getName() for s in self._names("versions")]
        return sorted(int(n) for n in names if n.isdigit())

    def _last(self) -> int:
        if not (known := self.versions()):
            raise FileNotFoundError(f"no version of a bundle in {self.path}")
        return known[-1]

    def _group(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/groups/{name}")

    def _axis(self, groups: list[dict], key: str) -> DataFrame:
        """The axis' columns from the groups that hold them; the first has the key too."""
        first, *others = [(self._group(g["group"]), g["columns"]) for g in groups]
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        pick = lambda df, columns: df.select(*[quoted(c) for c in columns])
        return reduce(lambda df, g: df.join(pick(g[0], [key, *g[1]]), key, "left"), others, pick(*first))

    def matrix(self, version: int | None = None) -> AnnotatedMatrix:
        """The matrix as of a version, by default the last; lazy."""
        m = self._manifest(self._last() if version is None else version)
        sets = {k: {n: self._group(g) for n, g in m[k].items()} for k in ("obsm", "varm")}
        return AnnotatedMatrix(self._group(m["x"]), self._axis(m["obs"], "obs_idx"), self._axis(m["var"], "var_idx"), **sets, layout=m["layout"])

    # Writing

    def _writable(self) -> None:
        if self.scope is not FileScope.READ_WRITE:
            raise PermissionError("the bundle was opened to be read")

    def _write(self, df: DataFrame, key: str | None) -> str:
        """A new group of df; one that cannot be written in full, or repeats a key, leaves nothing."""
        name = uuid.uuid4().hex
        try:
            df.write.parquet(f"{self.path}/groups/{name}")
            if key and not self._group(name).dropna(subset=[key]).groupBy(key).count().where("count > 1").isEmpty():
                raise ValueError(f"{key} repeats")
        except BaseException:
            self._drop(f"groups/{name}")
            raise
        return name

    def _commit(self, group: str, change: Callable[[dict], None]) -> int:
        """An error of the rename itself leaves the group, as the version may be in place, to vacuum()."""
        for _ in range(ATTEMPTS):
            last = self._last()
            manifest = self._manifest(last)
            try:
                change(manifest)
            except BaseException:
                self._drop(f"groups/{group}")
                raise
            if self._put(last + 1, manifest):
                return last + 1
        self._drop(f"groups/{group}")
        raise TimeoutError(f"other writers came first {ATTEMPTS} times")

    def add_columns(self, direction: Direction, columns: DataFrame) -> int:
        """Adds the columns to obs or var by its key and returns the new version; those of the same name are replaced. Rows
        of ids that the axis lacks, or of a null id, are kept in the group and join nothing; axis rows that columns lacks get
        nulls. A repeated id is an error."""
        self._writable()
        key, axis = direction.key, "obs" if direction.is_row else "var"
        added = [c for c in columns.columns if c != key]
        if key not in columns.columns or not added:
            raise ValueError(f"columns need {key} and one more")
        group = self._write(columns, key)

        def change(manifest: dict) -> None:
            for g in manifest[axis]:
                g["columns"] = [c for c in g["columns"] if c not in added]
            manifest[axis] = [g for g in manifest[axis] if g["columns"]] + [{"group": group, "columns": added}]

        return self._commit(group, change)

    def add_embedding(self, direction: Direction, name: str, frame: DataFrame) -> int:
        """Adds (key, vec) to obsm or varm under name, in place of one of that name, and returns the new version."""
        self._writable()
        if direction.key not in frame.columns:
            raise ValueError(f"the embedding lacks {direction.key}")
        group = self._write(frame, direction.key)
        return self._commit(group, lambda m: m["obsm" if direction.is_row else "varm"].update({name: group}))

    def compact(self, direction: Direction) -> int:
        """Writes the axis' groups as one, which saves readers the joins, and returns the new version. What another writer
        adds to the axis meanwhile goes on top."""
        self._writable()
        key, axis = direction.key, "obs" if direction.is_row else "var"
        before = self._manifest(self._last())[axis]
        whole = self._axis(before, key)
        group, seen = self._write(whole, None), {g["group"] for g in before}

        def change(manifest: dict) -> None:
            if manifest[axis][0]["group"] != before[0]["group"]:
                raise RuntimeError("another writer compacted the axis")
            later = [g for g in manifest[axis] if g["group"] not in seen]
            newer = {c for g in later for c in g["columns"]}
            manifest[axis] = [{"group": group, "columns": [c for c in whole.columns if c not in newer]}, *later]

        return self._commit(group, change)

    def vacuum(self, keep: int = 1, hours: float = 24.0) -> None:
        """Removes all but the last keep versions, and groups that no version left names. Groups younger than hours stay, as
        a writer may be about to name them; readers of a removed version fail."""
        self._writable()
        if keep < 1:
            raise ValueError("one version stays at least")
        known = self.versions()
        for old in known[:-keep]:
            self._drop(f"versions/{old:012d}")
        used = set()
        for v in known[-keep:]:
            m = self._manifest(v)
            used |= {m["x"], *m["obsm"].values(), *m["varm"].values(), *[g["group"] for a in ("obs", "var") for g in m[a]]}
        youngest = (time.time() - hours * 3600) * 1000
        for s in self._names("groups"):
            if s.getPath().getName() not in used and s.getModificationTime() <= youngest:
                self._drop(f"groups/{s.getPath().getName()}")


def create_bundle(am: AnnotatedMatrix, path: str) -> Bundle:
    """Writes the matrix as version 0 of a new bundle, x sorted by observation as write_matrix does; an error if there is one
    at path. Uns is not kept."""
    bundle = Bundle(am.x.sparkSession, path, FileScope.READ_WRITE)
    if bundle.versions():
        raise FileExistsError(f"{path} holds a bundle")
    written: list[str] = []

    def write(df: DataFrame, key: str | None) -> str:
        written.append(bundle._write(df, key))
        return written[-1]

    try:
        manifest = {"layout": am.layout, "x": write(am.x.repartitionByRange("obs_idx", "var_idx").sortWithinPartitions("obs_idx", "var_idx"), None)}
        for axis, df, key in (("obs", am.obs, "obs_idx"), ("var", am.var, "var_idx")):
            manifest[axis] = [{"group": write(df, key), "columns": df.columns}]
        for kind, frames, key in (("obsm", am.obsm, "obs_idx"), ("varm", am.varm, "var_idx")):
            manifest[kind] = {n: write(df, key) for n, df in frames.items()}
    except BaseException:
        for group in written:
            bundle._drop(f"groups/{group}")
        raise
    if not bundle._put(0, manifest):
        for group in written:
            bundle._drop(f"groups/{group}")
        raise FileExistsError(f"{path} holds a bundle")
    return bundle
