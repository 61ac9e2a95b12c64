"""The annotated matrix: five kinds of lazy DataFrames that belong together."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .params import Direction

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
LAYOUTS = ("csr", "csc")


def _require(df: DataFrame, name: str, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")


@dataclass(frozen=True)
class AnnotatedMatrix:
    """x holds one row per stored entry (obs_idx, var_idx, value), unique per pair; stored zeros count as entries.

    obs and var hold one row per observation and variable with any annotations; they decide the shape, so a row of obs
    without entries is an empty observation. obsm and varm hold (key, vec array<double>) by name. layout ('csr' or
    'csc') decides only the variance of empty groups. Operators return new bundles; nothing is evaluated until an
    action.
    """

    x: DataFrame
    obs: DataFrame
    var: DataFrame
    obsm: dict[str, DataFrame] = field(default_factory=dict)
    varm: dict[str, DataFrame] = field(default_factory=dict)
    uns: dict[str, object] = field(default_factory=dict)
    layout: str = "csr"

    def __post_init__(self) -> None:
        _require(self.x, "x", "obs_idx", "var_idx", "value")
        _require(self.obs, "obs", "obs_idx")
        _require(self.var, "var", "var_idx")
        if not isinstance(self.x.schema["value"].dataType, NUMERIC):
            raise TypeError(f"values are numbers, not {self.x.schema['value'].dataType.simpleString()}")
        if self.layout not in LAYOUTS:
            raise ValueError(f"layout is one of {LAYOUTS}")

    def axis(self, direction: Direction) -> DataFrame:
        return self.obs if direction.is_row else self.var

    def with_axis(self, direction: Direction, df: DataFrame) -> AnnotatedMatrix:
        return replace(self, obs=df) if direction.is_row else replace(self, var=df)

    def with_x(self, x: DataFrame) -> AnnotatedMatrix:
        return replace(self, x=x)

    def subset(self, direction: Direction, keep: DataFrame) -> AnnotatedMatrix:
        """Restricts every part to the ids in keep. Ids stay as they are; reindex() makes them dense."""
        key = direction.key
        keep = keep.select(key)
        semi = lambda df: df.join(keep, key, "left_semi")
        parts = {"x": semi(self.x)}
        if direction.is_row:
            parts |= {"obs": semi(self.obs), "obsm": {k: semi(v) for k, v in self.obsm.items()}}
        else:
            parts |= {"var": semi(self.var), "varm": {k: semi(v) for k, v in self.varm.items()}}
        return replace(self, **parts)

    def n_obs(self) -> int:
        return self.obs.count()

    def n_vars(self) -> int:
        return self.var.count()

    def obs_names(self) -> DataFrame:
        return self.obs.select("obs_idx", "obs_name")

    def var_names(self) -> DataFrame:
        return self.var.select("var_idx", "var_name")

    def persist(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> AnnotatedMatrix:
        """Caches x, obs and var, for several operators over one bundle: after a filter, each of the three would run
        through the entries anew."""
        return replace(self, x=self.x.persist(level), obs=self.obs.persist(level), var=self.var.persist(level))

    def unpersist(self) -> AnnotatedMatrix:
        for df in (self.x, self.obs, self.var):
            df.unpersist()
        return self

    def copy(self) -> AnnotatedMatrix:
        """Another bundle over the same immutable frames."""
        return replace(self, obsm=dict(self.obsm), varm=dict(self.varm), uns=dict(self.uns))

    def describe(self) -> str:
        return (
            f"AnnotatedMatrix {self.n_obs()} x {self.n_vars()}, layout {self.layout}\n"
            f"  obs: {', '.join(self.obs.columns)}\n  var: {', '.join(self.var.columns)}\n"
            f"  obsm: {', '.join(self.obsm) or '-'}\n  varm: {', '.join(self.varm) or '-'}"
        )

    def create_views(self, prefix: str = "") -> None:
        """Temporary views x, obs and var for ad-hoc SQL."""
        for name in ("x", "obs", "var"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
