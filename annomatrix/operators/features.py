"""Choice of variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import AnnotatedMatrix
from ..params import Direction, FeatureSelection
from .positions import numbered
from .stats import compute_variance


def chosen_features(am: AnnotatedMatrix, how: FeatureSelection) -> tuple[DataFrame, list[Column] | None]:
    """The chosen variables, and their order where it is not that of var_idx."""
    key = F.col("var_idx")
    if how.kind == "flagged":
        if how.column not in am.var.columns:
            raise ValueError(f"var has no column {how.column}")
        if not isinstance(am.var.schema[how.column].dataType, T.BooleanType):
            raise TypeError(f"{how.column} is not boolean")
        chosen, order = am.var.where(F.coalesce(F.col(how.column), F.lit(False))).select(key), None
    elif how.kind == "top_variance":
        ranked = F.when(F.isnan("variance"), None).otherwise(F.col("variance"))
        order = [F.desc_nulls_last("v"), key.asc()]
        chosen = compute_variance(am, Direction.COLUMN).select(key, ranked.alias("v")).orderBy(*order).limit(how.n)
    elif how.kind == "randomized":
        order = [F.col("h").asc(), key.asc()]
        chosen = am.var.select(key, F.md5(F.concat_ws(":", F.lit(str(how.seed)), key.cast("string")).cast("binary")).alias("h")).orderBy(*order).limit(how.n)
    elif how.kind == "variance_above":
        above = ~F.isnan("variance") & (F.col("variance") > how.threshold)
        chosen, order = compute_variance(am, Direction.COLUMN).where(above).select(key), None
    else:
        chosen, order = am.var.select(key), None
    return chosen, order


def select_features(am: AnnotatedMatrix, how: FeatureSelection) -> DataFrame:
    """(var_idx, out_pos): top_variance in order of falling variance, randomized in hash order, numbered in the one task
    that has found the first n; the rest by var_idx, numbered in ranges by jobs that run when this is called."""
    chosen, order = chosen_features(am, how)
    if order is None:
        return numbered(chosen, "var_idx", "out_pos")
    position = F.row_number().over(Window.orderBy(*order)) - 1
    return chosen.select("var_idx", position.cast("long").alias("out_pos"))
