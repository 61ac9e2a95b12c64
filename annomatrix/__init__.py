"""Annotated-matrix analytics on Spark: a sparse observation-by-variable matrix as a long table with companions."""

from .model import AnnotatedMatrix
from .params import (
    Absolute,
    ComputationMode,
    Direction,
    FeatureSelection,
    FileScope,
    Relative,
    Unbounded,
)

__all__ = [
    "Absolute",
    "AnnotatedMatrix",
    "ComputationMode",
    "Direction",
    "FeatureSelection",
    "FileScope",
    "Relative",
    "Unbounded",
]
