"""Small value types that parametrise the operators."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Direction(Enum):
    """Axis an operator works along: ROW gives one result per observation, COLUMN one per variable."""

    ROW = 0
    COLUMN = 1

    @property
    def key(self) -> str:
        return "obs_idx" if self is Direction.ROW else "var_idx"

    @property
    def is_row(self) -> bool:
        return self is Direction.ROW


class FileScope(Enum):
    READ = "read"
    READ_WRITE = "read_write"


@dataclass(frozen=True)
class ComputationMode:
    """Whole or chunked evaluation. Spark's input splits are the chunks, so both give the same plan and result;
    a chunk size is checked and otherwise only documents intent."""

    chunk: int | None = None

    def __post_init__(self) -> None:
        if self.chunk is not None and self.chunk < 1:
            raise ValueError("a chunk holds one row at least")

    @classmethod
    def whole(cls) -> ComputationMode:
        return cls()

    @classmethod
    def chunked(cls, rows: int) -> ComputationMode:
        return cls(rows)


@dataclass(frozen=True)
class Absolute:
    """Inclusive limit on the number of stored entries."""

    value: int

    def __post_init__(self) -> None:
        if self.value < 0:
            raise ValueError("an absolute limit is not negative")


@dataclass(frozen=True)
class Relative:
    """Inclusive limit on the sum of stored entries, given as a quantile of all sums."""

    p: float

    def __post_init__(self) -> None:
        if not 0 <= self.p <= 1:
            raise ValueError("a quantile lies in [0, 1]")


@dataclass(frozen=True)
class Unbounded:
    """No limit."""


Limit = Absolute | Relative | Unbounded


@dataclass(frozen=True)
class FeatureSelection:
    """Which variables to use. Build one with the class methods."""

    kind: str
    column: str | None = None
    n: int | None = None
    threshold: float | None = None
    seed: int = 0

    @classmethod
    def flagged(cls, column: str) -> FeatureSelection:
        """Variables whose boolean column is true; null counts as false."""
        return cls("flagged", column=column)

    @classmethod
    def top_variance(cls, n: int) -> FeatureSelection:
        """The n variables of the largest stored-entry variance; ties go to the lower var_idx, NaN last."""
        return cls("top_variance", n=_count(n))

    @classmethod
    def randomized(cls, n: int, seed: int = 0) -> FeatureSelection:
        """n variables without replacement, chosen by a seeded hash that partitioning does not change."""
        return cls("randomized", n=_count(n), seed=seed)

    @classmethod
    def variance_above(cls, threshold: float) -> FeatureSelection:
        """Variables whose stored-entry variance is strictly above the threshold; NaN is not."""
        return cls("variance_above", threshold=float(threshold))

    @classmethod
    def everything(cls) -> FeatureSelection:
        return cls("everything")


def _count(n: int) -> int:
    if n < 0:
        raise ValueError("a number of features is not negative")
    return int(n)
