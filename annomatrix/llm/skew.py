"""Joins with one row per key, where one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: A key with more than one in HEAVY of all rows is heavy, so that fewer than HEAVY keys are.
HEAVY = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], name: str, heavy: int = HEAVY) -> DataFrame:
    """rows joined with keyed on their common columns, without nulls there; keyed has one row per key and n, the key's
    number of rows. Heavy keys are broadcast, so that their rows stay in the tasks that read them; only rows of other
    keys are shuffled, and none of these keys fills a task. Both tables are read more than once and should be stored;
    keyed is stored here."""
    keyed = materialize(keyed, name)
    is_heavy = F.col("n") * heavy > F.lit(rows.count())
    few = keyed.where(is_heavy)
    spread = rows.join(F.broadcast(few.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(few), on).unionByName(spread.join(keyed.where(~is_heavy), on))
