from collections import Counter

import pytest
from pyspark.sql import functions as F

from annomatrix.llm import skew
from annomatrix.llm.shared import materialize


@pytest.mark.parametrize("heavy", [1, 3, 50, 1000])
def test_every_row_meets_its_key(spark, heavy):
    keys = [0] * 60 + [1] * 25 + list(range(2, 30)) + [5, 5, 9]
    rows = materialize(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(4), "skew-test")
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    got = skew.join_counted(rows, counted, ["k"], "skew-test-keys", heavy)
    times = Counter(keys)
    assert sorted((r.k, r.i, r.n) for r in got.collect()) == sorted((k, i, times[k]) for i, k in enumerate(keys) if times[k] > 1)


def test_empty(spark):
    rows = materialize(spark.createDataFrame([], "k long, i long"), "skew-test")
    assert skew.join_counted(rows, rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], "skew-test-keys").count() == 0
