import numpy as np
import pytest
from pyspark.errors import PySparkException

from annomatrix.sources import from_nested


def listed(am):
    return sorted(tuple(r) for r in am.x.collect())


def test_trailing_axes_run_fastest(spark):
    whole = np.arange(2 * 3 * 4 * 5, dtype=float).reshape(2, 3, 4, 5)
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(whole)], "id long, a array<array<array<double>>>")
    flat = whole.reshape(2, -1)
    for trailing in (None, (4, 5)):
        am = from_nested(df, "id", "a", trailing)
        assert listed(am) == [(i, j, flat[i, j]) for i in range(2) for j in range(60)]
        assert am.n_vars() == 60


def test_nulls_short_arrays_and_texts(spark):
    rows = [(1, [["1.5", "x"], None, ["", None]]), (2, None), (3, []), (4, [[], ["2"]]), (None, [["9", "9"]])]
    df = spark.createDataFrame(rows, "id long, a array<array<string>>").selectExpr("*", "1 as `a.b`", "2 as i0", "'n' as value")
    am = from_nested(df, "id", "a")
    assert listed(am) == [(1, 0, 1.5), (1, 1, 0.0), (1, 4, 0.0), (4, 2, 2.0)]
    assert am.n_vars() == 6 and {"a.b", "i0", "value"} <= set(am.obs.columns)


def test_an_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([], "id long, a array<array<int>>")
    assert listed(from_nested(df, "id", "a")) == [] and from_nested(df, "id", "a").n_vars() == 0
    twice = spark.createDataFrame([(1, [[1]]), (1, [[1]])], "id long, a array<array<int>>")
    assert listed(from_nested(twice, "id", "a")) == [(1, 0, 1.0), (1, 0, 1.0)]


def test_wrong_shapes_are_errors(spark):
    df = spark.createDataFrame([(1, [[1, 2, 3]])], "id long, a array<array<int>>")
    with pytest.raises(PySparkException, match="longer than 2"):
        listed(from_nested(df, "id", "a", (2,)))
    with pytest.raises(ValueError):
        from_nested(df, "id", "a", (2, 2))
    with pytest.raises(TypeError):
        from_nested(df.selectExpr("id", "a[0] as a"), "id", "a")
    with pytest.raises(TypeError):
        from_nested(df, "id", "id")
