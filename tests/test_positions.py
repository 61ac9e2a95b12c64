import math
import random

import pytest

from annomatrix import AnnotatedMatrix, Direction, FeatureSelection
from annomatrix import operators as O
from annomatrix.operators.positions import numbered

ROW, COLUMN = Direction.ROW, Direction.COLUMN


def bundle(spark, obs):
    x = spark.createDataFrame([(o, 0, 1.0) for o in obs], "obs_idx long, var_idx long, value double")
    return AnnotatedMatrix(x, x.select("obs_idx"), spark.range(1).withColumnRenamed("id", "var_idx"))


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_follow_the_order(spark, adaptive, parts):
    ids = random.Random(1).sample(range(-(10**9), 10**9), 3000)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts * 3))
    try:
        df = spark.createDataFrame([(i,) for i in ids], "k long").repartition(parts)
        got = {r.k: r.at for r in numbered(df, "k", "at").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {v: i for i, v in enumerate(sorted(ids))}


def test_ties_nulls_text_and_empty(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "k string")
    assert sorted((r.at, r.k) for r in numbered(df, "k", "at").collect()) == [(0, None), (1, "a"), (2, "b"), (3, "b")]
    assert numbered(df.limit(0), "k", "at").collect() == []


def test_no_window_without_keys_over_an_axis(spark):
    am = bundle(spark, range(50))
    for df in (O.select_features(am, FeatureSelection.everything()), O.reindex(am, ROW), O.to_dense(am)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert all(", [], " not in line and "windowspecdefinition(obs_idx" not in line and "windowspecdefinition(var_idx" not in line for line in plan.splitlines() if "Window" in line)


def test_positions_of_spaced_ids(spark):
    ids = [3 * i * i for i in range(40)]
    am = bundle(spark, ids)
    for start, end, step in ((0, None, 1), (4, 31, 5), (39, 40, 2), (7, 7, 1)):
        got = {r.obs_idx: r.out_pos for r in O.slice_positions(am, ROW, start, end, step).collect()}
        assert got == {v: i for i, v in enumerate(ids[start:end:step])}
    got = {r.obs_idx: r.out_pos for r in O.take_positions(am, ROW, [9, 0, 39]).collect()}
    assert got == {ids[9]: 0, ids[0]: 1, ids[39]: 2}
    for bad in (lambda: O.slice_positions(am, ROW, 40), lambda: O.slice_positions(am, ROW, 0, 41), lambda: O.take_positions(am, ROW, [40]), lambda: O.take_positions(am, ROW, [-1])):
        with pytest.raises(IndexError):
            bad()
    for bad in (lambda: O.slice_positions(am, ROW, 3, 2), lambda: O.take_positions(am, ROW, [1, 1])):
        with pytest.raises(ValueError):
            bad()
    assert O.slice_positions(bundle(spark, []), ROW, 2).count() == 0 and math.isclose(am.n_obs(), 40)
