"""Sums and variances against fractions, and the same bits at any partitioning."""

import math
import random
import struct
from fractions import Fraction

import pytest

from annomatrix import operators as O
from annomatrix.params import Direction, FeatureSelection
from annomatrix.plans import catalogue
from annomatrix.plans.matrices import orders_by_part
from annomatrix.sources import from_triplets
from tests.compare import assert_same

PARTITIONS = (1, 5, 16, 64)


def values():
    r = random.Random(7)
    sign = lambda: r.choice([1, -1]) * r.random()
    groups = [[sign() * 2.0 ** r.randint(-k, k) for _ in range(200)] for k in (0, 3, 25, 60, 500)]
    shifted = [[1e9 + r.random() for _ in range(200)], [0.1] * 13, [0.0], [-0.0, 5e-324], [1.7e308, -1.7e308, 3.0], [2.0**16, 2.0**-8, -(2.0**40)]]
    return groups + shifted


def exact(v):
    s = sum(map(Fraction, v))
    try:
        return float(s), float((len(v) * sum(Fraction(x) ** 2 for x in v) - s * s) / len(v) ** 2)
    except OverflowError:
        return float(s), math.inf


def matrix(spark, groups, partitions):
    x = spark.createDataFrame([(i, j, x) for j, v in enumerate(groups) for i, x in enumerate(v)], "obs_idx long, var_idx long, value double")
    am = from_triplets(x, unique=True)
    return am.with_x(x.repartition(partitions))


def bits(v):
    return struct.pack("<d", v) if isinstance(v, float) else v


def test_against_fractions(spark):
    groups = values()
    got = {r.var_idx: r for r in O.axis_stats(matrix(spark, groups, 3), Direction.COLUMN).collect()}
    for j, v in enumerate(groups):
        total, variance = exact(v)
        assert got[j]["count"] == len(v) and got[j].variance == variance and got[j].std == math.sqrt(variance)
        assert math.isclose(got[j]["sum"], total, rel_tol=1e-15, abs_tol=1e-300)
        assert (got[j].min, got[j].max) == (min(v), max(v))


def test_what_is_not_finite(spark):
    inf, nan = math.inf, math.nan
    groups = [[1.0, nan], [inf, 1.0], [inf, -inf], [-inf, -2.0]]
    got = {r.var_idx: r for r in O.axis_stats(matrix(spark, groups, 2), Direction.COLUMN, ("sum", "variance", "std")).collect()}
    assert [repr(got[j]["sum"]) for j in range(4)] == ["nan", "inf", "nan", "-inf"]
    assert all(math.isnan(got[j].variance) and math.isnan(got[j].std) for j in range(4))


def test_same_bits_at_any_partitioning(spark):
    groups, was = values(), spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in PARTITIONS:
            spark.conf.set("spark.sql.shuffle.partitions", n)
            am = matrix(spark, groups, n)
            seen.add(tuple(tuple(map(bits, r)) for d in Direction for r in sorted(O.axis_stats(am, d, ("sum", "variance", "std")).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(seen) == 1


@pytest.mark.parametrize("how", [FeatureSelection.variance_above(200.0), FeatureSelection.top_variance(25)])
def test_choice_of_variables_at_any_partitioning(spark, how):
    """A part of sf0.01 has a variance of exactly 200."""
    was, seen = spark.conf.get("spark.sql.shuffle.partitions"), set()
    try:
        for n in PARTITIONS:
            spark.conf.set("spark.sql.shuffle.partitions", n)
            am = orders_by_part(spark, "/root/testdata/sf0.01")
            am = am.with_x(am.x.repartition(n))
            seen.add(tuple(sorted(map(tuple, O.select_features(am, how).collect()))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(seen) == 1


@pytest.mark.parametrize("name", ["var_threshold", "hvg_topk", "qc_obs", "qc_var", "var_row", "std_col"])
def test_sql_at_sf001(spark, name):
    assert_same(spark, catalogue.queries()[name], catalogue.oracle_sql()[name], "/root/testdata/sf0.01")


def test_empty(spark):
    am = matrix(spark, [[1.0]], 1)
    am = am.with_x(am.x.limit(0))
    assert [(r["sum"], r.variance) for r in O.axis_stats(am, Direction.COLUMN, ("sum", "variance")).collect()] == [(0.0, 0.0)]
