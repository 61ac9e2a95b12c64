import math

import pytest
from pyspark.sql import functions as F

from annomatrix.model import AnnotatedMatrix
from annomatrix.operators import axis_stats
from annomatrix.params import Direction
from annomatrix.plans.matrices import orders_by_part
from annomatrix.sources import read_blocks, to_blocks

DIR = "/root/testdata/sf0.001"
ROW, COLUMN = Direction.ROW, Direction.COLUMN


@pytest.fixture(scope="module")
def orders(spark):
    return orders_by_part(spark, DIR).persist()


def listed(df):
    return sorted(tuple(r) for r in df.collect())


def small(spark, rows, extra=""):
    x = spark.createDataFrame(rows, f"obs_idx long, var_idx long, value double{extra}")
    ids = lambda name: spark.range(4).withColumnRenamed("id", name)
    return AnnotatedMatrix(x, ids("obs_idx"), ids("var_idx"))


@pytest.mark.parametrize("layout", ["csr", "csc"])
@pytest.mark.parametrize("most", [7, 1 << 16])
def test_entries_come_back_in_either_layout(orders, layout, most):
    blocks = to_blocks(orders, layout, most)
    assert listed(blocks.entries()) == listed(orders.x)
    assert listed(blocks.turned(most).entries()) == listed(orders.x)


@pytest.mark.parametrize("direction", list(Direction))
@pytest.mark.parametrize("layout", ["csr", "csc"])
def test_counts_and_statistics_are_those_of_the_entries(orders, layout, direction):
    blocks = to_blocks(orders, layout, 100)
    assert listed(blocks.counts(direction)) == listed(axis_stats(orders, direction, ("count",)))
    assert listed(blocks.stats(direction, ("sum", "max"))) == listed(axis_stats(orders, direction, ("sum", "max")))


def test_counts_read_neither_values_nor_what_they_do_not_need(spark, orders, tmp_path):
    path = f"file://{tmp_path}/m"
    to_blocks(orders, "csr", 500).write(path)
    blocks = read_blocks(spark, path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    along, across = plan(blocks.counts(ROW)), plan(blocks.counts(COLUMN))
    assert "offsets:array" in along and "vals:array" not in along and "indices:array" not in along
    assert "indices:array" in across and "vals:array" not in across and "offsets:array" not in across
    assert listed(blocks.counts(ROW)) == listed(axis_stats(orders, ROW, ("count",)))


def test_a_range_of_ids_is_pushed_to_the_file(spark, orders, tmp_path):
    path = f"file://{tmp_path}/m"
    to_blocks(orders, "csr", 50).write(path)
    some = read_blocks(spark, path).between(100, 300)
    assert "GreaterThanOrEqual(last,100)" in some._jdf.queryExecution().executedPlan().toString()
    assert listed(some) == listed(orders.x.where("obs_idx between 100 and 300"))


def test_a_hot_observation_is_spread_over_blocks_of_bounded_size(spark):
    rows = [(0, i, 1.0) for i in range(5000)] + [(i, 0, 2.0) for i in range(1, 50)]
    blocks = to_blocks(small(spark, rows), "csr", 256)
    sizes = blocks.chunks().collect()
    assert max(r.n_entries for r in sizes) <= 256 and sum(r.n_entries for r in sizes) == len(rows)
    assert sum(r.first == 0 for r in sizes) >= 5000 // 256
    assert dict(listed(blocks.counts(ROW)))[0] == 5000
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # which joins tasks as small as these
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        parts = to_blocks(small(spark, rows), "csr", 256).blocks.select(F.spark_partition_id().alias("part"), F.size("vals").alias("n"))
        by_task = [r.n for r in parts.groupBy("part").agg(F.sum("n").alias("n")).collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(by_task) == len(rows) and max(by_task) < 2500


def test_nulls_repeats_special_values_and_other_columns(spark):
    rows = [(0, 0, 0.0, 1), (0, 0, 0.0, 2), (1, 3, math.inf, 3), (1, 2, -1.5, 4), (None, 1, 1.0, 5), (1, None, 1.0, 6), (2, 2, None, 7)]
    blocks = to_blocks(small(spark, rows, ", vals int"), "csr")
    assert listed(blocks.entries()) == [(0, 0, 0.0), (0, 0, 0.0), (1, 2, -1.5), (1, 3, math.inf)]
    assert listed(blocks.counts(ROW)) == [(0, 2), (1, 2), (2, 0), (3, 0)]


def test_an_empty_matrix_has_no_blocks(spark):
    blocks = to_blocks(small(spark, []))
    assert blocks.blocks.count() == 0 and blocks.turned().entries().count() == 0
    assert listed(blocks.counts(COLUMN)) == [(i, 0) for i in range(4)]


def test_wrong_layouts_and_sizes_are_errors(orders):
    with pytest.raises(ValueError, match="layout"):
        to_blocks(orders, "coo")
    with pytest.raises(ValueError, match="block"):
        to_blocks(orders, "csr", 0)


def test_the_same_blocks_over_whole_sf001(spark):
    am = orders_by_part(spark, "/root/testdata/sf0.01")
    back = to_blocks(am, "csr", 1000).turned(1000).entries()
    assert back.count() == am.x.count() and back.exceptAll(am.x).isEmpty()
