import math
import random
import struct

import pytest

from annomatrix import Direction
from annomatrix import operators as O
from annomatrix.sources import from_triplets
from annomatrix.streaming import GrowingStatistics, read_entry_stream

ROW, COLUMN = Direction.ROW, Direction.COLUMN
SCHEMA = "obs_idx long, var_idx long, value double"


def chunk(seed, obs):
    rng = random.Random(seed)
    return [(o, v, rng.choice([rng.gauss(0, 1), 1e9 * rng.random(), 1e-9 * rng.random(), 0.0])) for o in obs for v in range(6) if rng.random() < 0.7]


def bits(df):
    return {r[0]: (r["count"], *(struct.pack("d", math.nan if math.isnan(r[c]) else r[c]) for c in ("sum", "variance", "std", "min", "max"))) for r in df.collect()}


def whole(spark, rows, n_obs):
    axis = lambda key, n: spark.range(n).withColumnRenamed("id", key)
    return from_triplets(spark.createDataFrame(rows, SCHEMA), axis("obs_idx", n_obs), axis("var_idx", 7), unique=True)


@pytest.mark.parametrize("direction", [ROW, COLUMN])
def test_state_after_batches_and_a_restart(spark, tmp_path, direction):
    source, folder = str(tmp_path / "in"), (tmp_path / "state").as_uri()
    chunks = [chunk(i, range(10 * i, 10 * i + 10)) for i in range(5)]
    chunks[2].append((3, 6, math.nan))
    chunks[4].append((4, 6, math.inf))

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = read_entry_stream(spark, source, 1).writeStream.foreachBatch(GrowingStatistics(spark, folder, direction).add)
        stream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()

    for rows in chunks[:3]:
        arrive(rows)
    run()
    state = GrowingStatistics(spark, folder, direction)
    assert state.versions() == [0, 1, 2]
    am = whole(spark, sum(chunks[:3], []), 60)
    assert bits(state.read(am)) == bits(O.axis_stats(am, direction))
    for rows in chunks[3:]:
        arrive(rows)
    run()
    assert state.versions() == [2, 3, 4]
    am = whole(spark, sum(chunks, []), 60)
    assert bits(state.read(am)) == bits(O.axis_stats(am, direction))
    assert state.read().count() == (50 if direction.is_row else 7)


def test_a_batch_run_again_counts_once(spark, tmp_path):
    state = GrowingStatistics(spark, (tmp_path / "s").as_uri(), ROW)
    with pytest.raises(ValueError):
        state.read()
    a, b = (spark.createDataFrame(chunk(i, range(4)), SCHEMA) for i in (1, 2))
    state.add(a, 0)
    state.add(b, 1)
    once = bits(state.read())
    state.add(b, 1)
    assert bits(state.read()) == once
    state.add(a.limit(0), 2)
    assert bits(state.read()) == once


def test_a_failed_batch_leaves_the_last_version(spark, tmp_path):
    from pyspark.sql import functions as F

    state = GrowingStatistics(spark, (tmp_path / "s").as_uri(), COLUMN)
    state.add(spark.createDataFrame(chunk(1, range(4)), SCHEMA), 0)
    before = bits(state.read())
    bad = spark.createDataFrame(chunk(2, range(4)), SCHEMA).withColumn("value", F.when(F.col("obs_idx") < 3, F.col("value")).otherwise(F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        state.add(bad, 1)
    assert state.versions() == [0] and bits(state.read()) == before
