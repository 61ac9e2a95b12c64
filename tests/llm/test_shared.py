from concurrent.futures import ThreadPoolExecutor
from threading import Barrier
from urllib.parse import urlparse
import os

import pytest

from annomatrix.llm import topk
from annomatrix.llm.shared import BATCH_BYTES, materialize, scratch, shared_dir, small_batches

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def tables(spark):
    folder = urlparse(shared_dir(spark)).path + "/tables"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_threads_drop_only_their_own_tables(spark):
    both = Barrier(2, timeout=120)

    def query(n):
        with scratch(spark) as kept:
            own = materialize(spark.range(n), f"own-{n}")
            both.wait()
            if n == 3:
                with scratch(spark):
                    materialize(spark.range(1), "inner")
            else:
                both.wait()
                assert own.count() == n
            kept.append(materialize(own, f"kept-{n}"))
        if n == 3:
            both.wait()
        return kept[0]

    before = tables(spark)
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(query, (3, 5)))
    assert [df.count() for df in found] == [3, 5]
    assert sorted(t.rsplit("-", 1)[0] for t in tables(spark) - before) == ["kept-3", "kept-5"]


def test_a_scope_hands_what_it_keeps_to_the_one_outside_also_after_an_error(spark):
    before = tables(spark)
    with pytest.raises(RuntimeError), scratch(spark):
        with scratch(spark) as kept:
            kept.append(materialize(spark.range(2), "inner"))
            materialize(spark.range(2), "other")
        assert kept[0].count() == 2 and len(tables(spark) - before) == 1
        raise RuntimeError
    assert tables(spark) == before


def test_the_bound_of_batches_outlasts_the_first_thread_that_leaves(spark):
    before, entered = spark.conf.get(KEY), Barrier(2, timeout=60)

    def inside(first):
        with small_batches(spark):
            entered.wait()
            if not first:
                entered.wait()
                return spark.conf.get(KEY)
        entered.wait()
        return None

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(inside, (True, False))) == [None, str(BATCH_BYTES)]
    assert spark.conf.get(KEY) == before


def test_queries_in_two_threads(spark):
    rows = [(i, [float(i % 7), float(i % 3)], 1) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    want = sorted(map(tuple, topk.top_k(df).collect()))
    before = tables(spark)
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda _: sorted(map(tuple, topk.top_k(df).collect())), range(2)))
    assert found == [want, want]
    assert [t.rsplit("-", 1)[0] for t in tables(spark) - before] == ["topk-ranked"] * 2
