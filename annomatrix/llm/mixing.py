"""Sources mixed to target weights by weighted fair queueing.

Each source's documents stand in a fixed random order and are repeated in passes. A copy's virtual finish time is the
source's words up to and with it, divided by the source's target; copies are taken in the order of finish times, less
half a copy's own time, until the total budget is spent. So every source arrives at its target together with the others,
whatever its size, and comes as near to it as half of its document at that point, long ones too.

Running sums never meet in one task: rows are range-sorted by a key that tells all of them apart, so that partitions
hold like numbers of rows, whatever a source's share; each is summed along its rows, and the partitions' sums, one number
each, are joined back. What was taken follows for each document from the last copy within the budget.

Null sources are one source, last. Null texts have size 0; documents of size 0 are taken 0 words. A text of any length
is one document. Rows that share a doc_id are told apart by their text and are queued each on its own; exact repetitions
stand next to each other, and which of them is taken is of no account. An empty table, or one without words, gives
targets of 0. Sources without words get the target 0. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, scratch

WEIGHTS = (1, 2, 3)
MOST_PASSES = 3
SEED = 17
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """sizes: (source, source_size), one row per source. Adds target: weights repeat over sources by code point, null
    last, and share the total; a target stops at most times its source's size and the excess is shared again by
    weight. The water level is found in closed form: sources fill up in the order of size / weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source here and below
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumn("caps_before", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("weights_left", F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_left"))
    s = s.withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(Window.partitionBy())["level"]
    s = s.withColumn("final", level)
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("w")))
    return s.select("source", "source_size", "w", target.alias("target"))


def running_sum(df: DataFrame, order: list[Column], out: str, name: str, partitions: int | None = None) -> DataFrame:
    """df with out, the sum of its column size up to and with each row in a range sort by order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = total + np.cumsum(batch.column("size").to_numpy(), dtype=np.int64)
            total = int(sums[-1]) if len(sums) else total
            columns = [*batch.columns, pa.array(sums), pa.array(np.full(len(sums), part, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out, "part"])

    schema = T.StructType(list(df.schema.fields)).add(out, T.LongType()).add("part", T.IntegerType())
    found = materialize(df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order).mapInArrow(run, schema), name)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = found.groupBy("part").agg(F.max(out).alias("sum")).select("part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    return found.join(F.broadcast(starts), "part").withColumn(out, F.col(out) + F.col("start")).drop("part", "start")


def mark_of(text: Column) -> Column:
    """What tells texts apart; a null one has its own."""
    return F.coalesce(F.md5(text.cast("string").cast("binary")), F.lit("null"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES, seed: int = SEED, slice_rows: int | None = None) -> DataFrame:
    """One row per input row: doc_id, source, mark (of the text), size, source_size, target, taken. slice_rows is about
    the number of documents of a partition of the running sums, which is left to Spark without it."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), mark_of(text).alias("mark"))
    shuffled = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "mark").cast("binary"))
    place = F.conv(F.substring(shuffled, 1, 15), 16, 10).cast("long")
    with scratch(docs.sparkSession) as kept:
        rows = materialize(rows.select("*", place.alias("place"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
        partitions = -(-rows.count() // slice_rows) if slice_rows else None
        per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        goals = targets(per_source, weights, most).withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        before = F.sum("source_size").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
        goals = materialize(goals.withColumn("before", F.coalesce(before, F.lit(0))), "mix-targets")
        budget = goals.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]

        goal = goals.select(F.col("source").alias("s"), "source_size", "target", "number", "before")
        queued = rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        queued = running_sum(queued, [F.col(c) for c in ("number", "place", "doc_id", "row")], "upto", "mix-queues", partitions)
        queued = queued.withColumn("upto", F.col("upto") - F.col("before"))
        passes = F.when(F.col("source_size") > 0, F.least(F.ceil(F.try_divide("target", "source_size") + 1e-9), F.lit(most))).otherwise(0).cast("int")
        middle = lambda turn: F.try_divide(turn * F.col("source_size") + F.col("upto") - F.col("size") / 2, F.col("target"))
        key = lambda turn: F.struct(middle(turn).alias("middle"), "number", "place", "doc_id", "row", turn.cast("int").alias("turn"))
        queued = materialize(queued.withColumn("passes", passes), "mix-queued")
        # Half a document after the target, no copy is taken; the budget is spent by then.
        copies = queued.where("size > 0").select("size", F.explode(F.transform(F.sequence(F.lit(0), F.greatest("passes", F.lit(1)) - 1), key)).alias("key"), "passes")
        copies = copies.where("passes > 0 and key.middle is not null").select("size", "key.*")
        order = [F.col(c) for c in ("middle", "number", "place", "doc_id", "row", "turn")]
        spent = running_sum(copies, order, "spent", "mix-copies", partitions)
        last = spent.where(F.col("spent") <= budget).agg(F.max(F.struct(*order)).alias("last")).first()["last"]
        kept.append(queued)
    taken = F.lit(0)
    if last is not None:
        # doc_id may be null, and nulls come first in the sort as in a comparison of structs.
        fields = [F.lit(last[c]).cast(t).alias(c) for c, t in (("middle", "double"), ("number", "int"), ("place", "long"), ("doc_id", "long"), ("row", "long"), ("turn", "int"))]
        turns = F.filter(F.sequence(F.lit(0), F.greatest("passes", F.lit(1)) - 1), lambda t: key(t) <= F.struct(*fields))
        taken = F.when((F.col("size") > 0) & (F.col("passes") > 0), F.size(turns)).otherwise(0) * F.col("size")
    return queued.select("doc_id", "source", "mark", "size", "source_size", "target", taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes the whole documents table."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The same by windows over the whole table; weights, passes and seed as above.
ORACLE = r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, coalesce(md5(text), 'null') as mark from documents),
r as materialized (select *, row_number() over () as row, substr(md5(concat_ws('|', '17', coalesce(doc_id::varchar, 'null'), mark)), 1, 15) as place from d),
s as (select source, sum(size)::bigint as source_size from r group by source),
w as (select *, row_number() over (order by source nulls last) as number, (((row_number() over (order by source nulls last)) - 1) % 3 + 1)::double as w, source_size * 3.0::double as cap from s),
f as (select *, coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0) as caps_before,
  sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as weights_left, (sum(source_size) over ())::double as total from w),
l as (select *, (total - caps_before) / weights_left as level from f),
m as (select arg_min(level, cap / w) as final from l where level * w < cap),
t as (select source, source_size, number, case when final is null then cap else least(cap, final * w) end as target from l cross join m),
q as materialized (select r.*, source_size, target, number, sum(size) over (partition by number order by place, doc_id nulls first, row) as upto,
  case when source_size > 0 then least(ceil(target / source_size + 1e-9), 3) else 0 end as passes from r join t on r.source is not distinct from t.source),
c as (select q.*, turn, (turn * source_size + upto - size / 2) / target as middle from q cross join (select unnest([0, 1, 2]) as turn) where size > 0 and turn < passes and target > 0),
x as (select *, sum(size) over (order by middle, number, place, doc_id nulls first, row, turn rows between unbounded preceding and current row) as spent from c),
k as (select row, sum(size) as taken from x where spent <= (select sum(size) from r) group by row)
select doc_id, size::bigint as size, source_size, target, coalesce(taken, 0)::bigint as taken from q left join k using (row)"""
