"""The queries over the driver's tables, and the same as DuckDB SQL. Doubles are rounded on both sides, and NaN, which
SQL engines compare in different ways, is null on both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import operators as O
from ..operators.dense import to_dense_selected
from ..params import Absolute, ComputationMode, Direction, FeatureSelection, Relative, Unbounded
from ..plotting import plot_range, raster
from ..sources import create_bundle, from_nested, read_blocks, to_blocks
from ..storage import new_path
from ..streaming import GrowingStatistics
from .matrices import orders_by_part, users_by_event, vectors

Query = Callable[[SparkSession, str], DataFrame]
ROW, COLUMN = Direction.ROW, Direction.COLUMN
DIGITS = 6

X1 = "x as (select l_orderkey obs_idx, l_partkey var_idx, sum(l_quantity) as value from lineitem group by 1, 2)"
X2 = """var as (select event_type var_name, row_number() over (order by event_type) - 1 as var_idx from (select distinct event_type from events)),
x as (select user_id obs_idx, var_idx, sum(value) as value from events join var on event_type = var_name group by 1, 2)"""
X3 = "x as (select vec_id obs_idx, unnest(range(len(embedding))) var_idx, unnest(embedding)::double as value from embeddings)"
#: Quantities are whole numbers, so that SQL has their variance from exact sums, rounded once, as the operators do.
EXACT = "(count(value) * sum(value::hugeint * value::hugeint) - sum(value::hugeint) * sum(value::hugeint))::double / (count(value) * count(value))::double"
OBS, VAR = "select o_orderkey obs_idx from orders", "select p_partkey var_idx from part"


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(F.when(~F.isnan(c), F.col(c)), DIGITS).alias(c) if c in columns else F.col(c) for c in df.columns])


def _stat(direction: Direction, *which: str) -> Query:
    doubles = [w for w in which if w != "count"]
    return lambda spark, d: _round(O.axis_stats(orders_by_part(spark, d), direction, which), *doubles)


def _stat_sql(direction: Direction, *which: str) -> str:
    axis, key = (OBS, "obs_idx") if direction.is_row else (VAR, "var_idx")
    empty = "null" if direction.is_row else "0.0"
    form = {
        "count": "count(value) as count",
        "sum": "round(coalesce(sum(value), 0.0), 6) as sum",
        "variance": f"round(case when count(value) = 0 then {empty} else {EXACT} end, 6) as variance",
        "std": f"round(case when count(value) = 0 then {empty} else sqrt({EXACT}) end, 6) as std",
        "min": "coalesce(min(value), 'inf'::double) as min",
        "max": "coalesce(max(value), '-inf'::double) as max",
    }
    return f"with {X1}, axis as ({axis}) select {key}, {', '.join(form[w] for w in which)} from axis left join x using ({key}) group by 1"


def _qc(direction: Direction) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        am = O.qc(orders_by_part(spark, d))
        names = list(O.stats.QC_NAMES[direction].values())
        return _round(am.axis(direction).select(direction.key, *names), *names[1:])

    return run


def _qc_sql(direction: Direction) -> str:
    renamed = ", ".join(f"{a} as {b}" for a, b in O.stats.QC_NAMES[direction].items())
    return f"select {direction.key}, {renamed} from ({_stat_sql(direction, 'count', 'sum', 'variance', 'std')})"


LIMITS = {
    "abs_abs": (Absolute(2), Absolute(5)),
    "rel_rel": (Relative(0.1), Relative(0.9)),
    "abs_rel": (Absolute(3), Relative(0.8)),
    "rel_abs": (Relative(0.2), Absolute(6)),
    "abs_none": (Absolute(3), Unbounded()),
    "none_abs": (Unbounded(), Absolute(4)),
    "rel_none": (Relative(0.25), Unbounded()),
    "none_rel": (Unbounded(), Relative(0.75)),
    "none_none": (Unbounded(), Unbounded()),
}
#: A part is in some thirty orders, an order has some four parts.
TIMES = {ROW: 1, COLUMN: 8}


def _scaled(limit, direction: Direction):
    return Absolute(limit.value * TIMES[direction]) if isinstance(limit, Absolute) else limit


def _filter(direction: Direction, kind: str) -> Query:
    lower, upper = (_scaled(v, direction) for v in LIMITS[kind])
    f = O.filter_obs if direction.is_row else O.filter_var
    return lambda spark, d: f(orders_by_part(spark, d), lower, upper).axis(direction).select(direction.key)


def _filter_sql(direction: Direction, kind: str) -> str:
    lower, upper = (_scaled(v, direction) for v in LIMITS[kind])
    axis, key = (OBS, "obs_idx") if direction.is_row else (VAR, "var_idx")
    parts = ["true"]
    for limit, op in ((lower, ">="), (upper, "<=")):
        if isinstance(limit, Absolute):
            parts.append(f"n {op} {limit.value}")
        elif isinstance(limit, Relative):
            parts.append(f"s {op} (select quantile_cont(s, {limit.p}) from g)")
    return f"""with {X1}, axis as ({axis}), g as (select {key}, count(value) n, coalesce(sum(value), 0.0) s
from axis left join x using ({key}) group by 1) select {key} from g where {" and ".join(parts)}"""


def _normalized(direction: Direction, then_log: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        am = O.normalize_total(orders_by_part(spark, d), 1e4, direction)
        return _round((O.log1p(am) if then_log else am).x, "value")

    return run


def _normalized_sql(key: str, form: str) -> str:
    return f"""with {X1}, s as (select {key}, sum(value) total from x group by 1)
select obs_idx, var_idx, round({form}, 6) as value from x join s using ({key})"""


SCALED = "case when total = 0 then 0.0 else value * (10000.0 / total) end"
RANKED = "variance desc, var_idx"
VARIANCE = f"v as (select p_partkey var_idx, case when count(value) = 0 then 0.0 else {EXACT} end as variance from part left join x on p_partkey = var_idx group by 1)"


def _features(how: FeatureSelection) -> Query:
    return lambda spark, d: O.select_features(orders_by_part(spark, d), how)


def _rounded_vec(df: DataFrame) -> DataFrame:
    return df.select("obs_idx", F.posexplode("vec").alias("position", "value")).select("obs_idx", F.col("position").cast("long").alias("position"), F.round("value", DIGITS).alias("value"))


def to_dense_users(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_vec(O.to_dense(users_by_event(spark, d)))


def dense_selected(spark: SparkSession, d: str) -> DataFrame:
    am = vectors(spark, d)
    return _rounded_vec(to_dense_selected(am, O.select_indices(am, COLUMN, [7, 3, 11])))


def sliced(spark: SparkSession, d: str) -> DataFrame:
    am = vectors(spark, d)
    return am.subset(COLUMN, O.select_slice(am, COLUMN, 2, 20, 3)).x.select("obs_idx", "var_idx", F.round("value", DIGITS).alias("value"))


def flagged_subset(spark: SparkSession, d: str) -> DataFrame:
    am = orders_by_part(spark, d)
    return am.subset(COLUMN, O.select_mask(am, COLUMN, "large")).x


def gram_vectors(spark: SparkSession, d: str) -> DataFrame:
    am = vectors(spark, d)
    g = O.gram(am, O.select_features(am, FeatureSelection.everything()))
    return g.select(F.col("i").alias("i"), F.col("j").alias("j"), F.round("g", DIGITS).alias("g"))


def pca_scores(spark: SparkSession, d: str) -> DataFrame:
    am = O.pca(vectors(spark, d), 3).matrix
    return am.obsm["X_pca"]


def pca_sparse(spark: SparkSession, d: str) -> DataFrame:
    """Filter, choose the 25 most variable parts, and project; the usual chain. Each step is cached, as its three frames
    and the next step's read it."""
    am = O.filter_obs(orders_by_part(spark, d).persist(), Absolute(2)).persist()
    am = O.filter_var(am, Absolute(3)).persist()
    return O.pca(am, 5, features=FeatureSelection.top_variance(25)).matrix.obsm["X_pca"]


def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    out = O.pca(vectors(spark, d), 3)
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(out.explained_variance, out.explained_variance_ratio, strict=True))]
    return spark.createDataFrame(rows, "component int, variance double, variance_ratio double")


def pca_loadings(spark: SparkSession, d: str) -> DataFrame:
    return O.pca(vectors(spark, d), 3).matrix.varm["PCA_loadings"]


def pca_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Squared length of every row's scores by a fitted model of all components, which is that of the scaled row itself."""
    am = vectors(spark, d)
    scores = O.apply_components(am, O.fit_components(am, am.n_vars())).obsm["X_pca"]
    return scores.select("obs_idx", F.round(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v), DIGITS).alias("d2"))


def svd_orders(spark: SparkSession, d: str) -> DataFrame:
    """The left vectors of the sparse matrix over its 25 most variable parts, by a QR of its rows."""
    am = orders_by_part(spark, d).persist()
    return O.svd(am, 5, FeatureSelection.top_variance(25)).matrix.obsm["X_svd"]


def tsne_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first rounds of t-SNE over ten components of all vectors."""
    return O.tsne(O.pca(vectors(spark, d), 10).matrix, perplexity=20, rounds=8).obsm["X_tsne"]


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's five nearest others, by rank. One centre, so that the result is exact."""
    points = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("obs_idx"), F.col("embedding").alias("vec"))
    near = O.nearest(points, 5, centres=1)
    return near.select("obs_idx", F.posexplode("near").alias("rank", "n")).select("obs_idx", F.col("rank").cast("long").alias("rank"), F.round("n.d2", 4).alias("d2"))


def range_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    points = spark.read.parquet(f"{d}/embeddings.parquet").select(F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))
    return _round(plot_range(points, "a", "b"), "x_min", "x_max", "y_min", "y_max")


def raster_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Points per pixel and label of a picture of the first two components."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    points = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").cast("string").alias("label"), at(0).alias("a"), at(1).alias("b"))
    return raster(points, "a", "b", 32, 24, "label")


def nested_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as arrays of four by some, put into columns again."""
    n = F.size("embedding")
    pieces = F.transform(F.sequence(F.lit(0), n - 1, F.lit(4)), lambda i: F.slice("embedding", i + 1, F.lit(4)))
    shaped = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.when(n > 0, pieces).alias("shaped"))
    return from_nested(shaped, "vec_id", "shaped").x.select("obs_idx", "var_idx", F.round("value", DIGITS).alias("value"))


def positions_of_kept(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh from the fifth of the orders that a filter has kept, whatever their ids."""
    am = O.filter_obs(orders_by_part(spark, d), Absolute(3))
    return O.slice_positions(am, ROW, 5, None, 7)


def growing_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each line's quantity as an entry of its part, streamed into a state of exact sums; every part's statistics after."""
    folder = new_path(spark)
    state = GrowingStatistics(spark, folder, COLUMN)
    lines = spark.readStream.schema(spark.read.parquet(f"{d}/lineitem.parquet").schema).parquet(f"{d}/lineitem.parque[t]")  # a pattern: a stream's plain path is a folder
    entries = lines.select(F.col("l_orderkey").alias("obs_idx"), F.col("l_partkey").alias("var_idx"), F.col("l_quantity").alias("value"))
    run = entries.writeStream.foreachBatch(state.add).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return _round(state.read(orders_by_part(spark, d)), "sum", "variance", "std")


def _in_blocks(spark: SparkSession, d: str, layout: str = "csr"):
    path = new_path(spark)
    to_blocks(orders_by_part(spark, d), layout).write(path)
    return read_blocks(spark, path, layout)


def _annotated_bundle(direction: Direction) -> Query:
    """The quality columns, added to a stored bundle after two others, one of them replaced by them."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        bundle = create_bundle(orders_by_part(spark, d), new_path(spark))
        am = bundle.matrix()
        names = O.stats.QC_NAMES[direction]
        counts = O.compute_number(am, direction)
        bundle.add_columns(direction, counts.select(direction.key, F.col("count").alias("stored"), F.lit(-1).alias(names["count"])))
        bundle.add_columns(direction, O.qc_variables(am)[direction.value])
        doubles = [n for k, n in names.items() if k != "count"]
        return _round(bundle.matrix().axis(direction).select(direction.key, "stored", *names.values()), *doubles)

    return run


def block_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Entries and different orders over all chunks, blocks cut at 4096 entries; an order that a cut divides counts once a block
    and is taken off again."""
    blocks = to_blocks(orders_by_part(spark, d), "csr", 4096)
    chunks = blocks.chunks()
    shared = chunks.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("edge")).groupBy("edge").agg((F.count(F.lit(1)) - 1).alias("again"))
    n = chunks.agg(F.sum(F.col("n_entries").cast("long")).alias("n_entries"), F.sum(F.col("n_ids").cast("long")).alias("ids"))
    return n.join(F.broadcast(shared.agg(F.sum("again").alias("again")))).select("n_entries", (F.col("ids") - F.col("again")).alias("n_orders"))  # one row each


def block_turned(spark: SparkSession, d: str) -> DataFrame:
    """The entries of all orders, stored by order and turned to be stored by part."""
    return _in_blocks(spark, d).turned().entries()


def block_range(spark: SparkSession, d: str) -> DataFrame:
    """The entries of the orders of a range of ids, by blocks whose statistics reach it."""
    return _in_blocks(spark, d).between(1000, 9000)


def pipeline_chain(spark: SparkSession, d: str) -> DataFrame:
    """Filter observations, then variables, scale each observation and take logarithms."""
    am = O.filter_var(O.filter_obs(orders_by_part(spark, d), Absolute(2), Relative(0.95)), Absolute(5))
    return _round(O.log1p(O.normalize_total(am, 1e4)).x, "value")


CHAIN_SQL = f"""with {X1}, g as (select o_orderkey obs_idx, count(value) n, coalesce(sum(value), 0.0) s from orders left join x on o_orderkey = obs_idx group by 1),
y as (select x.* from x join g using (obs_idx) where n >= 2 and s <= (select quantile_cont(s, 0.95) from g)),
z as (select * from y where var_idx in (select var_idx from y group by 1 having count(*) >= 5)),
t as (select obs_idx, sum(value) total from z group by 1)
select obs_idx, var_idx, round(ln(1 + {SCALED}), 6) as value from z join t using (obs_idx)"""


def _chunked(stat: str) -> Query:
    f = {"count": O.compute_number, "sum": O.compute_sum}[stat]

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = f(users_by_event(spark, d), COLUMN, ComputationMode.chunked(1000))
        return _round(out, "sum") if stat == "sum" else out

    return run


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {"qc_obs": _qc(ROW), "qc_var": _qc(COLUMN)}
    for name, which in (("count", ["count"]), ("sum", ["sum"]), ("var", ["variance"]), ("std", ["std"]), ("minmax", ["min", "max"])):
        out |= {f"{name}_row": _stat(ROW, *which), f"{name}_col": _stat(COLUMN, *which)}
    out |= {f"filter_obs_{k}": _filter(ROW, k) for k in LIMITS} | {f"filter_var_{k}": _filter(COLUMN, k) for k in LIMITS}
    return out | {
        "chunked_count_col": _chunked("count"),
        "chunked_sum_col": _chunked("sum"),
        "normalize_row": _normalized(ROW),
        "normalize_col": _normalized(COLUMN),
        "log1p": lambda spark, d: _round(O.log1p(orders_by_part(spark, d)).x, "value"),
        "norm_log1p": _normalized(ROW, True),
        "filter_norm_log1p": pipeline_chain,
        "hvg_topk": _features(FeatureSelection.top_variance(25)),
        "var_threshold": _features(FeatureSelection.variance_above(200.0)),
        "flagged_features": _features(FeatureSelection.flagged("large")),
        "random_features": _features(FeatureSelection.randomized(20, 7)),
        "all_features": _features(FeatureSelection.everything()),
        "to_dense": to_dense_users,
        "dense_selected": dense_selected,
        "subset_slice": sliced,
        "subset_mask": flagged_subset,
        "gram": gram_vectors,
        "pca_scores": pca_scores,
        "pca_sparse": pca_sparse,
        "pca_evr": pca_variance,
        "pca_loadings": pca_loadings,
        "pca_lengths": pca_lengths,
        "svd": svd_orders,
        "tsne": tsne_vectors,
        "nearest": nearest_vectors,
        "plot_range": range_of_vectors,
        "plot_raster": raster_of_vectors,
        "slice_positions": positions_of_kept,
        "nested_arrays": nested_arrays,
        "growing_stats": growing_parts,
        "bundle_obs": _annotated_bundle(ROW),
        "bundle_var": _annotated_bundle(COLUMN),
        "block_count_row": lambda spark, d: _in_blocks(spark, d).counts(ROW),
        "block_count_col": lambda spark, d: _in_blocks(spark, d).counts(COLUMN),
        "block_sum_col": lambda spark, d: _round(_in_blocks(spark, d, "csc").stats(COLUMN, ("sum",)), "sum"),
        "block_chunks": block_chunks,
        "block_turned": block_turned,
        "block_range": block_range,
    }


def oracle_sql() -> dict[str, str]:
    out = {"qc_obs": _qc_sql(ROW), "qc_var": _qc_sql(COLUMN)}
    for name, which in (("count", ["count"]), ("sum", ["sum"]), ("var", ["variance"]), ("std", ["std"]), ("minmax", ["min", "max"])):
        out |= {f"{name}_row": _stat_sql(ROW, *which), f"{name}_col": _stat_sql(COLUMN, *which)}
    out |= {f"filter_obs_{k}": _filter_sql(ROW, k) for k in LIMITS} | {f"filter_var_{k}": _filter_sql(COLUMN, k) for k in LIMITS}
    select3 = "case var_idx when 7 then 0 when 3 then 1 when 11 then 2 end"
    return out | {
        "chunked_count_col": f"with {X2} select var_idx, count(value) as count from var left join x using (var_idx) group by 1",
        "chunked_sum_col": f"with {X2} select var_idx, round(coalesce(sum(value), 0.0), 6) as sum from var left join x using (var_idx) group by 1",
        "normalize_row": _normalized_sql("obs_idx", SCALED),
        "normalize_col": _normalized_sql("var_idx", SCALED),
        "log1p": f"with {X1} select obs_idx, var_idx, round(ln(1 + value), 6) as value from x",
        "norm_log1p": _normalized_sql("obs_idx", f"ln(1 + {SCALED})"),
        "filter_norm_log1p": CHAIN_SQL,
        "hvg_topk": f"with {X1}, {VARIANCE} select var_idx, row_number() over (order by {RANKED}) - 1 as out_pos from v order by {RANKED} limit 25",
        "var_threshold": f"with {X1}, {VARIANCE} select var_idx, row_number() over (order by var_idx) - 1 as out_pos from v where variance > 200",
        "flagged_features": "select p_partkey var_idx, row_number() over (order by p_partkey) - 1 as out_pos from part where p_size > 40",
        "all_features": "select p_partkey var_idx, row_number() over (order by p_partkey) - 1 as out_pos from part",
        "random_features": "select var_idx, row_number() over (order by h, var_idx) - 1 as out_pos from (select p_partkey var_idx, md5(concat_ws(':', '7', p_partkey::varchar)) h from part order by h, var_idx limit 20)",
        "to_dense": f"with {X2}, o as (select distinct user_id obs_idx from events) select obs_idx, var_idx as position, round(coalesce(value, 0.0), 6) as value from o cross join var left join x using (obs_idx, var_idx)",
        "dense_selected": f"with {X3} select obs_idx, ({select3})::bigint as position, round(value, 6) as value from x where var_idx in (7, 3, 11)",
        "subset_slice": f"with {X3} select obs_idx, var_idx, round(value, 6) as value from x where var_idx >= 2 and var_idx < 20 and (var_idx - 2) % 3 = 0",
        "subset_mask": f"with {X1} select x.* from x join part on p_partkey = var_idx where p_size > 40",
        "gram": f"with {X3} select a.var_idx as i, b.var_idx as j, round(sum(a.value * b.value), 6) as g from x a join x b using (obs_idx) where a.var_idx <= b.var_idx group by 1, 2",
        "plot_raster": """with p as (select label::varchar as label, embedding[1]::double a, embedding[2]::double b from embeddings),
e as (select min(a) a0, max(a) a1, min(b) b0, max(b) b1 from p)
select label, floor((a - a0) / (a1 - a0) * 31)::int as cx, floor((b - b0) / (b1 - b0) * 23)::int as cy, count(*) as n from p, e group by 1, 2, 3""",
        "slice_positions": f"""with {X1}, k as (select o_orderkey obs_idx from orders join x on o_orderkey = obs_idx group by 1 having count(*) >= 3),
r as (select obs_idx, row_number() over (order by obs_idx) - 1 as place from k) select obs_idx, (place - 5) // 7 as out_pos from r where place >= 5 and (place - 5) % 7 = 0""",
        "nested_arrays": f"with {X3} select obs_idx, var_idx, round(value, 6) as value from x",
        "growing_stats": _stat_sql(COLUMN, "count", "sum", "variance", "std", "min", "max").replace(X1, "x as (select l_orderkey obs_idx, l_partkey var_idx, l_quantity as value from lineitem)"),
        "bundle_obs": f"select *, num_genes_per_cell as stored from ({_qc_sql(ROW)})",
        "bundle_var": f"select *, num_cells_per_gene as stored from ({_qc_sql(COLUMN)})",
        "block_count_row": _stat_sql(ROW, "count"),
        "block_count_col": _stat_sql(COLUMN, "count"),
        "block_sum_col": _stat_sql(COLUMN, "sum"),
        "block_chunks": f"with {X1} select count(*) as n_entries, count(distinct obs_idx) as n_orders from x",
        "block_turned": f"with {X1} select * from x",
        "block_range": f"with {X1} select * from x where obs_idx between 1000 and 9000",
        "pca_lengths": f"""with {X3}, m as (select var_idx, avg(value) mean, stddev_pop(value) std from x group by 1)
select obs_idx, round(sum(((value - mean) / std) ** 2), 6) as d2 from x join m using (var_idx) group by 1""",
        "nearest": """with p as (select a.vec_id as obs_idx, b.vec_id as o, list_distance(a.embedding::double[], b.embedding::double[]) ** 2 as d2 from embeddings a join embeddings b on a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by obs_idx order by d2, o) - 1 as rank from p) select obs_idx, rank, round(d2, 4) as d2 from r where rank < 5""",
        "plot_range": "select round(min(embedding[1])::double, 6) as x_min, round(max(embedding[1])::double, 6) as x_max, round(min(embedding[2])::double, 6) as y_min, round(max(embedding[2])::double, 6) as y_max from embeddings",
    }
