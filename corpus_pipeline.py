"""A training corpus in five stages: toxic documents out, one of each group of near copies, repeated passages cut,
sources mixed to their weights, and the rest packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result to the shared folder
and reads it again as the next one's documents. All but the last keep the columns of documents. What a stage decides
takes effect: the mix repeats a document as often as it takes it and leaves out what it does not take.

What a stage makes of nulls, empty and very long texts, repeated rows and empty tables is said by its operator: rows of
a null doc_id or text pass the first four stages (a text without words is not mixed, as it has no size), repeated rows
come down to one in the second, and an empty table gives an empty one. Other columns, whatever their names, go through
the first four stages unchanged, but for n_chars where a text is cut. Names that differ in case alone, which Spark cannot
tell apart unless spark.sql.caseSensitive is set, are an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annomatrix.llm import mixing, near, packing, repeats, toxicity
from annomatrix.llm.shared import drop, materialize, quoted, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SIMILARITY = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep(docs, SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text."""
    others = F.struct(F.lit(True).alias("_"), *[F.col(quoted(c)).alias(f"of_{c}") for c in docs.columns if c != "text"])
    out = repeats.remove_repeats(docs.select("doc_id", "text", others.alias("others")))
    own = {c: F.col("text") if c == "text" else F.col("others")[f"of_{c}"] for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(own["n_chars"])
    return out.select(*[v.alias(c) for c, v in own.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Exact repetitions, of one doc_id, text and source, get their times
    together; of rows that differ in other columns only, the one of the least hash stands for all of them."""
    key = ["doc_id", "mark", "source"]
    times = F.when(F.col("size") > 0, F.try_divide("taken", "size").cast("int")).otherwise(0)
    with scratch(spark) as kept:
        plan = mixing.mix(docs).groupBy(*key).agg(F.sum(times).alias("times"), F.count(F.lit(1)).alias("rows"))
        plan = materialize(plan.where("times > 0"), "mix-times")
        kept.append(plan)
    own = [F.col("doc_id").cast("long"), mixing.mark_of(F.col("text")), F.col("source").cast("string")]
    whole = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), *[c.alias(f"own_{k}") for k, c in zip(key, own, strict=True)])
    taken = whole.join(plan, [F.col(f"own_{k}").eqNullSafe(F.col(k)) for k in key])
    turns = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    once = taken.where("rows = 1")
    out = once.select("row", turns).select("row.*")
    if plan.where("rows > 1").isEmpty():
        return out
    least = F.min_by("row", F.xxhash64(*[F.col("row")[c] for c in docs.columns])).alias("row")
    several = taken.where("rows > 1").groupBy(*key).agg(least, F.max("times").alias("times"))
    return out.unionByName(several.select("row", turns).select("row.*"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The stages fit a model, hash sets and pack online, which SQL does not express; the tests check them one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's own tables, and what it read, are dropped once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with scratch(spark) as kept:
            docs = materialize(stage(spark, before, sf_dir), f"stage-{name}")
            kept.append(docs)
        if name != STAGES[0][0]:
            drop(spark, before.table_path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
