"""Ranked lexical search: the k best documents of each item by weighted term frequencies, exact, from inverted treaps.

Documents are cut into terms once; of each document its length and its times of the items' terms are kept in a table.
Global counts make the weights. Then each task indexes its documents in shards of some SHARD_POSTINGS postings as treaps, and
searches each shard for all items, carrying the kth scores from shard to shard; the tasks' best are ranked at the end.
Items go to the tasks by blocks of some BLOCK_BYTES of text, one pass over the documents a block.

A null text has no term. Documents without terms do not count in N. Repeated documents rank one by one; null doc_ids rank
behind others of the same score. An item is a distinct row of item_id and text, null or not, and one without terms or
hits has no row. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, scratch
from .terms import LETTERS_DIGITS, per_text, runs, terms_of
from .treaps import Best, Queries, build, search

K = 20
SHARD_POSTINGS = 1 << 20
#: Text of the items that one pass over the documents serves.
BLOCK_BYTES = 1 << 23
INT64 = np.iinfo(np.int64).max


def _postings(vocabulary: pa.Array) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, n, terms, times) of the documents that have terms; only the vocabulary's terms are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches):
            terms, bounds = terms_of(table.column("text"), LETTERS_DIGITS)
            n = np.diff(bounds)
            known = pc.index_in(terms.dictionary, value_set=vocabulary.cast(pa.large_string()))
            known = pc.fill_null(known, -1).to_numpy(zero_copy_only=False)
            text, code, times = per_text(terms, bounds)
            held = known[code] >= 0 if len(code) else np.zeros(0, dtype=bool)
            text, code, times = text[held], known[code[held]], times[held]
            offsets = pa.array(np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (code, times)]
            out = pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(n), *lists], names=["doc_id", "n", "terms", "times"])
            yield out.filter(pa.array(n > 0))

    return run


def _counts(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, n): documents of each term, and as terms -1 and -2 all documents and the sum of their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            docs, length = docs + len(batch), length + int(batch.column("n").to_numpy().sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([docs, length, *df[some].tolist()], pa.int64())], names=["term", "n"])

    return run


def _searched(queries: Queries, n_terms: int, docs: int, length: int, k: int, shard: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item, doc_id, score): a task's k best of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.bounds) - 1, k)

        def take(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")]).combine_chunks()
            none = table.column("doc_id").is_null().to_numpy()
            ids = pc.fill_null(table.column("doc_id"), INT64).to_numpy()
            lists = table.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(table)), np.diff(lists.offsets.to_numpy()))
            tf = table.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 100 - 25 + 25 * table.column("n").to_numpy() * docs // length
            impact = 10**9 * tf // (1000 * tf + 12 * m[doc])
            treaps = build(lists.flatten().to_numpy(), doc, impact, n_terms, len(table))
            search(treaps, queries, ids, none, best)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= shard:
                take(held)
                held, size = [], 0
        if size:
            take(held)
        ids = pa.array(best.id, mask=best.none)
        yield pa.RecordBatch.from_arrays([pa.array(best.query), ids, pa.array(best.score)], names=["item", "doc_id", "score"])

    return run


def _item_terms(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    terms, bounds = terms_of(pa.array(texts, pa.string()), LETTERS_DIGITS)
    item, code, times = per_text(terms, bounds)
    return terms.dictionary, np.searchsorted(item, np.arange(len(texts) + 1)), code, times


def _block(docs: DataFrame, items: list, k: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary, bounds, term, times = _item_terms([r.text for r in items])
    postings = materialize(docs.mapInArrow(_postings(vocabulary), "doc_id long, n long, terms array<int>, times array<int>"), "lexical-postings")
    counts = postings.select("n", "terms").mapInArrow(_counts(len(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r.term: r.n for r in counts.collect()}  # one number a term of the block
    n, length = counts.get(-1, 0), counts.get(-2, 0)
    weight = np.array([floor(1000 * log((2 * n + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(vocabulary))], dtype=np.int64)
    found = postings.mapInArrow(_searched(Queries(bounds, term, weight[term] * times), len(vocabulary), n, length, k, shard), "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    named = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], f"item long, item_id {items[0].kind}")
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # a block of items is bounded


def lexical(docs: DataFrame, items: DataFrame, k: int = K, shard: int = SHARD_POSTINGS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 of each item."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    with scratch(spark) as kept:
        items = materialize(items, "lexical-items")
        size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        blocks = 1 + size // block_bytes
        place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        out = [spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")]
        for b in range(blocks):
            own = items.where(place == b).withColumn("kind", F.lit(kind)).collect()  # some block_bytes
            if own:
                with scratch(spark) as ours:
                    out.append(materialize(_block(docs, own, k, shard), "lexical-ranks"))
                    ours.append(out[-1])
                kept.append(out[-1])
    return reduce(DataFrame.unionByName, out[1:], out[0]) if len(out) != 2 else out[1]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return lexical(read("documents"), read("benchmark"))


_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term"
ORACLE = f"""with i as (select item_id, {_TERMS} from benchmark), it as (select item_id, term, count(*) as times from i group by 1, 2),
d as (select row_number() over () as row, doc_id, text from documents), t as (select row, doc_id, {_TERMS} from d),
len as (select row, doc_id, count(*) as n from t group by 1, 2), total as (select count(*) as docs, sum(n)::bigint as length from len),
tf as (select row, term, count(*) as tf from t where term in (select term from it) group by 1, 2),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by 1),
hit as (select item_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // length)))))::bigint as score
    from it join tf using (term) join w using (term) join len using (row), total group by 1, 2),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from hit join len using (row) where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= {K}"""
