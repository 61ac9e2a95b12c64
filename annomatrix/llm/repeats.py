"""Passages that occur more than once, by seed and extend.

Seeds are winnowed anchors: in every window of WINDOW words the leftmost smallest hash of ANCHOR consecutive words.
Equal windows have equal anchors at the same place, so occurrences of a window always meet in the join on anchors. An
occurrence of an anchor stands for the windows that chose it, and is extended both ways over all of them: its span has
one hash. Occurrences whose spans agree repeat as a whole. Only where an anchor's spans differ, one occurrence of each
distinct span gives its windows one by one, and those that agree with another are joined back. Overlapping windows
make up the maximal repeats, whose words are removed everywhere.

No pair of occurrences is ever made: groups are counted, with partial sums, and the counts are joined back, those of
keys with a large share of the rows by a bounded broadcast. Anchors and spans are 64-bit hashes of different lanes (see
words.py), taken together; windows have both lanes.

Windows are judged on the input. Null texts have no words; texts shorter than a window keep them. Rows that share
doc_id and text are separate occurrences, so both lose what they share. A null doc_id is a document like others. An
empty table gives none. Texts of any length are read whole. Columns of the input named as the added ones (n_words,
n_removed, kept_sha256) are replaced; other names are free.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, quoted, scratch
from .skew import join_counted
from .words import Runs, chunks, mix, signed

WINDOW = 35
ANCHOR = 10
NO_ID = -(2**63)
KEY = ["_id", "_mark"]
ADDED = ["n_words", "n_removed", "kept_sha256"]


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of every width consecutive values, by doubling."""
    v, p, size = grams, np.arange(len(grams)), 1

    def least(shift: int) -> None:
        nonlocal v, p
        if shift:
            later = v[shift:] < v[:-shift]
            v, p = np.where(later, v[shift:], v[:-shift]), np.where(later, p[shift:], p[:-shift])

    while 2 * size <= width:
        least(size)
        size *= 2
    least(width - size)
    return p


def window_starts(bounds: np.ndarray, window: int) -> np.ndarray:
    """Every place where a window lies within one text."""
    n = np.maximum(np.diff(bounds) - window + 1, 0)
    return np.arange(n.sum()) + np.repeat(bounds[:-1] - (np.cumsum(n) - n), n)


def anchors(hashes: np.ndarray, bounds: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, anchor hash, span hash) of each anchor's occurrences."""
    starts = window_starts(bounds, window)
    if not len(starts):
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.int32),) + (np.zeros(0, dtype=np.uint64),) * 2
    at = np.arange(len(hashes) - anchor + 1)
    grams = Runs(hashes, 0).of(at, at + anchor)
    chosen = winnow(grams, window - anchor + 1)[starts]
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    many = np.diff(np.append(new, len(starts)))
    first, place = starts[new], chosen[new]
    span = Runs(hashes, 1).of(first, first + many - 1 + window)
    span = mix(span + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + many.astype(np.uint64))
    text = np.searchsorted(bounds, first, side="right") - 1
    return text, first - bounds[text], many.astype(np.int32), grams[place], span


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), text, _id and _mark, which tell documents apart."""
    text = F.col("text").cast("string")
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_mark")]
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), text.alias("text"), *key)


def occurrences(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("_id").to_numpy(), batch.column("_mark").to_numpy()
            for lo, hashes, bounds in chunks(batch.column("text")):
                text, first, many, a, c = anchors(hashes, bounds, window, anchor)
                rows = [ids[lo + text], marks[lo + text], first.astype(np.int32), many, signed(a), signed(c)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["_id", "_mark", "first", "many", "anchor", "span"])

    schema = "_id long, _mark long, first int, many int, anchor long, span long"
    return keyed.select("_id", "_mark", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def windows(texts: DataFrame, window: int) -> DataFrame:
    """(_id, _mark, first, w1, w2): the windows of the occurrences in the column wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, wanted = batch.column("_id").to_numpy(), batch.column("_mark").to_numpy(), batch.column("wanted").to_pylist()
            for lo, hashes, bounds in chunks(batch.column("text")):
                one, two = Runs(hashes, 0), Runs(hashes, 1)
                for i in range(len(bounds) - 1):
                    pairs = wanted[lo + i]
                    if not pairs:
                        continue
                    first = np.concatenate([np.arange(p["first"], p["first"] + p["many"]) for p in pairs])
                    at = first + bounds[i]
                    same = np.full(len(at), 0, dtype=np.int64)
                    rows = [same + ids[lo + i], same + marks[lo + i], first.astype(np.int32), signed(one.of(at, at + window)), signed(two.of(at, at + window))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["_id", "_mark", "first", "w1", "w2"])

    return texts.select("_id", "_mark", F.col("text").cast("string").alias("text"), "wanted").mapInArrow(run, "_id long, _mark long, first int, w1 long, w2 long")


def repeated_ranges(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(_id, _mark, first, many): runs of windows that start elsewhere too."""
    with scratch(keyed.sparkSession) as kept:
        seen = materialize(occurrences(keyed, window, anchor), "anchors")
        more = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("s0"), F.max("span").alias("s1"))
        more = more.where("n > 1").select("anchor", "n", (F.col("s0") != F.col("s1")).alias("differ"))
        shared = materialize(join_counted(seen, more, ["anchor"], "repeated-anchors").drop("n"), "shared-anchors")
        alike = shared.where("not differ").select(*KEY, "first", "many")
        differ = shared.where("differ")
        place = F.struct(*KEY, "first", "many")
        spans = differ.groupBy("anchor", "span").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
        whole = join_counted(differ, spans.where("n > 1").select("anchor", "span", "n"), ["anchor", "span"], "repeated-spans").select(*KEY, "first", "many")
        wanted = spans.select("place.*").groupBy(*KEY).agg(F.collect_set(F.struct("first", "many")).alias("wanted"))
        single = materialize(windows(keyed.select(*KEY, "text").join(wanted, KEY), window), "windows")
        twice = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        some = join_counted(single, twice, ["w1", "w2"], "repeated-windows").select(*KEY, "first", F.lit(1).alias("many"))
        out = materialize(alike.unionByName(whole).unionByName(some), "repeated-ranges")
        kept.append(out)
    return out


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 500) for whole in batches for lo in range(0, len(whole), 500)):
            texts, ranges = batch.column("text"), batch.column("ranges")
            out, n_words, n_removed, sums = [], [], [], []
            for i in range(len(batch)):
                text, found = texts[i].as_py(), ranges[i].as_py()
                words = text.encode().split() if text else []
                drop = np.zeros(len(words) + 1, dtype=np.int32)
                for r in found or ():
                    drop[r["first"]] += 1
                    drop[r["first"] + r["many"] - 1 + window] -= 1
                gone = np.cumsum(drop)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words
                joined = b" ".join(kept)
                out.append(joined.decode() if found else text)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                sums.append(hashlib.sha256(joined).hexdigest())
            new = [pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *new], names=["row", "text", *ADDED])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with what repeats cut from text, and n_words, n_removed and kept_sha256 (of the kept words joined by one
    space). A text that loses nothing stays as it is; another becomes its kept words joined by one space."""
    if not 0 < anchor <= window:
        raise ValueError("an anchor lies within a window")
    keyed = _keyed(docs)
    ranges = repeated_ranges(keyed, window, anchor)
    by_doc = ranges.groupBy(*KEY).agg(F.collect_set(F.struct("first", "many")).alias("ranges"))  # at most a document's windows
    joined = keyed.join(by_doc, KEY, "left")
    others = [c for c in docs.columns if c not in ("text", *ADDED)]  # text comes apart, and is replaced
    row = F.struct(F.lit(True).alias("_row"), *[F.col("row")[c].alias(c) for c in others])
    joined = joined.select(row.alias("row"), "text", "ranges")
    kind = T.StructType([T.StructField("row", joined.schema["row"].dataType, True), T.StructField("text", T.StringType(), True)])
    kind = kind.add("n_words", T.LongType()).add("n_removed", T.LongType()).add("kept_sha256", T.StringType())
    out = joined.mapInArrow(_cut(window), kind)
    names = [c for c in docs.columns if c not in ADDED]
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names], *ADDED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document of the whole table keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same by all windows of all documents, grouped by a digest.
ORACLE = r"""with d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select r, unnest(range(1, len(w) - 33)) as i, w from d where len(w) >= 35),
h as (select r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) as h from g),
s as (select r, i from h where h in (select h from h group by h having count(*) > 1)),
x as (select distinct r, unnest(range(i, i + 35)) as i from s),
u as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d),
k as (select r, string_agg(word, ' ' order by i) as kept from u anti join x using (r, i) group by r),
n as (select r, count(*) as n from x group by r)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join n using (r) left join k using (r)"""
