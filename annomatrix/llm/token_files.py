"""Token ids of a corpus as a compressed file set, written and read by Spark.

write() makes two tables under a path: code (one length per id) and blocks (one row per block, in files that follow
the order of doc_id). read() gives the documents back with their place among all ids. See huffman.py for the blocks.

Null texts have only the end id; a null doc_id sorts first, and one of any size keeps its bits. Rows that share a doc_id
are separate documents in the order of a hash of their ids and then of these, so that reruns agree and one doc_id may
fill many parts. A text of any length is one document. Other columns of the input, whatever their names, are not read.
An empty table gives an empty file set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .huffman import Code, code_lengths
from .shared import materialize, scratch, table_path

BLOCK_IDS = 1 << 18
BLOCKS = (
    "part int, block int, part_start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
    "offsets array<long>, payload binary"
)
NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def tokenize(docs: DataFrame, tokenizer: str | None = None, width: int = 2) -> DataFrame:
    """(doc_id, ids): ids of the whole text and the end id, packed little-endian in width bytes each."""
    path = tokenizer or tokens.tokenizer_path()
    end = tokens.END_ID.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = tokens.encoder(path, width).encode_all
        for batch in batches:
            ids = pa.array([ids + end for ids in encode_all(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(ids: DataFrame, vocabulary: int, width: int = 2) -> np.ndarray:
    """Occurrences of every id in the corpus. Each task adds its own up first, so that at most the vocabulary leaves
    it, and the driver gets one number per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for packed in batch.column("ids"):
                seen = np.bincount(np.frombuffer(packed.as_buffer(), dtype=f"<u{width}"))
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    out = np.zeros(vocabulary, dtype=np.int64)
    for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def write(docs: DataFrame, path: str, tokenizer: str | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Tokenizes docs, counts ids over all of them, and writes code and blocks below path."""
    spark, width = docs.sparkSession, 2
    with scratch(spark):
        ids = materialize(tokenize(docs, tokenizer, width), "ids")
        vocabulary = tokens.encoder(tokenizer or tokens.tokenizer_path(), width).tokenizer.get_vocab_size()
        lengths = code_lengths(id_counts(ids, vocabulary, width))
        spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths) if n], "id int, length int").coalesce(1).write.parquet(f"{path}/code")
        packed = lengths.tobytes()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code = Code(np.frombuffer(packed, dtype=np.uint8))
            part, block, start, held = TaskContext.get().partitionId(), 0, 0, 0
            docs_in: list[pa.Array] = []
            parts: list[pa.Array] = []

            def flush() -> pa.RecordBatch:
                nonlocal block, start, held
                of_docs = pa.concat_arrays(docs_in)
                sizes = np.concatenate([pc.binary_length(p).to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64) // width
                payload, offsets = code.encode(np.frombuffer(b"".join(x.as_buffer() for p in parts for x in p), dtype=f"<u{width}"))
                many = int(sizes.sum())
                row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start]), pa.array([many])]
                row += [pa.ListArray.from_arrays([0, len(x)], x) for x in (of_docs, pa.array(sizes), pa.array(offsets))]
                block, start, held = block + 1, start + many, 0
                docs_in.clear()
                parts.clear()
                return pa.RecordBatch.from_arrays([*row, pa.array([payload], pa.binary())], names=NAMES)

            for batch in batches:
                ends = np.cumsum(pc.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False), dtype=np.int64) // width
                lo = 0
                while lo < len(batch):
                    before = int(ends[lo - 1]) if lo else 0
                    hi = min(len(batch), int(np.searchsorted(ends, before + block_ids - held)) + 1)
                    docs_in.append(batch.column("doc_id")[lo:hi])
                    parts.append(batch.column("ids")[lo:hi])
                    held += int(ends[hi - 1]) - before
                    if held >= block_ids:
                        yield flush()
                    lo = hi
            if docs_in:
                yield flush()

        order = ["doc_id", "hash", "ids"]
        ordered = ids.withColumn("hash", F.xxhash64("ids")).repartitionByRange("doc_id", "hash").sortWithinPartitions(*order)
        ordered.select("doc_id", "ids").mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary): start counts the ids of all documents before; ids are little-endian
    unsigned 32-bit integers with the end id. Only the code (one row per id) and one row per file part pass through
    the driver or a single task."""
    code_rows = spark.read.parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r.id for r in code_rows), default=-1) + 1, dtype=np.uint8)
    for r in code_rows:
        lengths[r.id] = r.length
    packed = lengths.tobytes()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = blocks.join(F.broadcast(totals), "part")  # one row per output partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(packed, dtype=np.uint8))
        for batch in batches:
            for i in range(len(batch)):
                b = {c: batch.column(c)[i] for c in ("doc_ids", "doc_lengths", "offsets", "payload", "n_ids", "before", "part_start")}
                ids = code.decode(b["payload"].as_py(), b["offsets"].values.to_numpy(), b["n_ids"].as_py()).astype("<u4").tobytes()
                sizes = b["doc_lengths"].values.to_numpy()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                pieces = pa.array([ids[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                first = pa.array(b["before"].as_py() + b["part_start"].as_py() + starts)
                yield pa.RecordBatch.from_arrays([b["doc_ids"].values, first, pa.array(sizes), pieces], names=["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the whole documents table as a file set, reads it back and gives each document's checksum."""
    path = table_path(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
