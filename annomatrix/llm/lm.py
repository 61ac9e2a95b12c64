"""Language-model scores: the log-probability of each text under a causal self-attention model over subword ids, beside that
under counts of words. Training texts are those whose crc32 of the id is not 1 modulo 5.

Words are cut at white space and A-Z lower-cased. Their counts come from all training texts. Words with more than one in
FREQUENT of all tokens, fewer than FREQUENT of them, go to the tasks; texts meet the counts of all others in a join.

For the model, a text is the ids of its words, each with a space before it, and an end id; so a text's ids tell its words
and nothing else. The most frequent ids have a slot each, all others share one and have their counted share of it. Counts
of slot behind slot, over all training texts, make the model's prior (attention.Prior). The rest of the model is trained in ROUNDS: each
task starts from the same weights and takes one pass over its texts, and the tasks' weights are averaged by the windows they
saw. Every window of every training text is trained on once: a round takes each text's next of ROUNDS windows.
Scoring reads every window of every text, and scores each id once, with up to a window's context before it.

A null text is empty, and has its end alone. A null doc_id counts as '' in the split. Repeated rows are scored one by one
and count each. Without training texts all counts are 0. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention
from .attention import Model, Params, Prior, Texts
from .shared import materialize, scratch
from .terms import per_text, runs, terms_of
from .tokens import Encoder, encoder, tokenizer_path
from .words import SPACE

WORDS = ~SPACE
END = "<|endoftext|>"
FREQUENT, LONGEST = 1 << 20, 64
SLOTS, CLASSES = 1024, 32
#: Passes that share the windows of the training texts.
ROUNDS = 3
#: Ids of a run of texts, and windows that are scored at once.
RUN_IDS, SCORE_WINDOWS = 1 << 18, 1024
#: Logarithms are summed as multiples of 1 / UNIT, so that no order of rows changes a sum.
UNIT = float(1 << 32)
CHUNK = 1 << 12
CODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base long, words array<string>, times array<int>, ids binary"

Batches = Iterator[pa.RecordBatch]


def _units(c: np.ndarray, total: int, distinct: int) -> np.ndarray:
    return np.rint((np.log10(c + 0.5) - np.log10(total + 0.5 * (distinct + 1))) * UNIT).astype(np.int64)


def _count_words(batches: Batches) -> Batches:
    for table in runs(batches):
        words, _ = terms_of(table.column("text"), WORDS)
        n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        yield pa.RecordBatch.from_arrays([words.dictionary.cast(pa.string()), pa.array(n)], names=["word", "c"])


def _code(frequent, counts: tuple[int, int, int], path: str) -> Callable[[Batches], Batches]:
    """Each text's ids, its sums over frequent words and its end, and its other words."""
    total, distinct, ends = counts

    def run(batches: Batches) -> Batches:
        words_known, c_known = frequent.value
        known_units, unknown = _units(c_known, total, distinct), int(_units(np.zeros(1), total, distinct)[0])
        end_units = int(_units(np.array([ends]), total, distinct)[0])
        enc = encoder(path)
        for table in runs(batches):
            words, bounds = terms_of(table.column("text"), WORDS)
            n = np.diff(bounds)
            code = words.indices.to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(words.dictionary, value_set=words_known), -1).to_numpy(zero_copy_only=False)
            some = at >= 0
            units = np.where(some, known_units[at] if len(known_units) else 0, unknown)
            base = np.diff(np.concatenate([[0], np.cumsum(units[code])])[bounds]) + end_units
            before = np.concatenate([[0], np.cumsum(some[code])])[bounds]
            known = np.diff(before) + (ends > 0)
            others = pa.DictionaryArray.from_arrays(words.indices.filter(pa.array(~some[code])), words.dictionary)
            text, code, times = per_text(others, bounds - before)
            rest = pa.array(np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(rest, words.dictionary.take(pa.array(code)).cast(pa.string())), pa.ListArray.from_arrays(rest, pa.array(times.astype(np.int32)))]
            ids = _ids_of(words, bounds, enc)
            own = [table.column(c).combine_chunks() for c in ("row", "doc_id", "held_out")]
            names = [x.split()[0] for x in CODED.split(", ")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n + 1), pa.array(known), pa.array(base), *lists, ids], names=names)

    return run


def _ids_of(words: pa.DictionaryArray, bounds: np.ndarray, enc: Encoder) -> pa.Array:
    """The ids of each text, two bytes each, with the end id."""
    coded = [*map(enc.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), enc.packed([enc.tokenizer.token_to_id(END)])]
    which = np.insert(words.indices.to_numpy(), bounds[1:], len(coded) - 1)
    end_to_end = pa.array(coded, pa.large_binary()).take(pa.array(which))
    offsets = np.frombuffer(end_to_end.buffers()[1], dtype=np.int64)[bounds + np.arange(len(bounds))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), end_to_end.buffers()[2]]).cast(pa.binary())


def _flat(batches: Batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids end to end, lengths) for runs of texts of some RUN_IDS ids."""
    for batch in batches:
        column = batch.column("ids").cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] // 2
        data, lo = np.frombuffer(column.buffers()[2], dtype="<u2") if len(column) else None, 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + RUN_IDS, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[ends[lo] : ends[hi]], np.diff(ends[lo : hi + 1])
            lo = hi


def _count_ids(size: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        n = np.zeros(size, dtype=np.int64)
        for _, ids, _ in _flat(batches):
            n += np.bincount(ids, minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["id", "n"])

    return run


class Slots:
    """Slot of each id, the id's share of a shared slot as a logarithm, and the end's slot."""

    def __init__(self, n: np.ndarray, end_id: int, slots: int):
        rank = np.lexsort((np.arange(len(n)), -n, np.arange(len(n)) != end_id))
        self.of = np.full(len(n), slots - 1)
        self.of[rank[: slots - 1]] = np.arange(slots - 1)
        shared = self.of == slots - 1
        self.share = np.zeros(len(n))
        self.share[shared] = np.log((n[shared] + 0.5) / (n[shared].sum() + 0.5 * shared.sum()))
        self.end_id, self.slots = end_id, slots

    def moved(self, new: np.ndarray) -> None:
        self.of = new[self.of]

    def texts(self, ids: np.ndarray, lengths: np.ndarray) -> Texts:
        target = self.of[ids]
        last = np.empty_like(target)
        last[1:] = target[:-1]
        last[(np.cumsum(lengths) - lengths)[lengths > 0]] = self.of[self.end_id]
        return last, target, lengths


def _count_pairs(slots: Slots) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        n = np.zeros(slots.slots**2, dtype=np.int64)
        for _, ids, lengths in _flat(batches):
            last, target, _ = slots.texts(ids, lengths)
            n += np.bincount(last * slots.slots + target, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["pair", "n"])

    return run


def _classes(pairs: np.ndarray, classes: int) -> np.ndarray:
    """The new number of each slot, such that slots with like predecessors are next to each other: halves along the
    widest direction, again and again, down to classes of equal size."""
    share = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * len(pairs))
    seen = pairs.sum(1, keepdims=True)
    gain = np.log((pairs + 5 * share) / (seen + 5) / share) * np.sqrt(seen)
    _, size, way = np.linalg.svd(gain, full_matrices=False)
    place = (way[:32] * size[:32, None]).T

    def halves(own: np.ndarray, k: int) -> list[np.ndarray]:
        if k == 1:
            return [own]
        own = own[np.argsort((place[own] - place[own].mean(0)) @ np.linalg.svd(place[own] - place[own].mean(0), full_matrices=False)[2][0], kind="stable")]
        return [*halves(own[: len(own) // 2], k // 2), *halves(own[len(own) // 2 :], k // 2)]

    new = np.empty(len(pairs), dtype=np.int64)
    new[np.concatenate(halves(np.arange(len(pairs)), classes))] = np.arange(len(pairs))
    return new


def _trained(params: Params, prior: Prior, slots: Slots, every: int, nth: int) -> Callable[[Batches], Batches]:
    """A task's weights times its number of targets, in chunks."""

    def run(batches: Batches) -> Batches:
        own, n = attention.train(params, prior, (slots.texts(ids, lengths) for _, ids, lengths in _flat(batches)), every, nth)
        if n:
            flat = np.concatenate([own[c].ravel() for c in sorted(own)]).astype(np.float64) * n
            parts = np.array_split(flat, -(-len(flat) // CHUNK))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts))), pa.array([n] * len(parts)), pa.array([p.tobytes() for p in parts])], names=["chunk", "n", "sums"])

    return run


def _added(batches: Batches) -> Batches:
    """Sums by chunk; all rows of a chunk are in one partition, which holds one sum for each of its chunks."""
    n, sums = {}, {}
    for batch in batches:
        for chunk, times, own in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "sums")), strict=True):
            n[chunk] = n.get(chunk, 0) + times
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(own)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values())), pa.array([s.tobytes() for s in sums.values()])], names=["chunk", "n", "sums"])


def _averaged(ids: DataFrame, params: Params, prior: Prior, slots: Slots, every: int, nth: int) -> Params:
    kind = "chunk long, n long, sums binary"
    found = ids.mapInArrow(_trained(params, prior, slots, every, nth), kind).repartition("chunk").mapInArrow(_added, kind).orderBy("chunk").collect()
    if not found:
        return params
    flat, out, at = np.concatenate([np.frombuffer(r.sums) / r.n for r in found]), {}, 0
    for c in sorted(params):
        out[c] = flat[at : at + params[c].size].reshape(params[c].shape).astype(np.float32)
        at += params[c].size
    return out


def _scored(params: Params, prior: Prior, slots: Slots) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        model = Model(params, prior)
        for rows, ids, lengths in _flat(batches):
            logs = slots.share[ids]
            at = 0
            for batch in attention.batches(slots.texts(ids, lengths), SCORE_WINDOWS):
                logs[at : at + len(batch[3])] += model.log_probs(*batch)
                at += len(batch[3])
            score = np.add.reduceat(logs, np.cumsum(lengths) - lengths) / np.log(10) if len(lengths) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(score)], names=[*rows.schema.names[:-1], "score"])

    return run


def fit(ids: DataFrame, vocab_size: int, end_id: int, slots: int = SLOTS, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Params, Prior, Slots]:
    """The model of the training texts' ids. What the driver gets is bounded by the vocabulary, slots squared and the weights."""
    counts = ids.mapInArrow(_count_ids(vocab_size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(vocab_size, dtype=np.int64)
    n[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    of = Slots(n, end_id, slots)
    found = ids.mapInArrow(_count_pairs(of), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = np.zeros(slots * slots)
    pairs[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    pairs = pairs.reshape(slots, slots)
    new = _classes(pairs, classes)
    back = np.argsort(new)
    of.moved(new)
    prior, params = Prior(pairs[np.ix_(back, back)], classes), attention.start(slots, classes)
    for r in range(rounds):
        params = _averaged(ids, params, prior, of, rounds, r)
    return params, prior, of


def scores(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs."""
    spark, path = docs.sparkSession, path or tokenizer_path()
    tokenizer = encoder(path).tokenizer
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    with scratch(spark) as kept:
        train = docs.where("not held_out")
        vocab = train.select("text").mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
        vocab = materialize(vocab, "lm-words")
        ends = train.count()
        total, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        total, distinct = total + ends, distinct + (ends > 0)
        counts = total, distinct, ends
        known = (F.col("c") * frequent > total) & (F.octet_length("word") <= LONGEST)
        few = vocab.where(known).toArrow()  # fewer than frequent words, of up to LONGEST bytes
        shared = spark.sparkContext.broadcast((few.column("word").combine_chunks().cast(pa.large_string()), few.column("c").to_numpy()))
        numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
        coded = materialize(numbered.mapInArrow(_code(shared, counts, path), CODED), "lm-texts")

        params, prior, slots = fit(coded.where("not held_out").select("ids"), tokenizer.get_vocab_size(), tokenizer.token_to_id(END), rounds=rounds)
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base"]
        scored = coded.select(*names, "ids").mapInArrow(_scored(params, prior, slots), CODED.split(", words")[0] + ", score double")

        rare = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
        # What a word that is in training texts adds to one that is not; the constant of both cancels.
        more = F.round((F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5))) * UNIT).cast("long") * F.col("times")
        rare = rare.join(vocab.where(~known), "word").groupBy("row").agg(F.sum(more).alias("more"), F.sum("times").alias("more_known"))
        out = scored.join(rare, "row", "left").select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            ((F.col("base") + F.coalesce("more", F.lit(0))) / UNIT).alias("base_score"),
            "score",
        )
        out = materialize(out, "lm-scores")
        kept.append(out)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
