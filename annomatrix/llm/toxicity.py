"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

One weight vector is shared by ordered thresholds: P(grade > k) = sigmoid(w.x - t_k), and the expected severity is the
sum of these over k. Features are the presence of words (runs of letters, lower-cased) from a vocabulary of those that
tell toxic from other labelled documents best.

The labels are binary. Grade 0 is a document that is not toxic; toxic ones are split into grades 1 to GRADES by how many
words they hold that are far more frequent in toxic documents, at even quantiles of that number. The model is fitted on
at most MAX_TRAIN labelled documents that are in the table, those of the smallest hashes of their id, whatever the size
of the input; of rows that share an id it takes one text, that of the smallest hash. Every document is then scored over its whole text.

A document labelled twice takes the larger label; null labels and ids do not count. Null and empty texts have no
features. Without toxic labels, or without others, every severity is 0. A null doc_id is scored like others, repeated
rows each. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

MAX_TRAIN = 20_000
VOCABULARY = 4096
LEAST_DOCUMENTS = 4
LEAST_Z = 4.5
GRADES = 3
REJECT_FROM = 0.35
SEED = 11
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...] = ()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, np.inf))

    def severity(self, position: dict[str, int], text: str | None) -> float:
        found = [i for i in map(position.get, set(LETTERS.findall((text or "").lower()))) if i is not None]
        return float(sigmoid(self.weights[sorted(found)].sum() - self.thresholds).sum())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(x, -1e3, 1e3) / 2))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, width: int, levels: int, penalty: float = 0.2, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by Adam on the penalised log-likelihood. rows and columns hold the ones of the
    feature matrix; grades run from 0 to levels."""
    n = len(grades)
    share = np.array([(grades > k).mean() for k in range(levels)]).clip(0.5 / n, 1 - 0.5 / n)
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 0.1))
    p = np.concatenate([np.zeros(width), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    above, below = grades < levels, grades > 0
    for step in range(1, steps + 1):
        w, t = p[:width], np.concatenate([p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))])
        x = np.bincount(rows, weights=w[columns], minlength=n)
        hi = np.where(above, sigmoid(t[np.minimum(grades, levels - 1)] - x), 1.0)
        lo = np.where(below, sigmoid(t[np.maximum(grades - 1, 0)] - x), 0.0)
        mass = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = np.where(above, hi * (1 - hi), 0) / mass, np.where(below, lo * (1 - lo), 0) / mass
        g_x = (d_hi - d_lo) / n  # of minus the log-likelihood
        g_t = np.zeros(levels)
        np.add.at(g_t, grades[above], -d_hi[above] / n)
        np.add.at(g_t, grades[below] - 1, d_lo[below] / n)
        g_w = np.bincount(columns, weights=g_x[rows], minlength=width) + penalty * w / n
        g_gap = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([g_w, [g_gap[0]], g_gap[1:] * np.exp(p[width + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:width], np.concatenate([p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))])


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, list[int]] = {}
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            for w in set(LETTERS.findall((text or "").lower())):
                counts.setdefault(w, [0, 0])[int(toxic)] += 1
        if len(counts) > 200_000:
            yield _counted(counts)
            counts = {}
    yield _counted(counts)


def _counted(counts: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame([(w, a, b) for w, (a, b) in counts.items()], columns=["word", "others", "toxics"])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, vocabulary: int = VOCABULARY, grades: int = GRADES) -> Model:
    label = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    label = label.where("toxic in (0, 1)").join(text.select("id"), "id", "left_semi")
    label = label.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(max_train)
    train = text.join(F.broadcast(label), "id")  # at most max_train rows of two numbers
    train = train.groupBy("id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    train = materialize(train, "train")
    totals = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Model(thresholds=np.full(grades, np.inf))
    counts = train.mapInPandas(_count_words, "word string, others long, toxics long").groupBy("word").agg(F.sum("others").alias("others"), F.sum("toxics").alias("toxics"))
    n1, n0 = float(totals[1]), float(totals[0])
    share = (F.col("toxics") + F.col("others")) / F.lit(n1 + n0)
    gap = F.col("toxics") / F.lit(n1) - F.col("others") / F.lit(n0)
    z = F.abs(gap) / F.sqrt(share * (1 - share) * F.lit(1 / n1 + 1 / n0))  # of two equal shares
    odds = F.log((F.col("toxics") + 0.5) / F.lit(n1 + 1)) - F.log((F.col("others") + 0.5) / F.lit(n0 + 1))
    best = counts.where((F.col("toxics") + F.col("others") >= LEAST_DOCUMENTS) & (share < 1)).select("word", odds.alias("odds"), z.alias("z"))
    best = best.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(vocabulary).collect()
    if not best:
        return Model(thresholds=np.full(grades, np.inf))
    words = tuple(r.word for r in best)
    telling = np.array([r.odds > 2.0 for r in best])
    position = {w: i for i, w in enumerate(words)}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [sorted(i for i in map(position.get, set(LETTERS.findall((t or "").lower()))) if i is not None) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "toxic": pdf["toxic"], "found": found})

    rows = sorted(train.mapInPandas(features, "id long, toxic int, found array<int>").collect())
    toxic = np.array([r.toxic for r in rows])
    many = np.array([telling[r.found].sum() if r.found else 0 for r in rows])
    cuts = np.quantile(many[toxic == 1], np.arange(1, grades) / grades)
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, many, side="left"), 0)
    row = np.repeat(np.arange(len(rows)), [len(r.found) for r in rows])
    column = np.array([i for r in rows for i in r.found], dtype=np.int64)
    weights, thresholds = fit_ordinal(row, column, grade, len(words), grades)
    return Model(words, weights, thresholds)


def severity(model: Model, text: Column) -> Column:
    """Expected severity of each text, from 0 to the number of grades."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        position = {w: i for i, w in enumerate(model.words)}
        for texts in batches:
            yield pd.Series([model.severity(position, t) for t in texts], dtype="float64")

    return run(text.cast("string"))


def score(docs: DataFrame, labels: DataFrame, reject_from: float = REJECT_FROM, **options) -> DataFrame:
    """doc_id, severity, grade (rounded severity) and rejected."""
    model = fit(docs, labels, **options)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), severity(model, F.col("text")).alias("severity"))
    return out.select("doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= reject_from).alias("rejected"))


def keep(docs: DataFrame, labels: DataFrame, reject_from: float = REJECT_FROM, **options) -> DataFrame:
    """docs without the rejected ones, in their own columns."""
    return docs.where(severity(fit(docs, labels, **options), F.col("text")) < reject_from)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The severity of every document of the table."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return score(read("documents").select("doc_id", "text"), read("labels"))
